"""From pages to texts and items: stages before the model, the model's answer, stages after it."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.categories import DESCRIBED
from pagemill.functions.text import clean_response
from pagemill.operators import parsers as P
from pagemill.operators.models import MODES, ResponseProvider, dispatched, responses

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Endpoint:
    """Where a model answers; the key is never shown and never becomes a column."""

    base_url: str | None = None
    model_name: str | None = None
    timeout: float = 500.0
    max_retries: int = 1
    api_key: str | None = field(default=None, repr=False)

    def over(self, other: Endpoint) -> Endpoint:
        """Own values where there are any, else the other's."""
        pick = lambda n: getattr(self, n) if getattr(self, n) is not None else getattr(other, n)
        return Endpoint(*(pick(n) for n in ("base_url", "model_name", "timeout", "max_retries", "api_key")))


def first_endpoint(*urls: Column) -> Column:
    """What ``Endpoint.over`` gives for a column of urls: the first that there is."""
    return F.coalesce(*urls)


@dataclass(frozen=True)
class Family:
    """A provider that serves any model name: its address, where its key stands, whether pictures are described on the way."""

    base_url: str | None = None
    key_variable: str | None = None
    url_variable: str | None = None
    describes_inline: bool = False


#: Providers with their public addresses and the variables of their keys.
FAMILIES = {
    "hf": Family(),
    "google": Family("https://generativelanguage.googleapis.com/v1beta/openai/", "GOOGLE_API_KEY", "GOOGLE_API_BASE_URL", True),
    "openai": Family(None, "OPENAI_API_KEY", describes_inline=True),
    "azure": Family(None, "AZURE_OPENAI_API_KEY", "AZURE_OPENAI_ENDPOINT"),
    "anthropic": Family("https://api.anthropic.com/v1/", "ANTHROPIC_API_KEY", describes_inline=True),
}


def family_endpoint(provider: str, model: str, url: str | None = None, api_key: str | None = None, environment: Mapping[str, str] = os.environ) -> Endpoint:
    """Endpoint of any model of a provider: the url and key given, or else its own; a key that is nowhere is empty."""
    if provider not in FAMILIES:
        raise ValueError(f"no provider {provider}; there are {', '.join(FAMILIES)}")
    family = FAMILIES[provider]
    found = environment.get(family.url_variable or "", family.base_url)
    if api_key is None and family.key_variable:
        api_key = environment.get(family.key_variable, "")
    return Endpoint(found if url is None else url, model, api_key=api_key)


@dataclass(frozen=True)
class Conversion:
    """Settings of a run; ``before`` and ``after`` are applied in order."""

    mode: str = "ocr"
    dpi: int = 175
    max_image_size: int | None = 4000
    before: tuple[Stage, ...] = ()
    after: tuple[Stage, ...] = ()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"no mode {self.mode}")
        if not 30 <= self.dpi <= 600:
            raise ValueError("dpi lies between 30 and 600")
        if self.max_image_size is not None and self.max_image_size < 50:
            raise ValueError("max_image_size is 50 or more")


def convert(pages: DataFrame, provider: ResponseProvider, conversion: Conversion) -> DataFrame:
    """page_id, raw_response, text, items, error for pages with page_id, width and height.

    A page whose call fails keeps its error and has neither text nor items.
    """
    for stage in conversion.before:
        pages = stage(pages)
    answered = responses(pages, provider, conversion.mode)
    rows = pages.select("page_id", "width", "height").join(answered, "page_id")
    raw, w, h = F.col("response"), F.col("width"), F.col("height")
    kind = dispatched(F.lit(conversion.mode))
    items = F.when(kind == "layout_json", P.layout_json(raw, w, h)).when(kind == "region_tags", P.region_tags(raw))
    # in reading order; equal edges keep the order of the response
    ordered = F.transform(F.array_sort(F.transform("items", lambda x, k: F.struct(x["t"].alias("t"), x["l"].alias("l"), k.alias("k"), x["text"].alias("text")))), lambda x: x["text"])
    text = F.when(kind == "layout_json", F.array_join(F.filter(ordered, lambda x: x != ""), "\n\n")).when(kind == "region_tags", P.region_tags_text(raw)).otherwise(H.in_batches(H.to_markdown)(clean_response(raw)))
    out = rows.withColumn("items", items).select("page_id", raw.alias("raw_response"), F.when(raw.isNotNull(), text).alias("text"), "items", "error")
    for stage in conversion.after:
        out = stage(out)
    return out


def described(items: DataFrame, provider: ResponseProvider, categories: tuple[str, ...] = DESCRIBED) -> DataFrame:
    """Items whose category is to be described get the provider's text; one that fails keeps its own.

    ``items`` has page_id, item_pos, category and text.
    """
    key = F.struct("page_id", "item_pos")
    chosen = items.where(F.col("category").isin(*categories)).select(F.xxhash64(key).alias("page_id"), F.col("page_id").alias("item_page"), "item_pos", "category", "text")
    told = responses(chosen, provider, "image_description").select(F.col("page_id").alias("_key"), F.col("response").alias("_text"))
    return items.withColumn("_key", F.xxhash64(key)).join(told, "_key", "left").withColumn("text", F.coalesce("_text", "text")).drop("_key", "_text")
