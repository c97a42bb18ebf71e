"""Models, prompts and options as small tables, and the provider that answers for a model.

``ResponseProvider`` is where an endpoint would be called; ``MockProvider`` answers from the
page alone, so runs repeat.  Calls happen in Arrow batches on the executors, after all filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Conversion modes.
MODES = ("ocr", "ocr_layout", "ocr_layout_images", "table", "image_description", "formula", "chart")


def short_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def all_names(models: DataFrame) -> DataFrame:
    """name, model_name: every model under its own name, its short name and its aliases (an array)."""
    names = F.array_distinct(F.concat(F.array("model_name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array(short_name(F.col("model_name")))))
    return models.select(F.explode(names).alias("name"), "model_name")


def registered(calls: DataFrame, default: str = "registry") -> DataFrame:
    """name, provider, model_name, position of a log of registrations with these columns.

    The last call for a name and a provider says the model, the first one its place among the
    name's providers; a null provider is the default one.  To register is to append a row.
    """
    provider = F.coalesce("provider", F.lit(default)).alias("provider")
    return calls.groupBy("name", provider).agg(F.max_by("model_name", "position").alias("model_name"), F.min("position").alias("position"))


def resolved(requests: DataFrame, registered: DataFrame, default: str = "registry") -> DataFrame:
    """Requests (request_id, name, provider) with the provider that serves them; unknown names give null.

    The provider asked for, if it serves the name, or else the default one, or else the first.
    """
    offers = registered.select("name", F.col("provider").alias("offer"), F.col("position"))
    rank = F.when(F.col("offer") == F.col("provider"), 0).when(F.col("offer") == default, 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("request_id").orderBy(rank, "position"))
    return requests.join(offers, "name", "left").withColumn("_n", first).where("_n = 1").select("request_id", "name", "provider", F.col("offer").alias("resolved"))


def prompt_key(mode: Column, prompts: Column, mapped: Column) -> Column:
    """The mode if it has a prompt, or else the mode it is mapped to if that has one."""
    other = F.try_element_at(mapped, mode)
    return F.when(F.map_contains_key(prompts, mode), mode).when(other.isNotNull() & F.map_contains_key(prompts, F.coalesce(other, F.lit(""))), other)


def dispatched(mode: Column) -> Column:
    """Which parser a general model's answer goes to."""
    return F.when(mode == "ocr_layout", "layout_json").when(mode == "ocr_layout_images", "region_tags").otherwise("text")


def merged_options(*maps: Column) -> Column:
    """Maps joined; for a key in several the last one's value stays."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda _, a, b: F.coalesce(b, a))
    return out


class ResponseProvider(Protocol):
    def predict(self, pages: list[dict], mode: str) -> list[str]:
        """One raw response for each page of a batch."""


class MockProvider:
    """Answers that depend on the page and the mode only."""

    def predict(self, pages: list[dict], mode: str) -> list[str]:
        return [f"```markdown\n# Page {p['page_id']}\n\nread as {mode}\n```" for p in pages]


def responses(pages: DataFrame, provider: ResponseProvider, mode: str) -> DataFrame:
    """page_id, response, error: one call for each batch; a batch that fails is tried page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out, errors = b.to_pylist(), [], []
            try:
                out, errors = provider.predict(rows, mode), [None] * len(rows)
            except Exception:  # noqa: BLE001  one bad page must not fail the others
                for r in rows:
                    try:
                        out.append(provider.predict([r], mode)[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=["page_id", "response", "error"])

    return pages.mapInArrow(run, "page_id long, response string, error string")
