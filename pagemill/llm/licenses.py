"""License scan: base phrases, and templates found by voting on offset diagonals.

Every rolling word k-gram hash of every document is joined to the templates' k-gram positions.
A match votes for the diagonal document position minus template position; votes are summed by
document, template and diagonal, each diagonal is a span, neighbouring diagonals without the whole
template (an inserted or lost word) are also merged into one, and a span is verified by the share
of the template's k-grams that it really has and by how densely it has them.  The templates are a constant of this module, a few KB.

Edge cases: null and empty texts have no words, no labels ('') and the score 0; repeated rows
get equal results; rows with a null id are scanned like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.llm.store import small_batches

K = 3
#: Diagonals this close belong to one span.
MERGE = 4
#: Least share of a template's k-grams, and least share of a span's positions that match.
COVERAGE, DENSITY = 0.6, 0.5
#: Score of a base phrase alone.
PHRASE_SCORE = 0.5

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label and wording of common notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gpl-2", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved"),
)

_TABLE = W.separators(bytes(c for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)))


def _scan(texts: list[bytes]) -> W.Words:
    return W.scan(texts, _TABLE)


def base(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_words, n_base, first_word, last_word and base (labels) of every row."""
    wanted = [(_scan([p.encode()]).hash, label) for p, label in PHRASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.encoded(b.column(2), lower=True)
            n_words, n_base = (np.zeros(len(texts), dtype=np.int64) for _ in range(2))
            first, last, labels = [None] * len(texts), [None] * len(texts), [[] for _ in texts]
            for i, j in W.chunks(texts):
                words = _scan(texts[i:j])
                n_words[i:j] = np.diff(words.first)
                for phrase, label in wanted:
                    k = len(phrase)
                    at = words.whole(k)
                    for m in range(k):
                        at = at & (words.hash[m : m + len(at)] == phrase[m])
                    for p in np.flatnonzero(at).tolist():
                        d = int(words.doc[p])
                        place = p - int(words.first[d])
                        d += i
                        n_base[d] += 1
                        first[d] = place if first[d] is None else min(first[d], place)
                        last[d] = place if last[d] is None else max(last[d], place)
                        labels[d].append(label)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([sorted(set(x)) for x in labels], pa.list_(pa.string()))],
                names=["uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def grams(docs: DataFrame, k: int = K) -> DataFrame:
    """(uid, place, hash): every run of k words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, texts = b.column(0).to_numpy(), W.encoded(b.column(1), lower=True)
            for i, j in W.chunks(texts, 1 << 20):
                words = _scan(texts[i:j])
                at = np.flatnonzero(words.whole(k))
                doc = words.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(uids[i:j][doc]), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(words.grams(k)[at].view(np.int64))], names=["uid", "place", "hash"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, place int, hash long")


def spans(docs: DataFrame, templates: tuple = TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans, of one diagonal or several: uid, template, label, first, last (words, last excluded), coverage."""
    rows, sizes = [], []
    for t, (label, text) in enumerate(templates):
        found = _scan([text.encode()]).grams(k)
        rows += [(int(h), t, p) for p, h in enumerate(found.view(np.int64))]
        sizes.append((t, label, len(found)))
    spark = docs.sparkSession
    places = F.broadcast(spark.createDataFrame(rows, "hash long, template int, at int"))
    named = F.broadcast(spark.createDataFrame(sizes, "template int, label string, size int"))
    votes = grams(docs, k).join(places, "hash").groupBy("uid", "template", (F.col("place") - F.col("at")).alias("diagonal"), "place", "at").agg(F.lit(1).alias("vote"))
    lines = votes.groupBy("uid", "template", "diagonal").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("votes"), F.collect_set("at").alias("ats"))
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    broken = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > MERGE).cast("int"), F.lit(0))
    # a diagonal that has the whole template is a copy by itself; merged with those of other copies it would only look sparse
    partial = lines.join(named.select("template", "size"), "template").where("votes < size").drop("size")
    merged = partial.withColumn("_new", broken).withColumn("span", F.sum("_new").over(order)).groupBy("uid", "template", "span")
    merged = merged.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"))
    alone = lines.select("uid", "template", "first", "last", "votes", F.size("ats").alias("covered"))
    out = merged.select(alone.columns).unionByName(alone).distinct().join(named, "template").withColumn("coverage", F.col("covered") / F.col("size"))
    return out.where((F.col("coverage") >= COVERAGE) & (F.col("votes") >= DENSITY * (F.col("last") - F.col("first") + 1))).select("uid", "template", "label", "first", (F.col("last") + k).alias("last"), "coverage")


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``templates`` are (label, wording), from a sentence to a whole license; they are sent to all tasks.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spans(docs, templates).groupBy("uid").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))
    rows = base(docs).join(found, "uid", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    phrase = F.when(F.col("n_base") > 0, PHRASE_SCORE).otherwise(0.0)
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.greatest(F.coalesce("coverage", F.lit(0.0)), phrase).alias("score"))
