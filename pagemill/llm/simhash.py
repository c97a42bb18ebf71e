"""SimHash near-duplicates: pigeonhole blocks propose pairs, Hamming distance verifies them.

Edge cases, same for every entry point: a null or empty text has no word and the fingerprint
zero, linked like any other; a text shorter than a shingle is one shingle; repeated rows have
one fingerprint and so one component; an empty table gives an empty result; a row with a null
id keeps its fingerprint and its component, but is never the component's smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.llm.graph import components
from pagemill.llm.store import bucketed, forget, give_back, saved, scratch, small_batches, text_bytes
from pagemill.llm.words import encoded

#: 64 bits in four parts; two differing bits leave two parts whole, so six pairs of parts suffice.
PART_BITS = 16
#: Blocks of up to so many fingerprints are compared pair by pair, larger ones by one-bit variants.
PAIRWISE = 24


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words (repeats included), of the whole sequence if it is shorter."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= size:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - size] + 1))
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The number whose bit is set where over half of ``hashes`` set it."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long.  A-Z is lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority(shingle_hashes(t, shingle)) for t in encoded(b.column(1), lower=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block_keys(fp: Column) -> Column:
    """The six blocks of a fingerprint: (which, key, rest), each of two parts in key and two in rest."""
    part = [F.shiftrightunsigned(fp, PART_BITS * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    out = []
    for which, (a, b) in enumerate(combinations(range(4), 2)):
        c, d = (i for i in range(4) if i not in (a, b))
        pack = lambda x, y: F.shiftleft(part[x], 16).bitwiseOR(part[y])
        out.append(F.struct(pack(a, b).bitwiseOR(F.lit(which << 32)).alias("key"), pack(c, d).alias("rest")))
    return F.array(*out)


def links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs at ``max_distance`` bits or fewer (2 at most).

    ``fps`` has distinct ``fp``.  In small blocks every pair is verified.  In large ones (many
    near copies in one block) each fingerprint is filed under its rest and the rest's one-bit
    variants: two share a file exactly if they differ in two bits or fewer, so linking each to
    the least of the file links all without emitting the pairs.  At one bit each fingerprint has
    32 variants at most that are another's, and these pairs are all.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("four parts and six blocks cover up to two differing bits")
    blocks = fps.select("fp", F.explode(_block_keys(F.col("fp"))).alias("b")).select("fp", "b.key", "b.rest")
    sizes = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = blocks.join(sizes, "key")
    small, large = shared.where(F.col("n") <= PAIRWISE), shared.where(F.col("n") > PAIRWISE)
    pairs = small.select("key", F.col("fp").alias("u")).join(small.select("key", F.col("fp").alias("v")), "key").where("u > v").select("u", "v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance)
    variants = F.array(*(F.lit(f).cast("long") for f in (0, *(1 << i for i in range(32)))))
    filed = large.select("key", "fp", F.explode(F.transform(variants, lambda f: F.col("rest").bitwiseXOR(f))).alias("file"))
    if max_distance < 2:  # those of a file can be two bits apart: only a variant that is there itself is a neighbour
        there = large.select("key", F.col("rest").alias("file"), F.col("fp").alias("v"))
        return pairs.unionByName(filed.join(there, ["key", "file"]).where("fp > v").select(F.col("fp").alias("u"), "v").where(F.lit(max_distance == 1))).distinct()
    least = filed.groupBy("key", "file").agg(F.min("fp").alias("v"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = filed.join(least, ["key", "file"]).where("fp <> v").select(F.col("fp").alias("u"), "v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance)
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``max_distance`` differing bits.
    """
    small_batches(docs.sparkSession)
    fps = saved(fingerprints(docs, shingle), "fingerprints")
    each = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(each.select("fp"), max_distance))
    named = each.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents looked at to tell which shingles are common, at most about so many; this steers the order of shingles only.
ORDERED_BY = 8192
#: A shingle is common if so many of these documents have it.
COMMON = 3
#: Texts of a file that one task compares with those of the file's other groups.
PART = 256
#: Files of more texts than ``CROWD`` have so many hubs a turn instead of one; this steers which pairs are compared first only.
HUBS, CROWD = 16, 64
#: Files of each text that are marked: a pair with a common mark is compared in that file only, not in all that it shares.
MARKS = 6
#: Least shingle hashes of a text that pairs are looked at by first: all of most texts, an even sample of the whole of a longer one.
SKETCH = 1024
#: A pair is left out by its sample if that is so far under the limit, eight standard deviations; else the whole sets decide.
MARGIN = 0.1
#: A bit set has so many bits, of the shingles of a text up to ``SPARSE`` times that; of longer texts, of a fourth, a sixteenth ... of them.
BITS, SPARSE = 512, 4
#: Text bytes of one bucket of described documents, and the most buckets that Spark takes.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 100_000


def _runs(words: W.Words, d: int, runs: np.ndarray, shingle: int) -> np.ndarray:
    """Distinct shingle hashes of text ``d``, in order; those of its whole words if it is shorter than a shingle."""
    a, z = int(words.first[d]), int(words.first[d + 1])
    if z - a >= shingle:
        return np.unique(runs[a : z - shingle + 1])
    return np.array([xxhash.xxh64_intdigest(words.hash[a:z].tobytes())] if z > a else [], dtype=np.uint64)


def _common(docs: DataFrame, shingle: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several documents of a bounded sample have, and how many have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = encoded(b.column(0), lower=True)
            for i, j in W.chunks(texts, 1 << 20):
                words = W.scan(texts[i:j])
                runs = words.grams(shingle)
                sets = [_runs(words, d, runs, shingle) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["gram"])

    step = max(1, -(-count // ORDERED_BY))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(step)) == 0).select(F.lower(F.col("text").cast("string")).alias("text")).distinct()
    found = some.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toArrow()
    grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of distinct shingles, rare ones first, of which any set as similar has one among its own first."""
    known, n = common
    if len(known) and len(grams):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        grams = grams[np.lexsort((grams, np.where(known[at] == grams, n[at], 0)))]
    return grams[: int(len(grams) * (1 - similarity) + 1e-6) + 1]


def _bit_set(grams: np.ndarray) -> tuple[int, np.ndarray]:
    """Level and bits of a set of hashes: at level k one in 4**k of them counts; a bit says whether an odd number of these falls on it.

    Two sets differ in at least as many members as their bits differ, so unlike sets show without a look at their members.
    """
    level = 0
    while len(grams) > BITS * SPARSE**level:
        level += 1
    at = grams if not level else grams[(grams >> np.uint64(20)) & np.uint64(SPARSE**level - 1) == 0]
    odd = np.bincount((at & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return level, np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _described(docs: DataFrame, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, same, fp, size, level, bits, keys, grams, more): a hash of the words, the SimHash, the number of shingles, a bit set, the prefix, the least of the set of shingle hashes and the rest."""
    schema = "doc_id long, same binary, fp long, size int, level int, bits array<long>, keys array<long>, grams binary, more binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = encoded(b.column(1), lower=True)
            for i, j in W.chunks(texts, 1 << 20):
                words = W.scan(texts[i:j])
                runs, same, fps, size, levels, bits, keys, sets, more = words.grams(shingle), [], [], [], [], [], [], [], []
                for d in range(j - i):
                    same.append(xxhash.xxh3_128_digest(words.hash[int(words.first[d]) : int(words.first[d + 1])].tobytes()))
                    grams = _runs(words, d, runs, shingle)
                    fps.append(majority(grams))
                    size.append(len(grams))
                    level, odd = _bit_set(grams)
                    levels.append(level)
                    bits.append(odd)
                    keys.append(_prefix(grams, common, similarity).view(np.int64))
                    found = np.unique((grams >> np.uint64(32)).astype(np.uint32))
                    sets.append(found[:SKETCH].tobytes())
                    more.append(found[SKETCH:].tobytes())
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * (BITS // 64), np.concatenate(bits)), pa.ListArray.from_arrays(ends, np.concatenate(keys))]
                fp = np.array(fps, dtype=np.uint64).view(np.int64)
                cols = [b.column(0).slice(i, j - i), pa.array(same, pa.binary()), pa.array(fp), pa.array(size, pa.int32()), pa.array(levels, pa.int32()), *lists, pa.array(sets, pa.binary()), pa.array(more, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").mapInArrow(run, schema)


def _fits(similarity: float, one: str, two: str, *places: Column) -> Column:
    """Whether sets of these sizes can be as similar, if the shingle at these places is the first that they share."""
    need = (F.col(f"{one}size") + F.col(f"{two}size")) * (similarity / (1 + similarity)) - 1e-6
    a, b = places or (F.col(f"{one}pos"), F.col(f"{two}pos"))
    return (a <= F.col(f"{one}size") - need) & (b <= F.col(f"{two}size") - need)


def _alike(similarity: float, one: str, two: str) -> Column:
    """Whether sets with these sizes, places and bits can be as similar."""
    # of bits that stand for all shingles no more can differ than shingles may; of those for a part so many that chance has no more, eight standard deviations
    level, differ = F.col(f"{one}level"), F.lit(0)
    for i in range(BITS // 64):
        differ = differ + F.bit_count(F.col(f"{one}bits")[i].bitwiseXOR(F.col(f"{two}bits")[i]))
    may = (F.col(f"{one}size") + F.col(f"{two}size")) * ((1 - similarity) / (1 + similarity)) / F.pow(F.lit(float(SPARSE)), level)
    return _fits(similarity, one, two) & ((level != F.col(f"{two}level")) | (differ <= may + F.when(level > 0, 8 * F.sqrt(may) + 8).otherwise(0) + 1e-6))


def _mark(k: int) -> Column:
    return F.xxhash64("key", F.lit(k))


def _marks(shared: DataFrame) -> DataFrame:
    """(node, marks): the least of each text's files in several orders, with the text's place in it; early places first, where more pairs fit."""
    late = (F.col("pos") * 9 > F.col("size")).alias("late")
    return shared.groupBy("node").agg(F.array(*(F.min(F.struct(late, _mark(k).alias("file"), "pos")) for k in range(MARKS))).alias("marks"))


def _here(similarity: float, one: str, two: str) -> Column:
    """Whether the texts are compared in this file: their places fit, and also in the file of the first common mark that fits, if there is one, and that is this."""
    out = _fits(similarity, one, two)
    for k in reversed(range(MARKS)):
        a, b = F.col(f"{one}marks")[k], F.col(f"{two}marks")[k]
        out = F.when((a["file"] == b["file"]) & _fits(similarity, one, two, a["pos"], b["pos"]), a["file"] == _mark(k)).otherwise(out)
    return out


def _simhash_pairs(own: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints differ in two bits or fewer; of nodes with one fingerprint each with the least."""
    least = saved(own.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    equal = own.select("node", "fp").join(least, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    end = lambda fp, n: least.select(F.col("fp").alias(fp), F.col("least").alias(n))
    near = links(least.select("fp")).toDF("fp_u", "fp_v").join(end("fp_u", "a"), "fp_u").join(end("fp_v", "b"), "fp_v")
    return equal.unionByName(near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _files(own: DataFrame) -> DataFrame:
    """(key, node, pos, size): the texts filed under each shingle; shingles with the same texts are one file, where each text's first place counts."""
    rows = own.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    whose = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    files = rows.groupBy("key").agg(F.count("*").alias("n"), *whose).where("n > 1").select("key", F.xxhash64("n", "x1", "x2").alias("file"))
    return rows.join(files, "key").groupBy(F.col("file").alias("key"), "node").agg(F.min("pos").alias("pos"), F.first("size").alias("size"))


def _mixed(shared: DataFrame, label: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of ``shared`` in files that still hold several groups, with level and bits, label, the file's largest group (big) and its size (n)."""
    named = shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    files = groups.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("big"), F.count("*").alias("groups"), F.sum("m").alias("n"))
    return named.join(files.where("groups > 1").drop("groups"), "key").join(bits, "node")


def _with_hubs(rows: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs of each text outside its file's largest group with one text of that group, several in a crowd.

    Other texts in each turn and in each fourth of the files, so that one odd text parts no group.
    """
    order = F.xxhash64("node", F.lit(turn), F.pmod("key", F.lit(4))).alias("order")
    seat = F.when(F.col("n") > CROWD, F.pmod(F.xxhash64("node", F.lit(turn), F.lit(5)), F.lit(HUBS))).otherwise(0)
    hubs = rows.where("label = big").groupBy("key", seat.alias("seat")).agg(F.min(F.struct(order, "node", "pos", "size", "level", "bits")).alias("hub"))
    met = rows.where("label <> big").join(hubs, "key").where(_alike(similarity, "", "hub."))
    return met.select(F.greatest("node", "hub.node").alias("u"), F.least("node", "hub.node").alias("v")).distinct()


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs of texts in one file and different groups, each from one of the files that it shares; the rows of a file are dealt into parts of about ``PART``."""
    rows = rows if "marks" in rows.columns else rows.join(_marks(rows), "node")
    parts = F.ceil(F.col("n") / PART).cast("int")
    side = lambda n: ["key", F.col("node").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("label", "pos", "size", "level", "bits", "marks"))]
    one = rows.where("label <> big").select(*side("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    two = rows.select(*side("b"), "big", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    return one.join(two, ["key", "part"]).where("a_label <> b_label and (b_label = big or a > b)").where(_alike(similarity, "a_", "b_") & _here(similarity, "a_", "b_"))


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs that ``_compared`` leaves, each once: the larger node and the smaller."""
    return _compared(rows, similarity).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Of two sets of least hashes; over the range that both cover."""
    for cut in (one, two):
        if len(cut) == SKETCH:
            one, two = one[: np.searchsorted(one, cut[-1], "right")], two[: np.searchsorted(two, cut[-1], "right")]
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / max(1, len(one) + len(two) - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have the Jaccard similarity or more; ``sets`` has doc_id, grams and more."""

    def joined(pairs: DataFrame, sets: DataFrame, whole: Column) -> DataFrame:
        side = lambda n, name: sets.select(F.col("doc_id").alias(n), whole.alias(name))
        return pairs.join(side("u", "one"), "u").join(side("v", "two"), "v").select("u", "v", "one", "two")

    def run(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sure = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), dtype=np.uint32), np.frombuffer(y.as_buffer(), dtype=np.uint32)
                sure.append(whole or max(len(one), len(two)) < SKETCH)
                found = len(np.intersect1d(one, two, assume_unique=True)) if sure[-1] else 0
                keep.append(found / max(1, len(one) + len(two) - found) >= similarity if sure[-1] else _jaccard(one, two) >= similarity - MARGIN)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure, pa.bool_())], names=["u", "v", "sure"])
            yield out.filter(pa.array(keep, pa.bool_()))

    schema = "u long, v long, sure boolean"
    first = saved(joined(pairs, sets, F.col("grams")).mapInArrow(lambda batches: run(batches, False), schema), "likely")
    # a set much smaller than a cut one is not as similar
    long = sets.where(F.octet_length("grams") >= int(4 * SKETCH * similarity))
    second = joined(first.where("not sure").select("u", "v"), long, F.concat("grams", "more")).mapInArrow(lambda batches: run(batches, True), schema)
    return first.where("sure").unionByName(second).select("u", "v")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, rounds: int = 4) -> DataFrame:
    """(doc_id, group_id) for each document that has near copies; group_id is its group's least doc_id.

    Two texts are near copies if the Jaccard similarity of their sets of ``shingle``-word
    shingles (A-Z lower-cased) is ``similarity`` or more.  Texts with equal words are joined
    first, then those whose SimHashes of the same shingles share a block and differ in two bits or
    fewer, verified as all pairs are.  SimHash leaves out pairs near the limit; for an exact answer
    all texts are filed under the first of their shingles, a fifth of them, in one order
    for all texts, those rare in a sample first: two sets that are as similar always have one in
    common there, at any number of texts and for any kind of edit.  Pairs from a file are verified
    on their whole shingle sets; of texts over ``SKETCH`` shingles, a sample leaves out those that
    are ``MARGIN`` or more under the limit.
    Pairs whose bit sets (``_bit_set``) differ too much are passed over.  The texts outside a file's
    largest group are compared with one of that group, in a few turns; the last round compares all pairs of a file, whatever its size,
    that aren't in one group yet, each in one of the files that it shares (``_marks``).

    Null ids are in no group; rows that share a doc_id are one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    count = docs.count()
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // BUCKET_BYTES)))
    with scratch(spark):
        # rows that share a doc_id are one, that of the least of their words' hashes
        rows = _described(docs, shingle, similarity, _common(docs, shingle, count)).repartition(buckets, "doc_id")
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("same", "fp", "size", "level", "bits", "keys", "grams", "more")).alias("row")).select("doc_id", "row.*")
        described = bucketed(rows, "doc_id", buckets, "described")
        forget(spark)
        classes = described.groupBy("same").agg(F.min("doc_id").alias("node"))
        members = saved(described.select("doc_id", "same").join(classes, "same").select("doc_id", "node"), "members")
        own = described.join(members.where("doc_id = node").select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
        bits = own.select("node", "level", "bits")
        links = saved(_verified(_simhash_pairs(own), described, similarity), "links")
        label = components(links)
        shared = saved(_files(own), "files")
        forget(spark)
        for turn in range(rounds):
            last = turn == rounds - 1
            rows = _mixed(shared, label, bits.join(_marks(shared), "node") if last else bits)
            found = _verified(_across(rows, similarity) if last else _with_hubs(rows, turn, similarity), described, similarity)
            links = saved(links.unionByName(found), "links")
            label = components(links)
        return saved(members.join(label, "node", "left").select("doc_id", F.coalesce("label", "node").alias("group_id")), "groups", keep=True)


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one of the least doc_id; all columns kept."""
    gone = similar_groups(docs, shingle, similarity).where("doc_id <> group_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
