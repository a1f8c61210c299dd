"""Problem 1: records that share most of their words.

Records with the same words collapse into one class first. Classes get BagMinHash signatures of their counted words, meet
in bands of registers, drop out again by a 128-bit sketch, and are verified by the exact overlap of their sets or multisets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.bagminhash import GRID, BagMinHash, band_keys, bit_sketch
from docsieve.llm.text import WORD, WordHashes, mixed
from docsieve.plans.durable import durable

#: Bits of the sketch that each band row carries.
SKETCH_BITS = 128
#: Weights of words that occur once, twice or three times, and more often, where sets are compared: repetitions speak, but cannot outvote the words.
DAMPED = (1.0, 1.5, 2.0)
#: Word hashes that a worker remembers.
MOST_WORDS = 1_000_000
#: Rows of a band, or copies of a class, from which on its pairs (50 million) are spread over SALTS tasks.
HOT_ROWS, SALTS = 10_000, 32
#: Share of the classes, and their number at least and at most, in which hot bands are looked for, and how often such a band must be seen there.
HOT_SAMPLE, LEAST_SAMPLED, MOST_SAMPLED, SEEN = 0.05, 4_000, 1_000_000, 16
#: Hot bands up to which they are broadcast.
BROADCAST_KEYS = 100_000


def word_classes(df: DataFrame, id_col: str, text_cols: list[str], order_col: str | None, min_words: int, multiset: bool) -> DataFrame:
    """``(rid, seen, h, n, m, w, c)``: each row's class ``h`` of equal words (with ``multiset``, equal counted words), its number of distinct words ``n`` and of all words ``m``.

    ``w`` are hashes of the distinct words and ``c`` their counts, given once for each class of a batch and
    null in its other rows. Rows with fewer than ``min_words`` distinct words keep their place with
    ``h`` null: if the newest version of an id is too short, older ones must not stand in for it.
    """
    order = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")
    source = df.select(F.col(id_col).cast("string").alias("rid"), order.alias("seen"), F.concat_ws(" ", *[F.col(c) for c in text_cols]).alias("t")).where("rid is not null")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if len(hashes) > MOST_WORDS:
                hashes.clear()
            flat, counts, sizes = [], [], []
            for text in batch.column("t").to_pylist():
                bag = Counter(WORD.findall(text.lower()))
                enough = len(bag) >= min_words and len(bag) > 0
                sizes.append(len(bag) if enough else 0)
                if enough:
                    flat.extend(map(hashes.__getitem__, bag))
                    counts.extend(bag.values())
            words, count, size = np.array(flat, np.uint64), np.array(counts, np.int32), np.array(sizes, np.int64)
            kept = np.nonzero(size)[0]
            ends = np.cumsum(size)
            h, m = np.zeros(len(size), np.uint64), np.zeros(len(size), np.int64)
            if len(kept):  # a sum of scrambled hashes does not depend on the order of the words
                at = (ends - size)[kept]
                h[kept] = mixed(np.add.reduceat(mixed(words + (count if multiset else np.ones_like(count)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at))
                m[kept] = np.add.reduceat(count.astype(np.int64), at)
            first = np.zeros(len(size), bool)
            first[kept[np.unique(h[kept], return_index=True)[1]]] = True
            carried = np.repeat(first, size)
            offsets = np.r_[0, np.cumsum(np.where(first, size, 0))].astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[carried]), mask=pa.array(~first))  # noqa: E731, B023
            columns = [batch.column("rid"), batch.column("seen"), pa.array(h.view(np.int64), mask=size == 0), pa.array(size.astype(np.int32), mask=size == 0), pa.array(m.astype(np.int32), mask=size == 0), lists(words.astype(np.uint32).view(np.int32)), lists(count)]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "seen", "h", "n", "m", "w", "c"])

    return source.mapInArrow(classes, "rid string, seen timestamp, h long, n int, m int, w array<int>, c array<int>")


def newest_classes(classes: DataFrame) -> DataFrame:
    """``(id, h)``: the class of the newest version of each id; ids whose newest version has none are left out."""
    each = classes.groupBy("rid").agg(F.count(F.lit(1)).alias("rows"), F.count("h").alias("known"), F.min("h").alias("low"), F.max("h").alias("high"))
    agree = (F.col("known") == F.col("rows")) & (F.col("low") == F.col("high"))
    plain = each.where(agree).select(F.col("rid").alias("id"), F.col("low").alias("h"))
    odd = each.where(~agree & (F.col("known") > 0)).select("rid")
    number = odd.limit(BROADCAST_KEYS + 1).count()
    if not number:
        return plain
    odd = F.broadcast(odd) if number <= BROADCAST_KEYS else odd
    newest = classes.select("rid", "seen", "h").join(odd, "rid", "left_semi").groupBy("rid").agg(F.max(F.struct("seen", "h")).alias("v"))
    return plain.unionByName(newest.where("v.h is not null").select(F.col("rid").alias("id"), F.col("v.h").alias("h")))


def class_bands(classes: DataFrame, hashing: BagMinHash, bands: int, rows: int, size_col: str) -> DataFrame:
    """``(k, h, n, s0, s1)``: a row for each band of each class; ``n`` is its size."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.Table.from_batches([batch]).combine_chunks()
            if not batch.num_rows:
                continue
            lists = batch.column("w").chunk(0)
            starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
            words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            count = batch.column("c").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            weights = count if hashing.grid == GRID else np.minimum(1 + np.log2(count) / 2, 2)
            signatures = hashing.signatures(words, weights, starts - starts[0])
            keys, sketch = band_keys(signatures, bands, rows), bit_sketch(signatures, SKETCH_BITS)
            offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h").chunk(0), batch.column("n").chunk(0), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                names=["h", "n", "s0", "s1", "keys"],
            )

    made = classes.where("w is not null").select("h", F.col(size_col).alias("n"), "w", "c").mapInArrow(keyed, "h long, n int, s0 long, s1 long, keys array<long>")
    return made.select(F.explode("keys").alias("k"), "h", "n", "s0", "s1")


def hot_bands(classes: DataFrame, hashing: BagMinHash, bands: int, rows: int) -> DataFrame | None:
    """``(k)``: the bands in which very many classes meet, as a sample of the classes shows them; none if there are none.

    What is found decides where pairs are made, not which: a hot band that the sample does not show is made by one task.
    """
    known = classes.where("w is not null")
    number = known.count()
    share = min(1.0, max(LEAST_SAMPLED, min(MOST_SAMPLED, number * HOT_SAMPLE)) / max(1, number))
    part = known.where(F.pmod(F.xxhash64(F.lit("sample"), "h"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)) if share < 1 else known
    if number <= HOT_ROWS:
        return None
    seen = max(SEEN, int(HOT_ROWS * share))
    hot = durable(class_bands(part, hashing, bands, rows, "n").groupBy("k").agg(F.countDistinct("h").alias("seen")).where(F.col("seen") >= seen).select("k"))
    found = hot.count()
    return None if not found else F.broadcast(hot) if found <= BROADCAST_KEYS else hot


def spread_pairs(rows: DataFrame, key: str, alike: Column, columns: list[str]) -> DataFrame:
    """``rows`` joined with themselves on ``key``, one side cut into ``SALTS`` parts: ``columns`` with suffix a and b where ``alike`` holds."""
    salt = F.pmod(F.xxhash64(F.lit("salt"), columns[0]), F.lit(SALTS)).cast("int")
    a = rows.select(key, salt.alias("salt"), *[F.col(c).alias(c + "a") for c in columns])
    b = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *[F.col(c).alias(c + "b") for c in columns])
    return a.join(b, [key, "salt"]).where(alike).drop("salt")


def near_duplicates(
    df: DataFrame,
    id_col: str = "id",
    text_cols: tuple[str, ...] = ("name", "text"),
    order_col: str | None = None,
    threshold: float = 0.7,
    min_words: int = 8,
    multiset: bool = False,
    bands: int = 36,
    rows: int = 6,
    seed: int = 20_011,
    sketch: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Groups of records whose words overlap by at least ``threshold``.

    Returns ``(members, links)``: ``members(id, h)`` gives each record's class of equal words (with ``multiset``, counted),
    ``links(h_a, h_b, similarity)`` the pairs of different classes (``h_a < h_b``) that reach the
    threshold. Similarity is the size of the common words over that of all words of both, as sets or,
    with ``multiset``, counting repetitions; words are compared by 32-bit hashes, so that a pair is
    counted one word too high about twice in a million.

    Candidates come from weighted signatures: words weigh by their counts, rounded down to ``GRID``, or where sets are compared by counts ``DAMPED`` to
    at most twice a single word. A pair of weighted similarity s is missed with a probability of about (1 - s**rows)**bands,
    and by the sketch, unless it is turned off, with 0.002 at s = ``threshold``. Equal sets are one class, whatever their counts.

    Null texts count as empty; records with fewer than ``min_words`` distinct words take no part;
    null ids are dropped; of repeated ids the row with the latest ``order_col`` counts (ties and no
    ``order_col``: the largest class number). Other columns are ignored, whatever their names. An empty
    table gives two empty results.
    """
    classes = durable(word_classes(df, id_col, list(text_cols), order_col, min_words, multiset))
    members = durable(newest_classes(classes))

    hashing = BagMinHash(max(bands * rows, SKETCH_BITS), GRID if multiset else DAMPED, seed)
    size = "m" if multiset else "n"
    made = class_bands(classes, hashing, bands, rows, size)
    same = (1 + threshold) / 2
    most = int(SKETCH_BITS * (1 - same) + 3.0 * sqrt(SKETCH_BITS * same * (1 - same))) if sketch else SKETCH_BITS
    differ = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    alike = (F.col("ha") < F.col("hb")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (differ <= most)
    once = lambda part: part.repartition("k").groupBy("k", "h").agg(F.first("n").alias("n"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    hot = hot_bands(classes, hashing, bands, rows)
    banded = once(made if hot is None else made.join(hot, "k", "left_anti"))
    a, b = (banded.select("k", *[F.col(c).alias(c + side) for c in ("h", "n", "s0", "s1")]) for side in "ab")
    found = a.join(b, "k").where(alike).select("ha", "hb")
    if hot is not None:
        found = found.unionByName(spread_pairs(durable(once(made.join(hot, "k", "left_semi"))), "k", alike, ["h", "n", "s0", "s1"]).select("ha", "hb"))
    candidates = found.repartition("ha").distinct()

    items = F.flatten(F.zip_with("w", "c", lambda w, c: F.transform(F.sequence(F.lit(1), c), lambda o: F.hash(w, o)))) if multiset else F.col("w")
    bags = classes.where("w is not null").select("h", F.col(size).alias("n"), items.alias("w")).repartition("h").dropDuplicates(["h"])
    left, right = (bags.select(*[F.col(c).alias(c + side) for c in bags.columns]) for side in "ab")
    both = candidates.join(left, "ha").join(right, "hb")
    shared = F.size(F.array_intersect("wa", "wb"))
    similarity = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    links = both.select("ha", "hb", "na", "nb", shared.alias("shared")).select(F.col("ha").alias("h_a"), F.col("hb").alias("h_b"), similarity.alias("similarity"))
    return members, links.where(F.col("similarity") >= threshold - 1e-9)


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: every pair of records that one class or one link joins. The pairs of a hot class are made by many tasks."""
    x, y = (members.select(F.col("id").alias("i" + s), F.col("h").alias("h_" + s)) for s in "ab")
    linked = links.select("h_a", "h_b").join(x, "h_a").join(y, "h_b").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copied = members.join(sizes, "h")
    few = copied.where(F.col("copies") <= HOT_ROWS)
    x, y = few.select(F.col("id").alias("id_a"), "h"), few.select(F.col("id").alias("id_b"), "h")
    pairs = linked.unionByName(x.join(y, "h").where("id_a < id_b").select("id_a", "id_b"))
    if sizes.where(F.col("copies") > HOT_ROWS).isEmpty():
        return pairs
    many = spread_pairs(copied.where(F.col("copies") > HOT_ROWS).select("h", "id"), "h", F.col("ida") < F.col("idb"), ["id"])
    return pairs.unionByName(many.select(F.col("ida").alias("id_a"), F.col("idb").alias("id_b")))
