"""Problem 5: records equal but for spacing, case, punctuation and the order of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import distinct_words, squeezed
from docsieve.plans.durable import durable

#: A key is hot from this share of all rows on, so that at most 1 / HOT_SHARE keys are hot and may be broadcast; with fewer rows than HOT_ROWS none is.
HOT_SHARE = 1 / 2_000
HOT_ROWS = 1_000
#: Conflicting ids up to which they are broadcast.
BROADCAST_IDS = 100_000


def content_key(text_cols: tuple[str, ...]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the canonical fields in sorted order: equal for records that differ in writing or in field order only."""
    fields = F.array_sort(F.array(*[squeezed(c) for c in text_cols]))
    whole = F.concat_ws("\x1f", F.transform(fields, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)))
    return F.xxhash64(F.lit(1), whole), F.xxhash64(F.lit(2), whole)


def latest_keys(df: DataFrame, id_col: str, text_cols: tuple[str, ...], order_col: str | None, min_words: int) -> DataFrame:
    """``(id, k, l)``: the content key of the newest version of each id, null if that version has too few words."""
    first, second = content_key(text_cols)
    enough = F.size(distinct_words(*text_cols)) >= min_words
    order = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")

    def keyed(rows: DataFrame) -> DataFrame:
        made = rows.select(F.col(id_col).cast("string").alias("id"), order.alias("seen"), F.when(enough, F.struct(first.alias("k"), second.alias("l"))).alias("key"))
        return made.select("id", "seen", "key.k", "key.l")

    known = df.where(F.col(id_col).isNotNull())
    ends = [f(c).alias(f"{n}_{c}") for c in "kl" for n, f in (("low", F.min), ("high", F.max))]
    each = durable(keyed(known).groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count("k").alias("long"), *ends))
    agree = (F.col("long") == 0) | ((F.col("long") == F.col("rows")) & (F.col("low_k") == F.col("high_k")) & (F.col("low_l") == F.col("high_l")))
    plain = each.where(agree).select("id", F.col("low_k").alias("k"), F.col("low_l").alias("l"))
    odd = each.where(~agree).select("id")
    number = odd.limit(BROADCAST_IDS + 1).count()
    if not number:
        return plain
    odd = F.broadcast(odd) if number <= BROADCAST_IDS else odd  # only versions that contradict each other are read again
    again = known.join(odd.withColumnRenamed("id", "odd_id_"), F.col(id_col).cast("string") == F.col("odd_id_"), "left_semi")
    return plain.unionByName(keyed(again).groupBy("id").agg(F.max(F.struct("seen", "k", "l")).alias("v")).select("id", "v.k", "v.l"))


def collapse_copies(
    df: DataFrame,
    id_col: str = "id",
    text_cols: tuple[str, ...] = ("name", "text"),
    order_col: str | None = None,
    min_words: int = 8,
    salts: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """One record for each content, with the number of its copies.

    Returns ``(kept, members)``: ``kept(keep_id, copies)`` has a row for each content, represented
    by its smallest id, and ``members(id, keep_id)`` has every record whose content occurs more than once.

    Keys are counted exactly, with partial counts on the map side. The few hot ones (at most
    ``1 / HOT_SHARE``, hence safe to broadcast) are salted by id and aggregated in two levels; all others meet in one shuffle, in which every
    record finds its representative. Keys are 128-bit hashes of the contents. Null texts count as empty; records with fewer than ``min_words`` distinct words and
    null ids take no part; of repeated ids the latest ``order_col`` counts (ties and no ``order_col``:
    the largest key). Other columns are ignored. An empty table gives empty results.
    """
    rows = durable(latest_keys(df, id_col, text_cols, order_col, min_words).where("k is not null"))
    counts = rows.groupBy("k", "l").agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    hot = counts.where(F.col("n") > least).select("k", "l").collect()
    hot = F.broadcast(df.sparkSession.createDataFrame(hot, "k long, l long"))

    content = Window.partitionBy("k", "l")
    cold = rows.join(hot, ["k", "l"], "left_anti").select("id", F.min("id").over(content).alias("keep_id"), F.count(F.lit(1)).over(content).alias("copies"))

    heated = rows.join(hot, ["k", "l"], "left_semi")
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    parts = heated.groupBy("k", "l", salt.alias("salt")).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    hot_kept = parts.groupBy("k", "l").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    kept = cold.where("id = keep_id").select("keep_id", "copies").unionByName(hot_kept.select("keep_id", "copies"))
    members = cold.where("copies > 1").select("id", "keep_id").unionByName(heated.join(F.broadcast(hot_kept.drop("copies")), ["k", "l"]).select("id", "keep_id"))
    return kept, members
