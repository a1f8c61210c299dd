"""Problem 2: a subset of given size that covers the variety of each group.

Rows are features: the unit vector beside the zone of the value. A pivoted QR decomposition picks
rows that are far from the span of those picked before, so that the many members of a group of like
rows add nothing after the first. Blocks nominate independent rows, and pairs of blocks pivot their
nominees again until one block of each group is left. What it picked is taken out, and a new round
picks among the rest, until the group has its k rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.density import usable_rows
from docsieve.llm.vectors import BROADCAST_ROWS, distinct_rows, unit
from docsieve.plans.durable import durable

#: Rows of a block about.
BLOCK_ROWS = 4_096
#: A round picks as many rows as there are features, or this part of all wanted, if that is more.
ROUND_SHARE = 8
#: Squared distance up to which a row repeats another.
TOLERANCE = 1e-5


def pivoted(features: np.ndarray, k: int, tolerance: float = TOLERANCE) -> list[int]:
    """``k`` rows in the order of a QR decomposition with pivoting; ties go to the first row.

    Where the rows picked span all the others, a new round starts over the rows left, without those that repeat one picked
    before as long as there are others.
    """
    picked: list[int] = []
    left, repeated = np.arange(len(features)), np.zeros(0, np.int64)
    while len(picked) < k and len(left) + len(repeated):
        if not len(left):
            left, repeated = np.sort(repeated), left
        rest = features[left].astype(np.float64)
        norms = np.einsum("ij,ij->i", rest, rest)
        round_: list[int] = []
        while len(picked) + len(round_) < k:
            i = int(np.round(norms, 9).argmax())
            if norms[i] <= tolerance:
                break
            round_.append(i)
            direction = rest[i] / np.sqrt(norms[i])
            rest -= np.outer(rest @ direction, direction)
            norms = np.einsum("ij,ij->i", rest, rest)
            norms[round_] = 0
        if not round_:
            round_ = list(range(min(k - len(picked), len(left))))
        picked += left[round_].tolist()
        chosen, left = features[left[round_]].astype(np.float64), np.delete(left, round_)
        if len(picked) < k and len(left):
            rest = features[left].astype(np.float64)
            gap = np.einsum("ij,ij->i", rest, rest)[:, None] + np.einsum("ij,ij->i", chosen, chosen)[None] - 2 * rest @ chosen.T
            copy = (gap <= tolerance).any(axis=1)
            left, repeated = left[~copy], np.concatenate([repeated, left[copy]])
    return picked


def features_of(vectors: np.ndarray, values: np.ndarray, zones: int, weight: float) -> np.ndarray:
    """Unit vectors with the zone of each value as further coordinates."""
    zone = np.minimum((values * zones).astype(int), zones - 1)
    return np.hstack([unit(vectors), weight * np.eye(zones)[zone]])


def varied_subset(
    df: DataFrame,
    wanted: DataFrame | None = None,
    group_col: str = "session_id",
    id_col: str = "frame_id",
    vector_col: str = "embedding",
    value_col: str = "prediction",
    order_col: str | None = "scored_at",
    wanted_col: str = "n_eval_per_iteration",
    default: int = 20,
    zones: int = 5,
    weight: float = 0.7,
    dimension: int = 128,
    block_rows: int = BLOCK_ROWS,
    round_rows: int | None = None,
) -> DataFrame:
    """``(grp, id, pick)``: from every group as many rows as ``wanted`` says, in the order picked.

    ``wanted`` has the size for each ``group_col`` in ``wanted_col`` (repeated groups: the largest; null, missing or no
    ``wanted``: ``default``; 0 or less: no rows). Groups with fewer usable rows give all of them. Null values, NaN, values outside
    [0, 1], unusable vectors, null groups and null ids take no part; repeated ids count once, by the
    latest ``order_col``; of rows equally far from the span the smaller id is picked. Other columns are ignored.
    An empty table gives an empty result. A group of any size is spread over blocks of about
    ``block_rows`` rows; no task receives more than two blocks' nominees. A round picks ``round_rows`` rows of a group (without it, as many as
    there are features, or an eighth of all, if that is more). Rows that repeat one picked in an earlier round wait until a block has no others.
    """
    rows = usable_rows(df, group_col, id_col, vector_col, value_col, order_col, dimension)
    kinds = dict(rows.dtypes)
    sizes = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    if wanted is not None:
        ks = wanted.where(F.col(group_col).isNotNull()).groupBy(F.col(group_col).alias("grp")).agg(F.max(wanted_col).cast("int").alias("k"))
        sizes = sizes.join(ks, "grp", "left")
    else:
        sizes = sizes.withColumn("k", F.lit(default))
    sizes = sizes.select("grp", "blocks", F.coalesce("k", F.lit(default)).alias("k")).where("k > 0")
    most = sizes.agg(F.max("blocks").alias("blocks"), F.count(F.lit(1)).alias("groups"), F.max("k").alias("k")).first()
    sizes = F.broadcast(sizes) if most["groups"] <= BROADCAST_ROWS else sizes
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    whole = rows.join(sizes, "grp").select("grp", block.alias("block"), "blocks", "k", "rid", "value", "v")
    at_once = round_rows or max(dimension + zones, -(-(most["k"] or 1) // ROUND_SHARE))

    def nominees(table: pa.Table, earlier: pa.Table | None, done: int) -> pa.Table:
        ids, _, vectors = distinct_rows(table, dimension)
        rid = table.column("rid").to_numpy(zero_copy_only=False)
        place = np.unique(rid, return_index=True)[1]  # where each of the ids is
        features = features_of(vectors, table.column("value").to_numpy()[place], zones, weight)
        fresh = ~table.column("again").to_numpy(zero_copy_only=False).astype(bool)[place] if "again" in table.column_names else np.ones(len(ids), bool)
        if earlier is not None and earlier.num_rows:
            before = features_of(distinct_rows(earlier, dimension)[2], earlier.column("value").to_numpy()[np.unique(earlier.column("rid").to_numpy(zero_copy_only=False), return_index=True)[1]], zones, weight)
            gap = (features * features).sum(1)[:, None] + (before * before).sum(1)[None] - 2 * features @ before.T
            fresh &= (gap > TOLERANCE).all(axis=1)
            _, size, basis = np.linalg.svd(before, full_matrices=False)
            basis = basis[size > TOLERANCE**0.5]
            rest = features - (features @ basis.T) @ basis  # what the rows picked do not span, unless they span everything
            if (np.einsum("ij,ij->i", rest[fresh], rest[fresh]) > TOLERANCE).any():
                features = rest
        k = min(table.column("k")[0].as_py() - done, at_once)
        own = np.nonzero(fresh)[0]
        picked = own[pivoted(features[own], k)] if len(own) else np.arange(min(max(k, 0), len(ids)))
        chosen = table.select(["grp", "block", "k", "rid", "value", "v"]).take(pa.array(place[picked]))
        return chosen.append_column("again", pa.array(~fresh[picked])).append_column("pick", pa.array(np.arange(done + 1, done + len(picked) + 1), pa.int32()))

    def alone(done: int):
        return lambda table: nominees(table, None, done)

    def beside(done: int):
        return lambda table, earlier: nominees(table, earlier, done) if table.num_rows else none_of(table)

    schema = f"grp {kinds['grp']}, block int, k int, rid {kinds['rid']}, value double, v binary, again boolean, pick int"
    taken: DataFrame | None = None
    for done in range(0, max(1, most["k"] or 1), at_once):
        level, blocks, height = whole, most["blocks"] or 1, 0
        if taken is not None:
            level = whole.where(F.col("k") > done).join(taken.select("rid"), "rid", "left_anti").select(*whole.columns)
        while True:
            if taken is None:
                level = level.groupBy("grp", "block").applyInArrow(alone(done), schema)
            else:
                ahead = taken.join(sizes.select("grp", "blocks"), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("blocks") - 1, height))).alias("block"), "rid", "value", "v")
                level = level.groupBy("grp", "block").cogroup(ahead.groupBy("grp", "block")).applyInArrow(beside(done), schema)
            if blocks == 1:
                break
            blocks, height = -(-blocks // 2), height + 1
            level = level.select("grp", F.shiftright("block", 1).alias("block"), "k", "rid", "value", "v", "again")
        if done + at_once >= (most["k"] or 1):
            last = level.select("grp", "rid", "pick")
            return (last if taken is None else taken.select("grp", "rid", "pick").unionByName(last)).withColumnRenamed("rid", "id")
        new = level.select("grp", "rid", "value", "v", "pick")
        taken = durable(new if taken is None else taken.unionByName(new))


def none_of(table: pa.Table) -> pa.Table:
    """No nominees, for a block that has no row left."""
    kinds = {"block": pa.int32(), "k": pa.int32(), "value": pa.float64(), "v": pa.binary(), "again": pa.bool_(), "pick": pa.int32()}
    kinds = {c: kinds.get(c) or table.schema.field(c).type for c in ("grp", "block", "k", "rid", "value", "v", "again", "pick")}
    return pa.table({c: pa.nulls(0, k) for c, k in kinds.items()})
