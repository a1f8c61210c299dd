"""Which rows to label next: a budget for each zone of the prediction, spread over clusters within the zone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.vector import as_column, doubles, is_finite
from docsieve.operators.ranking import first_rows

#: Zones in the order in which they are filled, with their share of the budget in fifths.
ZONES = (("high", 2), ("mid", 2), ("low", 1))
HIGH, LOW = 0.7, 0.3
#: Rows of a zone that its centres are fitted on, about.
FIT_ROWS = 8_192


def zone_of(prediction: Column | str) -> Column:
    """0 above 0.7, 1 from 0.3 to 0.7, 2 below 0.3; null for null and NaN."""
    p = as_column(prediction)
    return F.when(p.isNull() | F.isnan(p), None).when(p > HIGH, 0).when(p >= LOW, 1).otherwise(2)


def budgets(n: int) -> list[int]:
    """The rows of each zone: its share of ``n`` rounded down, at least one."""
    return [max(1, n * fifths // 5) for _, fifths in ZONES]


def budget_of(zone: Column, n: Column) -> Column:
    fifths = F.element_at(F.array(*[F.lit(f) for _, f in ZONES]), zone + 1)
    return F.greatest(F.lit(1), F.floor(n * fifths / 5).cast("int"))


def draw(id_col: Column | str, seed: int | str = "") -> Column:
    """A seeded random order that every engine can repeat: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(str(seed)), as_column(id_col).cast("string")))


def zone_picks(rows: DataFrame, by: list[str], n: Column | int, prediction_col: str = "prediction", id_col: str = "id", seed: int | str = "") -> DataFrame:
    """Rows drawn at random within each zone's budget, trimmed to ``n`` in the order of zones; a zone's unused budget is not passed on.

    Adds ``zone`` and ``pick``, the place in the selection. Budgets of 0 or less select nothing.
    """
    n = F.lit(n) if isinstance(n, int) else n
    zoned = rows.withColumn("zone", zone_of(prediction_col)).where(F.col("zone").isNotNull()).withColumn("__n", n.cast("int")).where("__n > 0").withColumn("__draw", draw(id_col, seed))
    drawn = first_rows(zoned, [*by, "zone"], [F.col("__draw"), as_column(id_col)], budget_of(F.col("zone"), F.col("__n"))).withColumnRenamed("rank", "__rank")
    window = Window.partitionBy(*by).orderBy("zone", "__rank") if by else Window.orderBy("zone", "__rank")  # as many rows as there is budget
    return drawn.withColumn("pick", F.row_number().over(window)).where("pick <= __n").drop("__rank", "__n", "__draw")


def nearest_seed(vector: Column | str, seeds: list[tuple[int, list[float]]]) -> Column:
    """The number of the seed with the smallest squared distance; ties go to the smaller number."""
    v = doubles(vector)
    gaps = []
    for number, values in seeds:
        seed = F.array(*[F.lit(float(x)) for x in values])
        gap = F.aggregate(F.zip_with(v, seed, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        gaps.append(F.struct(F.round(gap, 9).alias("gap"), F.lit(number).alias("seed")))
    return F.array_min(F.array(*gaps))["seed"]


def representatives(rows: DataFrame, by: list[str], id_col: str = "id", seed: int | str = "") -> DataFrame:
    """One row of each group, drawn at random."""
    window = Window.partitionBy(*by).orderBy(draw(id_col, seed), as_column(id_col))
    return rows.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def fit_centres(x: np.ndarray, k: int, seed: int, starts: int = 3, rounds: int = 25) -> np.ndarray:
    """k-means with seeds far apart: of ``starts`` runs the centres with the least sum of squared distances."""
    best, least = x[:k], np.inf
    size = (x * x).sum(1)
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        centres = [x[rng.integers(len(x))]]
        gap = np.full(len(x), np.inf)
        for _ in range(1, k):
            gap = np.minimum(gap, np.maximum(size - 2 * x @ centres[-1] + centres[-1] @ centres[-1], 0))
            total = gap.sum()
            centres.append(x[rng.choice(len(x), p=gap / total) if total > 0 else rng.integers(len(x))])
        made = np.array(centres)
        for _ in range(rounds):
            home = nearest_centre(x, made)
            count = np.bincount(home, minlength=k)
            sums = (np.arange(k)[:, None] == home[None]).astype(float) @ x
            new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], made)
            if np.allclose(new, made, atol=1e-9):
                break
            made = new
        cost = np.maximum(size - 2 * (x * made[home]).sum(1) + (made[home] ** 2).sum(1), 0).sum()
        if cost < least:
            best, least = made, cost
    return best


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(axis=1)


def stratified_diverse(rows: DataFrame, n: int, prediction_col: str = "prediction", vector_col: str = "embedding", id_col: str = "id", seed: int = 42, fit_rows: int = FIT_ROWS, starts: int = 3) -> DataFrame:
    """At most ``n`` rows, with ``zone``, ``cluster`` and ``pick``: in each zone, one row drawn from each of as many clusters as the zone has budget.

    The centres of a zone's clusters are fitted on one batch of about ``fit_rows`` rows (all, where there are fewer), drawn by the MD5 of seed
    and id, from ``starts`` starts; every row of the zone is then given to its nearest centre, and each cluster draws among all of its rows. The
    result depends on the rows only, not on how they are partitioned. Rows without a prediction, and with a vector that is null, of
    another length than the longest, or not finite, take no part. An empty cluster gives no row.
    """
    zoned = rows.withColumn("zone", zone_of(prediction_col)).where(F.col("zone").isNotNull() & F.col(vector_col).isNotNull())
    nothing = zoned.withColumn("cluster", F.lit(0)).withColumn("pick", F.lit(0)).limit(0)
    if n <= 0:
        return nothing
    sizes = {r["zone"]: (r["count"], r["d"]) for r in zoned.groupBy("zone").agg(F.count(F.lit(1)).alias("count"), F.max(F.size(vector_col)).alias("d")).collect()}
    dimension = max((d for _, d in sizes.values()), default=0)
    zoned = zoned.where(is_finite(vector_col, dimension))
    vector = doubles(vector_col).alias("v")
    share = F.lit("g")  # above every digit
    for zone, (size, _) in sizes.items():
        if size > fit_rows:
            share = F.when(F.col("zone") == zone, f"{int(fit_rows / size * 2**32):08x}").otherwise(share)
    fitted = zoned.where(draw(id_col, seed) < share).select(F.col(id_col).alias("id"), "zone", vector).toArrow()
    if not fitted.num_rows:
        return nothing
    x = fitted.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    zone, ids = fitted.column("zone").to_numpy(), np.array(fitted.column("id").to_pylist(), object)
    centres = {}
    for z, budget in enumerate(budgets(n)):
        own = np.nonzero(zone == z)[0]
        if len(own):
            own = own[np.argsort(ids[own], kind="stable")]
            centres[z] = fit_centres(x[own], min(budget, len(own)), seed, starts)
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = dict(rows.dtypes)[id_col]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                zone, cluster = batch.column("zone").to_numpy(), np.zeros(batch.num_rows, np.int32)
                for z, made in shared.value.items():
                    cluster[zone == z] = nearest_centre(v[zone == z], made)
                yield pa.RecordBatch.from_arrays([batch.column("zone"), pa.array(cluster), batch.column("draw"), batch.column("id")], names=["zone", "cluster", "draw", "id"])

    assigned = zoned.select("zone", vector, draw(id_col, seed).alias("draw"), F.col(id_col).alias("id")).mapInArrow(assign, f"zone int, cluster int, draw string, id {kind}")
    chosen = assigned.groupBy("zone", "cluster").agg(F.min(F.struct("draw", "id")).alias("first")).select("cluster", F.col("first.id").alias(id_col), F.col("zone").alias("__zone"))
    # at most n + 3 rows, so that one task may order them and all may have them
    picked = chosen.withColumn("pick", F.row_number().over(Window.orderBy("__zone", "cluster"))).where(F.col("pick") <= n).drop("__zone")
    return zoned.join(F.broadcast(picked), id_col).select(*zoned.columns, "cluster", "pick")
