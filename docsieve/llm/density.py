"""Problem 4: clusters of mutually similar rows within each session.

Groups that fit one task are clustered there from the exact mutual-reachability graph. Larger ones
are spread over the inverted lists: each block keeps the spanning forest of its own edges, the
forests are joined by Borůvka rounds until a group's edges fit one task, and the hierarchy is
condensed there, or in bands of edges where the forest itself is larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.vector import dot, normalised, vector_mean
from docsieve.llm.hierarchy import Band, Hierarchy, cliques, dense_forest, density_hierarchy, edge_cosines, sparse_forest, split_cliques
from docsieve.llm.vectors import distinct_rows, grouped_equal, index_of, neighbours_of, newest_rows, routed, unit, unpacked, usable_vectors
from docsieve.plans.durable import durable, release

#: Rows up to which a group, and a component or a block of one that is checked pair by pair, is handled in one task.
GROUP_ROWS = 8_192
#: Edges up to which the forest of a group is finished in one task.
GROUP_EDGES = 2_000_000
#: Groups up to which their names are broadcast.
BROADCAST_GROUPS = 10_000


def usable_rows(df: DataFrame, group_col: str, id_col: str, vector_col: str, value_col: str, order_col: str | None, dimension: int) -> DataFrame:
    """``(grp, rid, value, v)``: the newest version of each row with a usable vector and a value in [0, 1], as a durable table; ``v`` is packed."""
    columns = list(dict.fromkeys([group_col, id_col, vector_col, value_col, *([order_col] if order_col else [])]))
    clean = newest_rows(df.where(F.col(id_col).isNotNull()).select(columns), id_col, order_col, [group_col, vector_col, value_col])
    value = F.col(value_col)
    fine = F.col(group_col).isNotNull() & value.isNotNull() & ~F.isnan(value) & value.between(0, 1)
    rows = clean.where(fine).select(F.col(group_col).alias("grp"), F.col(id_col).alias("rid"), value.cast("double").alias("value"), F.col(vector_col).alias("vector"))
    return durable(usable_vectors(rows, "vector", dimension))


def split_by_size(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``most`` rows, and those of larger groups, if there are any."""
    large = rows.groupBy("grp").count().where(F.col("count") > most).select("grp")
    number = large.limit(BROADCAST_GROUPS + 1).count()
    if not number:
        return rows, None
    large = F.broadcast(large) if number <= BROADCAST_GROUPS else large
    return rows.join(large, "grp", "left_anti"), rows.join(large, "grp", "left_semi")


def squared_core(vectors: np.ndarray, copies: np.ndarray, min_samples: int, furthest: float = np.inf) -> np.ndarray:
    """Squared distance to the ``min_samples``-th nearest row, the row itself included; copies count as rows.

    Where fewer rows lie within ``furthest``, it is the distance to the last of these, so that small groups of their own stay groups.
    """
    core = np.zeros(len(vectors))
    wanted = np.nonzero(copies < min_samples)[0]
    if not len(wanted):
        return core
    x = vectors.astype(np.float32)
    for begin in range(0, len(wanted), 256):
        part = wanted[begin : begin + 256]
        d = np.maximum(2 - 2 * (x[part] @ x.T), 0)
        near = np.argpartition(d, min(min_samples, d.shape[1]) - 1, axis=1)[:, : min(min_samples, d.shape[1])]
        near_d = np.take_along_axis(d, near, axis=1)
        order = np.argsort(near_d, axis=1, kind="stable")
        covered = np.cumsum(copies[np.take_along_axis(near, order, axis=1)], axis=1) >= min_samples
        at = np.where(covered.any(axis=1), covered.argmax(axis=1), covered.shape[1] - 1)
        core[part] = np.take_along_axis(near_d, order, axis=1)[np.arange(len(part)), at]
        core[part[~covered.any(axis=1)]] = np.inf
        beyond = np.nonzero(core[part] > furthest)[0]
        core[part[beyond]] = np.where(near_d[beyond] <= furthest, near_d[beyond], 0).max(axis=1, initial=0)
    return core


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def local_forest(vectors: np.ndarray, min_samples: int, furthest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the spanning forest over all rows of a group; exact copies hang on their first row."""
    where, first = grouped_equal(vectors)
    exact = unit(vectors[first])
    core = squared_core(exact, np.bincount(where, minlength=len(first)), min_samples, furthest + 1e-6)
    a, b, w = dense_forest(exact, core, furthest + 1e-6)
    copy = np.nonzero(first[where] != np.arange(len(where)))[0]
    near = np.maximum(core[where[copy]], 0)
    fine = near <= furthest
    return np.r_[first[a], first[where[copy]][fine]], np.r_[first[b], copy[fine]], np.r_[w, near[fine]]


def contracted(edges: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Borůvka rounds over ``(grp, a, b, w)`` until no group has more than ``most`` edges between components.

    Returns ``names(grp, v, c)``, the component of each vertex, the edges taken into the forest (both null without
    any round) and the edges left, as ``(grp, ca, cb, a, b, w)`` between components ``ca`` and ``cb``.
    Every round writes its state to the shared checkpoint folder.
    """
    left = edges.select("grp", F.col("a").alias("ca"), F.col("b").alias("cb"), "a", "b", "w")
    names: DataFrame | None = None
    taken: DataFrame | None = None
    while not left.groupBy("grp").count().where(F.col("count") > most).isEmpty():
        both = left.unionByName(left.select("grp", F.col("cb").alias("ca"), F.col("ca").alias("cb"), "a", "b", "w"))
        pick = F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "cb")
        chosen = durable(both.groupBy("grp", F.col("ca").alias("c")).agg(F.min(pick).alias("e")).select("grp", "c", F.col("e.cb").alias("to"), F.col("e.x").alias("a"), F.col("e.y").alias("b"), F.col("e.w").alias("w")))
        new = chosen.select("grp", "a", "b", "w").distinct()
        before, taken = taken, durable(new if taken is None else taken.unionByName(new))
        release(before)
        back = chosen.select("grp", F.col("c").alias("to"), F.col("to").alias("back"))
        own = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        up = durable(chosen.join(back, ["grp", "to"], "left").select("grp", "c", F.when(own, F.col("c")).otherwise(F.col("to")).alias("up")))
        while True:  # pointers are followed by doubling
            over = up.select("grp", F.col("c").alias("up"), F.col("up").alias("top"))
            jumped = durable(up.join(over, ["grp", "up"], "left").select("grp", "c", F.coalesce("top", "up").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            release(up)
            up = jumped.select("grp", "c", "up")
            up._durable_path = jumped._durable_path
            if jumped.where("moved").isEmpty():
                break
        before, names = names, durable(up.select("grp", F.col("c").alias("v"), F.col("up").alias("c")) if names is None else renamed(names, up, "c"))
        release(before)
        lightest = F.min(F.struct("w", "a", "b")).alias("e")
        apart = renamed(renamed(left, up, "ca"), up, "cb").where("ca <> cb")
        before, left = left, durable(apart.groupBy("grp", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(lightest).select("grp", "ca", "cb", "e.a", "e.b", "e.w"))
        release(before, chosen, up)
    return names, taken, left


def renamed(df: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by what ``up(grp, c, up)`` maps it to, where it maps it."""
    to = up.select("grp", F.col("c").alias(column), F.col("up").alias("to_"))
    return df.join(to, ["grp", column], "left").withColumn(column, F.coalesce("to_", column)).drop("to_").select(*df.columns)


def group_edges(large: DataFrame, dimension: int, min_samples: int, furthest: float, rows_per_list: int, probes: int, seed: int) -> DataFrame:
    """``(grp, a, b, w)``: forests of the blocks of the large groups ``(grp, rid, v)``, whose union holds their spanning forest but for edges beyond the lists probed.

    The lists probed are set so that ``TARGET`` of the neighbours within ``furthest`` of a sample of rows, found by holding these against all rows, lie in them.
    """
    kinds = dict(large.dtypes)
    reach = 1 - furthest / 2
    lists = index_of(large, dimension, max(10, min_samples), reach, rows_per_list, probes, seed)
    near = neighbours_of(large, lists, dimension, max(1, min_samples - 1), reach, ["grp", "list", "ib", "qb"])
    core = near.select("grp", F.col("id").alias("rid"), (2 - 2 * F.element_at("near", -1)["similarity"]).cast("float").alias("core"))
    # a row without a neighbour within reach has no edge either
    cored = large.join(core, ["grp", "rid"]).select("grp", "rid", "v", "core")

    def forest(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        ids, _, wide = distinct_rows(table, dimension + 1)
        core = wide[:, dimension].astype(float) if min_samples > 1 else np.zeros(len(ids))
        vectors = np.ascontiguousarray(wide[:, :dimension])
        where, first = grouped_equal(vectors)  # rows of other lists that probe this one meet all its rows, and each other
        a, b, w = dense_forest(unit(vectors[first]), core[first], furthest + 1e-6)
        copy = np.nonzero(first[where] != np.arange(len(where)))[0]
        a, b, w = np.r_[first[a], first[where[copy]]], np.r_[first[b], copy], np.r_[w, np.maximum(core[first[where[copy]]], core[copy])]
        fine = (w <= furthest + 1e-6) & (a != b)
        a, b, w = a[fine], b[fine], w[fine]
        keep = sparse_forest(len(ids), a, b, w)
        keep = keep[edge_cosines(unit(vectors), a[keep], b[keep]) >= np.round(reach, 6)]
        return pa.table({"grp": pa.array([grp] * len(keep), table.schema.field("grp").type), "a": pa.array(ids[a[keep]], table.schema.field("rid").type), "b": pa.array(ids[b[keep]], table.schema.field("rid").type), "w": np.minimum(w[keep], furthest)})

    schema = f"grp {kinds['grp']}, a {kinds['rid']}, b {kinds['rid']}, w double"
    return durable(routed(cored, lists, dimension).groupBy("grp", "list", "ib", "qb").applyInArrow(forest, schema))


def indexed(table: pa.Table, x: str, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of two columns, and each column as numbers of these."""
    a, b = (table.column(c).to_numpy(zero_copy_only=False) for c in (x, y))
    ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    index = index.ravel()
    return ids, index[: len(a)], index[len(a) :]


def repeated(table: pa.Table, column: str, n: int) -> pa.Array:
    """The one value that a grouping column has in its group, ``n`` times."""
    return pa.array([table.column(column)[0].as_py()] * n, table.schema.field(column).type)


def condensed(edges: DataFrame, least_size: int, furthest: float, most: int, apart: float = 0.0) -> DataFrame:
    """``(grp, cluster, id, persistence)``: the density hierarchy of the spanning forest of ``(grp, a, b, w)``.

    The forest of a group with more than ``most`` edges is condensed in bands of ``most`` edges, lightest first: each band hands the
    state of its components upward (size, mass, what the clusters inside are worth), and what was selected above them comes
    back down. The result is that of one task over the whole forest. Clusters that part within a squared distance of ``apart`` are not told apart.
    """
    kinds = dict(edges.dtypes)
    rid, grp = kinds["a"], kinds["grp"]
    names, taken, left = contracted(edges, most)
    root = 1 / max(furthest**0.5, 1e-6)

    def forest(table: pa.Table) -> pa.Table:
        ids, a, b = indexed(table, "ca", "cb")
        return table.take(sparse_forest(len(ids), a, b, table.column("w").to_numpy())).select(["grp", "a", "b", "w"])

    def hierarchy(table: pa.Table) -> pa.Table:
        ids, a, b = indexed(table, "ca", "cb")
        w = table.column("w").to_numpy()
        keep = sparse_forest(len(ids), a, b, w)
        found = density_hierarchy(len(ids), a[keep], b[keep], np.sqrt(np.maximum(w[keep], 0)), least_size, furthest**0.5, apart**0.5)
        return clusters_of(repeated(table, "grp", 1), table.schema.field("ca").type, ids, found)

    if names is None:
        return left.groupBy("grp").applyInArrow(hierarchy, f"grp {grp}, cluster {rid}, id {rid}, persistence double")

    edges = taken.unionByName(left.groupBy("grp").applyInArrow(forest, f"grp {grp}, a {rid}, b {rid}, w double"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("w", F.least("a", "b"), F.greatest("a", "b")))
    edges = durable(edges.withColumn("place", place).withColumn("band", F.floor((F.col("place") - 1) / F.lit(most)).cast("int")))
    last = edges.agg(F.max("band")).first()[0] or 0
    state_kind = "size long, mass double, below double, clustered boolean"

    def band_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table, Band]:
        table = table.take(pa.array(np.argsort(table.column("place").to_numpy())))
        ids, a, b = indexed(table, "ca", "cb")
        state = []
        for name in ("size", "mass", "below", "clustered"):
            at = {x: table.column(f"{name}_{x}").to_numpy(zero_copy_only=False) for x in ("ca", "cb")}
            out = np.zeros(len(ids), at["ca"].dtype)
            out[a], out[b] = at["ca"], at["cb"]
            state.append(out)
        return ids, a, table, Band(len(ids), a, b, np.sqrt(np.maximum(table.column("w").to_numpy(), 0)), least_size, apart**0.5, *state)

    def upward(table: pa.Table) -> pa.Table:
        ids, _, _, band = band_of(table)
        lead = band.leaders()
        size, mass, below, clustered = band.states(lead)
        return pa.table({"grp": repeated(table, "grp", len(ids)), "v": pa.array(ids, table.schema.field("ca").type), "c": pa.array(ids[lead], table.schema.field("ca").type), "size": size, "mass": mass, "below": below, "clustered": clustered})

    def downward(table: pa.Table) -> pa.Table:
        ids, a, table, band = band_of(table)
        kind = table.schema.field("ca").type
        lead = band.leaders()
        above, place_of = [None] * len(ids), [0.0] * len(ids)
        for x, label, persistence in zip(lead[a].tolist(), table.column("label").to_pylist(), table.column("persistence").to_pylist(), strict=True):
            above[x], place_of[x] = label, persistence
        label, persistence = band.selected(lead, above, place_of, ids.tolist())
        return pa.table({"grp": repeated(table, "grp", len(ids)), "c": pa.array(ids, kind), "label": pa.array(label, kind), "persistence": pa.array(persistence, pa.float64())})

    names = state = None
    bands: list[tuple[DataFrame, DataFrame]] = []
    for i in range(last + 1):
        own = edges.where(F.col("band") == i).select("grp", F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "place")
        if names is not None:
            up = names.select("grp", F.col("v").alias("c"), F.col("c").alias("up"))
            own = renamed(renamed(own, up, "ca"), up, "cb")
        for side in ("ca", "cb"):
            known = state.select("grp", F.col("c").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in ("size", "mass", "below", "clustered")]) if state is not None else None
            own = own.join(known, ["grp", side], "left") if known is not None else own.selectExpr("*", *[f"cast(null as {k.split()[1]}) as {k.split()[0]}_{side}" for k in state_kind.split(", ")])
            own = own.fillna({f"size_{side}": 1, f"mass_{side}": 0.0, f"below_{side}": -1.0, f"clustered_{side}": False})
        own = durable(own)
        old = (names, state)
        moved = durable(own.groupBy("grp").applyInArrow(upward, f"grp {grp}, v {rid}, c {rid}, {state_kind}"))
        bands.append((own, moved))
        step = moved.select("grp", F.col("v").alias("c"), F.col("c").alias("up"))
        fresh = moved.select("grp", "v", "c")
        names = durable(fresh if names is None else renamed(names, step, "c").unionByName(fresh.join(names.select("grp", "v"), ["grp", "v"], "left_anti")))
        ends = moved.where("v = c").drop("v")
        state = durable(ends if state is None else state.join(moved.select("grp", F.col("v").alias("c")), ["grp", "c"], "left_anti").unionByName(ends))
        release(*old)
    worth = F.col("clustered") & ((F.col("below") < 0) | (F.col("below") <= F.col("mass") - F.col("size") * F.lit(root)))
    fate = state.select("grp", "c", F.when(worth, F.col("c")).alias("label"), F.lit(0.0).alias("persistence"))
    for own, moved in reversed(bands):
        of_point = moved.select("grp", F.col("v").alias("ca"), F.col("c").alias("end")).join(fate.withColumnRenamed("c", "end"), ["grp", "end"], "left").drop("end")
        down = own.join(of_point, ["grp", "ca"], "left").groupBy("grp").applyInArrow(downward, f"grp {grp}, c {rid}, label {rid}, persistence double")
        fate = durable(fate.join(moved.select("grp", F.col("v").alias("c")), ["grp", "c"], "left_anti").unionByName(down))
    return fate.where("label is not null").select("grp", F.col("label").alias("cluster"), F.col("c").alias("id"), "persistence")


def clusters_of(grp: pa.Array, kind: pa.DataType, ids: np.ndarray, found: Hierarchy) -> pa.Table:
    """``(grp, cluster, id, persistence)`` of the points in clusters, which are named by their smallest id."""
    kept = np.nonzero(found.label >= 0)[0]
    kept = kept[np.lexsort((ids[kept], found.label[kept]))]
    starts = np.r_[True, np.diff(found.label[kept]) != 0] if len(kept) else np.zeros(0, bool)
    first = ids[kept][starts][np.cumsum(starts) - 1] if len(kept) else ids[:0]
    return pa.table({"grp": pa.array(grp.to_pylist() * len(kept), grp.type), "cluster": pa.array(first, kind), "id": pa.array(ids[kept], kind), "persistence": found.persistence[kept]})


def members_of(rows: DataFrame, dimension: int, least: float, min_samples: int, min_cluster_size: int, whole: float, group_rows: int, group_edges_most: int, rows_per_list: int, probes: int, seed: int) -> DataFrame:
    """``(grp, cluster, id, persistence)``: the clusters of the density hierarchy of every group of ``(grp, rid, v)``; ``cluster`` is a member.

    The hierarchy is that of the spanning forest of the mutual-reachability graph, with edges up to similarity ``least``. It is condensed to
    clusters of ``min_cluster_size`` rows, and those of largest stability are selected; clusters that part only above similarity ``whole`` are never told apart.
    Groups up to ``group_rows`` rows are clustered from all their distances in one task, larger ones by way of the lists.
    """
    kinds = dict(rows.dtypes)
    schema = f"grp {kinds['grp']}, cluster {kinds['rid']}, id {kinds['rid']}, persistence double"
    furthest, apart = 2 - 2 * least, max(0.0, 2 - 2 * whole)

    def local(table: pa.Table) -> pa.Table:
        ids, _, vectors = distinct_rows(table, dimension)
        a, b, w = local_forest(vectors, min_samples, furthest)
        fits = edge_cosines(unit(vectors), a, b) >= np.round(least, 6)
        distance = np.sqrt(np.clip(w[fits], 0, furthest))
        found = density_hierarchy(len(ids), a[fits], b[fits], distance, min_cluster_size, furthest**0.5, apart**0.5)
        return clusters_of(repeated(table, "grp", 1), table.schema.field("rid").type, ids, found)

    narrow = rows.select("grp", "rid", "v")
    small, large = split_by_size(narrow, group_rows)
    members = small.groupBy("grp").applyInArrow(local, schema)
    if large is None:
        return members
    edges = group_edges(durable(large), dimension, min_samples, furthest, rows_per_list, probes, seed)
    return members.unionByName(condensed(edges, min_cluster_size, furthest, group_edges_most, apart))


def similar_groups(df: DataFrame, group_col: str = "session_id", id_col: str = "frame_id", vector_col: str = "embedding", value_col: str = "prediction", order_col: str | None = "scored_at", least: float = 0.85, min_samples: int = 5, dimension: int = 128, group_rows: int = GROUP_ROWS, group_edges_most: int = GROUP_EDGES, rows_per_list: int = 1_500, probes: int = 3, seed: int = 7) -> DataFrame:
    """``(grp, first_id, id)``: clusters all of whose pairs reach similarity ``least``.

    ``first_id`` is the smallest id of the cluster and has a row of its own; rows without a partner are
    left out. The clusters are those of ``density_clusters`` with at least two rows and no edge below ``least``, where clusters that part above
    ``least`` only are one. Each is then checked: one with a pair below ``least`` is split (see ``cliques``), so that every cluster reported is one by definition.

    Unusable vectors, values that are null, NaN or outside [0, 1], null groups and null ids take no part.
    Repeated ids count once, by the latest ``order_col``. Exact copies are joined without being compared. Other
    columns are ignored. An empty table gives an empty result. In groups above ``group_rows`` rows,
    neighbours are looked for in lists of centroids.
    """
    rows = usable_rows(df, group_col, id_col, vector_col, value_col, order_col, dimension)
    kinds = dict(rows.dtypes)
    members = durable(members_of(rows, dimension, least, min_samples, 2, least, group_rows, group_edges_most, rows_per_list, probes, seed).select("grp", F.col("cluster").alias("comp"), F.col("id").alias("rid")))
    sizes = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("size"))
    large = durable(sizes.where(F.col("size") > group_rows))
    placed = members.join(rows.select("rid", "v"), "rid")  # a row has one group

    def check(table: pa.Table) -> pa.Table:
        ids, v = table.column("rid").to_numpy(zero_copy_only=False), unpacked(table.column("v"), dimension)
        ids, first = np.unique(ids, return_index=True)
        _, comp = np.unique(table.column("comp").to_numpy(zero_copy_only=False)[first], return_inverse=True)
        label = cliques(unit(v[first]), comp.ravel(), least)
        order = np.lexsort((ids, label))
        order = order[label[order] >= 0]
        starts = np.r_[True, np.diff(label[order]) != 0] if len(order) else np.zeros(0, bool)
        first = ids[order][starts][np.cumsum(starts) - 1] if len(order) else ids[:0]
        kind = table.schema.field("rid").type
        return pa.table({"grp": repeated(table, "grp", len(order)), "first_id": pa.array(first, kind), "id": pa.array(ids[order], kind)})

    schema = f"grp {kinds['grp']}, first_id {kinds['rid']}, id {kinds['rid']}"
    part = F.pmod(F.xxhash64("comp"), F.lit(16)).cast("int")  # several clusters a task, but never all of a hot group
    if large.isEmpty():
        return placed.groupBy("grp", part).applyInArrow(lambda t: check(t), schema)
    few = F.broadcast(large.select("grp", "comp"))  # fewer than one in group_rows rows
    sound = placed.join(few, ["grp", "comp"], "left_anti").groupBy("grp", part).applyInArrow(lambda t: check(t), schema)
    huge = placed.join(F.broadcast(large), ["grp", "comp"]).select("grp", "comp", "rid", "size", "v")
    return sound.unionByName(huge_cliques(durable(huge.dropDuplicates(["grp", "rid"])), least, dimension, group_rows))


def huge_cliques(rows: DataFrame, least: float, dimension: int, block_rows: int = GROUP_ROWS) -> DataFrame:
    """``(grp, first_id, id)``: what ``cliques`` makes of each component of ``(grp, comp, rid, size, v)``, ``v`` packed.

    A component within half the angle of its mean is found sound by an aggregate. The rows of the others are counted
    against each other block by block, which shows whether all pairs fit. Only a component with a pair that does not is split,
    in one task that holds its vectors but no matrix of its pairs.
    """
    kinds = dict(rows.dtypes)
    grp, rid = kinds["grp"], kinds["rid"]
    schema = f"grp {grp}, first_id {rid}, id {rid}"
    half = float(np.cos(np.arccos(least) / 2) + 1e-9)

    def units(batches):
        for batch in batches:
            if batch.num_rows:
                v = unit(unpacked(batch.column("v"), dimension))
                yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("comp"), pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dimension, dtype=np.int32)), pa.array(v.ravel()))], names=["grp", "comp", "u"])

    exact = rows.select("grp", "comp", "v").mapInArrow(units, f"grp {grp}, comp {rid}, u array<double>")
    means = exact.groupBy("grp", "comp").agg(normalised(vector_mean("u")).alias("mean"))
    # components have more than block_rows rows each, so that their means are few
    least_dot = exact.join(F.broadcast(means), ["grp", "comp"]).groupBy("grp", "comp").agg(F.min(F.coalesce(dot("u", "mean"), F.lit(-1.0))).alias("dot"))
    tight = durable(least_dot.select("grp", "comp", (F.col("dot") >= half).alias("tight")))
    marked = rows.join(F.broadcast(tight), ["grp", "comp"])
    whole = marked.where("tight").select("grp", "comp", "rid")
    open_ = marked.where("not tight")

    blocks = F.ceil(F.col("size") / F.lit(block_rows)).cast("int")
    own = open_.withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = own.select("grp", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "v")

    def count(table: pa.Table) -> pa.Table:
        v = unit(unpacked(table.column("v"), dimension))
        block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        first, second = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        partners = np.zeros(len(v), np.int64)
        for b in range(0, len(first), 512):
            part = first[b : b + 512]
            fits = np.round(v[part] @ v[second].T, 6) >= least
            partners[part] += fits.sum(axis=1)
            if i != j:
                partners[second] += fits.sum(axis=0)
        return pa.table({"grp": repeated(table, "grp", len(v)), "comp": repeated(table, "comp", len(v)), "rid": table.column("rid"), "partners": partners})

    counted = cells.groupBy("grp", "comp", "i", "j").applyInArrow(count, f"grp {grp}, comp {rid}, rid {rid}, partners long")
    degrees = durable(counted.groupBy("grp", "comp", "rid").agg(F.sum("partners").alias("degree")))
    fit = durable(degrees.groupBy("grp", "comp").agg((F.min("degree") == F.count(F.lit(1))).alias("fit")))
    whole = whole.unionByName(degrees.join(F.broadcast(fit.where("fit").drop("fit")), ["grp", "comp"]).select("grp", "comp", "rid"))

    def split(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("rid").to_numpy(zero_copy_only=False), kind="stable")))
        ids = table.column("rid").to_numpy(zero_copy_only=False)
        label = split_cliques(unit(unpacked(table.column("v"), dimension)), table.column("degree").to_numpy().copy(), least)
        order = np.lexsort((ids, label))
        order = order[label[order] >= 0]
        starts = np.r_[True, np.diff(label[order]) != 0] if len(order) else np.zeros(0, bool)
        first = ids[order][starts][np.cumsum(starts) - 1] if len(order) else ids[:0]
        kind = table.schema.field("rid").type
        return pa.table({"grp": repeated(table, "grp", len(order)), "first_id": pa.array(first, kind), "id": pa.array(ids[order], kind)})

    unfit = open_.join(F.broadcast(fit.where("not fit").drop("fit")), ["grp", "comp"]).join(degrees, ["grp", "comp", "rid"]).select("grp", "comp", "rid", "degree", "v")
    first = whole.groupBy("grp", "comp").agg(F.min("rid").alias("first_id"))
    return whole.join(first, ["grp", "comp"]).select("grp", "first_id", F.col("rid").alias("id")).unionByName(unfit.groupBy("grp", "comp").applyInArrow(split, schema))


def density_clusters(df: DataFrame, group_col: str = "session_id", id_col: str = "frame_id", vector_col: str = "embedding", value_col: str = "prediction", order_col: str | None = "scored_at", min_samples: int = 5, min_cluster_size: int = 3, least: float = 0.5, exemplars: int = 3, dimension: int = 128, group_rows: int = GROUP_ROWS, group_edges_most: int = GROUP_EDGES, rows_per_list: int = 1_500, probes: int = 3, seed: int = 7) -> DataFrame:
    """``(grp, cluster, size, mean_value, exemplars)``: density clusters of every group.

    ``cluster`` is the smallest id of the cluster, ``exemplars`` its most persistent members: those that stay in it up
    to the highest density (ties: the smaller id). Distances are Euclidean between unit vectors, smoothed by the distance to
    the ``min_samples``-th row (the row itself counts; where fewer are within reach, to the last of these); rows further apart than similarity ``least`` never meet.
    Clusters are chosen by excess of mass among those of at least ``min_cluster_size`` rows. Rows outside
    of all clusters are left out. What takes part is as in ``similar_groups``.
    """
    rows = usable_rows(df, group_col, id_col, vector_col, value_col, order_col, dimension)
    members = durable(members_of(rows, dimension, least, min_samples, min_cluster_size, 1.0, group_rows, group_edges_most, rows_per_list, probes, seed))
    values = rows.groupBy(F.col("rid").alias("id")).agg(F.max("value").alias("value"))
    valued = members.join(values, "id")
    whole = valued.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("value").alias("mean_value"), F.min("id").alias("first"))
    # the best of a cluster by way of the best of its parts, so that no task gets a whole hot cluster
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    rank = F.row_number().over(Window.partitionBy("grp", "cluster", part).orderBy(F.desc("persistence"), "id"))
    best = members.withColumn("rank", rank).where(F.col("rank") <= exemplars).groupBy("grp", "cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("persistence")).alias("p"), "id"))).alias("best"))
    return whole.join(best, ["grp", "cluster"]).select("grp", F.col("first").alias("cluster"), "size", "mean_value", F.transform(F.slice("best", 1, exemplars), lambda x: x["id"]).alias("exemplars"))
