"""An inverted-list index over rotated unit vectors, scanned block by block of columns.

Vectors go to the list of their nearest centroid and, as queries, to the lists of their
``probes`` nearest centroids and all lists within a margin that is measured (see ``measured_margin``). Within a list the squared distance is accumulated over blocks of
rotated columns; a candidate is abandoned as soon as its partial distance, scaled up to all
columns, fails a test against the best distances known for that query. Survivors are ranked by the
cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.text import named_apart
from docsieve.plans.durable import durable

#: Vectors that the centroids are fitted on: eight for each list, but so many at least and at most. The most is enough for lists of 1,500 rows up to
#: 196 million rows, and lists are a quarter of it at most, so that the centroids that every task receives stay under 131,072 * dimension * 4 bytes.
SAMPLE, MOST_SAMPLE = 16_384, 524_288
#: Lists from which on they are found by way of cells, and cells that a vector looks into.
FLAT_LISTS, CELLS_LOOKED_INTO = 4_096, 12
#: Rows that one task takes from a list, as candidates and as queries, about.
BLOCK_ROWS = 8_192
#: Queries that are held against all rows to measure recall, and the share of their neighbours that must lie in the lists probed.
MEASURED = 512
TARGET = 0.98
#: Rows that a task passes on at once.
ROUTED_ROWS = 20_000
#: How many standard errors a partial distance may exceed the bound before its candidate is abandoned.
STRICTNESS = 2.1
#: Conflicting ids up to which they are broadcast.
BROADCAST_ROWS = 100_000


def newest_rows(df: DataFrame, id_col: str, order_col: str | None, payload: list[str]) -> DataFrame:
    """``df`` without rows that a later row of the same id contradicts in ``payload``.

    Equal repetitions stay, for the consumer to collapse where it has them side by side. Only
    narrow rows are shuffled to find the contradictions; the wide ones move only if there are
    more contradictions than may be broadcast.
    """
    order = F.col(order_col).cast("timestamp") if order_col else F.lit(None).cast("timestamp")
    mark = F.xxhash64(*payload)
    key, win = named_apart(df.columns, "version_key", "version_mark")
    narrow = df.select(F.col(id_col).alias("i"), order.alias("o"), mark.alias("m"))
    odd = narrow.groupBy("i").agg(F.min("m").alias("low"), F.max("m").alias("high")).where("low <> high").select("i")
    found = odd.limit(BROADCAST_ROWS + 1).count()
    if not found:
        return df
    odd = F.broadcast(odd) if found <= BROADCAST_ROWS else odd
    winners = narrow.join(odd, "i", "left_semi").groupBy("i").agg(F.max(F.struct("o", "m")).alias("last")).select(F.col("i").alias(key), F.col("last.m").alias(win))
    winners = F.broadcast(winners) if found <= BROADCAST_ROWS else winners
    return df.join(winners, F.col(id_col) == F.col(key), "left").where(F.col(win).isNull() | (F.col(win) == mark)).select(*df.columns)


def usable_vectors(df: DataFrame, vector_col: str, dimension: int) -> DataFrame:
    """The other columns of ``df`` and ``v``: the vectors of exactly ``dimension`` finite values that are not all zero, as compact binary values.

    Rows with any other vector are left out.
    """
    others = [c for c in df.columns if c != vector_col]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            right = np.nonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dimension), False).to_numpy(zero_copy_only=False))[0]
            flat = lists.take(pa.array(right)).flatten()
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(right), dimension)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows = pa.array(right[fine])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in others], packed(np.ascontiguousarray(x[fine]))], names=[*others, "v"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "v binary"])
    return df.select(*others, F.col(vector_col).cast("array<float>").alias("v")).mapInArrow(pack, schema)


def packed(vectors: np.ndarray) -> pa.Array:
    """Vectors as binary values, their bytes sorted by significance so that block compression finds equal ones."""
    planes = np.ascontiguousarray(vectors.view(np.uint8).reshape(len(vectors), vectors.shape[1], 4).transpose(0, 2, 1)).reshape(len(vectors), 4 * vectors.shape[1])
    offsets = pa.py_buffer(np.arange(0, planes.size + 1, planes.shape[1], dtype=np.int32) if len(planes) else np.zeros(1, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(planes), [None, offsets, pa.py_buffer(planes)])


def unpacked(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset]
    planes = np.frombuffer(data, np.uint8)[start : start + len(column) * dimension * 4].reshape(len(column), 4, dimension)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.float32).reshape(len(column), dimension)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@dataclass
class Lists:
    """Centroids with the rotation of the scan and, from the sample, how many blocks each list is cut into.

    Many centroids are found by way of a few: ``cells`` are centres of centroids, ``cell_of`` ascends, and only the centroids of a
    vector's nearest cells are compared with it.
    """

    centroids: np.ndarray
    rotation: np.ndarray
    index_blocks: np.ndarray
    query_blocks: np.ndarray
    probes: int
    margin: float = -1.0
    cells: np.ndarray | None = None
    cell_of: np.ndarray | None = None

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Similarity of each vector to each centroid; -2 where the cell of the centroid is not among the vector's ``CELLS_LOOKED_INTO`` nearest."""
        if self.cells is None or self.margin == np.inf:
            return vectors @ self.centroids.T
        edges = np.searchsorted(self.cell_of, np.arange(len(self.cells) + 1))
        few = min(CELLS_LOOKED_INTO, len(self.cells))
        looked = np.argpartition(-(vectors @ self.cells.T), few - 1, axis=1)[:, :few]
        out = np.full((len(vectors), len(self.centroids)), -2, np.float32)
        row, cell = np.repeat(np.arange(len(vectors)), looked.shape[1]), looked.ravel()
        order = np.argsort(cell, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(cell[order]))[0] + 1):
            own = slice(edges[cell[part[0]]], edges[cell[part[0]] + 1])
            out[row[part], own] = vectors[row[part]] @ self.centroids[own].T
        return out

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, list, home)``: the ``probes`` nearest lists of each unit vector and those less similar than its home by ``margin`` at most."""
        height = max(1, 40_000_000 // len(self.centroids))
        parts = [self._nearest(vectors[b : b + height], b) for b in range(0, len(vectors), height)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3

    def _nearest(self, vectors: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = self.scores(vectors)
        p = min(self.probes, scores.shape[1])
        wanted = scores >= scores.max(axis=1, keepdims=True) - np.float32(self.margin)
        if p < scores.shape[1]:
            np.put_along_axis(wanted, np.argpartition(-scores, p - 1, axis=1)[:, :p], True, axis=1)
        else:
            wanted[:] = True
        row, to = np.nonzero(wanted)
        return row + first, to, to == scores.argmax(axis=1)[row]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        height = max(1, 40_000_000 // len(self.centroids))
        return np.concatenate([self.scores(vectors[b : b + height]).argmax(axis=1) for b in range(0, len(vectors), height)] or [np.zeros(0, np.int64)])

    def cut(self, sample: np.ndarray, n: int) -> None:
        """Sets the blocks of each list for ``n`` rows distributed as the sample is."""
        count = len(self.centroids)
        index, queries = np.zeros(count), np.zeros(count)
        for b in range(0, len(sample), 2_048):
            _, to, home = self.nearest(sample[b : b + 2_048])
            index += np.bincount(to[home], minlength=count)
            queries += np.bincount(to, minlength=count)
        scale = n / max(1, len(sample)) / BLOCK_ROWS
        self.index_blocks = np.maximum(1, np.ceil(index * scale)).astype(np.int64)
        self.query_blocks = np.maximum(1, np.ceil(queries * scale)).astype(np.int64)


def lists_wanted(n: int, rows_per_list: int) -> tuple[int, int]:
    """How many lists ``n`` rows are spread over, and how many rows they are fitted on: eight a list, ``SAMPLE`` at least and ``MOST_SAMPLE`` at most."""
    sample = min(n, max(SAMPLE, min(MOST_SAMPLE, 8 * round(n / rows_per_list))))
    return max(1, min(round(n / rows_per_list), sample // 4)), sample


def spherical_means(sample: np.ndarray, lists: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(sample[b : b + 2_048] @ centroids.T, axis=1) for b in range(0, len(sample), 2_048)])
        order = np.argsort(home, kind="stable")
        full, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        centroids[full] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
    return centroids


def fit_lists(sample: np.ndarray, n: int, rows_per_list: int, probes: int, seed: int, rounds: int = 8) -> Lists:
    """Spherical k-means on a bounded sample of unit vectors; ``n`` is the number of rows to index.

    More than ``FLAT_LISTS`` centroids are fitted in two levels: as many cells as the square root of their number, and in each cell its share of them.
    """
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0].astype(np.float32)
    sample = sample.astype(np.float32)
    lists = max(1, min(lists_wanted(n, rows_per_list)[0], len(sample) // 4))
    cells = cell_of = None
    if not len(sample):
        centroids = np.zeros((1, dimension), np.float32)
    elif lists <= FLAT_LISTS:
        centroids = spherical_means(sample, lists, rng, rounds)
    else:
        cells = spherical_means(sample, round(lists**0.5), rng, rounds)
        home = np.concatenate([np.argmax(sample[b : b + 2_048] @ cells.T, axis=1) for b in range(0, len(sample), 2_048)])
        parts = []
        for c in range(len(cells)):
            own = sample[home == c]
            parts.append(spherical_means(own, max(1, round(lists * len(own) / len(sample))), rng, rounds) if len(own) else cells[c : c + 1])
        centroids, cell_of = np.concatenate(parts), np.repeat(np.arange(len(cells)), [len(x) for x in parts])
    ones = np.ones(len(centroids), np.int64)
    made = Lists(centroids, rotation, ones, ones, probes, cells=cells, cell_of=cell_of)
    made.cut(sample, n)
    return made


def measured_margin(rows: DataFrame, lists: Lists, queries: np.ndarray, dimension: int, k: int, least: float) -> float:
    """The smallest margin with which ``TARGET`` of the ``k`` nearest of all rows of each query lie in the lists it probes.

    The queries are rows themselves and leave themselves out; they are held against every row of ``(rid, v)``, so that the
    neighbours are those at full size and not those of a sample.
    """
    if len(lists.centroids) <= lists.probes or not len(queries):
        return -1.0
    q = queries.astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((q, lists))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, lists = shared.value
        held, home = np.full((len(q), k + 1), -2, np.float32), np.zeros((len(q), k + 1), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(unpacked(batch.column("v"), dimension)).astype(np.float32)
            scores = q @ v.T
            near = np.argpartition(-scores, k, axis=1)[:, : k + 1] if len(v) > k + 1 else np.tile(np.arange(len(v)), (len(q), 1))
            used, at = np.unique(near, return_inverse=True)
            own = lists.home(v[used]).astype(np.int32)
            both = np.hstack([held, np.take_along_axis(scores, near, axis=1)])
            homes = np.hstack([home, own[at.reshape(near.shape)]])
            order = np.argsort(-both, axis=1, kind="stable")[:, : k + 1]
            held, home = np.take_along_axis(both, order, axis=1), np.take_along_axis(homes, order, axis=1)
        i, j = np.nonzero(held >= least)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(held[i, j]), pa.array(home[i, j])], names=["query", "score", "home"])

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "home"))
    found = rows.select("v").mapInArrow(best, "query int, score float, home int").withColumn("place", place).where(F.col("place").between(2, k + 1)).select("query", "home").toArrow()
    if not found.num_rows:
        return -1.0
    i, home = found.column("query").to_numpy(), found.column("home").to_numpy()
    scores = lists.scores(q)
    gap = scores.max(axis=1)[i] - scores[i, home]
    rank = (scores[i] > scores[i, home][:, None]).sum(axis=1)
    gap[rank < lists.probes] = -1
    gap = gap[scores[i, home] > -1.5]  # no margin reaches into cells that are not looked into
    if not len(gap):
        return -1.0
    return float(np.sort(gap)[int(np.ceil(TARGET * len(gap))) - 1]) + 1e-6 if (gap >= 0).mean() > 1 - TARGET else -1.0


def sampled(df: DataFrame, dimension: int, n: int, most: int) -> np.ndarray:
    """At most about ``most`` of the ``n`` vectors of ``(rid, v)`` at unit length, chosen by a hash of the id."""
    share = min(1.0, most / max(1, n))
    rows = df.where(F.pmod(F.xxhash64(F.lit("sample"), "rid"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)) if share < 1 else df
    got = rows.select("v").toArrow()
    return np.concatenate([unit(unpacked(part, dimension)).astype(np.float32) for part in got.column("v").chunks]) if got.num_rows else np.zeros((0, dimension), np.float32)


def routed(df: DataFrame, lists: Lists, dimension: int) -> DataFrame:
    """``(grp, list, ib, qb, role, rid, v)`` from ``(grp, rid, v)``: role 1 is a candidate, 2 a query, 3 both.

    Where ``df`` has a column ``core``, it is carried as one more value of ``v``.
    """
    carried = ["core"] if "core" in df.columns else []
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(lists)
    kinds = dict(df.dtypes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cut = (own.index_blocks > 1) | (own.query_blocks > 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unpacked(batch.column("v"), dimension)
            row, to, home = own.nearest(unit(vectors).astype(np.float32))
            if carried:
                vectors = np.hstack([vectors, batch.column("core").to_numpy(zero_copy_only=False).astype(np.float32)[:, None]])
            role = np.where(home, 3, 2).astype(np.int64)
            ib = qb = np.zeros(len(row), np.int64)
            if cut[to].any():
                salt = np.array([hash_of(x) for x in batch.column("rid").to_pylist()])
                parts = []
                for r, t, kind in zip(row.tolist(), to.tolist(), role.tolist(), strict=True):
                    wide, high = int(own.index_blocks[t]), int(own.query_blocks[t])
                    i, q = int(salt[r] % wide), int(salt[r] // 1_000_003 % high)
                    cells = {(x, q): 2 for x in range(wide)}
                    if kind == 3:
                        for y in range(high):
                            cells[(i, y)] = cells.get((i, y), 0) | 1
                    parts += [(r, t, what, x, y) for (x, y), what in cells.items()]
                row, to, role, ib, qb = np.array(parts).T
            for begin in range(0, len(row), ROUTED_ROWS):
                part = slice(begin, begin + ROUTED_ROWS)
                taken = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grp").take(taken), pa.array(to[part], pa.int32()), pa.array(ib[part], pa.int32()), pa.array(qb[part], pa.int32()), pa.array(role[part], pa.int8()), batch.column("rid").take(taken), packed(vectors[row[part]])],
                    names=["grp", "list", "ib", "qb", "role", "rid", "v"],
                )

    return df.select("grp", "rid", "v", *carried).mapInArrow(route, f"grp {kinds['grp']}, list int, ib int, qb int, role byte, rid {kinds['rid']}, v binary")


def hash_of(value: object) -> int:
    """A hash of an id that is the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(str(value).encode()) >> 1


def close_pairs(queries: np.ndarray, candidates: np.ndarray, rotation: np.ndarray, k: int, furthest: float, columns: int = 32, strictness: float = STRICTNESS) -> tuple[np.ndarray, np.ndarray]:
    """``(query, candidate)`` numbers that hold the ``k`` nearest of each query within squared distance ``furthest``.

    Both are unit vectors in double precision. All ties of the k-th are kept, with a margin for single precision.
    """
    dimension = queries.shape[1]
    q, c = queries.astype(np.float32) @ rotation, candidates.astype(np.float32) @ rotation
    cuts = [*range(0, dimension, columns), dimension]
    q_norm = np.stack([(q[:, a:b] ** 2).sum(1) for a, b in zip(cuts, cuts[1:])])
    c_norm = np.stack([(c[:, a:b] ** 2).sum(1) for a, b in zip(cuts, cuts[1:])])
    slack = np.float32(2e-5)
    allowed = [np.float32(b / dimension * (1 + strictness / b**0.5) ** 2) if b < dimension else np.float32(1) for b in cuts[1:]]
    seeds = np.arange(0, len(c), 4) if len(c) > 4 * k else np.arange(len(c))
    height = max(16, min(256, 4_000_000 // max(1, len(c))))
    found_q, found_c, found_d = [], [], []
    for top in range(0, len(q), height):
        part = slice(top, top + height)
        bound = np.full(len(q[part]), furthest, np.float32)
        if len(seeds) >= k:
            near = 2 - 2 * (q[part] @ c[seeds].T)
            bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1])
        bound += slack
        columns_left = np.arange(len(c))
        total = q_norm[0, part, None] + c_norm[None, 0] - 2 * (q[part, : cuts[1]] @ c[:, : cuts[1]].T)
        alive = total <= bound[:, None] * allowed[0]
        step = 1
        while step < len(cuts) - 1:  # densely, on the candidates that some query of the tile still wants
            if np.count_nonzero(alive) < 0.05 * alive.size:
                break
            wanted = alive.any(axis=0)
            if not wanted.all():
                columns_left, total = columns_left[wanted], total[:, wanted]
            a, b = cuts[step], cuts[step + 1]
            other = c[columns_left]
            total += q_norm[step, part, None] + c_norm[step, columns_left][None] - 2 * (q[part, a:b] @ other[:, a:b].T)
            alive = total <= bound[:, None] * allowed[step]
            step += 1
        qi, ci = np.nonzero(alive)
        d, ci = total[qi, ci], columns_left[ci]
        while step < len(cuts) - 1 and len(qi):  # then pair by pair
            a, b = cuts[step], cuts[step + 1]
            d = d + ((q[top + qi, a:b] - c[ci, a:b]) ** 2).sum(axis=1)
            keep = d <= bound[qi] * allowed[step]
            qi, ci, d, step = qi[keep], ci[keep], d[keep], step + 1
        if not len(qi):
            continue
        order = np.lexsort((d, qi))
        qi, ci, d = qi[order], ci[order], d[order]
        first = np.r_[0, np.nonzero(np.diff(qi))[0] + 1]
        sizes = np.diff(np.r_[first, len(qi)])
        kth = d[first + np.minimum(sizes, k) - 1]
        keep = d <= np.repeat(kth, sizes) + slack
        found_q.append(qi[keep] + top), found_c.append(ci[keep]), found_d.append(d[keep])
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_c)


def cosines(x: np.ndarray, y: np.ndarray, xi: np.ndarray, yi: np.ndarray, block: int = 65_536) -> np.ndarray:
    """Row-by-row products of double-precision unit vectors, rounded to 6 decimals."""
    out = np.empty(len(xi))
    for b in range(0, len(xi), block):
        out[b : b + block] = np.einsum("ij,ij->i", x[xi[b : b + block]], y[yi[b : b + block]])
    return np.round(out, 6)


def grouped_equal(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its vector among the distinct ones, and the first row of each of these."""
    _, first, where = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return where.ravel(), first


def search_block(rid: np.ndarray, role: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, least: float, strictness: float = STRICTNESS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query rows, neighbour rows, similarity)`` of one block, best first for each query.

    Rows are sorted by id and distinct. Exact copies of a vector are searched once: as candidates
    only the k + 1 smallest ids of a vector can be among anyone's k nearest, and as queries they
    share one result up to leaving themselves out.
    """
    where, first = grouped_equal(vectors)
    is_candidate = np.nonzero(role & 1)[0]
    order = is_candidate[np.argsort(where[is_candidate], kind="stable")]
    group, starts, sizes = np.unique(where[order], return_index=True, return_counts=True)
    is_query = np.nonzero(role & 2)[0]
    if not len(order) or not len(is_query):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    asked = np.unique(where[is_query])
    exact = unit(vectors[first])
    qi, gi = close_pairs(exact[asked], exact[group], rotation, k + 1, 2 - 2 * least, strictness=strictness)
    similarity = cosines(exact, exact, asked[qi], group[gi])
    keep = similarity >= least
    qi, gi, similarity = qi[keep], gi[keep], similarity[keep]
    take = np.minimum(sizes[gi], k + 1)  # every group of copies with its smallest ids
    pair = np.repeat(np.arange(len(qi)), take)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(take) - take, take)
    qi, similarity, neighbour = qi[pair], similarity[pair], order[starts[gi[pair]] + at]
    qi, similarity, neighbour = ranked(qi, similarity, neighbour, k + 1)
    return expanded(asked, where, is_query, qi, similarity, neighbour, k)


def ranked(q: np.ndarray, similarity: np.ndarray, neighbour: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((neighbour, -similarity, q))
    q, similarity, neighbour = q[order], similarity[order], neighbour[order]
    if not len(q):
        return q, similarity, neighbour
    first = np.r_[0, np.nonzero(np.diff(q))[0] + 1]
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < k], similarity[rank < k], neighbour[rank < k]


def expanded(asked, where, is_query, qi, similarity, neighbour, k):
    """The results of distinct query vectors, given to each row that has the vector, without itself."""
    starts = np.searchsorted(qi, np.arange(len(asked)))
    sizes = np.searchsorted(qi, np.arange(len(asked)), side="right") - starts
    number = np.searchsorted(asked, where[is_query])
    many = sizes[number]
    row = np.repeat(is_query, many)
    at = np.repeat(starts[number], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    other, score = neighbour[at], similarity[at]
    keep = other != row
    row, other, score = row[keep], other[keep], score[keep]
    if not len(row):
        return row, other, score
    first = np.r_[0, np.nonzero(np.diff(row))[0] + 1]
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[rank < k], other[rank < k], score[rank < k]


def distinct_rows(table: pa.Table, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order without repetition, the roles of all their rows joined, and their vectors."""
    rid = table.column("rid").to_numpy(zero_copy_only=False)
    vectors = unpacked(table.column("v"), dimension)
    role = table.column("role").to_numpy() if "role" in table.column_names else np.full(len(rid), 3, np.int8)
    ids, first, where = np.unique(rid, return_index=True, return_inverse=True)
    joined = np.zeros(len(ids), np.int8)
    np.bitwise_or.at(joined, where.ravel(), role)
    return ids, joined, vectors[first]


def index_of(rows: DataFrame, dimension: int, k: int, least: float, rows_per_list: int, probes: int, seed: int) -> Lists:
    """The lists for ``(rid, v)``, with the margin that was measured for them."""
    n = rows.count()
    sample = sampled(rows, dimension, n, lists_wanted(n, rows_per_list)[1])
    lists = fit_lists(sample, n, rows_per_list, probes, seed)
    measured = np.random.default_rng(seed + 1).permutation(len(sample))[:MEASURED]
    lists.margin = measured_margin(rows, lists, sample[measured], dimension, k, least)
    lists.cut(sample, n)
    return lists


def neighbours(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", order_col: str | None = None, k: int = 10, least: float = -1.0, dimension: int = 128, rows_per_list: int = 1_500, probes: int = 3, seed: int = 7, strictness: float = STRICTNESS, exact: bool = False) -> DataFrame:
    """``(id, near)``: for every usable vector its ``k`` most similar others, best first.

    ``near`` is an array of ``struct<similarity double, id>``. Similarity is the cosine in double
    precision rounded to 6 decimals, ties go to the smaller id, and others below ``least`` do not
    count. Rows without any such neighbour, unusable vectors (null, of another length, with NaN or
    infinite values, all zero) and null ids are left out. Repeated ids count once, by the latest
    ``order_col``. Other columns are ignored. An empty table gives an empty result.

    Every row is indexed and every row is a query. The centroids are fitted on a bounded sample (see ``lists_wanted``). A hot list is cut into blocks of candidates and blocks of queries that meet in separate
    tasks; nothing is capped. Two things are approximate. Not all lists are looked into: each row probes its ``probes``
    nearest lists and further ones within a margin, which is set so that ``TARGET`` of the neighbours of
    ``MEASURED`` rows, found by holding these against all rows, lie in the lists they probe. And a candidate is abandoned when its partial distance fails a
    test, the more rarely wrongly the larger ``strictness`` is. ``exact`` turns both off, at the cost of comparing all rows with each other block by block.
    """
    columns = dict.fromkeys([id_col, vector_col, *([order_col] if order_col else [])])
    clean = newest_rows(df.where(F.col(id_col).isNotNull()).select(*columns), id_col, order_col, [vector_col])
    rows = durable(usable_vectors(clean.select(F.lit(0).alias("grp"), F.col(id_col).alias("rid"), F.col(vector_col).alias("vector")), "vector", dimension))
    if exact:
        n = rows.count()
        lists = fit_lists(np.zeros((0, dimension), np.float32), n, n + 1, 1, seed)
        lists.index_blocks = lists.query_blocks = np.maximum(1, np.ceil(np.full(1, n / BLOCK_ROWS))).astype(np.int64)
        strictness = np.inf
    else:
        lists = index_of(rows, dimension, k, least, rows_per_list, probes, seed)
    return neighbours_of(rows, lists, dimension, k, least, ["list", "ib", "qb"], strictness).drop("grp")


def neighbours_of(rows: DataFrame, lists: Lists, dimension: int, k: int, least: float, cell: list[str], strictness: float = STRICTNESS) -> DataFrame:
    """``(grp, id, near)``: the ``k`` most similar rows of each row ``(grp, rid, v)`` among those that share a cell with it."""
    kinds = dict(rows.dtypes)
    rotation = lists.rotation

    def search(table: pa.Table) -> pa.Table:
        ids, role, vectors = distinct_rows(table, dimension)
        row, other, score = search_block(ids, role, vectors, rotation, k, least, strictness)
        starts = np.r_[0, np.nonzero(np.diff(row))[0] + 1] if len(row) else np.zeros(0, np.int64)
        kind = table.schema.field("rid").type
        pairs = pa.StructArray.from_arrays([pa.array(score), pa.array(ids[other], kind)], names=["similarity", "id"])
        offsets = pa.array(np.r_[starts, len(row)].astype(np.int32))
        grp = pa.array([table.column("grp")[0].as_py()] * len(starts), table.schema.field("grp").type)
        return pa.table({"grp": grp, "id": pa.array(ids[row[starts]], kind), "near": pa.ListArray.from_arrays(offsets, pairs)})

    schema = f"grp {kinds['grp']}, id {kinds['rid']}, near array<struct<similarity:double,id:{kinds['rid']}>>"
    part = routed(rows, lists, dimension).groupBy(*cell).applyInArrow(search, schema)
    ascending = F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct((-x["similarity"]).alias("far"), x["id"].alias("id"))))
    best = part.groupBy("grp", "id").agg(F.slice(ascending, 1, k).alias("near"))
    return best.select("grp", "id", F.transform("near", lambda x: F.struct((-x["far"]).alias("similarity"), x["id"].alias("id"))).alias("near"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: pairs in which at least one is a neighbour of the other."""
    linked = near.select(F.col("id").alias("x"), F.explode("near.id").alias("y"))
    return linked.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
