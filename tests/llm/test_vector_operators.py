import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import vectors as vectors_module
from docsieve.llm.density import condensed, contracted, density_clusters, local_forest, similar_groups
from docsieve.llm.hierarchy import cliques, dense_forest, density_hierarchy, sparse_forest
from docsieve.llm.subset import pivoted, varied_subset
from docsieve.llm.vectors import close_pairs, neighbour_pairs, neighbours, packed, unit, unpacked

BAD = [None, [], [1.0], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15]


def clustered(seed=0, sizes=(1, 1, 2, 3, 5, 8, 20, 60, 150), dimension=16, spread=0.05):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.standard_normal(dimension) + spread * rng.standard_normal((n, dimension)) for n in sizes for _ in range(3)])
    return (x * rng.uniform(0.5, 3, (len(x), 1))).astype(np.float32)


def frame(spark, x, bad=True):
    rows = [(f"v{i:04}", [float(f) for f in v], 1, "l") for i, v in enumerate(x)]
    rows += [(f"bad{i}", v, 1, "l") for i, v in enumerate(BAD)] * bad + [(None, [1.0] * 16, 1, "l")] * bad
    return spark.createDataFrame(rows, "id string, embedding array<float>, role int, list string")


def brute(x, k, least):
    u = unit(x)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    near = {}
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -s[i]))[:k]
        near[i] = [int(j) for j in order if s[i, j] >= least]
    return near


def test_bytes_round_trip():
    x = clustered()[:50]
    assert np.array_equal(unpacked(packed(x), 16), x) and np.array_equal(unpacked(packed(x)[7:20], 16), x[7:20])


def test_scan_keeps_the_nearest():
    x = unit(clustered(sizes=(40, 80, 200)))
    rotation = np.linalg.qr(np.random.default_rng(1).standard_normal((16, 16)))[0].astype(np.float32)
    q, c = close_pairs(x, x, rotation, 6, 0.6, columns=4)
    got = set(zip(q.tolist(), c.tolist(), strict=True))
    d = 2 - 2 * x @ x.T
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i])[:6] if d[i, j] <= 0.6}
    assert len(want - got) <= 0.01 * len(want)


def test_neighbours_exactly_where_all_lists_are_probed(spark):
    x = clustered()
    df = frame(spark, x)
    found = neighbours(df.unionByName(df.limit(9)).repartition(3), k=10, least=0.7, dimension=16, rows_per_list=150, probes=99).collect()
    want = {i: n for i, n in brute(x, 10, 0.7).items() if n}
    assert {int(r["id"][1:]): [int(n["id"][1:]) for n in r["near"]] for r in found} == want


def test_recall_where_few_lists_are_probed(spark):
    x = clustered(sizes=(2, 3, 10, 40, 200, 600))
    pairs = {(int(r["id_a"][1:]), int(r["id_b"][1:])) for r in neighbour_pairs(neighbours(frame(spark, x), k=10, least=0.7, dimension=16, rows_per_list=100)).collect()}
    want = {(min(i, j), max(i, j)) for i, n in brute(x, 10, 0.7).items() for j in n}
    assert len(pairs & want) >= 0.95 * len(want)


def test_recall_in_a_diffuse_group_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(128)
    x = np.concatenate([centre + 0.42 * rng.standard_normal((2_000, 128)), rng.standard_normal((4_000, 128))]).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04}", [float(f) for f in v]) for i, v in enumerate(x)], "id string, embedding array<float>")
    pairs = {(int(r["id_a"][1:]), int(r["id_b"][1:])) for r in neighbour_pairs(neighbours(df, k=10, least=0.7, rows_per_list=60)).collect()}
    want = {(min(i, j), max(i, j)) for i, n in brute(x, 10, 0.7).items() for j in n}
    assert len(want) > 10_000 and len(pairs & want) >= 0.95 * len(want)


def test_nothing_is_missed_where_all_are_compared(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "BLOCK_ROWS", 300)
    x = clustered(sizes=(2, 3, 10, 40, 200))
    found = neighbours(frame(spark, x), k=10, least=0.7, dimension=16, rows_per_list=20, exact=True).collect()
    want = {i: n for i, n in brute(x, 10, 0.7).items() if n}
    assert {int(r["id"][1:]): [int(n["id"][1:]) for n in r["near"]] for r in found} == want


def test_many_lists_are_found_by_way_of_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "FLAT_LISTS", 16)
    x = clustered(seed=3, sizes=(2, 3, 10, 40, 200, 600))
    pairs = {(int(r["id_a"][1:]), int(r["id_b"][1:])) for r in neighbour_pairs(neighbours(frame(spark, x), k=10, least=0.7, dimension=16, rows_per_list=40)).collect()}
    want = {(min(i, j), max(i, j)) for i, n in brute(x, 10, 0.7).items() for j in n}
    assert len(pairs & want) >= 0.95 * len(want)


def test_lists_keep_their_size_as_rows_grow():
    for n in (1_000_000, 10_000_000, 100_000_000):
        lists, sample = vectors_module.lists_wanted(n, 1_500)
        assert 0.95 <= n / lists / 1_500 <= 1.05 and sample <= vectors_module.MOST_SAMPLE


def test_exact_copies_and_hot_lists_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "BLOCK_ROWS", 40)
    x = np.concatenate([np.repeat(clustered(sizes=(1,))[:1], 130, axis=0), clustered(sizes=(70,), spread=0.3)])
    found = neighbours(frame(spark, x), k=5, least=0.5, dimension=16, rows_per_list=1_000, probes=2).collect()
    want = {i: n for i, n in brute(x, 5, 0.5).items() if n}
    assert {int(r["id"][1:]): [int(n["id"][1:]) for n in r["near"]] for r in found} == want


def test_newest_version_and_empty_table(spark):
    one = [1.0] + [0.0] * 15
    rows = [("a", one, 1), ("a", [0.0] * 16, 2), ("b", one, 1), ("c", one, 1)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, at int")
    assert {r["id"] for r in neighbours(df, order_col="at", dimension=16).collect()} == {"b", "c"}
    assert neighbours(df.limit(0), dimension=16).count() == 0


# --- clusters ------------------------------------------------------------------------------------------------------


def sessions(spark, x, groups=2):
    rows = [(i, f"s{i % groups}", [float(f) for f in v], 0.5, i, "t") for i, v in enumerate(x)]
    bad = [(9_000 + i, "s0", v, 0.5, 1, "t") for i, v in enumerate(BAD)] + [(9_100, "s0", [float(f) for f in x[0]], None, 1, "t"), (9_101, "s0", [float(f) for f in x[0]], float("nan"), 1, "t"), (9_102, "s0", [float(f) for f in x[0]], 1.5, 1, "t"), (9_103, None, [float(f) for f in x[0]], 0.5, 1, "t"), (None, "s0", [float(f) for f in x[0]], 0.5, 1, "t")]
    df = spark.createDataFrame(rows + bad + rows[:4], "frame_id long, session_id string, embedding array<float>, prediction double, scored_at int, grp string")
    return df.repartition(3)


def clique_truth(x, groups=2, least=0.85):
    out = set()
    for g in range(groups):
        ids = np.arange(g, len(x), groups)
        u = unit(x[ids])
        near = np.round(u @ u.T, 6) >= least
        out |= {(int(ids[row].min()), int(j)) for row in near for j in ids[row] if j != ids[row].min()}
    return out


@pytest.mark.parametrize("options", [{}, {"group_rows": 50, "rows_per_list": 60}, {"group_rows": 50, "group_edges_most": 20, "rows_per_list": 60}])
def test_similar_groups(spark, options):
    x = clustered(sizes=(1, 2, 3, 9, 40, 90), spread=0.04)
    x = np.concatenate([x, x[:3], x[-1:].repeat(30, axis=0)])
    found = similar_groups(sessions(spark, x), least=0.85, dimension=16, **options).where("id <> first_id").collect()
    got = {(r["first_id"], r["id"]) for r in found}
    assert len(got) == len(found) and got == clique_truth(x)


def test_similar_groups_of_an_empty_table(spark):
    df = sessions(spark, clustered()).limit(0)
    assert similar_groups(df, dimension=16).count() == 0 and density_clusters(df, dimension=16).count() == 0


def test_components_with_a_distant_pair_are_split():
    angle = np.deg2rad([0, 20, 40, 90])
    v = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    label = cliques(v, np.array([0, 0, 0, 1]), np.cos(np.deg2rad(25)))
    assert label[3] == -1 and label[1] >= 0 and (label[:3] == label[1]).sum() == 2


def test_components_above_the_size_of_a_task_are_checked_and_split_alike(spark):
    rng = np.random.default_rng(6)
    angle = np.deg2rad(np.r_[rng.uniform(0, 60, 90), rng.uniform(180, 190, 70), rng.uniform(270, 301, 60)])  # a chain, a tight group, one that fits only pair by pair
    x = np.zeros((len(angle), 16), np.float32)
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    df = sessions(spark, x, groups=1)
    found = lambda **o: {(r["first_id"], r["id"]) for r in similar_groups(df, least=0.85, dimension=16, **o).collect()}
    want = found()
    assert found(group_rows=40, rows_per_list=500) == want and len({first for first, _ in want}) > 3
    u = unit(x)
    for first in {first for first, _ in want}:
        own = [i for f, i in want if f == first]
        assert (np.round(u[own] @ u[own].T, 6) >= 0.85).all()


def kruskal(d, furthest):
    n = len(d)
    i, j = np.triu_indices(n, 1)
    keep = d[i, j] <= furthest
    i, j = i[keep], j[keep]
    return d[i, j][sparse_forest(n, i, j, d[i, j])].sum()


def test_dense_forest_has_least_weight():
    x = unit(clustered(sizes=(3, 10, 30)))
    d = np.maximum(2 - 2 * x @ x.T, 0)
    core = np.sort(d, axis=1)[:, 2]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    a, b, w = dense_forest(x, core, 0.5)
    assert np.isclose(w.sum(), kruskal(reach, 0.5), atol=1e-4) and len(set(zip(a, b, strict=True))) == len(a)


def test_contraction_keeps_the_forest(spark):
    rng = np.random.default_rng(3)
    edges = {(int(min(a, b)), int(max(a, b))): float(w) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.random(150), strict=True) if a != b}
    df = spark.createDataFrame([("g", a, b, w) for (a, b), w in edges.items()], "grp string, a long, b long, w double")
    names, taken, left = contracted(df, 0)
    assert left.count() == 0
    a, b = np.array(list(edges)).T
    w = np.array(list(edges.values()))
    want = w[sparse_forest(40, a, b, w)]
    got = [r["w"] for r in taken.collect()]
    assert np.allclose(sorted(got), sorted(want)) and names.select("c").distinct().count() == len(set(a) | set(b)) - len(want)


def test_clusters_that_part_within_a_distance_are_one():
    a, b, d = np.arange(5), np.arange(1, 6), np.array([0.1, 0.4, 0.1, 0.9, 0.1])
    assert density_hierarchy(6, a, b, d, 2, 1.0).label.tolist() == [0, 0, 1, 1, 3, 3] or len(set(density_hierarchy(6, a, b, d, 2, 1.0).label.tolist())) == 3
    assert len(set(density_hierarchy(6, a, b, d, 2, 1.0, 0.5).label.tolist())) == 2
    assert len(set(density_hierarchy(6, a, b, d, 2, 1.0, 1.0).label.tolist())) == 1
    assert density_hierarchy(2, np.array([0]), np.array([1]), np.array([1.0]), 2, 1.0).label.tolist() == [0, 0]  # a pair at the very reach


def test_hierarchy_selects_dense_clusters():
    d = np.array([0.1, 0.1, 0.9, 0.1, 0.1, 0.1, 2.0])
    found = density_hierarchy(8, np.arange(7), np.arange(1, 8), d, 3, 4.0)
    assert found.label[0] == found.label[1] == found.label[2] != found.label[3]
    assert len(set(found.label[3:7])) == 1 and found.label[7] in (-1, found.label[3])


@pytest.mark.parametrize("options", [{}, {"group_rows": 50, "rows_per_list": 80}, {"group_rows": 50, "group_edges_most": 60, "rows_per_list": 80}])
def test_density_clusters(spark, options):
    x = clustered(sizes=(1, 12, 40, 80), spread=0.05)
    found = density_clusters(sessions(spark, x, groups=1), min_cluster_size=5, dimension=16, **options).collect()
    assert sum(r["size"] for r in found if r["size"] >= 9) >= 0.9 * 3 * (12 + 40 + 80)
    for r in found:
        u = unit(x[r["exemplars"]])
        assert (u @ u.T).min() > 0.6 and r["mean_value"] == 0.5 and 1 <= len(r["exemplars"]) <= 3
        assert r["cluster"] <= min(r["exemplars"])
    assert len({r["cluster"] for r in found}) == len(found)


def test_a_forest_in_bands_has_the_clusters_of_one_task(spark):
    x = clustered(seed=2, sizes=(1, 2, 4, 12, 40, 80), spread=0.15)
    x = np.concatenate([x, x[200:210], x[-1:].repeat(9, axis=0)])
    a, b, w = local_forest(x, 5, 1.0)
    df = spark.createDataFrame([(g, int(i) + n, int(j) + n, float(d)) for g, n in (("g", 0), ("h", 900)) for i, j, d in zip(a, b, w, strict=True) if n == 0 or i < 60 and j < 60], "grp string, a long, b long, w double")

    def found(most):
        sets = {}
        for r in condensed(df, 3, 1.0, most).collect():
            sets.setdefault((r["grp"], r["cluster"]), set()).add((r["id"], round(r["persistence"], 6)))
        return {(g, frozenset(s)) for (g, _), s in sets.items()}

    want = found(10**6)
    assert len(want) > 8 and found(60) == want and found(25) == want


@pytest.mark.parametrize("options", [{}, {"group_rows": 50, "rows_per_list": 1_000}])
def test_noise_between_dense_groups_does_not_chain_them(spark, options):
    rng = np.random.default_rng(12)
    across = lambda degrees: np.stack([np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))] + [0 * degrees] * 14, axis=1)
    ends = [across(np.full(40, m)) + 0.0165 * rng.standard_normal((40, 16)) for m in (0.0, 60.0)]
    x = np.concatenate([*ends, across(np.arange(3, 60, 5.2)), across(np.array([180.0, 181, 182]))]).astype(np.float32)
    sizes = lambda **o: {r["cluster"]: r["size"] for r in density_clusters(sessions(spark, x, groups=1), dimension=16, **options, **o).collect()}
    plain, smooth = sizes(min_samples=2), sizes()
    assert max(plain.values()) > 85 and sorted(smooth.values())[-2] >= 36 and max(smooth.values()) < 60, (plain, smooth)
    assert smooth[len(x) - 3] == 3  # fewer rows within reach than min_samples are still a cluster


# --- subsets -------------------------------------------------------------------------------------------------------


def test_pivots_span_the_rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 4)) @ rng.standard_normal((4, 10))
    picked = pivoted(x, 4)
    assert np.linalg.matrix_rank(x[picked]) == 4 and picked[0] == int((x**2).sum(1).argmax())
    assert sorted(pivoted(x, 99)) == list(range(50)) and len(set(pivoted(x, 20))) == 20
    assert pivoted(np.zeros((3, 2)), 2) == [0, 1] and pivoted(np.zeros((0, 2)), 2) == []


def test_copies_wait_until_all_distinct_rows_are_picked():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12, 4)) @ rng.standard_normal((4, 10))
    x[:2] *= 9  # picked first
    rows = np.concatenate([np.repeat(x[:2], 40, axis=0), x[2:]])
    picked = pivoted(rows, 12)
    assert len(np.unique(rows[picked], axis=0)) == 12
    assert sorted(pivoted(rows, 99)) == list(range(90))


@pytest.mark.parametrize("options", [{}, {"block_rows": 30}, {"block_rows": 30, "round_rows": 3}])
def test_subset_covers_every_group_of_like_rows(spark, options):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((8, 16))
    x = np.concatenate([c + 0.02 * rng.standard_normal((n, 16)) for c, n in zip(centres, (400, 100, 20, 5, 3, 2, 1, 1), strict=True)]).astype(np.float32)
    group = np.repeat(np.arange(8), (400, 100, 20, 5, 3, 2, 1, 1))
    df = sessions(spark, x, groups=1)
    wanted = spark.createDataFrame([("s0", 8), ("s0", 8), ("s9", 3)], "session_id string, n_eval_per_iteration int")
    found = varied_subset(df, wanted, dimension=16, **options).collect()
    assert len(found) == 8 and {int(group[r["id"]]) for r in found} == set(range(8))
    assert sorted(r["pick"] for r in found) == list(range(1, 9))


def test_subset_sizes(spark):
    x = clustered(sizes=(2, 3))
    df = sessions(spark, x)
    sizes = lambda wanted: {r["grp"]: r["n"] for r in varied_subset(df, wanted, dimension=16).groupBy("grp").agg(F.count("*").alias("n")).collect()}
    assert sizes(None) == {"s0": 8, "s1": 7}  # fewer rows than asked for: all
    assert sizes(spark.createDataFrame([("s0", 0), ("s1", None)], "session_id string, n_eval_per_iteration int")) == {"s1": 7}
    assert varied_subset(df.limit(0), dimension=16).count() == 0
