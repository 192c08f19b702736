"""Numerical kernels against plain numpy, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from molgrid.operators import aggregate as agg
from molgrid.operators import annotate, assignment, controls, embedding, geometry, mapping, metrics, normalize, sample, shapes, spatial, tables

SQUARE = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
CONCAVE = [{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 6.0, "y": 6.0}, {"x": 3.0, "y": 1.0}, {"x": 0.0, "y": 6.0}]
RING = "cell_id long, ring array<struct<x:double,y:double>>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=40), st.integers(-5, 5))
def test_hull(points, shift):
    p = np.array(points, float)
    ring = shapes.hull(p)
    size = shapes.area(ring)
    assert size >= 0 and abs(shapes.area(shapes.hull(p + shift)) - size) < 1e-6
    if size:
        x, y = ring[:, 0], ring[:, 1]
        nx, ny = np.roll(x, -1), np.roll(y, -1)
        for q in p:  # no point lies outside of any edge
            assert ((nx - x) * (q[1] - y) - (ny - y) * (q[0] - x) >= -1e-9).all()


def test_areas_of_small_cells():
    assert [shapes.alpha_area(np.array(p, float), 0.0) for p in ([[1, 1]], [[0, 0], [1, 1]], [[0, 0], [1, 1], [2, 2]], [[0, 0], [1, 0], [1, 1], [0, 1]])] == [0, 0, 0, 1]
    rng = np.random.default_rng(0)
    p = rng.random((40, 2))
    assert abs(shapes.alpha_area(p, 1e-6) - shapes.area(shapes.hull(p))) < 0.02
    assert shapes.alpha_area(p, 8.0) < shapes.alpha_area(p, 1.0) + 1e-12


def test_outline_is_the_inverse_of_rasterize(spark):
    poly = spark.createDataFrame([(1, SQUARE), (2, [{"x": p["x"] + 10, "y": p["y"] + 2} for p in SQUARE])], RING)
    spans = spatial.rasterize(poly, 30, 30)
    back = {r.cell_id: {(p.x, p.y) for p in r.ring} for r in shapes.labels_to_polygons(spans).collect()}
    assert back == {1: {(0, 0), (4, 0), (4, 4), (0, 4)}, 2: {(10, 2), (14, 2), (14, 6), (10, 6)}}


def test_points_and_polygons(spark):
    poly = spark.createDataFrame([(5, SQUARE), (7, CONCAVE)], RING)
    rows = [("in both", 1.0, 1.0), ("corner", 0.0, 0.0), ("edge", 4.0, 1.0), ("notch", 3.0, 4.5), ("arm", 5.5, 4.0), ("out", 50.0, 50.0), ("negative", -1.0, -1.0)]
    pts = spark.createDataFrame(rows, "transcript_id string, x double, y double")
    for size in (1.0, 64.0):
        got = {r.transcript_id: r.cell_id for r in spatial.assign_by_polygons(pts, poly, size, 0).collect()}
        assert got == {"in both": 5, "corner": 0, "edge": 7, "notch": 0, "arm": 7, "out": 0, "negative": 0}


def test_labels_equal_polygons_off_the_borders(spark):
    rng = np.random.default_rng(3)
    poly = spark.createDataFrame([(k + 1, [{"x": p["x"] * 3 + 13.0 * k, "y": p["y"] * 3} for p in SQUARE]) for k in range(6)], RING)
    pts = spark.createDataFrame([(str(k), float(int(x) + 0.5), float(int(y) + 0.5)) for k, (x, y) in enumerate(rng.random((400, 2)) * [80, 14])], "transcript_id string, x double, y double")
    a = spatial.assign_by_labels(pts, spatial.rasterize(poly, 100, 20), 100, 20, bucket=8)
    b = spatial.assign_by_polygons(pts, poly, 5.0, 0)
    assert a.select("transcript_id", "cell_id").exceptAll(b.select("transcript_id", "cell_id")).isEmpty()


def test_counts_and_inverse(spark):
    pts = spark.createDataFrame([(k % 4, f"g{k % 3}") for k in range(50)], "cell_id long, feature_name string")
    cnt = agg.count_matrix(pts)
    assert cnt.agg(F.sum("count")).first()[0] == pts.where("cell_id > 0").count()
    assert agg.count_matrix(agg.explode_counts(cnt)).exceptAll(cnt).isEmpty()


@pytest.mark.parametrize(("n", "want"), [(20, {"a": 1, "b": 2, "c": 5, "d": 12}), (500, {"a": 1, "b": 2, "c": 5, "d": 100}), (7, {"a": 1, "b": 2, "c": 2, "d": 2})])
def test_quotas(spark, n, want):
    rows = [(k, f"{k}{i}") for k, size in (("a", 1), ("b", 2), ("c", 5), ("d", 100)) for i in range(size)]
    df = spark.createDataFrame(rows, "k string, id string")
    assert {r.k: r.quota for r in sample.group_quotas(df, "k", n).collect()} == want
    got = sample.balanced_subsample(df, "k", "id", n, 1)
    assert got.count() == min(n, 108)
    assert got.exceptAll(sample.balanced_subsample(df, "k", "id", n, 1)).isEmpty()


def test_names_ids_and_cut(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 4)], "g string, o int")
    assert sorted(r.g for r in tables.make_unique(df, "g", "o").collect()) == ["A", "A-1", "A-2", "B"]
    ids = spark.createDataFrame([("-1",), (" none ",), ("UNASSIGNED",), (None,), ("17",), ("",)], "cell_id string")
    assert sorted(r.cell_id for r in tables.normalize_ids(ids).collect()) == [0, 0, 0, 0, 0, 17]
    cells = spark.createDataFrame([(k, 5 if k < 5 else 50) for k in range(10)], "cell_id long, n_counts long")
    assert agg.qc_filter(cells, 10, 0.8).where("passed_QC").count() >= 8


def test_guards(spark):
    a = spark.createDataFrame([(1, 2.0)], "cell_id long, volume double")
    with pytest.raises(ValueError):
        tables.attach_volume(spark.createDataFrame([(2,)], "cell_id long"), a)
    with pytest.raises(ValueError):
        tables.attach_volume(spark.createDataFrame([(1,)], "cell_id long"), a.withColumn("volume", F.lit(0.0)))
    with pytest.raises(ValueError):
        tables.assert_labels(spark.createDataFrame([(0,)], "label long"))
    with pytest.raises(ValueError):
        tables.require_columns(a, "nope")
    out = spark.createDataFrame([(900.0, 900.0)], "x double, y double")
    with pytest.raises(Exception, match="outside the raster"):
        tables.out_of_bounds(out, 10, 10).collect()


def test_numbered_ids(spark):
    def numbered(*ids):
        return [r.c for r in tables.numbered_ids(spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k long, c string"), "c").orderBy("k").collect()]

    assert numbered("CR4b-27", None, "CR4b-3", "CR4b-27") == [27, None, 3, 27]
    assert numbered("5", "7") == [5, 7] and numbered() == [] and numbered(None) == [None]
    for ids, why in ((("CR-1", "2"), "mixed types"), (("CR-1", "CT-1"), "same number"), (("CR-x",), "no number"), (("1", "one"), "no number")):
        with pytest.raises(Exception, match=why):
            numbered(*ids)


def test_row_ids_are_contiguous(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(7)
    got = sample.with_row_id(df, "k").orderBy("k").collect()
    assert [r.row_id for r in got] == list(range(1000))


def test_pca_and_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(5)
    placed, load = embedding.pca(df, "id", "v", 3)
    got = np.array([r.X_pca for r in placed.orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6) and load.shape == (6, 3)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = embedding.knn(df, "id", "v", 4, blocks=3).collect()
    assert {(r.src, r.dst) for r in near} == {(i, j) for i in range(200) for j in np.argsort(d[i])[:4]}


def test_ranks_and_nnls():
    assert mapping.ranks(np.array([[3.0, 1.0, 3.0, 0.0]])).tolist() == [[3.5, 2.0, 3.5, 1.0]]
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, x = rng.random((12, 4)), np.maximum(rng.normal(size=4), 0)
        assert np.allclose(mapping.nnls(a, a @ x), x, atol=1e-6)
        free = mapping.nnls(a, rng.normal(size=12))
        assert (free >= 0).all()


@pytest.fixture(scope="module")
def reference(spark):
    """Three types with markers of their own."""
    rng = np.random.default_rng(4)
    types, rows, cells = ("a", "b", "c"), [], []
    for k in range(60):
        t = k % 3
        cells.append((k, types[t]))
        for g in range(9):
            n = int(rng.poisson(12 if g // 3 == t else 1))
            if n:
                rows.append((k, f"g{g}", n))
    return spark.createDataFrame(rows, "cell_id long, gene string, count long"), spark.createDataFrame(cells, "cell_id long, cell_type string")


def test_annotators_find_the_types(spark, reference):
    cnt, cells = reference
    truth = {r.cell_id: r.cell_type for r in cells.collect()}
    profile = annotate.type_profiles(cnt, cells)
    found = {
        "correlation": annotate.annotate_correlation(cnt, profile),
        "spearman": mapping.annotate_spearman(cnt, normalize.log_cp(cnt), cells),
        "nnls": mapping.annotate_weights(cnt, profile),
        "projection": mapping.annotate_weights(cnt, profile, "projection"),
        "ot": mapping.annotate_ot(cnt, profile, cells),
    }
    for name, df in found.items():
        right = [truth[r.cell_id] == r.label for r in df.collect()]
        assert len(right) == 60 and sum(right) >= 57, name
    pairs = mapping.decompose(cnt, profile, profile.select("gene").distinct())
    assert sum(truth[r.cell_id] == r.first_type for r in pairs.collect()) >= 57
    pure = normalize.purify_counts(cnt, pairs, profile)
    assert pure.where("purified > count + 1e-9 or purified < 0").isEmpty()


def test_controls_bracket_the_scores(spark, reference):
    cnt, cells = reference
    norm = normalize.log_cp(cnt)
    same = metrics.neg_marker_purity_reads((norm, cells), (norm, cells), 0.5).first().metric_value
    mixed = controls.control_permuted(norm, cells, 3)["cells"]
    worse = metrics.neg_marker_purity_reads((norm, mixed), (norm, cells), 0.9).first().metric_value
    assert same == 1.0 and worse <= 1.0
    a = metrics.coexpression_similarity((norm, cells), (norm, cells)).first().metric_value
    b = metrics.relative_celltype_similarity((norm, cells), (norm, cells)).first().metric_value
    c = metrics.relative_celltype_similarity((norm, mixed), (norm, cells)).first().metric_value
    assert abs(a - 1) < 1e-9 and abs(b - 1) < 1e-9 and c < b


def test_probabilistic_assignment(spark, reference):
    cnt, cells = reference
    profile = annotate.type_profiles(cnt, cells)
    rows = [(f"{k}-{i}", 100.0 * k + dx, float(dy), f"g{3 * k + i % 3}", 0) for k in range(3) for i, (dx, dy) in enumerate([(1, 1), (-2, 1), (0, -3), (2, 2), (-1, -1), (3, 0)])]
    rows.append(("far", 5000.0, 5000.0, "g0", 0))
    pts = spark.createDataFrame(rows, "transcript_id string, x double, y double, feature_name string, cell_id long")
    at = spark.createDataFrame([(k + 1, 100.0 * k, 0.0) for k in range(3)], "cell_id long, x double, y double")
    got = {r.transcript_id: r.cell_id for r in assignment.probabilistic_assign(pts, at, profile).collect()}
    assert got.pop("far") == 0 and all(v == int(k[0]) + 1 for k, v in got.items())


def test_crop_window_stays_in_the_image(spark):
    c = spark.createDataFrame([(5.0, 990.0)], "center_x double, center_y double")
    r = geometry.crop_window(c, 1000, 1000, 10_000).first()
    assert (r.x, r.y, r.w, r.h) == (0, 900, 100, 100)
    assert geometry.crop_window(c, 50, 50, 10_000).first().w == 50
    r = geometry.crop_window(c, 2000, 50, 10_000).first()
    assert r.h == 50 and r.w == 200


def test_best_pair_of_all_types():
    rng = np.random.default_rng(11)
    base = rng.random(30)
    p = np.abs(base + 0.15 * rng.normal(size=(12, 30)))
    p /= p.sum(axis=1, keepdims=True)
    x = rng.dirichlet(np.ones(12), 150) @ p + 0.004 * rng.random((150, 30))
    x /= x.sum(axis=1, keepdims=True)
    first, second, w = mapping.best_pairs(x, p)
    outside = 0
    for k, row in enumerate(x):
        error = {}
        for i in range(12):
            for j in range(i + 1, 12):
                v = mapping.nnls(p[[i, j]].T, row)
                error[i, j] = ((p[[i, j]].T @ v - row) ** 2).sum()
        own = ((w[k] @ p[[first[k], second[k]]] - row) ** 2).sum()
        assert (w[k] >= 0).all() and own <= min(error.values()) + 1e-10
        four = set(np.argsort(-mapping.nnls(p.T, row))[:4].tolist())
        outside += not {int(first[k]), int(second[k])} <= four
    assert outside


def test_types_of_few_cells_are_left_out(spark, reference):
    cnt, cells = reference
    profile = annotate.type_profiles(cnt, cells)
    genes = profile.select("gene").distinct()
    few = cells.where("cell_type != 'c' or cell_id < 30")
    got = mapping.decompose(cnt, profile, genes, ref_cells=few, type_min=20).collect()
    assert {x for r in got for x in (r.first_type, r.second_type)} <= {"a", "b", None, "None_sp"}


def test_probabilistic_assignment_runs_to_its_tolerance(spark, reference):
    import warnings

    cnt, cells = reference
    profile = annotate.type_profiles(cnt, cells)
    rows = [(f"{k}-{i}", 100.0 * k + i, float(i), f"g{3 * k + i % 3}", 0) for k in range(3) for i in range(6)] + [("far", 5000.0, 5000.0, "g0", 0)]
    pts = spark.createDataFrame(rows, "transcript_id string, x double, y double, feature_name string, cell_id long")
    at = spark.createDataFrame([(k + 1, 100.0 * k, 0.0) for k in range(3)], "cell_id long, x double, y double")
    with pytest.warns(UserWarning, match="after 1 rounds"):
        assignment.probabilistic_assign(pts, at, profile, max_iter=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = {r.transcript_id: r for r in assignment.probabilistic_assign(pts, at, profile).collect()}
    far = got.pop("far")
    assert (far.cell_id, far.cell_type, far.cell_type_prob) == (0, None, None)
    assert all(r.cell_type == "abc"[int(k[0])] and 0.9 < r.cell_type_prob <= 1 for k, r in got.items())


def test_row_ids_written_out_are_contiguous(spark, tmp_path):
    # more rows and columns than the sort's own sample of bounds sees alike
    df = spark.range(600_000, numPartitions=7).selectExpr("id", "hash(id) % 5000 as k", "concat('value ', id) as v", "id * 0.5 as w")
    sample.with_row_id(df, "k", "id").write.parquet(f"{tmp_path}/rows")
    got = spark.read.parquet(f"{tmp_path}/rows")
    n = got.selectExpr("count(*)", "count(distinct row_id)", "min(row_id)", "max(row_id)").first()
    assert tuple(n) == (600_000, 600_000, 0, 599_999)
    steps = got.alias("a").join(got.alias("b"), F.expr("b.row_id = a.row_id + 1"))
    assert steps.where("struct(b.k, b.id) <= struct(a.k, a.id)").count() == 0


def test_permuted_column_keeps_every_row(spark, tmp_path):
    df = spark.range(300_000, numPartitions=5).selectExpr("id as cell_id", "concat('t', id % 7) as cell_type", "concat('value ', id) as v")
    sample.permute_column(df, "cell_type", "cell_id", 9).write.parquet(f"{tmp_path}/rows")
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert got.count() == 300_000 == got.select("cell_id").distinct().count()
    assert sorted(map(tuple, got.groupBy("cell_type").count().collect())) == sorted(map(tuple, df.groupBy("cell_type").count().collect()))


def test_unique_names_leave_out_those_taken(spark):
    from molgrid.operators import tables as t

    names = ["A", "A", "A-1", "A", "A-3", "B", "B", "A-1", "A-02", "C"]
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    got = [r.name for r in t.make_unique(df, "name", "k").orderBy("k").collect()]
    assert got == ["A", "A-2", "A-1", "A-4", "A-3", "B", "B-1", "A-1-1", "A-02", "C"]
    assert len(set(got)) == len(got)


def test_names_of_labels_and_back(spark):
    rows = spark.createDataFrame([("a/b",), ("a_b",), ("a/b",), (None,), ("c",)], "t string")
    names = tables.label_names(rows, "t")
    assert {r.label: r.name for r in names.collect()} == {"a/b": "a_b", "a_b": "a_b-1", "c": "c"}
    back = tables.restore_labels(spark.createDataFrame([("a_b",), ("a_b-1",), ("other",), (None,)], "t string"), "t", names)
    assert sorted(str(r.t) for r in back.collect()) == ["None", "a/b", "a_b", "other"]


def test_processed_dataset_has_window_labels_and_metadata(spark):
    from molgrid.operators import controls

    pts = spark.createDataFrame([(k, 10.0 + k, 10.0 + k, "g1" if k % 2 else "g2") for k in range(11)], "transcript_id long, x double, y double, feature_name string")
    poly = spark.createDataFrame([(c, [{"x": a, "y": a}, {"x": a + 4, "y": a}, {"x": a + 4, "y": a + 4}, {"x": a, "y": a + 4}]) for c, a in ((1, 12.0), (2, 40.0))], "cell_id long, ring array<struct<x:double,y:double>>")
    cnt = spark.createDataFrame([(1, "g1", 2), (1, "g9", 1), (2, "g1", 1)], "cell_id long, gene string, count long")
    cells = spark.createDataFrame([(1, "T"), (2, "B")], "cell_id long, cell_type string")
    meta = spark.createDataFrame([("old",)], "dataset_id string")
    out = controls.process_dataset(pts, poly, cnt, cells, 10, None, 0, (50, 50), 100, meta, {"dataset_id": "new"})
    assert sorted(r.transcript_id for r in out["transcripts"].collect()) == [1, 3, 5, 7, 9]
    assert [r.cell_id for r in out["polygons"].collect()] == [1] and {r.label for r in out["labels"].collect()} == {1}
    assert sum(r.x_end - r.x_start + 1 for r in out["labels"].collect()) == 16
    assert out["metadata"].first().dataset_id == "new" and {r.gene for r in out["ref_counts"].collect()} == {"g1"}
    with pytest.raises(ValueError):
        controls.process_dataset(pts, poly, cnt, cells, 10, None, 0)
