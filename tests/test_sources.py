"""Readers and writers on small files that the tests write."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from molgrid.functions import scalars
from molgrid.operators.controls import stamp_meta
from molgrid.sources import readers, writers
from molgrid.streaming.counts import stream_counts


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_xenium_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(1, 1.5, 2.5, 0.0, "g1", 0), (2, 3.0, 4.0, 1.0, "g2", 7)], "transcript_id long, x double, y double, z double, feature_name string, cell_id long")
    poly = spark.createDataFrame([(7, [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}])], "cell_id long, ring array<struct<x:double,y:double>>")
    writers.export_xenium(pts, poly, str(tmp_path))
    back = readers.read_xenium_points(spark, f"{tmp_path}/transcripts.parquet").orderBy("transcript_id").collect()
    assert [(r.x, r.y, r.feature_name, r.cell_id, r.qv, r.overlaps_nucleus) for r in back] == [(1.5, 2.5, "g1", None, 40.0, False), (3.0, 4.0, "g2", "7", 40.0, True)]
    assert spark.read.parquet(f"{tmp_path}/cell_boundaries.parquet").count() == 3


def test_cosmx(spark, tmp_path):
    path = put(tmp_path / "a_tx_file.csv", "fov,cell_ID,target,x_global_px,y_global_px,z,extra\n1,2,g1,10.5,20.5,0,x\n2,0,g2,1,2,1,x\n2,3,g1,5,6,1,x\n")
    got = sorted((r.fov, r.cell_id, r.feature_name, r.x) for r in readers.read_cosmx_points(spark, path).collect())
    assert got == [(1, 6, "g1", 10.5), (2, 0, "g2", 1.0), (2, 11, "g1", 5.0)]


def test_rebuild_cosmx(spark, tmp_path):
    put(tmp_path / "calls/Run_FOV001.csv", "x,y,z,target,CellId\n1,2,0,g1,1\n3,4,0,g1,1\n5,6,0,g2,0\n")
    put(tmp_path / "calls/Run_FOV002.csv", "x,y,z,target,CellId\n1,1,0,g3,2\n")
    put(tmp_path / "calls/Run_FOV009.csv", "x,y,z,target,CellId\n1,1,0,g3,2\n")
    fovs = put(tmp_path / "a.fovs.csv", "0.1,0.2,0,0,0,1\n0.3,0.4,0,0,0,2\n0.3,0.4,0,0,0,2\n")
    put(tmp_path / "stats/Cell_Stats_FOV001.csv", "CellId,CenterX,CenterY,Area\n1,2,3,9\n2,5,5,4\n")
    put(tmp_path / "stats/Cell_Stats_FOV002.csv", "CellId,CenterX,CenterY,Area\n2,1,1,7\n")
    tx, meta, expr = readers.rebuild_cosmx(spark, f"{tmp_path}/calls", fovs, f"{tmp_path}/stats", 100.0, 11)
    assert sorted((r.fov, r.cell_id, round(r.x, 6), round(r.y, 6)) for r in tx.collect()) == [(1, 0, 15.0, 24.0), (1, 4, 11.0, 28.0), (1, 4, 13.0, 26.0), (2, 8, 31.0, 49.0)]
    assert sorted((r.cell_id, r.n_counts) for r in meta.collect()) == [(4, 2), (5, 0), (8, 1)]
    assert sorted((r.cell_id, r.gene, r["count"]) for r in expr.collect()) == [(4, "g1", 2), (8, "g3", 1)]


def test_merscope_and_boundaries(spark, tmp_path):
    t = put(tmp_path / "t.csv", "gene,global_z,transcript_id,x,y\nA,3,E1,1,2\n")
    g = put(tmp_path / "g.csv", "cell,A,B.1\n10,2,0\n11,0,3\n12,1,1\n")
    m = put(tmp_path / "m.csv", "id,fov\n10,1\n11,1\n")
    pts, cnt = readers.read_merscope(spark, t, g, m)
    assert pts.first().asDict() == {"feature_name": "A", "ensembl_id": "E1", "x": 1.0, "y": 2.0, "z": 3.0}
    assert sorted((r.cell_id, r.gene, r["count"]) for r in cnt.collect()) == [("10", "A", 2), ("11", "B.1", 3)]
    ring = [{"x": 0.0, "y": 0.0}]
    rows = [(1, 0, 1, ring), (1, 3, 2, ring), (2, 5, 1, ring), (2, 4, 2, ring), (3, 3, 1, None), (2, 4, 1, ring)]
    got = readers.pick_boundary(spark.createDataFrame(rows, "cell_id long, z int, seq int, ring array<struct<x:double,y:double>>"))
    assert sorted((r.cell_id, r.z, r.seq) for r in got.collect()) == [(1, 3, 2), (2, 4, 1)]


def test_abca(spark, tmp_path):
    s = put(tmp_path / "s.csv", "global_x,global_y,global_z,target_gene,barcode_id\n10.0,21.0,1.0,A,5\n")
    r = readers.read_abca_spots(spark, s, 100.0, 2.0).first()
    assert (r.x, r.y, r.z, r.feature_name) == (95.0, 10.0, 1.0, "A")
    b = put(tmp_path / "b.csv", ',boundaryX_z0,boundaryY_z0\nc1,"1,2,3","4,5,6"\nc2,,\n')
    rows = readers.read_abca_boundaries(spark, b).collect()
    assert [(r.cell_id, [(p.x, p.y) for p in r.ring]) for r in rows] == [("c1", [(1, 4), (2, 5), (3, 6)])]


def test_matrices(spark, tmp_path):
    m = put(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate integer general\n%\n3 2 4\n1 1 5\n3 1 1\n2 2 7\n3 2 4\n")
    b = put(tmp_path / "b.tsv", "c1\nc2\n")
    g = put(tmp_path / "g.tsv", "gA\tx\ngB\tx\ngC\tx\n")
    want = [("c1", "gA", 5), ("c1", "gC", 1), ("c2", "gB", 7), ("c2", "gC", 4)]
    assert sorted((r.cell, r.gene, r["count"]) for r in readers.read_mtx(spark, m, b, g).collect()) == want
    d = tmp_path / "d.tsv.gz"
    with gzip.open(d, "wt") as f:
        f.write("\tc1\tc2\ngA\t5\t0\ngB\t0\t7\ngC\t1\t4\n")
    cells = spark.createDataFrame([("c2",), ("c1",)], "cell string")
    assert sorted((r.cell, r.gene, r["count"]) for r in readers.read_dense_matrix(spark, str(d), cells).collect()) == want
    with pytest.raises(ValueError):
        readers.read_dense_matrix(spark, str(d), cells.limit(1))


def test_regions_tables_and_metadata(spark, tmp_path):
    for name in ("OLF-1", "TH-1", "CB-1"):
        spark.createDataFrame([("c1", name, 1), ("c9", name, 2)], "cell string, gene string, count long").coalesce(1).write.parquet(str(tmp_path / "tmp" / name))
        (tmp_path / "regions").mkdir(exist_ok=True)
        part = next((tmp_path / "tmp" / name).glob("*.parquet"))
        part.rename(tmp_path / "regions" / f"{name}.parquet")
    (tmp_path / "regions" / "OLF-bad.parquet").write_bytes(b"PAR1 no file PAR1")
    got = readers.read_regions(spark, str(tmp_path / "regions"), "{OLF,TH}-1*", spark.createDataFrame([("c1",)], "cell string"))
    assert sorted(r.gene for r in got.collect()) == ["OLF-1", "TH-1"]
    writers.write_table(got, str(tmp_path / "out"), "csv")
    writers.write_table(got, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    meta = spark.createDataFrame([("a", "A", "old")], "dataset_id string, dataset_name string, orig_dataset_id string")
    r = stamp_meta(meta, {"dataset_id": "b", "dataset_name": "B"}).first()
    assert (r.dataset_id, r.dataset_name, r.orig_dataset_id) == ("b", "B", "a") and "orig_dataset_name" not in r.asDict()


def test_experiments_and_cells_of_a_matrix(spark, tmp_path):
    e = put(tmp_path / "e.csv", "animal_id,experiment_id,sample_id\nm1,adaptor,s0\nm1,old,s1\nm2,good,s2\n")
    rows = readers.read_experiments(spark, e, ("adaptor",), {"old": "new"}).collect()
    assert sorted((r.experiment_id, r.sample_id) for r in rows) == [("good", "s2"), ("new", "s1")]
    o = put(tmp_path / "o.csv", "id,kind\n1,T\n1,B\n2,T\n")
    b = put(tmp_path / "b.tsv", "c9\nc1\nc5\n")
    assert sorted((r.cell, r.id, r.kind) for r in readers.read_mtx_obs(spark, o, b).collect()) == [("c1", "1", "B"), ("c5", "2", "T"), ("c9", "1", "T")]
    with pytest.raises(ValueError):
        readers.read_mtx_obs(spark, o, put(tmp_path / "b2.tsv", "c9\nc1\n"))


def test_text_parts_are_read_in_their_order(spark, tmp_path):
    """Parts whose sizes fall the other way: Spark hands out the largest first."""
    kinds = [["k" * (n + 1), "T" * 50 * (n + 1)] for n in range(6)]
    for n, own in enumerate(kinds):
        put(tmp_path / f"obs/part-{n:05d}.csv", "kind\n" + "\n".join(own) + "\n")
        put(tmp_path / f"names/part-{n:05d}.txt", f"c{2 * n}\nc{2 * n + 1}\n")
    got = {r.cell: r.kind for r in readers.read_mtx_obs(spark, str(tmp_path / "obs"), str(tmp_path / "names")).collect()}
    assert got == {f"c{2 * n + k}": own[k] for n, own in enumerate(kinds) for k in (0, 1)}
    put(tmp_path / "mtx/part-00000", "%%MatrixMarket\n2 12 2\n")
    put(tmp_path / "mtx/part-00001", "1 3 5\n2 12 2\n" + "% a longer part\n" * 20)
    g = put(tmp_path / "g.tsv", "gA\ngB\n")
    assert sorted((r.cell, r.gene, r["count"]) for r in readers.read_mtx(spark, str(tmp_path / "mtx"), str(tmp_path / "names"), g).collect()) == [("c11", "gB", 2), ("c2", "gA", 5)]
    put(tmp_path / "dense/part-00000", "c1\tc2\tc2\n")
    put(tmp_path / "dense/part-00001", "gA\t5\t0\t1\n" + "gB\t0\t7\t0\n" * 9)
    want = [("c1", "gA", 5), ("c2", "gA", 1), *[("c2", "gB", 7)] * 9]
    assert sorted((r.cell, r.gene, r["count"]) for r in readers.read_dense_matrix(spark, str(tmp_path / "dense")).collect()) == want


def test_unreadable_regions_are_reported(spark, tmp_path):
    spark.createDataFrame([("c1", "g", 1)], "cell string, gene string, count long").coalesce(1).write.parquet(str(tmp_path / "tmp"))
    (tmp_path / "regions").mkdir()
    next((tmp_path / "tmp").glob("*.parquet")).rename(tmp_path / "regions" / "TH-1.parquet")
    (tmp_path / "regions" / "TH-2.parquet").write_bytes(b"PAR1 no file PAR1")
    with pytest.warns(UserWarning, match="TH-2"):
        got = readers.read_regions(spark, str(tmp_path / "regions"), "TH-*", spark.createDataFrame([("c1",)], "cell string"))
    assert got.count() == 1


def test_footers_are_checked_in_tasks(spark, tmp_path):
    spark.createDataFrame([("c1", "g", 1)], "cell string, gene string, count long").coalesce(1).write.parquet(str(tmp_path / "tmp"))
    whole = next((tmp_path / "tmp").glob("*.parquet")).read_bytes()
    (tmp_path / "r").mkdir()
    files = {"A-1": whole, "A-2": whole[:-9], "A-3": b"", "A-4": b"PAR1", "A-5": whole[:-20] + b"x" * 12 + whole[-8:], "A-6": whole[:40] + whole[60:], "A-7": b"PAR1" + b"\xff\xff\xff\xffPAR1" + b" " * 4, "B-1": b"other"}
    for name, data in files.items():
        (tmp_path / "r" / f"{name}.parquet").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1].removesuffix(".parquet"): r for r in readers.footers(spark, str(tmp_path / "r"), "A-*").collect()}
    assert sorted(got) == ["A-1", "A-2", "A-4", "A-5", "A-6", "A-7"] and all(got[k].length == len(files[k]) for k in got)
    assert {k for k, r in got.items() if r.fault is None} == {"A-1", "A-6"}  # A-6: its footer is whole
    assert readers.footers(spark, str(tmp_path / "r"), "C-*").count() == 0


def test_sidecar(spark):
    rows = [(json.dumps({"analysis_sw_version": "xenium-3.1.0"}),), ("{}",), ("no json",)]
    df = spark.createDataFrame(rows, "j string").select(scalars.software_major(F.col("j")).alias("v"))
    assert [r.v for r in df.collect()] == [3, 0, 0]


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    from molgrid.operators.aggregate import count_matrix
    from molgrid.plans.bindings import points

    points(spark, sf_dir).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_counts(stream, "running_counts", str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.table("running_counts").exceptAll(count_matrix(batch)).isEmpty()
    assert spark.table("running_counts").count() == count_matrix(batch).count()


def test_regions_are_written_by_all_tasks(spark, sf_dir, monkeypatch):
    """The query's files come from tasks of their own, not from one task for each segment."""
    from molgrid.plans.queries import QUERIES

    def refused(self, n):
        raise AssertionError("all rows in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    got = QUERIES["a15_read_regions"](spark, sf_dir)
    assert got.count() > 0 and len(got.inputFiles()) >= 2
