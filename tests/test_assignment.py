"""The probabilistic assignment against a dense reference written with loops."""

import math
from pathlib import Path

import numpy as np
import pytest

from molgrid.operators import assignment

GENES, TYPES = [f"g{k}" for k in range(8)], ["a", "b", "c"]


def test_digamma():
    assert assignment.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-10)
    for x in (0.1, 0.7, 2.0, 31.5):
        assert assignment.digamma(np.array([x + 1]))[0] == pytest.approx(assignment.digamma(np.array([x]))[0] + 1 / x, abs=1e-9)
        h = 1e-5
        assert assignment.digamma(np.array([x]))[0] == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), abs=1e-5)


def dense(pts, cells, mu, rounds, k=2, radius=60.0, bonus=2.0, misread=1e-5, r_gene=20.0, inefficiency=0.2, r=2.0, reg=0.1, empty=0.5):
    """Loops over cells, genes and types; pts: (gene, x, y, prior), cells: (x, y, area)."""
    n_cells, n_genes, n_types = len(cells), *mu.shape
    sizes = [a for *_, a in cells if a]
    area = [a / (sum(sizes) / len(sizes)) if a else 1.0 for *_, a in cells]
    near = []
    for g, x, y, prior in pts:
        d = sorted((math.dist((x, y), c[:2]), i) for i, c in enumerate(cells))
        near.append([(i, far, prior == i) for far, i in d[:k] if far <= radius])
    all_d = [far**2 for own in near for _, far, _ in own]
    spread = sum(all_d) / len(all_d)
    s2 = []
    for c in range(n_cells):
        own = [far**2 for ones in near for i, far, inside in ones if i == c and inside]
        s2.append((sum(own) + 10 * spread) / (2 * (len(own) + 10)))
    p = np.tile([(1 - empty) / n_types] * n_types + [empty], (n_cells, 1))
    eta, n = np.full(n_genes, inefficiency), np.zeros((n_cells, n_genes))
    for _ in range(rounds):
        share = []
        for (g, *_), own in zip(pts, near):
            l = []
            for c, far, inside in own:
                e = p[c, -1] * (math.log(reg) - math.log(r)) + assignment.digamma(np.array([r + n[c, g]]))[0]
                for t in range(n_types):
                    m = area[c] * mu[g, t] * eta[g]
                    e += p[c, t] * (math.log(m + reg) - math.log(r + m))
                l.append(-(far**2) / (2 * s2[c]) - math.log(2 * math.pi * s2[c]) + bonus * inside + e)
            whole = sum(map(math.exp, l)) + misread
            share.append([math.exp(v) / whole for v in l])
        # expectations are of the efficiency before, types and efficiency of the counts since
        n = np.zeros((n_cells, n_genes))
        for (g, *_), own, s in zip(pts, near, share):
            for (c, *_), v in zip(own, s):
                n[c, g] += v
        for c in range(n_cells):
            l = []
            for t in [*range(n_types), None]:
                v = math.log((1 - empty) / n_types if t is not None else empty)
                for g in range(n_genes):
                    m = (area[c] * mu[g, t] * eta[g] if t is not None else 0) + reg
                    v += n[c, g] * math.log(m / (m + r)) - r * math.log(1 + m / r)
                l.append(v)
            e = np.exp(np.array(l) - max(l))
            p[c] = e / e.sum()
        old, due = eta.copy(), np.zeros(n_genes)
        for c in range(n_cells):
            for g in range(n_genes):
                for t in range(n_types):
                    due[g] += p[c, t] * mu[g, t] * area[c] * (r + n[c, g]) / (r + area[c] * mu[g, t] * old[g])
        eta = (r_gene + (n * (1 - p[:, -1:])).sum(axis=0)) / (r_gene / inefficiency + due)
        yield near, share, p.copy(), eta.copy()


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(7)
    mu = np.where(rng.random((8, 3)) < 0.3, 12.0, 0.5)
    cells = [(50.0 * (c % 5), 50.0 * (c // 5), [0, 900.0, 1500.0][c % 3]) for c in range(15)]
    pts = []
    for c, (x, y, _) in enumerate(cells[:13]):  # two cells have no molecules of their own
        weight = mu[:, c % 3]
        for _ in range(25):
            pts.append((int(rng.choice(8, p=weight / weight.sum())), x + rng.normal() * 9, y + rng.normal() * 9, c if rng.random() < 0.7 else -1))
    pts.append((0, 4000.0, 4000.0, -1))
    return pts, cells, mu


def frames(spark, scene):
    pts, cells, mu = scene
    rows = [(f"m{i}", float(x), float(y), GENES[g], prior + 1) for i, (g, x, y, prior) in enumerate(pts)]
    rows.append(("alien", 0.0, 0.0, "no such gene", 1))
    return (
        spark.createDataFrame(rows, "transcript_id string, x double, y double, feature_name string, cell_id long").repartition(3),
        spark.createDataFrame([(c + 1, x, y, float(a)) for c, (x, y, a) in enumerate(cells)], "cell_id long, x double, y double, area double").repartition(2),
        spark.createDataFrame([(t, g, float(mu[i, k])) for i, g in enumerate(GENES) for k, t in enumerate(TYPES)], "cell_type string, gene string, mean double"),
    )


@pytest.mark.parametrize("rounds", [1, 2])
def test_equals_the_dense_reference(spark, scene, rounds):
    with pytest.warns(UserWarning, match="still moved"):
        out = assignment.probabilistic_assign(*frames(spark, scene), neighbours=2, max_iter=rounds, tolerance=0.0)
    got = {r.transcript_id: r for r in out.collect()}
    near, share, p, _ = list(dense(*scene, rounds))[-1]
    assert len(got) == len(scene[0]) + 1 and got["alien"].cell_id == 0 and got["alien"].cell_type is None
    names = [*TYPES, "None_sp"]
    for i, (own, s) in enumerate(zip(near, share)):
        best = max(s, default=0.0)
        background = 1 - sum(s)
        r = got[f"m{i}"]
        assert r.prob == pytest.approx(max(best, background), abs=1e-9)
        if abs(best - background) > 1e-9:
            cell = own[s.index(best)][0] + 1 if best > background else 0
            assert r.cell_id == cell
            if cell:
                assert r.cell_type == names[int(p[cell - 1].argmax())] and r.cell_type_prob == pytest.approx(p[cell - 1].max(), abs=1e-9)


def test_converges_and_keeps_no_rounds(spark, scene):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {f.name for f in shared.glob("molgrid-*")}
    rows = assignment.probabilistic_assign(*frames(spark, scene), neighbours=2).collect()
    left = sorted(f.name.split("-")[1] for f in shared.glob("molgrid-*") if f.name not in before)
    assert left == ["candidates", "cells", "shares"]
    *_, (near, share, p, eta) = dense(*scene, 40)
    names, same = [*TYPES, "None_sp"], 0
    got = {r.transcript_id: r for r in rows}
    for i, (own, s) in enumerate(zip(near, share)):
        cell = own[int(np.argmax(s))][0] if s and max(s) > 1 - sum(s) else None
        r = got[f"m{i}"]
        same += (r.cell_id, r.cell_type) == ((0, None) if cell is None else (cell + 1, names[int(p[cell].argmax())]))
    assert same >= 0.98 * len(near)


def test_an_empty_cell_has_no_type(spark, scene):
    """One stray molecule makes no typed cell."""
    pts, cells, mu = scene
    only = ([(0, 1.0, 1.0, 0)], cells[:2], mu)
    r = [r for r in assignment.probabilistic_assign(*frames(spark, only), neighbours=2).collect() if r.transcript_id == "m0"][0]
    assert r.cell_id in (0, 1) and r.cell_type in (None, "None_sp")


def test_a_profile_beyond_the_bound_is_refused(spark, scene, monkeypatch):
    monkeypatch.setattr(assignment, "LARGEST_PROFILE", 5)
    with pytest.raises(ValueError, match="profile"):
        assignment.probabilistic_assign(*frames(spark, scene))


def test_rounds_do_not_shuffle_molecules(spark):
    """Where cells are few, molecules stand in one row with their candidates and meet their rates by a broadcast."""
    from molgrid.operators import assignment, spatial

    pts = spark.range(3000).selectExpr("id as transcript_id", "cast(id % 60 as double) as x", "cast(id % 50 as double) as y")
    cells = spark.range(20).selectExpr("id", "id * 3.0 as x", "id * 2.0 as y")
    plan = spatial.spatial_knn(pts.withColumnRenamed("transcript_id", "id"), cells, 2, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    candidates = pts.selectExpr("transcript_id", "1 as g", "transcript_id % 20 as c0", "-1.0 as w0", "cast(null as bigint) as c1", "cast(null as double) as w1")
    expected = spark.range(20).selectExpr("id as cell_id", "1 as g", "0.5 as e")
    shared = assignment._shared_out(candidates, expected, 2, 1e-5)
    assert "Exchange hashpartitioning" not in shared._jdf.queryExecution().executedPlan().toString()
    row = shared.first()
    assert row.p1 is None and 0.99 < row.p0 < 1
