import random

import numpy as np
from xxhash import xxh64_intdigest

from molgrid.llm import simhash
from molgrid.llm.components import connected_components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    of = {f: f for f in fps}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    every = list(of)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                of[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_against_brute_force(edge_docs, edge_rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(edge_docs).collect()), key=repr)
    fps = [brute_fp(t) for _, t in edge_rows]
    comp = brute_components(set(fps))
    low = {}
    for (doc, _), f in zip(edge_rows, fps):
        if doc is not None:
            low[comp[f]] = min(low.get(comp[f], doc), doc)
    assert got == sorted(((d, f"{f:016x}", low.get(comp[f])) for (d, _), f in zip(edge_rows, fps)), key=repr)


def test_links_in_crowded_buckets(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(fps)
    for tile in (8, 512):
        roots = {r.node: r.root for r in connected_components(simhash.links(distinct, 2, tile)).collect()}
        groups = {}
        for x in signed:
            groups.setdefault(roots.get(x, x), set()).add(x % (1 << 64))
        expected = {}
        for f, r in want.items():
            expected.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    n = 300
    rows = [(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1001)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_one_of_each_group_stays(spark, edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 7 in ids and 8 not in ids and 11 in ids and 12 not in ids and 3 in ids and 4 not in ids
    assert ids.count(9) == 2  # an id with two texts: each is judged by itself
    assert simhash.report(no_docs).count() == 0
