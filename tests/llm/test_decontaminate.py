import hashlib
import re

import pytest

from molgrid.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item) if item is not None else None)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in windows}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[g] - {None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (10, " ".join(f"shared{k}" for k in range(5, 20))),
    (9, " ".join(f"SHARED{k}" for k in range(8, 22))),
    (3, "one"),
    (4, "alpha, beta"),
    (5, None),
    (6, ""),
    (None, "quite different from"),
    (7, "ÜNÏCÖDÉ ça ñandú"),
]


@pytest.mark.parametrize("limit", [256 << 20, 0])
def test_against_brute_force(spark, edge_docs, edge_rows, limit):
    items = spark.createDataFrame([(*x, "x") for x in ITEMS], "item_id long, text string, key string")
    got = decontaminate.contamination(edge_docs, items, broadcast_bytes=limit)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got.collect()]
    assert sorted(got, key=repr) == sorted([r[:4] for r in brute(edge_rows, ITEMS)], key=repr)
    full = [tuple(r) for r in decontaminate.report(edge_docs, items).collect()]
    assert sorted(full, key=repr) == brute(edge_rows, ITEMS)


def test_empty_tables(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(no_docs, none).count() == 0
    assert decontaminate.report(edge_docs, none).where("contaminated").count() == 0


def test_documents_and_spans_go(spark, edge_docs):
    items = spark.createDataFrame([(1, " ".join(f"shared{k}" for k in range(60)))], "item_id long, text string")
    kept = decontaminate.decontaminate(edge_docs, items)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    cut = decontaminate.decontaminate(edge_docs, items, mode="spans")
    texts = {r.text for r in cut.where("doc_id = 2").collect()}
    assert texts == {"Other words before it. And words behind it."}
    assert cut.count() == edge_docs.count()


def test_plan_is_native(edge_docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate.report(edge_docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
