import zlib

import numpy as np

from molgrid.llm import toxicity
from molgrid.llm.toxicity import Config


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.report(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").toPandas()
    assert all(scored["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored["doc_id"]])
    own = scored[scored["held_out"]]
    positive, negative = own[own["toxic"] == 1]["score"].to_numpy(), own[own["toxic"] == 0]["score"].to_numpy()
    auc = (positive[:, None] > negative[None, :]).mean()
    assert auc > 0.9 and (own["predicted"] == own["toxic"]).mean() > 0.9


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re") for b in ("ban", "dor", "fel") for c in ("to", "na", "s")]
    texts, y = [], []
    for k in range(200):
        own = rng.choice(words, 60).tolist()
        if k % 3 == 0:
            own.insert(int(rng.integers(60)), "stupid")
        texts.append(" ".join(own))
        y.append(int(k % 3 == 0))
    model = toxicity.fit(texts, np.array(y), Config(buckets=1 << 14))
    seen = toxicity._Words(model)
    clean = " ".join(words[:30])
    assert toxicity.score_text(clean + " stuupid " + clean, seen) > toxicity.score_text(clean + " " + clean, seen)


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.report(edge_docs, none).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score < 0.5 and r.predicted == 0 and r.held_out is not None for r in rows)
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.report(edge_docs, some).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.report(no_docs, some).count() == 0
    assert toxicity.keep_clean(edge_docs, none).columns == edge_docs.columns
    alike = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(alike) == 1  # no words: one score


def test_passages():
    assert toxicity.passage_starts(0, 5).tolist() == [0]
    assert toxicity.passage_starts(12, 5).tolist() == [0, 5]
    assert toxicity.passage_starts(13, 5).tolist() == [0, 5, 10]
