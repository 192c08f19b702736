import hashlib
import random

from molgrid.llm import suffixes


def brute(rows, length=50):
    texts = [((1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, b), (own, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows(edge_docs, edge_rows):
    assert sorted((tuple(r) for r in suffixes.deduplicated(edge_docs).collect()), key=repr) == brute(edge_rows)


def test_many_overlapping_copies(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab cd") for _ in range(400)) for _ in range(4)]
    rows = []
    for k in range(120):
        text = ""
        for _ in range(rng.randint(1, 5)):
            b = rng.choice(base)
            i = rng.randrange(300)
            text += b[i : i + rng.randint(30, 140)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 20)))
        rows.append((rng.randrange(100), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in suffixes.deduplicated(docs).collect()), key=repr) == brute(rows)


def test_spans_and_kept_bytes(spark, no_docs):
    docs = spark.createDataFrame([(1, "x" * 60), (2, "abc" + "x" * 60 + "def")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.deduplicated(docs, texts=True).collect()}
    assert [(s.start, s.end) for s in got[2].spans] == [(3, 63)] and bytes(got[2].kept) == b"abcdef"
    assert got[1].n_removed == 0
    assert suffixes.deduplicated(no_docs).count() == 0


def test_multikey_order_is_the_order_of_the_bytes():
    import numpy as np

    rng = np.random.default_rng(3)
    n = 5000
    rec = {k: np.zeros(n, t) for k, t in suffixes.KINDS.items()}
    for k, size in zip(suffixes.ORDER, (40, 4, 3, 5)):
        rec[k] = rng.integers(0, size, n).astype(suffixes.KINDS[k])
    rec["lead"][:50] = np.arange(1000, 1050)
    order, new_token, new_run = suffixes.multikey_ties(rec)
    keys = list(zip(*(rec[k].tolist() for k in suffixes.ORDER)))
    from collections import Counter

    often = Counter(k[:2] for k in keys)
    want = sorted(k for k in keys if often[k[:2]] > 1)
    got = [keys[i] for i in order]
    assert got == want
    assert [bool(x) for x in new_token] == [i == 0 or got[i][:2] != got[i - 1][:2] for i in range(len(got))]
    assert [bool(x) for x in new_run] == [i == 0 or got[i][:3] != got[i - 1][:3] for i in range(len(got))]


def test_over_full_buckets_are_split_again(spark):
    rng = random.Random(6)
    shared = "one passage that very many of these documents share, word for word, again and again. "
    rows = [(k % 300, "".join(rng.choice("abcdef gh") for _ in range(rng.randint(0, 300))) + shared * rng.randint(0, 3)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    numbered = suffixes.numbered(docs)
    plain = sorted(tuple(r) for r in suffixes.repeated_runs(numbered).distinct().collect())

    def bytes_of(runs):
        return {(d, nth, i) for d, nth, run in runs for i in range(run >> 8, (run >> 8) + (run & 255))}

    tiny = suffixes.repeated_runs(numbered, bucket_bytes=2000, most_buckets=3, room=3000, at_once=4000).collect()
    assert bytes_of(tiny) == bytes_of(plain) and len(plain) > 300
