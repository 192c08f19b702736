import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from molgrid.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def check(rows, docs, tokenizer):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    total = 0
    for doc, text in docs.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and r.length <= 1024 and (r.length == 1024 or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        total += len(ids)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), -(-total // 1024)


def test_edge_rows(edge_docs, edge_rows, tokenizer):
    distinct = {d: t for d, t in edge_rows if d is not None and [x for x, _ in edge_rows].count(d) == 1}
    rows = packing.pack(edge_docs, VOCABULARY).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.piece == 0 for r in rows) == len(edge_rows)
    check([r for r in packing.pack(edge_docs.where(edge_docs.doc_id.isin(*distinct)), VOCABULARY).collect()], distinct, tokenizer)


def test_white_space_is_encoded_like_the_library(tokenizer):
    encode = packing.encoder(VOCABULARY)
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "12", "!", " ", " ", "🙂"]) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_given_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    used, bound = check(packing.pack(docs, VOCABULARY).collect(), texts, tokenizer)
    assert used <= bound + 2


def test_solver_is_close_to_the_bound():
    rng = random.Random(2)
    hist = Counter(min(1023, max(1, int(rng.gauss(420, 260)))) for _ in range(40_000))
    groups = packing.solve(hist, 1024)
    placed = Counter()
    for shape, bins in groups:
        assert sum(k * n for k, n in shape) <= 1024
        for k, n in shape:
            placed[k] += n * bins
    assert placed == hist
    assert sum(n for _, n in groups) <= 1.002 * sum(k * n for k, n in hist.items()) / 1024


def fewest(pieces, capacity):
    """By trying every placement."""
    best = len(pieces)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(pieces):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= pieces[at] and rooms[k] not in rooms[:k]:
                place(at + 1, [r - pieces[at] * (i == k) for i, r in enumerate(rooms)])
        place(at + 1, [*rooms, capacity - pieces[at]])

    place(0, [])
    return best


def test_plan_against_every_placement():
    rng = random.Random(7)
    for _ in range(40):
        capacity = rng.choice((10, 17, 30))
        pieces = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        p = packing.plan(Counter(pieces), capacity)
        least = fewest(pieces, capacity)
        assert p.bound <= least <= p.sequences <= least + (least > 3)
        assert sum(n for _, n in p.groups) == p.sequences
        placed = Counter()
        for shape, bins in p.groups:
            assert sum(k * n for k, n in shape) <= capacity
            for k, n in shape:
                placed[k] += n * bins
        assert placed == Counter(pieces)


def test_bound_and_weights_where_volume_alone_says_little():
    # 600s cannot share a bin with each other, 500s go in pairs: 120 bins are needed, 102 by volume
    p = packing.plan({600: 100, 500: 40, 400: 60}, 1024)
    assert 114 <= p.bound <= p.sequences == 120 and p.fractional == pytest.approx(120, rel=0.002)
    p = packing.plan({350: 200, 340: 200, 330: 200, 520: 50}, 1024)
    assert p.sequences <= p.bound + 1


def test_knapsack():
    assert packing.price(np.array([3, 5]), np.array([3.0, 5.0]), 8) == {3: 1, 5: 1}
    assert packing.price(np.array([3, 5]), np.array([3.0, 4.0]), 9) == {3: 3}
    assert packing.price(np.array([3, 5]), np.array([3.0, 4.0]), 9, np.array([1, 5])) == {3: 1, 5: 1}


def test_special_tokens_are_those_of_the_library(tokenizer):
    encode = packing.encoder(VOCABULARY)
    assert np.frombuffer(encode("text <|endoftext|> more"), "<u4").tolist() == [5239, 220, 50256, 517]
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", " ", "<|endoftext|>", "<|end", "oftext|>", "|>", "\n", "é"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_empty(no_docs):
    assert packing.pack(no_docs, VOCABULARY).count() == 0


@pytest.mark.parametrize("n", [300, 60_000])
def test_rounds_do_not_depend_on_the_size(monkeypatch, n):
    """What is left over after whole bins is covered for as many rounds in large tables as in small ones."""
    real, calls = packing.covered, []

    def one_more(prices, need, whole, lean=0.05):
        out = real(prices, need, whole, lean)
        if whole:
            calls.append(n)
            out[0] = (out[0][0], out[0][1] + 1)
        return out

    monkeypatch.setattr(packing, "covered", one_more)
    lengths = np.clip(np.random.default_rng(3).lognormal(5.3, 1.0, n), 1, 1023).astype(int)
    packing.plan(dict(zip(*(v.tolist() for v in np.unique(lengths, return_counts=True)))), 1024, rounds=1, whole_rounds=3)
    assert len(calls) == 3


def test_pieces_come_in_parts_of_a_few_megabytes(spark):
    """A task holds the ids of some texts, not of a whole batch of ten thousand."""
    import pyarrow as pa

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = packing.pieces(Docs(), VOCABULARY, with_ids=True)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["some words " * 70_000, None, "", "more words " * 150_000])], names=["doc_id", "text"])
    parts = list(run(iter([batch])))
    assert len(parts) > 1
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows if not r["piece"]] == [1, 2, 3, 4]
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 1024 and zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r["ids_crc32"]
