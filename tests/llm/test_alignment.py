import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from molgrid.llm import alignment

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(VOCABULARY, MODEL)


@pytest.fixture(scope="module")
def tokens():
    """text -> (ids and ends in bytes) of A and of B for whole texts, by the libraries alone; None where bytes differ."""
    a, b = Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    names = {v: k for k, v in a.get_vocab().items()}
    # GPT-2's letters, from a text that has every byte: the library writes it down itself
    letter = {}
    for n in range(256):
        found = "".join(names[i] for i in a.encode(chr(n), add_special_tokens=False).ids)
        for c, byte in zip(found, chr(n).encode()):
            letter[c] = byte
    for lead in range(0xC2, 0xF5):
        char = bytes([lead, *{2: [0x80], 3: [0xA0 if lead == 0xE0 else 0x80, 0x80], 4: [0x90 if lead == 0xF0 else 0x80, 0x80, 0x80]}[2 if lead < 0xE0 else 3 if lead < 0xF0 else 4]]).decode()
        for c, byte in zip("".join(names[i] for i in a.encode(char, add_special_tokens=False).ids), char.encode()):
            letter[c] = byte

    def run(text):
        if not text:
            return None
        target = f" {text}".encode()
        sides = []
        for ids, raw in (
            (own := a.encode(f" {text}", add_special_tokens=False).ids, [bytes(letter[c] for c in names[i]) for i in own]),
            (own := b.encode(text), [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in own for p in [b.id_to_piece(i)]]),
        ):
            if b"".join(raw) != target:
                return None
            ends, at = [], 0
            for r in raw:
                at += len(r)
                ends.append(at)
            sides.append((ids, ends))
        return sides

    return run


def groups_of(sides):
    (a, a_ends), (b, b_ends) = sides
    out, i, k = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        j, n = a_ends.index(end, i) + 1, b_ends.index(end, k) + 1
        out.append((a[i:j], b[k:n]))
        i, k = j, n
    return out


def brute(rows, tokens):
    each = [(doc, tokens(text)) for doc, text in rows]
    groups = [(doc, sides, groups_of(sides) if sides else []) for doc, sides in each]
    count = Counter((a[-1], b[-1]) for _, _, own in groups for a, b in own)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc, sides, own in groups:
        links = [(a[-1], b[-1]) for a, b in own]
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        out.append((
            doc, len(sides[0][0]) if sides else 0, len(sides[1][0]) if sides else 0, len(own), len(links), sum(count[x] == most[x[1]] for x in links),
            sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if sides else "",
        ))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, *map(lambda v: v or 0, r[:-1]), r[-1]))


ODD = ["漢字", "漢", "字字", "🙂", "👩‍👩‍👧", "é", "é", "ﬁ", "▁", "<s>", "<|endoftext|>", "<0x41>", "\x00", "\t", "\n\n", " ", "  ", "   ", "Ωmega", "'s", "don't", "12345", "...", " ", "​", "\x1c", "\x85", "word", "Wörd", "한국어", "ป่า", "a" * 50, "=-=-", "\r\n", "</s>", "unk", "\n", "Satz.", "no", ",", "'ll", "e.g.", "x1", "-"]


def test_spans_and_bytes_agree(pair, tokens):
    """Groups from coarse cuts, refined by bytes, are those of all common ends of bytes."""
    rng = random.Random(1)
    told = 0
    for _ in range(3000):
        text = "".join(rng.choice(ODD) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 12)))
        want, found = tokens(text), pair.align(text)
        assert (found is None) == (want is None), repr(text)
        if want:
            assert [(found.a[i:j], found.b[k:n]) for i, j, k, n in found.groups()] == groups_of(want), repr(text)
            told += any(len(a) > 1 and len(b) > 1 for a, b in groups_of(want))
    assert told > 100


def test_parts_give_the_whole(pair, tokens):
    """Texts aligned part by part are the whole texts aligned at once."""
    assert pair.cut
    rng, known = random.Random(2), alignment.Parts(pair, most=300, longest=5, at_once=7)
    for _ in range(200):
        texts = ["".join(rng.choice(ODD) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(10)]
        known.learn([pair.parts(text) for text in texts])
        for text in texts:
            own, whole = [known[p] for p in pair.parts(text)], pair.align(text)
            assert (None in own) == (whole is None), repr(text)
            if whole:
                assert ";".join(p[3] for p in own) == ";".join(whole.written()) and [sum(p[k] for p in own) for k in range(2)] == [len(whole.a), len(whole.b)]
                assert b"".join(p[2] for p in own) == whole.links().tobytes()


@pytest.mark.parametrize("high", [0x7F, 0x250, 0x3000])
def test_parts_of_any_characters(pair, high):
    """Every code point up to `high` beside letters, signs, digits, spaces and lines."""
    rng, known = random.Random(high), alignment.Parts(pair)
    for _ in range(1500 if high < 0x3000 else 3000):
        text = "".join(chr(rng.randint(0, high)) if rng.random() < 0.4 else rng.choice("aB.,'\n 7×é—") for _ in range(rng.randint(1, 14)))
        known.learn([pair.parts(text)])
        own, whole = [known[p] for p in pair.parts(text)], pair.align(text)
        assert (None in own) == (whole is None), repr(text)
        if whole:
            assert ";".join(p[3] for p in own) == ";".join(whole.written()), repr(text)


@pytest.mark.parametrize("hot_pairs", [2_000_000, 40, 0])
def test_brute_force(spark, sf_dir, tokens, hot_pairs):
    """All pairs broadcast, some, or none: the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert ordered(alignment.linked(docs, VOCABULARY, MODEL, hot_pairs).collect()) == ordered(brute(rows, tokens))


def test_edge_rows(spark, edge_docs, edge_rows, tokens):
    assert ordered(alignment.linked(edge_docs, VOCABULARY, MODEL, 20).collect()) == ordered(brute(edge_rows, tokens))


def test_empty_table(no_docs):
    assert alignment.linked(no_docs, VOCABULARY, MODEL).count() == 0
    assert alignment.spans(no_docs, VOCABULARY, MODEL).count() == 0


def test_spans_are_whole(spark, edge_docs, edge_rows):
    rows = alignment.spans(edge_docs, VOCABULARY, MODEL).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert [g.a_from for g in r.groups] + [len(r.a)] * bool(r.a) == [0] * bool(r.a) + [g.a_to for g in r.groups]
        assert [g.b_from for g in r.groups] + [len(r.b)] * bool(r.b) == [0] * bool(r.b) + [g.b_to for g in r.groups]
