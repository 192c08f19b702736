import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from molgrid.llm import addressable

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


class Counted(io.BytesIO):
    """A file that tells how many bytes were read from it."""

    bytes_read = 0

    def read(self, size=-1):
        out = super().read(size)
        self.bytes_read += len(out)
        return out


def opened(ids, docs=1):
    cuts = np.linspace(0, len(ids), docs + 1).astype(int)
    return addressable.Codes(Counted(b"".join(addressable.file_bytes(list(range(docs)), np.diff(cuts).tolist(), np.array(ids, "<u4")))))


def expected(rows, tokenizer):
    out, start = [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["zipf", "uniform", "zeros", "large", "one", "none", "lengths"])
def test_codes_round_trip(kind):
    rng = np.random.default_rng(3)
    ids = {
        "zipf": np.minimum(rng.zipf(1.3, 30_000), 50_000), "uniform": rng.integers(0, 50_257, 5_000), "zeros": np.zeros(5_000, int), "large": rng.integers(0, 2**32, 3_000),
        "one": np.array([7]), "none": np.array([], int), "lengths": np.repeat([0, 1, 255, 256, 65_535, 65_536, 2**32 - 1], 513),
    }[kind].astype(np.uint32)
    codes = opened(ids)
    assert len(codes) == len(ids) and codes.part(0, len(ids)).tolist() == ids.tolist()
    for i in rng.integers(0, len(ids), 300) if len(ids) else []:
        assert codes[int(i)] == ids[i]
        stop = int(rng.integers(i, len(ids) + 1))
        assert codes.part(int(i), stop).tolist() == ids[i:stop].tolist()
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_rank_equals_a_count():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 50_257, 20_000)
    codes = opened(ids)
    left = ids
    for width, n, places in codes.levels[:-1]:
        goes_on = left >> width > 0
        assert n == len(left)
        for i in [0, 1, 7, 8, 511, 512, 513, 1024, n - 1, *rng.integers(0, n, 50).tolist()]:
            assert codes._rank(places, i) == goes_on[:i].sum()
        left = (left >> width)[goes_on]


def test_one_token_needs_few_bytes():
    codes = opened(np.minimum(np.random.default_rng(5).zipf(1.2, 400_000), 50_000))
    codes.source.bytes_read = 0
    for i in range(0, 400_000, 4_001):
        codes[i]
    assert codes.source.bytes_read < 100 * 100 * len(codes.levels)


def test_widths_are_the_cheapest():
    rng = random.Random(6)
    for _ in range(20):
        lengths = np.array([rng.choice([0, 0, rng.randint(0, 1000)]) for _ in range(9)] + [0] * 23)
        top = max(np.flatnonzero(lengths), default=0) + 1

        def cost(widths):
            total = at = 0
            for w in widths:
                total += lengths[at:].sum() * (w + (at + w < top) + addressable.LEVEL_COST)
                at += w
            return total

        def splits(n):
            return [[n]] + [[k, *rest] for k in range(1, n) for rest in splits(n - k)]

        assert cost(addressable.widths_for(lengths)) == pytest.approx(min(map(cost, splits(top))))


def test_edge_rows(spark, tmp_path, edge_docs, edge_rows, tokenizer):
    folder = f"file://{tmp_path}/tokens"
    addressable.write(edge_docs, VOCABULARY, folder, file_tokens=500)
    rows = addressable.read(spark, folder).orderBy("start").collect()
    texts = {}
    for doc, text in edge_rows:
        texts.setdefault(doc, []).append(text)
    order = []
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        text = next(t for t in texts[r.doc_id] if tokenizer.encode(t or "", add_special_tokens=False).ids + [0] == ids)
        texts[r.doc_id].remove(text)
        order.append((r.doc_id, text))
    assert not any(texts.values()) and [d for d, _ in order] == sorted((d for d, _ in edge_rows), key=lambda d: (d is not None, d))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == expected(order, tokenizer)
    assert len(addressable.manifest(folder)["files"]) > 3


def test_empty_table(spark, no_docs):
    assert addressable.report(no_docs, VOCABULARY).count() == 0


def test_given_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").select("doc_id", "text").collect()]
    got = sorted(map(tuple, addressable.report(docs, VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == [r[:4] for r in expected(rows, tokenizer)]


def test_repeated_row_in_many_files(spark, tmp_path, tokenizer):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(5)).alias("doc_id"), F.lit("same words here").alias("text"))
    addressable.write(docs, VOCABULARY, str(tmp_path / "t"), file_tokens=1000)
    rows = addressable.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    n = len(tokenizer.encode("same words here").ids) + 1
    assert [r.start for r in rows] == list(range(0, 3000 * n, n)) and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    held = addressable.manifest(str(tmp_path / "t"))
    assert held["docs"] == 3000 and held["tokens"] == 3000 * n and max(f["tokens"] for f in held["files"]) <= 1000


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    folder = tmp_path / "t"
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    addressable.write(docs, VOCABULARY, str(folder))
    (folder / "part-000000-0000-lost.tok").write_bytes(b"half a file")
    assert addressable.read(spark, str(folder)).count() == 2


def test_tokens_at_positions(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = str(tmp_path / "t")
    addressable.write(docs, VOCABULARY, folder, file_tokens=3000)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in addressable.read(spark, folder).orderBy("start").collect()])
    rng = random.Random(8)
    asked = [rng.randrange(len(ids)) for _ in range(800)] + [0, len(ids) - 1, len(ids), -1, None] + [17] * 400
    got = addressable.tokens_at(spark.createDataFrame([(p,) for p in asked], "position long"), folder).collect()
    assert sorted((str(r.position), r.token) for r in got if r.token is not None) == sorted((str(p), int(ids[p])) for p in asked if p is not None and 0 <= p < len(ids))
    assert len(got) == len(asked) and {r.position for r in got if r.token is None} == {len(ids), -1, None}
