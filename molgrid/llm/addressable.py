"""Token ids in files of directly addressable codes: any token is read by itself, without decoding a block.

Ids are split into chunks of bits, low bits first. Level k holds the k-th chunk of every id that has one, packed in
`widths[k]` bits, and a bitmap that says which of them go on at the next level; a directory of ones before every 512
bits makes their place there (the rank) a lookup and a count of at most 64 bytes. The widths of a file are those that
make it smallest, by a dynamic program over the bit lengths of its ids.

Spark reads and writes the files by the source `Tokens` ("token_codes"): each task writes files of about `file_tokens`
ids under new names; the commit lists those of the tasks that count in a manifest, in task order, with the documents
and ids before each. So repeated tasks and lost executors leave nothing that is read. Reading has one partition for
each file. `write` puts documents in ascending order of doc_id by a range shuffle; `tokens_at` looks ids up at given
positions by random access, in tasks balanced by position.

The folder is a URI that `pyarrow.fs` knows (file, hdfs, s3, gs). The manifest is what the driver holds: about 100
bytes a file.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows with the same doc_id are in the
order of a hash of their texts, repeated rows stand beside each other; an empty table gives a manifest without files and
an empty result; other columns are not read; a document longer than `file_tokens` is one file. Strings that are special
tokens of the vocabulary become these tokens, as the `tokenizers` library does it. Positions that are null or outside
of the corpus have a null id.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from molgrid.llm.common import shared_dir, sliced, text_key
from molgrid.llm.packing import encoder

MAGIC = b"TOKCODE1"
MANIFEST = "manifest.json"
RANK_BITS = 512
#: Ids that are packed or unpacked at once.
AT_ONCE = 1 << 18
#: Directory and header cost of one level, in bits for an id; it keeps levels few.
LEVEL_COST = 1 / RANK_BITS * 64


def widths_for(lengths: np.ndarray) -> list[int]:
    """Bits of each level, so that ids with these bit lengths (counts of 1, 2, 3, ... bits) take the least room."""
    top = max(int(np.flatnonzero(lengths)[-1]) + 1, 1) if lengths.any() else 1
    longer = np.append(np.cumsum(lengths[:top][::-1])[::-1], 0)  # ids with more than k bits
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for done in range(top - 1, -1, -1):  # the levels that hold the bits from `done` on
        best[done] = min(
            (longer[done] * ((to - done) + (to < top) + LEVEL_COST) + best[to][0], [to - done, *best[to][1]]) for to in range(done + 1, top + 1)
        )
    return best[0][1]


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many ids have 1, 2, ..., 32 bits; zero counts as one bit."""
    return np.bincount(np.frexp(np.maximum(ids, 1).astype(np.float64))[1], minlength=33)[1:33]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    out = []
    step = AT_ONCE  # a multiple of eight, so that parts end at whole bytes
    for first in range(0, len(values), step):
        part = values[first : first + step].astype("<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(data: bytes, start_bit: int, n: int, width: int) -> np.ndarray:
    """n values of `width` bits from bit `start_bit` of `data` on."""
    if width in (8, 16, 32) and not start_bit % 8:
        return np.frombuffer(data, f"<u{width // 8}", n, start_bit // 8).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[start_bit : start_bit + n * width].reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def encoded(ids: np.ndarray) -> tuple[dict, list[bytes]]:
    """The header's part on the levels, and the bytes of each level: chunks, bitmap, directory."""
    left = np.ascontiguousarray(ids, dtype=np.uint32)
    widths = widths_for(bit_lengths(left))
    levels, parts = [], []
    for k, width in enumerate(widths):
        chunks = pack_bits(left if width == 32 else left & np.uint32((1 << width) - 1), width)
        levels.append({"width": width, "n": len(left), "chunks": len(chunks)})
        parts.append(chunks)
        if k + 1 < len(widths):
            left = left >> np.uint32(width)
            goes_on = left > 0
            bitmap = np.packbits(goes_on, bitorder="little").tobytes()
            ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.uint64) if len(goes_on) else np.zeros(0, np.uint64)
            directory = (np.cumsum(ones) - ones).astype("<u8").tobytes()
            levels[-1] |= {"bitmap": len(bitmap), "directory": len(directory)}
            parts += [bitmap, directory]
            left = left[goes_on]
    return {"levels": levels}, parts


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> list[bytes]:
    """A whole file: magic, length of the header, header (JSON), places of the documents, levels."""
    header, parts = encoded(ids)
    places = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits([d is None for d in doc_ids], bitorder="little").tobytes()
    header |= {"docs": len(doc_ids), "tokens": len(ids), "sizes": [len(places), len(names), len(nulls)]}
    head = json.dumps(header).encode()
    return [MAGIC, struct.pack("<Q", len(head)), head, places, names, nulls, *parts]


class Codes:
    """An open file. `codes[i]` and `take` read single ids; `part` reads neighbours; nothing else is read or decoded."""

    def __init__(self, source):
        self.source = source
        magic, size = struct.unpack("<8sQ", self._read(0, 16))
        if magic != MAGIC:
            raise ValueError("not a file of token codes")
        header = json.loads(self._read(16, size))
        at = 16 + size
        self.n_docs, self.n_tokens = header["docs"], header["tokens"]
        self.sections = []
        for n in header["sizes"]:
            self.sections.append((at, n))
            at += n
        self.levels = []
        for level in header["levels"]:
            places = {}
            for name in ("chunks", "bitmap", "directory"):
                if name in level:
                    places[name] = at
                    at += level[name]
            self.levels.append((level["width"], level["n"], places))

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids, and the place of each document's first id, with the end of the last."""
        places, names, nulls = (self._read(*s) for s in self.sections)
        null = np.unpackbits(np.frombuffer(nulls, np.uint8), bitorder="little")[: self.n_docs]
        return [None if gone else d for d, gone in zip(np.frombuffer(names, "<i8").tolist(), null.tolist())], np.frombuffer(places, "<u8").astype(np.int64)

    def __len__(self) -> int:
        return self.n_tokens

    def _rank(self, places: dict, i: int) -> int:
        """Ones of the bitmap before bit i: one directory entry, and the bytes from there on."""
        block = i // RANK_BITS
        before = struct.unpack("<Q", self._read(places["directory"] + 8 * block, 8))[0]
        first = block * RANK_BITS
        bits = int.from_bytes(self._read(places["bitmap"] + first // 8, (i - first + 7) // 8), "little")
        return before + (bits & ((1 << (i - first)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for width, _, places in self.levels:
            bit = i * width
            data = self._read(places["chunks"] + bit // 8, (bit % 8 + width + 7) // 8)
            value |= (int.from_bytes(data, "little") >> bit % 8 & ((1 << width) - 1)) << shift
            if "bitmap" not in places or not self._read(places["bitmap"] + i // 8, 1)[0] >> i % 8 & 1:
                break
            i, shift = self._rank(places, i), shift + width
        return value

    def take(self, positions: list[int]) -> list[int]:
        return [self[i] for i in positions]

    def part(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, from these bits of each level alone."""
        out = np.zeros(stop - start, np.uint32)
        if stop <= start:
            return out
        at, shift, first, n = np.arange(stop - start), 0, start, stop - start
        for width, _, places in self.levels:
            bit = first * width
            data = self._read(places["chunks"] + bit // 8, (bit % 8 + n * width + 7) // 8)
            out[at] |= unpack_bits(data, bit % 8, n, width) << np.uint32(shift)
            if "bitmap" not in places:
                break
            bits = np.unpackbits(np.frombuffer(self._read(places["bitmap"] + first // 8, (first % 8 + n + 7) // 8), np.uint8), bitorder="little")
            at = at[bits[first % 8 : first % 8 + n].astype(bool)]
            first, n, shift = self._rank(places, first), len(at), shift + width
            if not n:
                break
        return out


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, path.rstrip("/")


def manifest(folder: str) -> dict:
    """files: name, docs, tokens and the docs and tokens before; tokens: all ids."""
    system, path = _opened(folder)
    with system.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int, int]]


@dataclass
class Shard(InputPartition):
    name: str
    tokens_before: int


class Tokens(DataSource):
    """format("token_codes"): write (doc_id long, ids binary: little-endian unsigned 32-bit), or with a vocabulary (doc_id
    long, text string), which is encoded where it is written; read ids with start, n_tokens and ids_crc32.

    Options: path, file_tokens (ids in a file), vocabulary, end_id (behind each encoded text), ids ("false" leaves them out).
    """

    @classmethod
    def name(cls) -> str:
        return "token_codes"

    def schema(self) -> str:
        ids = ", ids binary" if self.options.get("ids", "true") == "true" else ""
        return f"doc_id long, start long, n_tokens long, ids_crc32 long{ids}"

    def reader(self, schema) -> DataSourceReader:
        return TokensReader(self.options["path"], "ids" in schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokensWriter(self.options["path"], int(self.options.get("file_tokens", 1 << 24)), self.options.get("vocabulary"), int(self.options.get("end_id", 0)))


class TokensWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, file_tokens: int, vocabulary: str | None, end_id: int):
        self.folder, self.file_tokens, self.vocabulary, self.end_id = folder, file_tokens, vocabulary, end_id

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        """Documents and their ids."""
        encode, end = encoder(self.vocabulary) if self.vocabulary else None, struct.pack("<I", self.end_id)
        for b in batches:
            b = b.select(["doc_id", "text" if encode else "ids"])
            for part in sliced(iter([b]), 1, 1 << 21):
                for doc, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield doc, encode(own or "") + end if encode else own

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _opened(self.folder)
        system.create_dir(path)
        partition, files = TaskContext.get().partitionId(), []
        names, lengths, held, n = [], [], [], 0

        def close() -> None:
            nonlocal names, lengths, held, n
            if not names:
                return
            name = f"part-{partition:06d}-{len(files):04d}-{uuid.uuid4().hex}.tok"
            with system.open_output_stream(f"{path}/{name}") as f:
                for part in file_bytes(names, lengths, np.frombuffer(b"".join(held), "<u4")):
                    f.write(part)
            files.append((name, len(names), n))
            names, lengths, held, n = [], [], [], 0

        for doc, own in self._rows(iterator):
            if n and n + len(own) // 4 > self.file_tokens:
                close()
            names.append(doc)
            lengths.append(len(own) // 4)
            held.append(own)
            n += len(own) // 4
        close()
        return Written(partition, files)

    def commit(self, messages: list) -> None:
        system, path = _opened(self.folder)
        system.create_dir(path)
        files, docs, tokens = [], 0, 0
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, own_docs, own_tokens in m.files:
                files.append({"name": name, "docs": own_docs, "tokens": own_tokens, "docs_before": docs, "tokens_before": tokens})
                docs, tokens = docs + own_docs, tokens + own_tokens
        with system.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps({"docs": docs, "tokens": tokens, "files": files}).encode())

    def abort(self, messages: list) -> None:
        system, path = _opened(self.folder)
        for m in messages:
            for name, _, _ in m.files if m else []:
                system.delete_file(f"{path}/{name}")


class TokensReader(DataSourceReader):
    def __init__(self, folder: str, with_ids: bool):
        self.folder, self.with_ids = folder, with_ids

    def partitions(self) -> list[Shard]:
        return [Shard(f["name"], f["tokens_before"]) for f in manifest(self.folder)["files"]] or [Shard("", 0)]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        if not shard.name:
            return
        system, path = _opened(self.folder)
        with system.open_input_file(f"{path}/{shard.name}") as f:
            codes = Codes(f)
            names, places = codes.documents()
            first = 0
            while first < len(names):  # documents of about AT_ONCE ids, or one longer one
                last = max(first + 1, int(np.searchsorted(places, places[first] + AT_ONCE, side="right")) - 1)
                ids = memoryview(codes.part(int(places[first]), int(places[last])).astype("<u4").tobytes())
                cut = [ids[4 * (s - places[first]) : 4 * (e - places[first])] for s, e in zip(places[first:last], places[first + 1 : last + 1])]
                columns = [
                    pa.array(names[first:last], pa.int64()), pa.array(places[first:last] + shard.tokens_before), pa.array(np.diff(places[first : last + 1])),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                ]
                fields = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if self.with_ids:
                    columns.append(pa.array([bytes(c) for c in cut], pa.binary()))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=fields)
                first = last


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, file_tokens: int = 1 << 24) -> None:
    """Encode `docs` and write the ids, an end id behind each document, in ascending order of doc_id."""
    docs.sparkSession.dataSource.register(Tokens)
    # the last key tells repeated rows apart, so that a third of all rows may be the same one
    keys = [F.col("doc_id").asc_nulls_first(), F.col("text_key"), F.col("salt")]
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"), F.rand(7).alias("salt"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("doc_id").cast("long"), "text")

    out = ordered.write.format("token_codes").mode("append").option("vocabulary", vocabulary).option("end_id", end_id)
    out.option("file_tokens", file_tokens).save(folder)


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document."""
    spark.dataSource.register(Tokens)
    return spark.read.format("token_codes").option("ids", str(ids).lower()).load(folder)


def tokens_at(positions: DataFrame, folder: str) -> DataFrame:
    """The rows of `positions` (a column `position`, counted over the whole corpus) with the `token` there.

    Each task takes a range of positions, however many rows ask for the same one, and opens only the files it needs.
    """
    held = manifest(folder)
    starts = np.array([f["tokens_before"] for f in held["files"]], np.int64)
    names, total = [f["name"] for f in held["files"]], held["tokens"]
    keys = [F.col("position"), F.rand(7)]
    ordered = positions.select("position").repartitionByRange(*keys).sortWithinPartitions("position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        opened, codes, f = -1, None, None
        last, value = None, None
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                if p is None or not 0 <= p < total:
                    out.append(None)
                    continue
                if p != last:
                    at = int(np.searchsorted(starts, p, side="right")) - 1
                    if at != opened:
                        if f:
                            f.close()
                        f = system.open_input_file(f"{path}/{names[at]}")
                        opened, codes = at, Codes(f)
                    last, value = p, codes[p - int(starts[at])]
                out.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["position", "token"])
        if f:
            f.close()

    return ordered.mapInArrow(run, f"position {dict(positions.dtypes)['position']}, token long")


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the files in the shared folder, and reads the digest that the query returns back from them."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/molgrid-token-codes-{uuid.uuid4().hex}"
    write(docs, vocabulary, folder)
    return read(spark, folder, ids=False)
