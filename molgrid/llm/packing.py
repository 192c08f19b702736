"""Best-fit packing of token sequences, by a configuration linear program over the length histogram.

Documents become token pieces in one pass. Their lengths, at most `capacity` of them however large the corpus, form
a histogram on which the driver works. The covering program over bin configurations (every length covered as often as
it occurs, by as few bins as possible) is solved by multiplicative weights: each round covers the histogram with the
configurations that a knapsack dynamic program prices best, learns what share of a bin each length was charged, and
moves the lengths' prices by that factor. Any prices, scaled until no configuration is worth more than one bin, bound
the program from below; rounds end when cover and bound are within `gap`, or after `rounds`. Configurations are then
rounded down to whole bins, and what is left over is covered by whole bins, priced in the same way among the pieces
that are left, for a few rounds of the same weights. `plan` gives bins, bound and rounds.

Each piece then finds its sequence from its rank among the pieces of its length: ranks are counted in hashed blocks,
so a length that a third of all pieces have is spread over all tasks.

Defined cases: a null or empty text is one piece that holds the end token alone; rows that repeat are packed once for
each row; a null doc_id stays null; an empty table gives an empty result; other columns are not read. Strings that are
special tokens of the vocabulary become these tokens, as the `tokenizers` library does it.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molgrid.llm.common import materialize, n_partitions, sliced

Groups = list[tuple[list[tuple[int, int]], int]]


class _Chunks(dict):
    """Token ids (little-endian bytes) of a text between two single spaces, kept up to a bound in each worker."""

    def __init__(self, encode, lead: str, most: int = 250_000):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise LookupError  # white space that the tokenizer may join with its neighbours
        ids = self.encode(self.lead + chunk)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


@cache
def encoder(vocabulary: str):
    """text -> ids as little-endian unsigned 32-bit bytes, those of the `tokenizers` file without added special tokens.

    Where the same vocabulary lies beside it as ranks (.tiktoken), the same ids come from those, several times faster.
    Its patterns never cut across a single space between two other characters, so texts are encoded space by space and
    repeated words are looked up. A text with the string of an added token goes to the `tokenizers` library itself.
    """
    import base64
    import json
    import os

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens") or []]

    def plain(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks_file):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        encode = plain

    first, later = _Chunks(encode, "", 20_000), _Chunks(encode, " ")

    def run(text: str) -> bytes:
        if not text:
            return b""
        if any(map(text.__contains__, added)):
            ids = plain(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        head, *rest = text.split(" ")
        try:
            return first[head] + b"".join(map(later.__getitem__, rest))
        except LookupError:
            ids = encode(text)
            return struct.pack(f"<{len(ids)}I", *ids)

    return run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): a longer document's first piece takes the odd tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = struct.pack("<I", end_id)
        for b in sliced(batches, 1, 2 << 20):
            doc, piece, start, length, crc, held = [], [], [], [], [], []
            for at, text in enumerate(b.column(1).to_pylist()):
                own = encode(text or "") + end
                n = len(own) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(at)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(own[4 * s : 4 * e]))
                if with_ids:
                    held.append(own)
            cols = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:  # the pieces follow each other, so their ids are one array with its cuts
                ends = np.r_[0, np.cumsum(length)].astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def price(lengths: np.ndarray, value: np.ndarray, capacity: int, most: np.ndarray | None = None) -> dict[int, int]:
    """The configuration of the largest value that fits, with at most `most` pieces of each length: a knapsack, solved
    for every room up to capacity at once. Of equal values the longer pieces are taken."""
    copies = capacity // lengths if most is None else np.minimum(most, capacity // lengths)
    best = np.zeros(capacity + 1)
    taken = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        left, n, length = int(copies[i]), 1, int(lengths[i])
        while left:  # 1, 2, 4, ... pieces at once
            n = min(n, left)
            gain = best[: capacity + 1 - n * length] + n * value[i]
            better = gain > best[n * length :] + 1e-12
            np.copyto(best[n * length :], gain, where=better)
            taken.append((length, n, better))
            left, n = left - n, 2 * n
    shape: dict[int, int] = defaultdict(int)
    room = capacity
    for length, n, better in reversed(taken):
        if room >= n * length and better[room - n * length]:
            shape[length] += n
            room -= n * length
    return dict(shape)


class _Prices:
    """The lengths' prices, and the multiplicative update after a cover."""

    def __init__(self, hist: dict[int, int], capacity: int, rate: float):
        self.lengths = np.array(sorted(x for x in hist if hist[x]))
        self.need = np.array([hist[int(x)] for x in self.lengths], dtype=float)
        self.place = {int(x): i for i, x in enumerate(self.lengths)}
        self.capacity, self.rate = capacity, rate
        self.now = self.lengths / capacity

    def bound(self) -> float:
        """No cover, whole or fractional, has fewer bins."""
        best = price(self.lengths, self.now, self.capacity)
        return float(self.need @ self.now) / sum(self.now[self.place[x]] * n for x, n in best.items())

    def update(self, cover: list[tuple[dict[int, int], float]]) -> None:
        """A bin is charged to its pieces by their prices; lengths that pay more than theirs rise, the others fall."""
        paid = np.zeros(len(self.lengths))
        for shape, bins in cover:
            at = np.array([self.place[x] for x in shape])
            share = self.now[at] * np.array(list(shape.values()))
            paid[at] += bins * share / share.sum()
        self.now = self.now * (np.maximum(paid, 1e-12) / (self.need * self.now)) ** self.rate


def covered(prices: _Prices, need: np.ndarray, whole: bool, lean: float = 0.05) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is used, so that every length is covered `need` times.

    Each step prices the best configuration among the pieces not covered yet and uses it until its scarcest length is
    covered, so there are few more steps than lengths; in whole bins only, and none wider than what is left, if `whole`.
    Prices lean a little towards long pieces, which are the harder to place later on.
    """
    left = need.copy()
    value = prices.now * (prices.lengths / prices.capacity) ** lean
    used: dict[tuple, float] = defaultdict(float)
    while True:
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            return [(dict(k), v) for k, v in used.items()]
        shape = price(prices.lengths[open_], value[open_], prices.capacity, left[open_].astype(np.int64) if whole else None)
        at = np.array([prices.place[x] for x in shape])
        copies = np.array(list(shape.values()), dtype=float)
        step = float((left[at] // copies if whole else left[at] / copies).min())
        used[tuple(sorted(shape.items()))] += step
        left[at] = np.where(left[at] - step * copies < 1e-9, 0, left[at] - step * copies)


@dataclass(frozen=True)
class Plan:
    """groups: (configuration as (length, copies), number of such bins); bound: no packing has fewer bins; fractional:
    bins of the program's solution; rounds: of the multiplicative weights."""

    groups: Groups
    sequences: int
    bound: int
    fractional: float
    rounds: int


def plan(hist: dict[int, int], capacity: int, gap: float = 0.001, rounds: int = 24, whole_rounds: int = 12, rate: float = 1.0) -> Plan:
    """Bins for the whole histogram."""
    left = {k: v for k, v in hist.items() if v}
    full = left.pop(capacity, 0)  # such pieces fill a sequence alone
    groups: Groups = [([(capacity, 1)], full)] if full else []
    if not left:
        return Plan(groups, full, full, full, 0)
    prices = _Prices(left, capacity, rate)
    best, value, bound, n = [], np.inf, 0.0, 0
    for n in range(1, rounds + 1):
        bound = max(bound, prices.bound())
        cover = covered(prices, prices.need, whole=False)
        bins = sum(v for _, v in cover)
        if bins < value:
            best, value = cover, bins
        if value <= (1 + gap) * bound or np.ceil(value - 1e-9) <= np.ceil(bound - 1e-9):
            break
        prices.update(cover)
    for shape, bins in best:
        if whole := int(bins + 1e-9):
            groups.append((sorted(shape.items()), whole))
            for k, copies in shape.items():
                left[k] -= whole * copies
    left = {k: v for k, v in left.items() if v}
    if left:
        rest = _Prices(left, capacity, rate)
        least = int(np.ceil(sum(k * v for k, v in left.items()) / capacity - 1e-9))
        found: list[tuple[dict[int, int], float]] = []
        for _ in range(whole_rounds):
            cover = covered(rest, rest.need, whole=True)
            if not found or sum(v for _, v in cover) < sum(v for _, v in found):
                found = cover
            if sum(v for _, v in found) <= least:
                break
            rest.update(cover)
        groups += [(sorted(shape.items()), int(bins)) for shape, bins in found]
    return Plan(groups, sum(bins for _, bins in groups), full + int(np.ceil(bound - 1e-9)), full + value, n)


def solve(hist: dict[int, int], capacity: int) -> Groups:
    """Bins for the whole histogram as (configuration, number of such bins), the configuration as (length, copies)."""
    return plan(hist, capacity).groups


def _slots(groups: Groups) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first sequence, copies in a sequence and place of the first copy."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for shape, bins in groups:
        place = 0
        for length, copies in shape:
            out[length].append((taken[length], sequence, copies, place))
            taken[length] += copies * bins
            place += copies * length
        sequence += bins
    return {k: np.array(v, dtype=np.int64).T for k, v in out.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset. with_ids adds the token ids of each piece."""
    cut = materialize(pieces(docs, vocabulary, capacity, end_id, with_ids), "packing-pieces")
    blocks = 4 * n_partitions(docs.sparkSession)
    placed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = placed.groupBy("length", "block").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(solve(hist, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "block", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = placed.withColumn("own", own).join(base, ["length", "block"])
    kept = cut.columns
    ranked = ranked.select(*kept, (F.col("base") + F.col("own") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, start, copies, place = slots[int(x)][:, np.searchsorted(slots[int(x)][0], rank[at], side="right") - 1]
                nth = rank[at] - first
                sequence[at] = start + nth // copies
                offset[at] = place + nth % copies * x
            cols = [*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{k} {t}" for k, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
