"""Which tokens of two tokenizers cover the same bytes, and how often their ids are linked in the whole corpus.

One side is a byte-level file of the `tokenizers` library (A), the other a `sentencepiece` model (B). Both give spans in
characters (B those that its release has in place of the immutable proto). Places where both have a token's end at a
character's end are coarse cuts. Between two of them only tokens that share a character (a character cut into bytes, byte
fallback) can end together; there the tokens' own bytes decide. Groups lie between neighbouring common ends; the tokens
that end together are linked.

A single space between two other characters always begins a token on both sides, and so does what follows a letter
without being one (for B that is read from its pieces), so texts are cut there and each distinct part is aligned once
as long as its worker keeps it. A text whose tokens do not give back its bytes (the normaliser changed it, or it holds
U+2581) has no tokens.

Counts of id pairs are summed in each task before they are shuffled. The most frequent pairs, at most `hot_pairs` of
them, are then broadcast as numpy arrays and looked up where the documents are; rarer ones meet their counts in an
equi-join, where no key is hot. Both ways are exact.

Defined cases: a null or empty text has no tokens and an empty groups_sha256; special tokens' strings are plain text;
repeated rows are aligned and counted once for each row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molgrid.llm.common import materialize, sliced

#: U+2581 stands for a space in pieces.
MARK = "▁"
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Cuts inside of words: between a letter and an ASCII character that is none, and between a line's end and a letter. Only
#: Latin letters are named (without the two signs among them), about which all releases of Unicode agree.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
INSIDE = re.compile(rf"(?<={LETTER})(?=[!-@\[-`{{-~\n])|(?<=\S\n)(?={LETTER})")
#: Surrogates occur in no text: one marks a part that no space leads, the other a cut.
GLUED, CUT = "\ud800", "\ud801"
MARKED = re.compile(rf"(?<=\S) (?=\S)|{CUT}")


class Aligned(NamedTuple):
    """Ids of both sides, how many of A and of B lie before each common end, and the tokens' ends in characters."""

    a: list[int]
    b: list[int]
    j: np.ndarray
    n: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def groups(self) -> list[tuple[int, int, int, int]]:
        """First A, last A + 1, first B, last B + 1 of each group."""
        j, n = self.j.tolist(), self.n.tolist()
        return list(zip([0, *j[:-1]], j, [0, *n[:-1]], n))

    def written(self) -> list[str]:
        """Each group as `a1,a2|b1`."""
        a, b = list(map(str, self.a)), list(map(str, self.b))
        return [f"{a[i]}|{b[k]}" if j - i == 1 == n - k else f"{','.join(a[i:j])}|{','.join(b[k:n])}" for i, j, k, n in self.groups()]

    def links(self) -> np.ndarray:
        """The linked ids of each group, B's in the high half."""
        return np.array(self.b, np.int64)[self.n - 1] << 32 | np.array(self.a, np.int64)[self.j - 1]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _common(a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and B lie before each end that both have, among the ends that a_of and b_of name."""
    a_at, b_at = np.flatnonzero(a_of), np.flatnonzero(b_of)
    _, j, n = np.intersect1d(a[a_at], b[b_at], assume_unique=True, return_indices=True)
    return a_at[j] + 1, b_at[n] + 1


class Pair:
    """The two tokenizers, with the bytes of each of their tokens."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        known = {i: bytes(letters[c] for c in entry) for entry, i in self.a.get_vocab().items() if all(c in letters for c in entry)}
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_sizes = np.array([len(p) for p in self.b_bytes])
        self.a_sizes = np.array([len(p) for p in self.a_bytes])
        normal = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        added = json.loads(self.a.to_str())
        plain = added["normalizer"] is None and (added["pre_tokenizer"] or {}).get("type") == "ByteLevel" and added["pre_tokenizer"].get("use_regex")
        #: No piece has a space behind another character, so no merge crosses a single space.
        self.cut = bool(plain) and not any(MARK in p.lstrip(MARK) for p in pieces)
        #: No piece has a letter before another kind of character, or a line's end, so none crosses the cuts inside of words.
        self.cut_inside = self.cut and not any("\n" in p or any(x.isalpha() and not y.isalpha() for x, y in zip(p, p[1:])) for p in normal)

    def align(self, text: str) -> Aligned | None:
        """The groups of one text, or None where a side does not give back space + text."""
        target = f" {text}"
        found, spans = self.a.encode(target, add_special_tokens=False), self.b.encode(text, return_type="offset_mapping")
        a, b, raw = found.ids, spans["ids"], target.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        (a_from, a_to), (b_from, b_to) = (np.fromiter(chain.from_iterable(s), np.int64, 2 * len(s)).reshape(-1, 2).T for s in (found.offsets, spans["offsets"]))
        b_to = b_to + 1
        # A: a token's end is coarse if the next token starts there; else both share a character
        a_coarse = np.append(a_from[1:] >= a_to[:-1], True)
        # B: of the bytes of a character only the last has a span
        b_coarse = (b_to > b_from + 1) | ~self.is_byte[b]
        j, n = _common(a_to, a_coarse, b_to, b_coarse)
        if not a_coarse.all() and not b_coarse.all():  # inside of characters by the tokens' own bytes
            finer = _common(self.a_sizes[a].cumsum(), ~a_coarse, self.b_sizes[b].cumsum(), ~b_coarse)
            j, n = np.append(j, finer[0]), np.append(n, finer[1])
            order = np.argsort(j)
            j, n = j[order], n[order]
        return Aligned(a, b, j, n, a_to, b_to)

    def entries(self, parts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, links as bytes, groups as written) of each part, or None; the parts are aligned as one text, which a space cuts."""
        leads = ["" if part[0] != GLUED else "a\n" if part[1].isalpha() else "a" for part in parts]
        whole = self.align(" ".join([lead + part[1:] if lead else part for lead, part in zip(leads, parts)]))
        if whole is None:
            return [None] if len(parts) == 1 else [self.entries([part])[0] for part in parts]
        at = np.cumsum([1 + len(part) + len(lead) - bool(lead) for lead, part in zip(leads, parts)])
        j, n = np.searchsorted(whole.a_ends, at, side="right"), np.searchsorted(whole.b_ends, at, side="right")
        groups, links, last = whole.written(), whole.links().tobytes(), np.searchsorted(whole.j, j, side="right")
        cuts = [[0, *c.tolist()] for c in (j, n, last)]
        # each character of a lead is a token of both sides
        return [
            (j - i - c, n - k - c, links[8 * (x + c) : 8 * y], ";".join(groups[x + c : y]))
            for c, i, j, k, n, x, y in zip(map(len, leads), cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], cuts[2], cuts[2][1:])
        ]

    def parts(self, text: str) -> list[str]:
        """Parts that can be aligned by themselves; those that no space leads are marked."""
        if self.cut_inside:
            return MARKED.split(INSIDE.sub(CUT + GLUED, text))
        return BETWEEN.split(text) if self.cut else [text]


class Parts(dict):
    """The entries of parts of texts in each worker: of the latest texts, and of those before. What is used again stays,
    older parts go, so there are no more than `most`. Longer parts are not kept."""

    def __init__(self, pair: Pair, most: int = 1_000_000, longest: int = 40, at_once: int = 500):
        super().__init__()
        self.pair, self.most, self.longest, self.at_once = pair, most, longest, at_once
        self.before: dict[str, tuple | None] = {}

    def __missing__(self, part: str) -> tuple | None:
        return self.pair.entries([part])[0]

    def learn(self, texts: list[list[str]]) -> None:
        """Have the parts of these texts: known ones, and the new ones that a space cuts on both sides, aligned together."""
        parts = set().union(*texts)
        if 2 * (len(self) + len(parts)) > self.most:
            self.before = dict(self)
            self.clear()
        new = parts.difference(self)
        again = new.intersection(self.before)
        self.update((part, self.before[part]) for part in again)
        new = [part for part in new.difference(again) if len(part) <= self.longest and not part[:1].isspace() and (not part[-1:].isspace() or part[0] == GLUED and part[-1] == "\n" and not part[-2].isspace())]
        for k in range(0, len(new), self.at_once):
            some = new[k : k + self.at_once]
            self.update(zip(some, self.pair.entries(some)))


@cache
def _pair(vocabulary: str, model: str) -> Pair:
    return Pair(vocabulary, model)


@cache
def _parts(vocabulary: str, model: str) -> Parts:
    return Parts(_pair(vocabulary, model))


NOTHING = Aligned([], [], *[np.zeros(0, np.int64)] * 4)


def spans(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """doc_id, a, b (ids of both sides) and groups (first and one past the last place in a, the same in b) for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(vocabulary, model)
        for batch in batches:
            for b in sliced(iter([batch]), 1, 1 << 18):
                rows = [(pair.align(text) if text else None) or NOTHING for text in b.column(1).to_pylist()]
                groups = [[{"a_from": i, "a_to": j, "b_from": k, "b_to": n} for i, j, k, n in r.groups()] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([r.a for r in rows], pa.list_(pa.int32())), pa.array([r.b for r in rows], pa.list_(pa.int32())), pa.array(groups, GROUPS)],
                    names=["doc_id", "a", "b", "groups"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>, groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>")


GROUPS = pa.list_(pa.struct([(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")]))


def _aligned(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """For each row of `docs`: row (its own number), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct) and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, known = _pair(vocabulary, model), _parts(vocabulary, model)
        row = TaskContext.get().partitionId() << 40
        for b in sliced(batches, 1, 1 << 20):
            numbers, shas, pairs, times = [], [], [], []
            texts = [pair.parts(text) if text else [] for text in b.column(1).to_pylist()]
            known.learn(texts)
            for parts in texts:
                own = list(map(known.__getitem__, parts))
                if None in own or not own:
                    numbers.append((0, 0))
                    shas.append("")
                    linked_ids = b""
                else:
                    n_a, n_b, links, written = zip(*own)
                    numbers.append((sum(n_a), sum(n_b)))
                    shas.append(hashlib.sha256(";".join(written).encode()).hexdigest())
                    linked_ids = b"".join(links)
                found, n = np.unique(np.frombuffer(linked_ids, np.int64), return_counts=True)
                pairs.append(found)
                times.append(n)
            n_a, n_b = (pa.array(c, pa.int64()) for c in zip(*numbers))
            n_links = pa.array([int(t.sum()) for t in times], pa.int64())  # one for each group
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + b.num_rows)), b.column(0), n_a, n_b, n_links, n_links, pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times), pa.int32())),
                ],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )
            row += b.num_rows

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame, at_once: int = 1 << 21) -> DataFrame:
    """pair, n (links in the corpus that hold it) and best (no pair of the same B id has more), summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, size = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            found, place = np.unique(np.concatenate(pairs), return_inverse=True)
            return found, np.bincount(place, np.concatenate(times)).astype(np.int64)

        for b in batches:
            pairs.append(_flat(b.column(0)))
            times.append(_flat(b.column(1)).astype(np.int64))
            size += len(pairs[-1])
            if size >= at_once:
                found, n = summed()
                if len(found) > at_once // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])
                    found, n = found[:0], n[:0]
                pairs, times, size = [found], [n], len(found)
        if size:
            found, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

    counts = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # the pairs of one B id are no more than A has ids
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("n") == most)


def linked(docs: DataFrame, vocabulary: str, model: str, hot_pairs: int = 2_000_000) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = materialize(_aligned(docs, vocabulary, model), "alignment-texts")
    counts = materialize(pair_counts(aligned), "alignment-pairs")
    # pairs by the power of two in their count: at most 63 rows
    powers = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()}
    least, held = 64, 0
    for power in sorted(powers, reverse=True):
        held += powers[power]
        if held > hot_pairs:
            break
        least = power
    is_hot = F.floor(F.log2("n")) >= least
    hot = counts.where(is_hot).toArrow()
    order = np.argsort(hot.column("pair").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast([hot.column(c).to_numpy()[order] for c in ("pair", "n", "best")])
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for b in batches:
            pairs, times = _flat(b.column("pairs")), _flat(b.column("times")).astype(np.int64)
            sizes = np.diff(b.column("pairs").offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            place = np.searchsorted(known, pairs)
            place[place == len(known)] = 0
            found = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(n_best, row[found], times[found] * best[place[found]])
            np.add.at(count_sum, row[found], times[found] * n[place[found]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=b.num_rows))]), pa.int32())
            rare = pa.StructArray.from_arrays([pa.array(pairs[~found]), pa.array(times[~found])], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(n_best), pa.array(count_sum), pa.ListArray.from_arrays(offsets, rare)],
                names=[*kept, "n_best", "count_sum", "rare"],
            )

    schema = ", ".join(f"{c} {t}" for c, t in aligned.dtypes if c in kept) + ", n_best long, count_sum long, rare array<struct<pair:long,times:long>>"
    out = aligned.mapInArrow(run, schema)
    if any(power < least for power in powers):
        out = materialize(out, "alignment-rare")
        rest = out.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.where(~is_hot), "pair")
        added = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(added, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
        )
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
