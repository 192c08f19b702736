"""Exact removal of byte strings that an earlier document has, by sorting sampled suffixes.

A 50-byte string repeats in another document only if the suffix that starts at its anchor repeats there: the anchor
is the position, among those of its 16-byte tokens, whose token has the least fingerprint, so it depends on the
string alone. Neighbouring strings share an anchor and form one run, so a text has about one suffix for 17 bytes
instead of one for each.

1. Suffixes are range-partitioned by their leading tokens (two of eight bytes, in byte order, then a fingerprint of
   the run, then doc_id) with sampled splitters, so that a token that many documents share is split by doc_id over
   several buckets. Neighbouring buckets lie in one partition. Each bucket is sorted by multikey quicksort: by the
   first token, ties alone by the next, and so on. A run equal to one of a smaller doc_id is removed whole. A key
   that equals a splitter can lie on both sides of a boundary: the buckets' first and last keys are compared
   afterwards. A bucket that is fuller than a task may hold is split again, by splitters from its own rows, over
   files of the task.
2. Runs that share the token but not the rest may still share some of their strings: these few are cut into their
   50-byte strings, which are sorted and compared the same way.
3. The removed runs meet their texts again, one document at a time.

Before each shuffle a task removes what repeats a smaller doc_id within its own part of the input, so one key sends
one document from each part at most. Sixteen bytes are compared as such, the rest by a 64-bit fingerprint of the run.

Defined cases: a null or empty text has no bytes and loses none; texts under the length lose none; rows that repeat
a doc_id are not smaller than each other, whatever their texts; a null doc_id counts as larger than any number, and
null rows are not smaller than each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molgrid.llm.common import materialize, n_partitions, sliced, text_key, utf8

TOKEN = 16
LAST_ID = (1 << 63) - 1
#: Texts are handled in pieces of this many bytes, which bounds the memory of a task; positions fit the low bits.
PIECE = 1 << 18
_POS = np.uint64((1 << 20) - 1)
#: Odd multipliers.
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA24BAED4963EE407)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[2]
    h = (h ^ (h >> np.uint64(29))) * _K[3]
    return h ^ (h >> np.uint64(32))


@cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and the powers of an odd base and of its inverse modulo 2**64."""
    base = int(_K[which])
    back = pow(base, -1, 1 << 64)
    n = 3 * PIECE
    up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, dtype=np.uint64)]) for x in (base, back))
    return np.random.default_rng(which).integers(0, 1 << 64, 256, dtype=np.uint64), up, down


def _sums(buf: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums from which `_between` takes the fingerprint of any substring."""
    values, up, _ = _powers(which)
    return np.r_[np.uint64(0), np.cumsum(values[buf] * up[: len(buf)])]


def _between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * _powers(which)[2][start] + (end - start).astype(np.uint64))


def _runs(buf: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each run: first string, number of strings, the token's halves as numbers in byte order, rest, what stands
    left and right of the token (0: less than a side), place of the token. valid: positions at which a string starts."""
    words = np.ascontiguousarray(np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)))
    h = words[:-8] * _K[0]
    h = _mix((h ^ (h >> np.uint64(31))) + words[8:] * _K[1])
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width, need = 1, length - TOKEN + 1
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    at = np.flatnonzero(valid)
    anchor = (low[at] & _POS).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    count = np.diff(np.r_[first, len(at)])
    start, anchor = at[first], anchor[first]
    end = start + count + (length - 1)
    sums = _sums(buf, 4)
    rest = _between(sums, start, end, 4) ^ _mix((anchor - start).astype(np.uint64) + _K[0])
    side = _side(length)
    left = np.where(anchor - start >= side, _between(sums, np.maximum(anchor - side, 0), anchor, 4) | np.uint64(1), 0)
    after = anchor + TOKEN
    right = np.where(end - after >= side, _between(sums, after, np.minimum(after + side, len(buf)), 4) | np.uint64(1), 0)
    in_order = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))
    return start, count, in_order[anchor], in_order[anchor + 8], rest, left, right, anchor - start


def _side(length: int) -> int:
    """Each string of the length holds at least so many bytes on the left or so many on the right of its token."""
    return -(-(length - TOKEN) // 2)


def pieces(ids: np.ndarray, nths: np.ndarray, texts: list[bytes | None], length: int) -> Iterator[tuple]:
    """Concatenated texts (long ones in overlapping parts) of about PIECE bytes: buf, valid, and for each part its
    place in buf, doc_id, nth and the position in its text."""
    parts, held = [], 0
    for doc, nth, text in zip(ids.tolist(), nths.tolist(), texts):
        if text is None or len(text) < length:
            continue
        for s in range(0, len(text) - length + 1, PIECE):
            cut = text[s : s + PIECE + length - 1]
            parts.append((cut, doc, nth, s))
            held += len(cut)
            if held >= PIECE:
                yield _joined(parts, length)
                parts, held = [], 0
    if parts:
        yield _joined(parts, length)


def _joined(parts: list[tuple], length: int) -> tuple:
    buf = np.frombuffer(b"".join(p[0] for p in parts), dtype=np.uint8)
    sizes = np.array([len(p[0]) for p in parts])
    ends = np.cumsum(sizes)
    valid = np.ones(len(buf), dtype=bool)
    for e in ends:
        valid[e - length + 1 : e] = False
    return buf, valid, ends - sizes, *(np.array([p[k] for p in parts], dtype=np.int64) for k in (1, 2, 3))


#: A run's columns. left and right are cut to 16 bits: they only save comparisons.
KINDS = {"lead": "<u8", "next": "<u8", "rest": "<u8", "doc": "<i8", "start": "<u4", "nth": "<u4", "left": "<u2", "right": "<u2", "count": "u1", "place": "u1"}
Records = dict[str, np.ndarray]


#: The keys in the order of comparison; those that make a token, and those that make a run.
ORDER = ("lead", "next", "rest", "doc")
TOKEN_KEYS, RUN_KEYS = ORDER[:2], ORDER[:3]


def _records(batch: pa.RecordBatch, length: int) -> Records:
    """All runs of a batch of (doc_id, nth, text) rows."""
    ids = batch.column(0).fill_null(LAST_ID).to_numpy()
    out: dict[str, list] = {k: [] for k in KINDS}
    for buf, valid, at, doc, nth, offset in pieces(ids, batch.column(1).to_numpy(), utf8(batch.column(2)), length):
        start, count, lead, after, rest, left, right, place = _runs(buf, valid, length)
        part = np.searchsorted(at, start, side="right") - 1
        of = {"lead": lead, "next": after, "rest": rest, "doc": doc[part], "nth": nth[part], "start": start - at[part] + offset[part]}
        for k, v in (of | {"count": count, "left": left, "right": right, "place": place}).items():
            out[k].append(v.astype(KINDS[k]))
    return {k: np.concatenate(v) if v else np.zeros(0, KINDS[k]) for k, v in out.items()}


def _take(rec: Records, at: np.ndarray) -> Records:
    return {k: v[at] for k, v in rec.items()}


def _concat(parts: list[Records]) -> Records:
    return {k: np.concatenate([p[k] for p in parts]) for k in KINDS}


def multikey_ties(rec: Records) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose token occurs more than once in order of all keys; where tokens and where runs begin there.

    Multikey quicksort over whole columns: each key sorts only what the keys before it left equal, and rows that no
    other equals in a token are left out as soon as that shows.
    """
    order = np.argsort(rec["lead"])  # quicksort
    begin = np.arange(len(order)) == 0
    begins = {}
    for k, name in enumerate(ORDER):
        if k:
            group = np.cumsum(begin)
            order = order[np.lexsort((rec[name][order], group))]
        value = rec[name][order]
        begin[1:] |= value[1:] != value[:-1]
        if name in TOKEN_KEYS:
            alone = begin & np.r_[begin[1:], True][: len(begin)]
            order, begin = order[~alone], begin[~alone]
        begins[name] = begin.copy()
    return order, begins[TOKEN_KEYS[-1]], begins[RUN_KEYS[-1]]


def _later(rec: Records, order: np.ndarray, new_key: np.ndarray) -> np.ndarray:
    """Of the sorted rows, those whose key a smaller doc_id has."""
    doc = rec["doc"][order]
    return doc > doc[np.flatnonzero(new_key)][np.cumsum(new_key) - 1]


def _local(rec: Records) -> tuple[Records, Records]:
    """What a smaller doc_id of the same batch repeats, and the others."""
    order, _, new_key = multikey_ties(rec)
    gone = np.zeros(len(rec["doc"]), dtype=bool)
    gone[order[_later(rec, order, new_key)]] = True
    return _take(rec, np.flatnonzero(gone)), _take(rec, np.flatnonzero(~gone))


def _bucket(rec: Records, splitters: np.ndarray) -> np.ndarray:
    """The number of splitters (sorted rows of the keys) that are not larger than each row."""
    at, high = (np.searchsorted(splitters["lead"], rec["lead"], side) for side in ("left", "right"))
    open_ = np.flatnonzero(at < high)
    while len(open_):
        s = splitters[at[open_]]
        reached = np.ones(len(open_), dtype=bool)
        for name in ORDER[:0:-1]:
            own = rec[name][open_]
            reached = (s[name] < own) | ((s[name] == own) & reached)
        open_ = open_[reached]
        at[open_] += 1
        open_ = open_[at[open_] < high[open_]]
    return at


def _pack(rec: Records) -> bytes:
    doc = np.diff(rec["doc"], prepend=0)  # rows of one document stand together: mostly zeros
    return b"".join((doc if k == "doc" else rec[k]).astype(t).tobytes() for k, t in KINDS.items())


_WIDTH = sum(np.dtype(t).itemsize for t in KINDS.values())


def _unpack(blob: bytes) -> Records:
    n, at, out = len(blob) // _WIDTH, 0, {}
    for k, t in KINDS.items():
        out[k] = np.frombuffer(blob, t, n, at)
        at += n * np.dtype(t).itemsize
    return out | {"doc": np.cumsum(out["doc"])}


def _dealt(rec: Records, bucket: np.ndarray, gone: Records, buckets: int, partitions: int, turn: int, most: int = 1 << 14) -> pa.RecordBatch:
    """Rows of up to `most` runs for each bucket, with the partition that its range of buckets has; buckets from
    `buckets` on carry what is removed already."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    places, ids, blobs = [], [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for i in range(a, b, most):
            own = int(bucket[order[i]])
            places.append(own * partitions // buckets)
            ids.append(own)
            blobs.append(_pack(_take(rec, order[i : min(i + most, b)])))
    for i in range(0, len(gone["doc"]), most):
        places.append(turn % partitions)
        ids.append(buckets)
        blobs.append(_pack({k: v[i : i + most] for k, v in gone.items()}))
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["place", "bucket", "runs"])


DEALT = "place int, bucket int, runs binary"
GONE, UNSURE, FIRST, PENDING = range(4)
OUT = "kind byte, lead long, next long, rest long, doc long, nth long, run long"


def _rows(kind: int, rec: Records, keyed: bool = False) -> pa.RecordBatch:
    """run: the first string and, in the low byte, the number of strings."""
    n = len(rec["doc"])
    run = rec["start"].astype(np.int64) * 256 + rec["count"].astype(np.int64)
    key = [pa.array(rec[k].view(np.int64)) if keyed else pa.nulls(n, pa.int64()) for k in RUN_KEYS]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), *key, pa.array(rec["doc"]), pa.array(rec["nth"].astype(np.int64)), pa.array(run)],
        names=["kind", *RUN_KEYS, "doc", "nth", "run"],
    )


def _equals(rec: Records, splitter: np.void, names: tuple[str, ...]) -> np.ndarray:
    return np.logical_and.reduce([rec[k] == splitter[k] for k in names])


def _sorted_bucket(rec: Records, low: np.void | None, high: np.void | None, length: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """low, high: the splitters below and above the bucket. whole: runs that share the token only are wanted too."""
    edge = np.zeros(len(rec["doc"]), dtype=bool)
    for s in (low, high):
        if s is not None:
            edge |= _equals(rec, s, TOKEN_KEYS)
    order, new_token, new_key = multikey_ties(rec)
    later = _later(rec, order, new_key)
    yield _rows(GONE, _take(rec, order[later]))
    for s, kind in ((high, FIRST), (low, PENDING)):
        if s is not None and edge.any():
            at = np.flatnonzero(_equals(rec, s, RUN_KEYS))
            if len(at):
                at = at[rec["doc"][at] == rec["doc"][at].min()]
                yield _rows(kind, _take(rec, at), keyed=True)
    if not whole:
        return
    # runs still there whose token has another rest, of another document, with the same left or right side
    group = np.cumsum(new_token) - 1
    begin = np.flatnonzero(new_token)
    doc = rec["doc"][order]
    mixed = np.zeros(0, bool)
    if len(begin):
        mixed = (np.bincount(group, weights=new_key) > 1) & (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))
    reps = np.flatnonzero(new_key)
    key_of = np.cumsum(new_key) - 1
    match = {}
    for name in ("left", "right"):
        value = rec[name][order[reps]].astype(np.uint64)
        use = np.flatnonzero((value > 0) & mixed[group[reps]])
        sides = group[reps[use]].astype(np.uint64) * np.uint64(1 << 16) + value[use]
        _, inverse, n = np.unique(sides, return_inverse=True, return_counts=True)
        hit = np.zeros(len(reps), dtype=bool)
        hit[use] = n[inverse] > 1
        match[name] = np.zeros(len(rec["doc"]), dtype=bool)
        match[name][order] = hit[key_of] & ~later
        gone = np.zeros(len(rec["doc"]), dtype=bool)
        gone[order[later]] = True
        match[name] |= edge & ~gone & (rec[name] > 0)
    at = np.flatnonzero(match["left"] | match["right"])
    if not len(at):
        return
    # string i of a run has place - i bytes before the token
    r, side = _take(rec, at), _side(length)
    middle = r["place"].astype(np.int64) - side
    n = r["count"].astype(np.int64)
    first = np.where(match["left"][at], 0, np.maximum(middle - (length - TOKEN) % 2, 0))
    last = np.where(match["right"][at], n - 1, np.minimum(middle, n - 1))
    ok = last >= first
    r = _take(r, np.flatnonzero(ok))
    r["start"], r["count"] = (r["start"] + first[ok]).astype("<u4"), (last - first + 1)[ok].astype(np.uint8)
    yield _rows(UNSURE, r)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Each bucket with its blobs, one after the other; `batches` (bucket, runs) are sorted by bucket."""
    rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows))
    return ((k, (blob for _, blob in own)) for k, own in groupby(rows, key=lambda r: r[0]))


def _cuts(rec: Records, parts: int) -> np.ndarray:
    """Splitters between parts of about equal size, from the rows themselves."""
    keys = np.zeros(len(rec["doc"]), dtype=_KEY)
    for k in ORDER:
        keys[k] = rec[k]
    keys = keys[np.lexsort([keys[k] for k in reversed(ORDER)])]
    found = keys[np.linspace(0, len(keys) - 1, parts + 1)[1:-1].astype(int)] if len(keys) else keys
    # the first key would leave the lowest part empty
    return np.unique(found[found != keys[0]]) if len(found) else found


def _held(blobs: Iterator[bytes], low: np.void | None, high: np.void | None, room: int, parts: int = 16) -> Iterator[tuple]:
    """A bucket's rows with the splitters around them; in parts, over files of the task, if they take over `room` bytes."""
    held, size = [], 0
    for blob in blobs:
        held.append(_unpack(blob))
        size += len(blob)
        if size > room:
            break
    rec = _concat(held)
    cuts = _cuts(rec, parts) if size > room else []
    if not len(cuts):  # small, or a single key of one document
        rest = [_unpack(x) for x in blobs]
        yield _concat([rec, *rest]) if rest else rec, low, high
        return
    del held
    with ExitStack() as stack:
        files = [stack.enter_context(tempfile.TemporaryFile()) for _ in range(len(cuts) + 1)]
        for part in chain([rec], map(_unpack, blobs)):
            of = _bucket(part, cuts)
            for k in np.unique(of).tolist():
                packed = _pack(_take(part, np.flatnonzero(of == k)))
                files[k].write(len(packed).to_bytes(8, "little") + packed)
            part = rec = None
        for k, file in enumerate(files):
            file.seek(0)
            own = (file.read(int.from_bytes(n, "little")) for n in iter(lambda f=file: f.read(8), b""))
            yield from _held(own, cuts[k - 1] if k else low, cuts[k] if k < len(cuts) else high, room, parts)


def _compared(dealt: DataFrame, partitions: int, length: int, splitters: np.ndarray | None, room: int, name: str) -> DataFrame:
    """`dealt` sorted and compared bucket by bucket, written to the shared folder. Without splitters each key lies in
    one bucket, and runs are single strings, with nothing to cut further."""
    buckets = len(splitters) + 1 if splitters is not None else partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            if bucket >= buckets:
                for blob in blobs:
                    yield _rows(GONE, _unpack(blob))
                continue
            low = splitters[bucket - 1] if splitters is not None and bucket else None
            high = splitters[bucket] if splitters is not None and bucket < len(splitters) else None
            for rec, above, below in _held(blobs, low, high, room):
                yield from _sorted_bucket(rec, above, below, length, splitters is not None)

    placed = dealt.repartitionById(partitions, "place").select("bucket", "runs").sortWithinPartitions("bucket")
    return materialize(placed.mapInArrow(run, OUT), name)


_KEY = [("lead", "<u8"), ("next", "<u8"), ("rest", "<u8"), ("doc", "<i8")]


def _sampled_splitters(docs: DataFrame, length: int, partitions: int, bucket_bytes: int, most_buckets: int) -> np.ndarray:
    """Splitters between buckets of about `bucket_bytes` bytes of text, at most `most_buckets` of them, from a sample of
    about 16 keys for each."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = min(max(partitions, int(size / bucket_bytes)), max(most_buckets, partitions))
    fine = np.uint64(8)
    # a text of `size / n` bytes has a run for 17 bytes, of which one in `fine` is taken
    want = 16 * buckets * 17 * int(fine) / max(size / max(n, 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec = _records(b, length)
            at = np.flatnonzero(_mix(rec["lead"] ^ rec["next"] * _K[1] ^ rec["doc"].view(np.uint64) * _K[0]) % fine == 0)
            yield pa.RecordBatch.from_arrays([pa.array(rec[k][at].view(np.int64)) for k in ORDER], names=list(ORDER))

    part = min(1.0, max(want, 2000) / max(n, 1))
    found = docs.sample(False, part, 7).mapInArrow(run, ", ".join(f"{k} long" for k in ORDER)).toPandas()
    return _cuts({k: found[k].to_numpy().view(t) for k, t in _KEY}, buckets)


def _strings(batches: Iterator[pa.RecordBatch], partitions: int, length: int) -> Iterator[pa.RecordBatch]:
    """(doc, nth, text, runs) rows: every string of the runs as a record of its own, dealt by its fingerprint."""
    for turn, b in enumerate(batches):
        parts = []
        for doc, nth, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist()):
            runs = np.sort(np.array(runs, dtype=np.int64))
            start, count = runs >> 8, runs & 255
            at = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            at = np.unique(at)
            for s in range(0, len(text), PIECE):
                own = at[np.searchsorted(at, s) : np.searchsorted(at, s + PIECE)] - s
                if not len(own):
                    continue
                buf = np.frombuffer(text[s : s + PIECE + length - 1], np.uint8)
                keys = [_between(_sums(buf, k), own, own + length, k) for k in (4, 1)]
                fill = {"lead": keys[0], "rest": keys[1], "doc": doc, "nth": nth, "start": own + s, "count": 1}
                parts.append({k: np.broadcast_to(fill.get(k, 0), own.shape).astype(t) for k, t in KINDS.items()})
        if parts:
            gone, rec = _local(_concat(parts))
            yield _dealt(rec, (rec["lead"] >> np.uint64(32)).astype(np.int64) * partitions >> 32, gone, partitions, partitions, turn)


def _resolved(found: DataFrame) -> DataFrame:
    """doc, nth, run of what is removed: at once, or since an earlier bucket has the key with a smaller doc_id."""
    first = found.where(F.col("kind") == FIRST).groupBy(*RUN_KEYS).agg(F.min("doc").alias("low"))
    pending = found.where(F.col("kind") == PENDING).join(first, list(RUN_KEYS)).where("low < doc")
    return found.where(F.col("kind") == GONE).select("doc", "nth", "run").unionByName(pending.select("doc", "nth", "run"))


def numbered(docs: DataFrame) -> DataFrame:
    """doc (null ids last), nth (0, but for rows that repeat a doc_id), text, doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    again = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = materialize(again, "suffix-repeated-ids")
    plain = own.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.lit(0).cast("long").alias("nth"), "text", "doc_id")
    if again.isEmpty():
        return plain
    rows = own.withColumn("key", text_key(F.col("text")))
    many = rows.join(again.withColumnRenamed("doc_id", "again"), F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
    nth = many.select("doc_id", "key").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")).cast("long"))
    nth = materialize(nth.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "nth"), "suffix-repeated-rows")
    joined = rows.join(nth, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    return joined.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.coalesce("nth", F.lit(0).cast("long")).alias("nth"), "text", "doc_id")


def repeated_runs(rows: DataFrame, length: int = 50, bucket_bytes: int = 4 << 20, most_buckets: int = 1 << 15, room: int = 32 << 20, at_once: int = 8 << 20) -> DataFrame:
    """doc, nth, run: the strings of `rows` (as `numbered` gives them) that a smaller doc has too.

    A task holds the runs of `at_once` bytes of text before the shuffle, and `room` bytes of runs behind it, whatever
    the size of the table: buckets are of about `bucket_bytes` of text, and fuller ones, as tables beyond
    `most_buckets` of them have, are split in the task.
    """
    texts = rows.select("doc", "nth", "text")
    partitions = 2 * n_partitions(rows.sparkSession)
    splitters = _sampled_splitters(texts, length, partitions, bucket_bytes, most_buckets)
    buckets = len(splitters) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, b in enumerate(sliced(batches, 2, at_once)):
            gone, rec = _local(_records(b, length))
            yield _dealt(rec, _bucket(rec, splitters), gone, buckets, partitions, turn)

    found = _compared(texts.mapInArrow(deal, DEALT), partitions, length, splitters, room, "suffix-runs")
    unsure = found.where(F.col("kind") == UNSURE).groupBy("doc", "nth").agg(F.collect_list("run").alias("runs"))
    cut = texts.join(unsure, ["doc", "nth"]).select("doc", "nth", "text", "runs")
    # strings are dealt by the leading bits of a fingerprint: each part of the input sends a key once, so none is heavy
    dealt = cut.mapInArrow(lambda it: _strings(sliced(it, 2, at_once), partitions, length), DEALT)
    strings = _compared(dealt, partitions, length, None, room, "suffix-strings")
    return _resolved(found).unionByName(_resolved(strings))


def _spans(runs: list[int] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs as [start, end) byte positions."""
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r = np.sort(np.array(runs, dtype=np.int64))
    start, end = r >> 8, (r >> 8) + (r & 255) + (length - 1)
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:] - 1, len(r) - 1]]


def deduplicated(docs: DataFrame, length: int = 50, texts: bool = False) -> DataFrame:
    """For each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With texts=True also spans (the removed [start, end) byte ranges) and kept (the remaining bytes, as binary: a cut
    may fall inside a character).
    """
    rows = numbered(docs)
    runs = repeated_runs(rows, length).groupBy("doc", "nth").agg(F.collect_list("run").alias("runs"))
    joined = rows.join(runs, ["doc", "nth"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        schema += ", spans array<struct<start:long,end:long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k.split()[0]: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for text, own in zip(utf8(b.column(1)), b.column(2).to_pylist()):
                text = text or b""
                start, end = _spans(own, length)
                bounds = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(bounds[::2], bounds[1::2])) if len(start) else text
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(start))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["spans"].append([{"start": i, "end": j} for i, j in zip(start.tolist(), end.tolist())])
                    out["kept"].append(kept)
            cols = {"doc_id": b.column(0)} | {k: pa.array(v) for k, v in out.items() if k not in ("spans", "kept")}
            if texts:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                cols |= {"spans": pa.array(out["spans"], kind), "kept": pa.array(out["kept"], pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    return joined.mapInArrow(run, schema)
