"""SimHash near-duplicates: fingerprints of 3-word shingles, compared exactly in tiles.

The bits are cut into radius + 2 blocks. Two fingerprints within the radius agree on two of them at least, so equal
pairs of blocks (buckets) bring together all pairs that can link, and a bucket holds a small part of the fingerprints
even of a very large table. In each bucket a tile is one population count: rows are sorted by it, and tiles whose
counts differ beyond the radius are never compared. A bucket with many distinct fingerprints is dealt out tile pair by
tile pair (by a hash too, where one count alone is too many). numpy compares by exclusive-or and bit count; a forest
of the links found leaves the task, so a group of any size costs no more rows than it has members. Equal
fingerprints are one row throughout.

Defined cases: a null, empty or blank text has the zero fingerprint, which links like any other; rows that repeat a
doc_id share its component; a null doc_id takes part but is never the smallest unless it is the only one, and then
component_id is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.llm.common import materialize, n_partitions, text_key, utf8, whole_groups
from molgrid.llm.components import connected_components

SEED = 42
BITS = 64


def fingerprint_batch(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints. A bit is set where over half of the shingle hashes have it."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    for at, text in enumerate(texts):
        words = text.lower().split() if text else []  # bytes: A-Z and the six ASCII white-space characters only
        if not words:
            continue
        if len(words) <= shingle:
            hashes = [xxh64_intdigest(b" ".join(words), SEED)]
        elif shingle == 3:
            led = [w + b" " for w in words]
            hashes = [xxh64_intdigest(a + b + c, SEED) for a, b, c in zip(led, led[1:], words[2:])]
        else:
            hashes = [xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
        votes = np.zeros(BITS, dtype=np.int64)
        for s in range(0, len(hashes), 1 << 17):
            part = np.array(hashes[s : s + (1 << 17)], dtype="<u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[at] = weights[2 * votes > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fp: one row for each row of `docs`; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_batch(utf8(b.column(2)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return of.mapInArrow(run, "doc_id long, text_key long, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the links a-b connect it to."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _compare(radius: int):
    """Links of tile pairs sorted by population count: rows d apart are compared for d = 1, 2, ... all at once, as long
    as their counts are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket", "pair"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            bucket, pair = t.column("bucket").to_numpy(), t.column("pair").to_numpy()
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])]
            group, pop = np.cumsum(new), np.bitwise_count(fp).astype(np.int64)
            at = np.arange(len(fp) - 1)
            root, d = np.arange(len(fp)), 1
            linked_a, linked_b, held = [], [], 0
            while True:
                at = at[at + d < len(fp)]
                at = at[(group[at] == group[at + d]) & (pop[at + d] - pop[at] <= radius)]
                if not len(at):
                    break
                near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
                linked_a.append(near)
                linked_b.append(near + d)
                held += len(near)
                d += 1
                if held > 2_000_000:  # fold the links found so far into the forest
                    up = np.flatnonzero(root != np.arange(len(fp)))
                    root = _forest(len(fp), np.concatenate([*linked_a, up]), np.concatenate([*linked_b, root[up]]))
                    linked_a, linked_b, held = [], [], 0
            up = np.flatnonzero(root != np.arange(len(fp)))
            root = _forest(len(fp), np.concatenate([*linked_a, up]).astype(int), np.concatenate([*linked_b, root[up]]).astype(int))
            hung = np.flatnonzero(root != np.arange(len(fp)))
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[hung]), pa.array(signed[root[hung]])], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 2, tile: int = 512) -> DataFrame:
    """a, b: a forest over the distinct fingerprints `fp`, with a path wherever fingerprints within `radius` lead."""
    blocks = radius + 2
    width = -(-BITS // blocks)
    cut = [F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << min(width, BITS - k * width)) - 1)) for k in range(blocks)]
    pairs = list(combinations(range(blocks), 2))
    values = [(F.shiftleft(cut[i], width).bitwiseOR(cut[j])) * len(pairs) + k for k, (i, j) in enumerate(pairs)]
    rows = distinct.select("fp", F.explode(F.array(*values)).alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(crowded, "bucket").withColumn("pop", F.bit_count("fp"))
    # a tile: one population count, and one of `cuts` hash values where that many rows may have the same count
    cuts = F.ceil(F.col("n") / (4 * tile))
    span = F.when(F.col("n") <= tile, F.lit(0)).otherwise(cuts)
    tiled = rows.withColumn("cuts", span).withColumn("own", F.pmod(F.xxhash64("fp"), F.greatest("cuts", F.lit(1))))
    near = F.sequence(F.col("pop") - radius, F.col("pop") + radius)
    other = F.flatten(
        F.transform(near, lambda p: F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda c: p * F.col("cuts") + c))
    )
    mine = F.col("pop") * F.col("cuts") + F.col("own")
    base = (BITS + 2 * radius + 2) * F.col("cuts")
    pair = F.transform(other, lambda o: F.least(mine, o) * base + F.greatest(mine, o))
    parts = tiled.select("bucket", "fp", F.explode(F.when(F.col("cuts") == 0, F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("pair"))
    n = n_partitions(distinct.sparkSession)
    dealt = parts.repartition(n, "bucket", "pair").sortWithinPartitions("bucket", "pair", F.bit_count("fp"))
    return dealt.select("bucket", "pair", "fp").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, tile: int = 512) -> DataFrame:
    """doc_id, text_key, fp, component_id (smallest doc_id reachable through links), one row for each row of `docs`."""
    of = materialize(fingerprints(docs, shingle), "simhash-fp")
    distinct = materialize(of.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    roots = connected_components(links(distinct, radius, tile), "simhash-components")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    label = rooted.join(low, "root").select("fp", "component_id")
    return of.join(label, "fp").select("doc_id", "text_key", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest doc_id; all columns kept.

    Rows that repeat that doc_id stay with it where they have the same text. Where all ids of a component are null,
    all of its rows stay: none can be told from the others.
    """
    gone = (
        near_duplicates(docs, radius)
        .where("doc_id != component_id or (doc_id is null and component_id is not null)")
        .select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"))
    )
    on = docs["doc_id"].eqNullSafe(gone["__doc_id"]) & (text_key(docs["text"]) == gone["__text_key"])
    return docs.join(gone, on, "left_anti")
