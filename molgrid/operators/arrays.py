"""Sums of array columns, which Spark's own aggregates don't have: rows of one key stand beside each other and are added up in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sum_arrays(parts: DataFrame, keys: list[str], value: str, dealt_by: list[str] | None = None) -> DataFrame:
    """One row for each of `keys` with the element-wise sum of `value` (array<double>, equally long within a key).

    A task holds one sum at a time. dealt_by: the keys that rows are partitioned by, if not all.
    """
    kinds = {**dict(parts.dtypes), value: "array<double>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, types = None, None, None

        def rows(found: list[tuple], sums: list[np.ndarray]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.list_(pa.float64()))], names=[*keys, value])

        for b in batches:
            types = [b.column(k).type for k in keys]
            found, sums = [], []
            at, flat = b.column(value).offsets.to_numpy(), b.column(value).values.to_numpy()
            for n, own in enumerate(zip(*(b.column(k).to_pylist() for k in keys))):
                v = flat[at[n] : at[n + 1]]
                if own == key:
                    total = total + v
                    continue
                if key is not None:
                    found.append(key)
                    sums.append(total)
                key, total = own, v
            if found:
                yield rows(found, sums)
        if key is not None:
            yield rows([key], [total])

    dealt = parts.select(*keys, value).repartition(*(dealt_by or keys)).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, value]))
