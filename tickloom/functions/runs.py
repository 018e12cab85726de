"""A function of each group of rows, for groups that are small and many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Places where a row's keys differ from those of the row before; null equals null."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k)
        codes = (c if pa.types.is_dictionary(c.type) else c.dictionary_encode(null_encoding="encode")).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def each_run(df: DataFrame, keys: list[str], order: list[str | Column], work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """work(rows of a group, in order) of each group of `keys`, as groupBy().applyInArrow() gives it."""
    return runs(df, keys, order, lambda groups: pa.concat_batches([work(g) for g in groups]), schema)


def runs(df: DataFrame, keys: list[str], order: list[str | Column], work: Callable[[list[pa.RecordBatch]], pa.RecordBatch], schema: StructType | str, cells: int = 100_000) -> DataFrame:
    """work(several groups of `keys`, each its rows in order) of all groups.

    As many groups come together as have `cells` rows or less when padded to the longest one; one at least. Groups are dealt by their keys and lie sorted in a partition, which one Python call goes through: many groups come in
    one Arrow batch, where applyInArrow() sends each on its own. No more than a batch, one group and
    `cells` rows are held.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _starts(batch, keys)
            if held:
                same = all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
                first = at[1] if len(at) > 1 else batch.num_rows
                if same:
                    held.append(batch.slice(0, first))
                    at = at[1:]
                if not len(at):
                    continue
                yield pa.concat_batches(held)
            for i, j in zip(at[:-1], at[1:]):
                yield batch.slice(i, j - i)
            held = [batch.slice(at[-1])]
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, longest = [], 0
        for group in whole(batches):
            longest = max(longest, group.num_rows)
            if few and longest * (len(few) + 1) > cells:
                yield work(few)
                few, longest = [], group.num_rows
            few.append(group)
        if few:
            yield work(few)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
