"""Running sums and numbers over range-partitioned rows: no group, however large, is one task's work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep

WRAP = 1 << 64


def task_count(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _local(group: str, values: list[str], names: list[str]):
    """Rows of one sorted task with ``nth`` and sums that begin anew with each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counted, summed = None, np.int64(0), [np.uint64(0)] * len(values)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = batch.column(group)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            same = last is not None and keys[0].as_py() == last
            starts = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            nth = np.arange(1, n + 1) - starts[which]
            first = which == 0
            if same:
                nth[first] += counted
            sums = []
            for i, v in enumerate(values):
                total = np.cumsum(batch.column(v).to_numpy().view(np.uint64), dtype=np.uint64)
                before = np.concatenate((np.zeros(1, np.uint64), total[:-1]))[starts]
                total = total - before[which]
                if same:
                    total[first] += summed[i]
                sums.append(total)
            last, counted, summed = keys[n - 1].as_py(), nth[-1], [s[-1] for s in sums]
            extra = [pa.array(nth), *[pa.array(s.view(np.int64)) for s in sums]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return run


def _finished(values: list[str], names: list[str]):
    """Adds the sums of earlier tasks; gives each value's sum up to the row and the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            nth = batch.column("nth").to_numpy() + batch.column("base_nth").fill_null(0).to_numpy()
            found["nth"] = pa.array(nth)
            for v in values:
                base = batch.column(f"base_{v}").fill_null(0).to_numpy().view(np.uint64)
                total = batch.column(f"sum_{v}").to_numpy().view(np.uint64) + base
                found[f"sum_{v}"] = pa.array(total.view(np.int64))
                found[f"before_{v}"] = pa.array((total - batch.column(v).to_numpy().view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [found[c] if c in found else batch.column(c) for c in names], names=names
            )

    return run


def running(
    rows: DataFrame,
    group: str,
    order: list[Column | str],
    values: list[str],
    name: str,
    after: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``rows`` with ``nth`` (from 1) and for each of ``values`` the running sums ``sum_v`` and ``before_v``
    (without the row itself) within ``group``, in ``order``; sums of 64-bit numbers, modulo 2**64.

    Rows are sorted by ranges of (group, order), so a group with a third of all rows lies in a third of the
    tasks. Each task sums what it holds; the sorted rows are stored with the number of their task, and one row
    a task (its first group, its last group and that group's sums) tells what the tasks before add to its
    first group. ``group`` is never null. ``after`` replaces columns once the rows are sorted, before they are
    stored, and keeps ``group`` and the order and number of the rows.
    """
    spark = rows.sparkSession
    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(task_count(spark), *keys).sortWithinPartitions(*keys)
    ranged = after(ranged) if after else ranged
    ranged = ranged.withColumn("task", F.spark_partition_id())
    fields = [*ranged.schema.fields, T.StructField("nth", T.LongType())]
    fields += [T.StructField(f"sum_{v}", T.LongType()) for v in values]
    local = keep(ranged.mapInArrow(_local(group, values, [f.name for f in fields]), T.StructType(fields)), name)
    ends = local.groupBy("task").agg(
        F.min(group).alias("first"), F.max(F.struct(group, "nth", *[f"sum_{v}" for v in values])).alias("last")
    )
    bases, open_group, carried = [], None, []
    for row in sorted(ends.collect(), key=lambda r: r["task"]):  # one row a task
        first, (last, *sums) = row["first"], row["last"]
        met = open_group is not None and first == open_group
        if met:
            bases.append((row["task"], first, *[x - WRAP if x >= WRAP // 2 else x for x in carried]))
        carried = [((b if met and last == first else 0) + x) % WRAP for b, x in zip(carried or [0] * len(sums), sums)]
        open_group = last
    kind = T.StructType(
        [T.StructField("task", T.IntegerType()), T.StructField(group, rows.schema[group].dataType)]
        + [T.StructField(f"base_{v}", T.LongType()) for v in ["nth", *values]]
    )
    joined = local.join(F.broadcast(spark.createDataFrame(bases, kind)), ["task", group], "left")
    out = [f for f in fields if f.name != "task"] + [T.StructField(f"before_{v}", T.LongType()) for v in values]
    return joined.mapInArrow(_finished(values, [f.name for f in out]), T.StructType(out))
