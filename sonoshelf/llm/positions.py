"""Places of rows within their group, in order, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stow, unused

TASK_BITS = 33  # what monotonically_increasing_id leaves for the rows of a task


def numbered(df: DataFrame, group: str, order: list[str], pos: str = "pos", size: str = "size") -> DataFrame:
    """df with the place of each row within its group, from 0, and the group's number of rows.

    Rows are dealt by ranges of group and order, so a large group lies in many tasks. Each task numbers its rows; what
    lies before a task is summed over one row per group and task. Nulls come first; rows that are alike in group and
    order stand as they were read.
    """
    row, at, task, first, n, of, before = unused(df.columns, "row", "at", "task", "first", "n", "of", "before")
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, row)]
    dealt = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(row)
    placed = stow(dealt.withColumn(at, F.monotonically_increasing_id()), "placed").withColumn(task, F.shiftright(at, TASK_BITS))
    runs = placed.groupBy(F.col(group).alias(of), F.col(task).alias(f"{of}_task")).agg(F.min(at).alias(first), F.count("*").alias(n))
    by_task = Window.partitionBy(of).orderBy(f"{of}_task")
    runs = runs.withColumn(before, F.coalesce(F.sum(n).over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(size, F.sum(n).over(Window.partitionBy(of)))
    out = placed.join(runs, F.col(group).eqNullSafe(F.col(of)) & (F.col(task) == F.col(f"{of}_task")))
    return out.withColumn(pos, F.col(at) - F.col(first) + F.col(before)).select(*df.columns, pos, size)
