"""How many tasks a step gets. Sizes after shuffles are what rows take when they are compressed, and a table's splits know nothing of the
texts that are made of its rows; a step whose rows are large counts them instead, so that one task's share has a bound at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a task, where rows are of a line or two; characters of a task, where rows are whole texts.
ROWS, CHARS = 50_000, 2 << 20


def tasks_of(df: DataFrame, size: Column | None = None, most: int = ROWS) -> int:
    """As many tasks as df's rows need, or the sum of ``size`` over them, with ``most`` to a task; at least one for each core. It is a pass
    over the columns that ``size`` needs."""
    total = df.agg(F.count(F.lit(1)) if size is None else F.sum(size)).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-int(total) // most))
