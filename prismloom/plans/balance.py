"""Even work for tasks that spend their time in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, per_core: int = 4) -> DataFrame:
    """Rows over at least ``per_core`` partitions per core. A small or coarsely split input is
    shuffled once; an input whose files make as many partitions, as a large one's do, is left
    alone. Decided by the sizes in the optimised plan, which runs nothing."""
    session = rows.sparkSession
    wanted = per_core * session.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    split = int(session._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return rows.repartition(wanted) if size < wanted * split else rows
