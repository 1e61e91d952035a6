"""Sessions as a line of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.workflow import HEAD, TAIL, step_text

ARROW = " \N{RIGHTWARDS ARROW} "


def oneliners(steps: DataFrame, key: str, order: list[str], depths: tuple[str, ...]) -> DataFrame:
    """key, steps, and a line for each depth: the first five and the last two of a session's steps, or all up to seven.

    ``steps`` has a column ``step``; ``order`` makes its rows distinct within a session. Only the ends
    of a session are sorted: limits on row numbers reach the tasks before the shuffle.
    """
    shown = HEAD + TAIL
    first, last = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    texts = steps.select(key, *order, F.struct(*(step_text(F.col("step"), d).alias(d) for d in depths)).alias("text"))
    head = texts.withColumn("n", F.row_number().over(first)).where(F.col("n") <= shown).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("head"))
    tail = texts.withColumn("n", F.row_number().over(last)).where(F.col("n") <= TAIL).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "text"))).alias("tail"))
    counts = steps.groupBy(key).agg(F.count(F.lit(1)).alias("steps"))
    said = lambda c, depth: F.transform(c, lambda x: x["text"][depth])
    more = F.concat(F.lit("... "), (F.col("steps") - shown).cast("string"), F.lit(" more ..."))
    parts = lambda d: F.when(F.col("steps") <= shown, said("head", d)).otherwise(F.concat(said(F.slice("head", 1, HEAD), d), F.array(more), said("tail", d)))
    return counts.join(head, key).join(tail, key).select(key, "steps", *(F.array_join(parts(d), ARROW).alias(d) for d in depths))
