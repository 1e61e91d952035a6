"""Holds and revision checks as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def effective_hold(now: Column) -> Column:
    """The hold state, with embargoes that are over as released."""
    over = (F.col("hold_state") == "embargoed") & (F.col("embargo_until") <= F.to_date(now))
    return F.when(over, "released").otherwise(F.col("hold_state"))


def blockers(asked: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """session_id, blocker of the asked sessions that may not be released."""
    held = sessions.select("session_id", effective_hold(now).alias("hold"))
    why = F.when(F.col("hold").isNull(), "missing").when(F.col("hold") == "pending_review", "pending").when(F.col("hold") == "embargoed", "embargoed")
    return asked.join(held, "session_id", "left").select("session_id", why.alias("blocker")).where("blocker IS NOT NULL")


def revision_blockers(sessions: DataFrame) -> DataFrame:
    w = Window.partitionBy("logical_id").orderBy("started_at", "session_id")
    p = sessions.select("session_id", "status", "cost", F.lag(F.struct("session_id", "status", "cost")).over(w).alias("p"))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"p.{c}"))
    blocker = F.when(F.col("p").isNull(), "first").when(same("status") & same("cost"), "exact_shared").when(~same("status"), "share_changed").otherwise("predecessor")
    return p.select("session_id", blocker.alias("blocker"))
