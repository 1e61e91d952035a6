"""Which sessions may be uploaded without asking, and why the others may not; when lessons are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# States, limits and hours of the surveyed rules.
HOLDS = ("auto_redacted", "pending_review", "released", "embargoed")
SHAREABLE = ("auto_redacted", "released")
REVIEWS = ("new", "shortlisted", "approved")
STABLE_HOURS, SELECTED = 24, 5
MIN_DAYS, STALE_DAYS, COOLDOWN_DAYS = 7, 14, 3
MIN_SESSIONS, BURST_SESSIONS, FAILURE_SESSIONS = 5, 25, 3


def effective_hold(now: Column) -> Column:
    """The hold state: an unknown one waits for review, an embargo that is over releases."""
    known = F.when(F.col("hold_state").isin(*HOLDS), F.col("hold_state")).otherwise("pending_review")
    return F.when((known == "embargoed") & (F.col("embargo_until") <= now), "released").otherwise(known)


def family_controls(sessions: DataFrame, now: Column) -> DataFrame:
    """logical_id, family_blocked, family_hold: the strictest states of a family's sessions.

    An embargo without an end waits for review.
    """
    hold = effective_hold(now)
    asked = F.bool_or((hold == "pending_review") | ((hold == "embargoed") & F.col("embargo_until").isNull()))
    state = F.when(asked, "pending_review").when(F.bool_or(hold == "embargoed"), "embargoed").when(F.bool_and(hold == "released"), "released").otherwise("auto_redacted")
    return sessions.groupBy("logical_id").agg(F.coalesce(F.bool_or(F.col("review_status") == "blocked"), F.lit(False)).alias("family_blocked"), state.alias("family_hold"))


def shared_revisions(shares: DataFrame) -> DataFrame:
    """session_id, latest_revision, shared_revisions of what was shared: (session_id, share_id, revision, shared_at, created_at)."""
    done = shares.where("shared_at IS NOT NULL AND revision IS NOT NULL")
    return done.groupBy("session_id").agg(F.max_by("revision", F.struct("shared_at", "created_at", "share_id")).alias("latest_revision"), F.collect_set("revision").alias("shared_revisions"))


def scope_blockers(scopes: DataFrame, active: DataFrame) -> DataFrame:
    """blocker of an enrollment: the sources and projects of its (source, project) pairs that are no longer among the active ones."""
    gone = lambda c: scopes.select(c).distinct().join(active.select(c).distinct(), c, "left_anti").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(f"enrolled_{c}_removed").alias("blocker"))
    return gone("source").unionByName(gone("project"))


def upload_reasons(sessions: DataFrame, shares: DataFrame, scopes: DataFrame, modes: DataFrame, enrolled_at: Column, now: Column, *, confirmed: bool = True) -> DataFrame:
    """The sessions with ``reason``: the first of twelve that keeps one back, or ``eligible``.

    ``scopes`` are the enrolled (source, project) pairs and ``modes`` tells of each source how its
    sessions end: by an explicit close, or once their revision and end are a day old (sealed segments
    at once). ``confirmed`` is false where the enrollment lost a part of its scope. A null in
    ``review_status`` means new. Sessions whose ``active`` is false take no part.
    """
    s = sessions.where(F.coalesce("active", F.lit(True)))
    flag = lambda df, name, *keys: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = (
        s.join(family_controls(s, now), "logical_id", "left").join(shared_revisions(shares), "session_id", "left")
        .join(flag(scopes, "_source", "source"), "source", "left").join(flag(scopes, "_project", "project"), "project", "left")
        .join(flag(scopes, "_pair", "source", "project"), ["source", "project"], "left").join(modes.select("source", "mode"), "source", "left")
    )
    end, cutoff = F.col("ended_at"), now - F.expr(f"INTERVAL {STABLE_HOURS} HOUR")
    settled = (F.col("mode") == "explicit_close") | (F.col("mode") == "stable_revision") & (F.col("sealed") | (F.col("stable_since") <= cutoff) & (end <= cutoff))
    review = F.coalesce("review_status", F.lit("new"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.col("_source").isNull(), "source_excluded").when(F.col("_project").isNull(), "project_excluded").when(F.col("_pair").isNull(), "scope_pair_excluded")
        .when(F.lit(not confirmed), "scope_confirmation_changed").when(end.isNull(), "unsupported_unsettled").when(end <= enrolled_at, "pre_enrollment")
        .when(no((end <= now) & settled), "unsupported_unsettled").when(F.array_contains("shared_revisions", F.col("revision")), "already_shared")
        .when(~F.col("latest_revision").eqNullSafe(F.col("revision")) & F.col("latest_revision").isNotNull() & (review != "approved"), "changed_revision_needing_approval")
        .when(F.col("family_blocked") | ~review.isin(*REVIEWS), "blocked_review_status").when(~F.col("family_hold").isin(*SHAREABLE), "held_or_embargoed")
        .when(no(F.col("has_blob")), "missing_blob").when(no(F.col("has_raw")), "raw_source_unavailable").otherwise("eligible")
    )
    return rows.withColumn("reason", reason).drop("_source", "_project", "_pair")


def upload_selection(reasons: DataFrame, n: int = SELECTED) -> DataFrame:
    """The best eligible sessions: session_id, score, ended_at, mode, updated (shared before in another revision), deferred (how many more there are)."""
    e = reasons.where("reason = 'eligible'")
    total = e.agg(F.count(F.lit(1)).alias("_total"))  # one row
    best = e.orderBy(F.col("score").desc_nulls_last(), F.col("ended_at").desc(), "session_id").limit(n).crossJoin(F.broadcast(total))
    return best.select("session_id", "score", "ended_at", "mode", F.col("latest_revision").isNotNull().alias("updated"), F.greatest(F.col("_total") - n, F.lit(0)).alias("deferred"))


def lessons_due(sessions: DataFrame, scopes: DataFrame, excluded: DataFrame, now: Column) -> DataFrame:
    """scope, days, sessions, failures, saturated, decision: whether each scope's lessons are due.

    ``scopes`` has scope, enabled, last_activity (the last run or look at the lessons) and last_nudged;
    sessions count when they began after that activity, may be shared, aren't ``segmented`` and
    their project isn't ``excluded`` (session's scope, project). Of each scope the newest 25 are looked at:
    they settle every limit, and ``saturated`` tells that there may be more. Windows keep no more of a
    group in a task than these.
    """
    days = F.when(F.col("last_activity").isNotNull(), F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))) / 86_400_000_000.0, F.lit(0.0)))
    nudged = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_nudged").cast("timestamp"))) / 86_400_000_000.0
    anchors = scopes.select("scope", "enabled", "last_activity", nudged.alias("nudged"), days.alias("days"))
    s = sessions.where(effective_hold(now).isin(*SHAREABLE) & (F.coalesce("review_status", F.lit("new")) != "segmented") & (F.col("started_at") <= now))
    s = s.join(excluded.select("scope", "project").distinct(), ["scope", "project"], "left_anti").join(anchors.select("scope", "last_activity"), "scope").where("started_at > last_activity")
    newest = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("started_at").desc(), "session_id"))
    failed = (F.col("score") >= 3) | F.col("outcome").isin("failed", "abandoned")
    kept = s.select("scope", failed.alias("failed"), newest.alias("n")).where(F.col("n") <= BURST_SESSIONS)
    counted = kept.groupBy("scope").agg(F.count(F.lit(1)).alias("sessions"), F.count(F.when(F.col("failed"), 1)).alias("failures"))
    zero = F.lit(0).cast("long")
    a = anchors.join(counted, "scope", "left").withColumns({"sessions": F.coalesce("sessions", zero), "failures": F.coalesce("failures", zero)})
    urgent = (F.col("failures") >= FAILURE_SESSIONS) | (F.col("sessions") >= BURST_SESSIONS) | (F.col("days") >= STALE_DAYS)
    decision = (
        F.when(~F.coalesce("enabled", F.lit(False)), "nudge-not-enabled").when(F.col("days").isNull(), "never-distilled").when(F.col("days") < MIN_DAYS, "fresh")
        .when(F.col("nudged") < COOLDOWN_DAYS, "cooldown").when(F.col("sessions") < MIN_SESSIONS, "quiet").when(urgent, "due").otherwise("waiting")
    )
    return a.select("scope", "days", "sessions", "failures", (F.col("sessions") >= BURST_SESSIONS).alias("saturated"), decision.alias("decision"))
