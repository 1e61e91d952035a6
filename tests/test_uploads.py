"""Upload reasons against a plain loop, family states, shared revisions, selection; when lessons are due."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelake.operators import uploads

NOW, ENROLLED = datetime(2026, 6, 1), datetime(2026, 1, 1)
SESSION = "session_id long, logical_id long, source string, project string, review_status string, hold_state string, embargo_until timestamp_ntz, revision string, stable_since timestamp_ntz, sealed boolean, ended_at timestamp_ntz, active boolean, has_blob boolean, has_raw boolean, score int"
SHARE = "session_id long, share_id long, revision string, shared_at timestamp_ntz, created_at timestamp_ntz"
NAMES = [c.split()[0] for c in SESSION.split(", ")]
SCOPES, MODES = [("a", "p"), ("a", "q"), ("b", "q"), ("c", "p")], [("a", "stable_revision"), ("b", "explicit_close"), ("c", "sometimes")]


def lit(t):
    return F.lit(t.isoformat()).cast("timestamp_ntz")


def session(**other):
    old = NOW - timedelta(days=9)
    return {"session_id": 1, "logical_id": 1, "source": "a", "project": "p", "review_status": "new", "hold_state": "auto_redacted", "embargo_until": None, "revision": "r1", "stable_since": old, "sealed": False, "ended_at": old, "active": True, "has_blob": True, "has_raw": True, "score": 3, **other}


def decided(spark, sessions, shares=(), confirmed=True, scopes=tuple(SCOPES)):
    s = spark.createDataFrame([tuple(x[c] for c in NAMES) for x in sessions], SESSION)
    return uploads.upload_reasons(
        s, spark.createDataFrame(list(shares), SHARE), spark.createDataFrame(list(scopes), "source string, project string"),
        spark.createDataFrame(MODES, "source string, mode string"), lit(ENROLLED), lit(NOW), confirmed=confirmed,
    )


def reason_of(x, family, shares):
    """The rules one by one, for a session and its family."""
    pairs, day = set(SCOPES), timedelta(days=1)
    mode = dict(MODES).get(x["source"])
    done = sorted((s[3], s[4], s[1], s[2]) for s in shares if s[0] == x["session_id"] and s[3] and s[2])

    def hold(m):
        state = m["hold_state"] if m["hold_state"] in ("auto_redacted", "pending_review", "released", "embargoed") else "pending_review"
        if state == "embargoed" and m["embargo_until"] is None:
            return "pending_review"
        return "released" if state == "embargoed" and m["embargo_until"] <= NOW else state

    steps = [
        ("source_excluded", lambda: all(x["source"] != s for s, _ in pairs)), ("project_excluded", lambda: all(x["project"] != p for _, p in pairs)), ("scope_pair_excluded", lambda: (x["source"], x["project"]) not in pairs),
        ("unsupported_unsettled", lambda: x["ended_at"] is None), ("pre_enrollment", lambda: x["ended_at"] <= ENROLLED), ("unsupported_unsettled", lambda: x["ended_at"] > NOW or mode not in ("stable_revision", "explicit_close")),
        ("unsupported_unsettled", lambda: mode == "stable_revision" and not x["sealed"] and (x["stable_since"] is None or x["stable_since"] > NOW - day or x["ended_at"] > NOW - day)),
        ("already_shared", lambda: any(d[3] == x["revision"] for d in done)), ("changed_revision_needing_approval", lambda: done and x["review_status"] != "approved"),
        ("blocked_review_status", lambda: any(m["review_status"] == "blocked" for m in family) or (x["review_status"] or "new") not in ("new", "shortlisted", "approved")),
        ("held_or_embargoed", lambda: any(hold(m) in ("pending_review", "embargoed") for m in family)), ("missing_blob", lambda: not x["has_blob"]), ("raw_source_unavailable", lambda: not x["has_raw"]),
    ]
    return next((name for name, applies in steps if applies()), "eligible")


def test_reasons_equal_the_rules_one_by_one(spark):
    rng = random.Random(5)
    near = [NOW - timedelta(hours=h) for h in (-1, 0, 1, 23, 24, 25, 400)] + [ENROLLED, ENROLLED + timedelta(seconds=1), None]
    often = lambda usual, *rare: usual if rng.random() < 0.75 else rng.choice(rare)
    base = session()
    sessions = [
        session(
            session_id=i, logical_id=i // 2, source=often("a", "b", "c", "x", None), project=often("p", "q", "z", None), review_status=often("new", "approved", "shortlisted", "blocked", "rejected", None), hold_state=often("released", "auto_redacted", "pending_review", "embargoed", "?", None),
            embargo_until=rng.choice(near), revision=often("r1", "r2", None), stable_since=often(base["stable_since"], *near), sealed=often(False, True, None), ended_at=often(base["ended_at"], *near), active=often(True, None, False), has_blob=often(True, False, None), has_raw=often(True, False, None),
        )
        for i in range(1500)
    ]
    shares = [(rng.randrange(1500), k, rng.choice(["r1", "r2", "r0", None]), often(NOW, None), NOW) for k in range(400)]
    got = {r.session_id: r.reason for r in decided(spark, sessions, shares).select("session_id", "reason").collect()}
    live = [x for x in sessions if x["active"] is not False]
    want = {x["session_id"]: reason_of(x, [m for m in live if m["logical_id"] == x["logical_id"]], shares) for x in live}
    assert got == want and len(set(want.values())) == 12  # all but the lost confirmation


def test_a_lost_confirmation_keeps_all_enrolled_sessions_back(spark):
    rows = decided(spark, [session(), session(session_id=2, source="x")], confirmed=False).select("session_id", "reason").collect()
    assert {r.session_id: r.reason for r in rows} == {1: "scope_confirmation_changed", 2: "source_excluded"}
    pairs = lambda rows: spark.createDataFrame(rows, "source string, project string")
    assert [r.blocker for r in uploads.scope_blockers(pairs(SCOPES), pairs([("a", "p"), ("b", "z")])).orderBy("blocker").collect()] == ["enrolled_project_removed", "enrolled_source_removed"]
    assert uploads.scope_blockers(pairs(SCOPES), pairs(SCOPES)).count() == 0


def test_an_approved_change_goes_up_again_unless_shared_before(spark):
    shares = [(1, 1, "r0", NOW, NOW), (2, 1, "r1", NOW - timedelta(days=2), NOW), (2, 2, "r9", NOW, NOW), (3, 1, "r0", NOW, NOW), (3, 2, "r0", None, NOW)]
    rows = decided(spark, [session(session_id=i, logical_id=i, review_status="approved" if i < 3 else "new") for i in (1, 2, 3)], shares)
    assert {r.session_id: (r.reason, r.latest_revision) for r in rows.collect()} == {1: ("eligible", "r0"), 2: ("already_shared", "r9"), 3: ("changed_revision_needing_approval", "r0")}


def test_selection_orders_by_score_then_end_and_counts_the_rest(spark):
    ends = [NOW - timedelta(days=d) for d in (5, 4, 4, 9, 3, 8, 2)]
    scores = [5, 5, 5, None, 1, 0, None]
    rows = decided(spark, [session(session_id=i, logical_id=i, score=s, ended_at=e) for i, (s, e) in enumerate(zip(scores, ends))])
    got = uploads.upload_selection(rows, 5).collect()
    assert [r.session_id for r in got] == [1, 2, 0, 4, 5] and {r.deferred for r in got} == {2} and not any(r.updated for r in got)
    assert uploads.upload_selection(rows, 9).first().deferred == 0
    assert uploads.upload_selection(rows.limit(0)).count() == decided(spark, []).count() == 0


@pytest.fixture(scope="module")
def decisions(spark):
    """Scopes named days-nudged-sessions-failures, each with as many sessions."""
    day = timedelta(days=1)
    cases = list(itertools.product((None, 6.9, 7, 13, 14), (None, 2.9, 3), (0, 4, 5, 24, 25, 40), (0, 2, 3)))
    scopes, sessions = [], []
    for i, (days, nudged, n, failures) in enumerate(cases):
        seen = None if days is None else NOW - days * day
        scopes.append((str(i), i % 11 != 10, seen, None if nudged is None else NOW - nudged * day))
        for k in range(n):
            sessions.append((i * 100 + k, str(i), "p", NOW - timedelta(minutes=k), 3 if k < failures and k % 2 else 0, "failed" if k < failures and k % 2 == 0 else "resolved", "released", None, "new"))
        if seen is not None:  # none of these counts
            more = [("p", seen, "released", "new"), ("p", NOW + day, "released", "new"), ("out", NOW, "released", "new"), ("p", NOW, "pending_review", "new"), ("p", NOW, None, "new"), ("p", NOW, "released", "segmented")]
            sessions += [(i * 100 + 50 + k, str(i), p, at, 5, "failed", hold, None, review) for k, (p, at, hold, review) in enumerate(more)]
    s = spark.createDataFrame(sessions, "session_id long, scope string, project string, started_at timestamp_ntz, score int, outcome string, hold_state string, embargo_until timestamp_ntz, review_status string")
    got = uploads.lessons_due(s, spark.createDataFrame(scopes, "scope string, enabled boolean, last_activity timestamp_ntz, last_nudged timestamp_ntz"), spark.createDataFrame([(str(i), "out") for i in range(len(cases))], "scope string, project string"), lit(NOW))
    return cases, {int(r.scope): r for r in got.collect()}


def test_lessons_are_due_by_every_limit(decisions):
    cases, got = decisions
    assert len(got) == len(cases)
    for i, (days, nudged, n, failures) in enumerate(cases):
        failures = min(failures, n)
        want = (
            "nudge-not-enabled" if i % 11 == 10 else "never-distilled" if days is None else "fresh" if days < 7 else "cooldown" if nudged is not None and nudged < 3
            else "quiet" if n < 5 else "due" if failures >= 3 or n >= 25 or days >= 14 else "waiting"
        )
        assert got[i].decision == want, cases[i]
        if days is not None:
            assert got[i].sessions == min(n, 25) and got[i].saturated == (n >= 25), cases[i]
            assert n > 25 or got[i].failures == failures
