from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracelake.functions import money, text
from tracelake.functions.time import lower_bound
from tracelake.operators import aggregate as agg
from tracelake.operators import canonical, findings, graph, ranking, search, sequence


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


# --- aggregate ---------------------------------------------------------------------------


def test_spec_limits():
    with pytest.raises(ValueError):
        agg.Spec(("a", "b", "c", "d"))
    with pytest.raises(ValueError):
        agg.Spec(("a",), limit=1001)
    with pytest.raises(ValueError):
        agg.Predicate("a", "like", "x")
    with pytest.raises(ValueError):
        agg.Spec(("a",), since=datetime(2024, 1, 1), filters=(agg.Predicate("time", ">=", "2024"),))


def test_partition_dimension_is_prepended_unless_isolated(spark):
    domain = agg.Domain(dims={n: F.col(n) for n in ("a", "b", "c", "src")}, partition_by="src")
    assert agg.partitioned(agg.Spec(("a",)), domain).dims == ("src", "a")
    assert agg.partitioned(agg.Spec(("a",), filters=(agg.Predicate("src", "=", "x"),)), domain).dims == ("a",)
    with pytest.raises(ValueError):
        agg.partitioned(agg.Spec(("a", "b", "c")), domain)


@pytest.mark.parametrize("window,want", [("today", datetime(2026, 3, 4, tzinfo=timezone.utc)), ("thisweek", datetime(2026, 3, 2, tzinfo=timezone.utc)), ("3d", datetime(2026, 3, 1, 12, tzinfo=timezone.utc)), ("90m", datetime(2026, 3, 4, 10, 30, tzinfo=timezone.utc))])
def test_lower_bound(window, want):
    assert lower_bound(window, datetime(2026, 3, 4, 12, tzinfo=timezone.utc)) == want


@pytest.mark.parametrize("window", ["0d", "3w", "", "-1d"])
def test_lower_bound_rejects(window):
    with pytest.raises(ValueError):
        lower_bound(window)


# --- money -------------------------------------------------------------------------------


@pytest.mark.parametrize("model,want", [
    ("anthropic/claude-3-opus-20240229", ("claude", "opus", "anthropic")), ("o3-mini-2025", ("o", "3-mini", "openai")), ("gpt-5.1-codex-max", ("gpt", "5.1-codex-max", "openai")),
    ("gpt-9", ("gpt", "gpt-9", "openai")), ("models/gemini-2.5-flash", ("gemini", "flash", "google")), ("  ", ("unknown", "", "unknown")), (None, ("unknown", "", "unknown")), ("Mystery", ("unknown", "Mystery", "unknown")),
])
def test_model_info(spark, model, want):
    assert tuple(one(spark, money.model_info(F.lit(model).cast("string")))) == want


def test_longest_prefix_wins(spark):
    assert one(spark, money.prefix_price(F.lit("openai/GPT-4.1-mini-x"))["prefix"]) == "gpt-4.1-mini"
    assert one(spark, money.prefix_price(F.lit("llama"))["prefix"]) is None


def test_session_cost_counts_caches(spark):
    args = (F.lit("claude-sonnet-4-5"), F.lit(1_000_000), F.lit(None).cast("long"), F.lit(1_000_000), F.lit(1_000_000))
    assert one(spark, money.session_cost(*args)) == pytest.approx(3 + 0.3 + 3.75)


# --- text --------------------------------------------------------------------------------


def test_outcome_normalisation(spark):
    raw = "2026-04-21T10:00:00.5Z open /home/ann/x/y.py PID: 123\n [4567]"
    assert one(spark, text.normalized_outcome(F.lit(raw))) == "<TS> open <PATH> PID <PID> [<PID>]"


@pytest.mark.parametrize("raw,want", [
    ('open "/Users/ann/My Docs/a, b.txt" now', 'open "<PATH>" now'), ("open /Users/ann/My Docs/a.txt now", "open <PATH> now"), ("/home/ann/ x", "<PATH>/ x"),
    ("see (/tmp/a b/c)", "see (<PATH>)"), ("/home/ alone", "/home/ alone"), ("/tmp/a  b/c", "<PATH> b/c"), ("`/var/x y`", "`<PATH>`"),
    ("/tmp/" + "word " * 50_000 + "/end", "<PATH> " + "word " * 49_999 + "/end"), ("/tmp/" + "and/or " * 50_000 + "x", "<PATH> x"),
])
def test_paths_in_outcomes(spark, raw, want):
    assert one(spark, text.normalized_outcome(F.lit(raw))) == want


def test_names_next_to_other_scripts(spark):
    assert one(spark, text.anonymized(F.lit("用户alice说 alices /home/alice/x"), "alice")) == "用户[USER]说 alices /home/[USER]/x"


def test_each_row_has_its_own_name(spark):
    rows = [("alice", "/home/alice/x by Alice, bobby"), ("bobby", "/Users/bobby alice"), ("al", "al /home/al/x"), ("a.b$", "a.b$ axb$ /home/a.b$"), ("x\\Ey", "x\\Ey xy"), ("", "/home//x"), (None, "alice"), ("alice", None)]
    got = spark.createDataFrame(rows, "name string, t string").coalesce(1).select(text.anonymized(F.col("t"), F.col("name"))).collect()
    assert [r[0] for r in got] == ["/home/[USER]/x by [USER], bobby", "/Users/[USER] alice", "al /home/[USER]/x", "[USER] axb$ /home/[USER]", "[USER] xy", "/home//x", "alice", None]


def test_whole_texts_are_anonymised_and_normalised(spark, tmp_path):
    from tracelake.plans import catalog

    rows = [(i, 0, role, f"{role} 2026-04-21T10:00:00Z pid 12 {i}") for i, role in enumerate(["user", "assistant", "system"])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {q: sorted(r[-1] for r in catalog.QUERIES[q](spark, str(tmp_path)).collect()) for q in ("anonymize_texts", "outcome_texts")}
    assert got["anonymize_texts"] == [f"[USER] 2026-04-21T10:00:00Z pid 12 {i}" for i in range(3)]
    assert got["outcome_texts"] == sorted(f"{r[2]} <TS> pid <PID> {r[0]}" for r in rows)


@pytest.mark.parametrize("output,want", [
    ("Exit code 1\nTraceback (most recent call last):\n  File \"/a/b.py\", line 3\nKeyError: 'x'", "keyerror: 'x'"),
    ("\r\n  Error:\rcannot open /usr/lib/x.so at 0123abc line 42  ", "cannot open <path> at <hex> line #"),
    ("failed", ""), ("short\n\n", ""), ("", ""), (None, ""), ("x" * 200, "x" * 110),
    ("EISDIR: reading /a/b", ""), ("The user doesn't want to proceed with this tool use", ""),
])
def test_error_signatures(spark, output, want):
    assert one(spark, text.teachable_error(F.lit(output).cast("string"))) == want


@pytest.mark.parametrize("turn,want", [
    ("no, use the other file", True), ("nothing to add", False), ("ok but that's not what I meant", True), ("Let's use raw traces instead", True),
    ("can we use gpt instead?", False), ("please write " + "a" * 600 + " try again", False), ("<system-reminder>wrong\n</system-reminder> thanks", False),
    ("Caveat: this is wrong", False), ("x\nInvoke: redo it", False), ("", False), (None, False), ("it still fails", True),
])
def test_corrections(spark, turn, want):
    assert one(spark, text.is_correction(text.by_user(F.lit(turn).cast("string")))) is want


@pytest.mark.parametrize("command,want", [
    ("cd /x && pytest -q", "test"), ("/usr/bin/git status", "vcs"), ("make; ls -l", "filesystem"), ("a || docker-compose up", "container"),
    ("unknown --x", "other"), ("", "other"), (None, "other"), ("git push;", "other"), ("rg foo | head", "search"),
])
def test_command_categories(spark, command, want):
    assert one(spark, text.command_category(F.lit(command).cast("string"))) == want


@pytest.mark.parametrize("outputs,last,want", [
    (["3 passed, 1 failed"], "assistant", "tests_failed"), (["BUILD FAILED x::y", "5 passed"], "assistant", "build_failed"), (["FAILED a.py::t"], "assistant", "tests_failed"),
    (["pytest: all passed"], "user", "tests_passed"), (["passed"], "user", "partial"), (["a", "b", "Permission denied"], "assistant", "errored"),
    (["Permission denied", "b", "c", "d"], "assistant", "completed"), ([], "user", "analysis_only"), (["Ran 3 tests\nOK"], "assistant", "tests_passed"),
])
def test_outcome_badges(spark, tmp_path, outputs, last, want):
    from tracelake.plans import catalog

    rows = [(1, 0, "user", "12 failed"), *((1, i + 1, "assistant", o) for i, o in enumerate(outputs)), *([(1, 99, "user", None)] if last == "user" else [])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["badge"] for r in catalog.QUERIES["outcome_badge"](spark, str(tmp_path)).collect()] == [want]


def test_candidates_rank_by_recurrence(spark):
    rank = lambda *n: one(spark, ranking.candidate_rank(*(F.lit(x).cast("double") for x in n)))
    assert [rank(4, 5, 1, 2), rank(4, 5, 1, 9), rank(0, None, 0, None), rank(1, -3, 7, -1)] == pytest.approx([32, 32, 0.5, 1])


def test_names_and_risk(spark):
    names = lambda t, **k: one(spark, text.proper_names(F.lit(t), **k))
    assert names("xAnn Lee, Ann  Leeds _Bo Li1 Value Error Ann McLee Fix Build") == ["Ann  Leeds", "Bo Li", "Fix Build"]
    assert names("Fix Build Bo Li", no_first=("fix",)) == ["Bo Li"]
    risk = lambda *n: one(spark, text.sensitivity(*map(F.lit, n)))
    assert [risk(0, 0, 0), risk(1, 2, 1), risk(9, 0, 0)] == pytest.approx([0, 0.65, 1])


def test_badges_stand_in_for_judgements(spark):
    rows = [("resolved", "errored", "resolved"), ("odd", "errored", "unknown"), (None, "errored", "failed"), (None, "completed", "inconclusive"), (None, "x", "unscored"), (None, None, "unscored")]
    got = spark.createDataFrame(rows, "j string, b string, want string").select(text.normalized_badge(F.col("j"), F.col("b")), "want").collect()
    assert all(a == b for a, b in got)


def test_control_sequences(spark):
    raw = "a\x9b1mb\x1bPq#0\x1b\\c\x1b_x\x1b\\d\x1b]0;no end\x85e\tf\n"
    assert one(spark, text.without_ansi(F.lit(raw))) == "abcd]0;no ende\tf\n"


def test_ansi(spark):
    assert one(spark, text.without_ansi(F.lit("\x1b[31mred\x1b[0m\x07 \x1b]0;t\x07ok"))) == "red ok"


def test_task_type_first_wins_ties(spark):
    assert one(spark, text.task_type(F.lit("fix and add"), F.lit(""))) == "debugging"
    assert one(spark, text.task_type(F.lit("zzz"), F.lit("zzz"))) == "general"


def test_entropy(spark):
    assert one(spark, text.shannon_entropy(F.lit("aabb"))) == pytest.approx(1.0)


# --- canonical ---------------------------------------------------------------------------


def test_override_needs_equal_rank_to_win_and_strict_to_replace(spark):
    ev = spark.createDataFrame([(1, "k", "a", "medium", 1, 1), (1, None, "b", "low", 2, 2), (1, None, "c", "low", 2, 3)], "session int, event_key string, type string, confidence string, event_at int, event_id int")
    ov = spark.createDataFrame([(1, "k", "x", "medium", 1), (1, "k", "y", "medium", 2), (1, "h", "z", "low", 3)], "session int, event_key string, type string, confidence string, write_seq int")
    got = sorted(tuple("" if x is None else x for x in r) for r in canonical.merged(ev, ov).collect())
    assert got == [(1, "", "b", "low", "base"), (1, "", "c", "low", "base"), (1, "h", "z", "low", "hook_only"), (1, "k", "x", "medium", "override")]


# --- sequence ----------------------------------------------------------------------------


def usage(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "session int, turn int, data_source string, input long, cache_read long")


def test_estimate_breaks_the_cache_chain(spark):
    rows = [("api", 100, 1000), ("estimated", 100, 900), ("api", 100, 100), ("api", 110, 40)]
    assert [r["turn"] for r in sequence.cache_read_collapse(usage(spark, rows)).collect()] == [3]


def test_spike_needs_five_before_and_joins_the_baseline(spark):
    rows = [("api", 10, 0)] * 5 + [("estimated", 900, 0), ("api", 31, 0), ("api", 30, 0), ("api", 200, 0)]
    assert sorted(r["turn"] for r in sequence.input_spike(usage(spark, rows)).collect()) == [6, 8]


def test_runs_break_at_messages(spark):
    rows = [(1, i, i, k) for i, k in enumerate("aaaxaabbb")]
    df = spark.createDataFrame(rows, "session int, event_at int, event_id int, k string")
    got = sequence.loop_runs(df, F.when(F.col("k") != "x", F.col("k")), F.col("k") == "x").collect()
    assert sorted((r["fingerprint"], r["count"], r["first_event"], r["last_event"]) for r in got) == [("a", 3, 0, 2), ("b", 3, 6, 8)]


def test_error_then_recovery(spark):
    rows = [(1, "t", i, i, k) for i, k in enumerate(["e", "b", "e", "s", "e", "s", "s"])]
    df = spark.createDataFrame(rows, "session int, tool string, event_at int, event_id int, k string")
    got = sequence.error_recovery(df, F.col("k") == "s", F.col("k") == "e").collect()
    assert sorted((r["error_event"], r["success_event"]) for r in got) == [(2, 3), (4, 5)]


# --- graph -------------------------------------------------------------------------------


def test_tree_drops_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "node long, parent long")
    assert sorted(tuple(r) for r in graph.tree_depths(df).collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (6, 6, 0)]


# --- search, findings, ranking -----------------------------------------------------------


def test_search_terms(spark):
    docs = spark.createDataFrame([(1, "Red car fast"), (2, "red bus"), (3, "blue car"), (4, None)], "id long, text string")
    ids = lambda **k: sorted(r["doc_id"] for r in search.search(docs, search.Search(**k), "id", "text").collect())
    assert ids(all_of=("red", "car")) == [1]
    assert ids(any_of=("red", "car"), none_of=("bus",)) == [1, 3]
    assert ids(phrase=("red", "car")) == [1]
    assert ids(prefix="fas") == [1]
    with pytest.raises(ValueError):
        search.Search(none_of=("x",))


@pytest.mark.parametrize("text,want", [
    ("mail ann.lee@example.com now", [("email", "ann.lee@example.com")]), ("noreply@example.com", []),
    ("see https://github.com/ann-dev/proj.", [("github_repo_slug", "ann-dev/proj.")]), ("at 10.1.2.3 and 192.168.0.7", [("private_ip_10", "10.1.2.3"), ("private_ip_192", "192.168.0.7")]),
    ("http://localhost:80/x?y", [("localhost_url", "http://localhost:80/x?y")]), ("ssn 123-45-6789 not 000-12-3456", [("ssn_us", "123-45-6789")]),
    ("ann-macbook", [("personal_hostname", "ann-macbook")]), ("aa:bb:cc:dd:ee:ff", [("mac_address", "aa:bb:cc:dd:ee:ff")]),
])
def test_rules(spark, text, want):
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [(r["rule"], r["entity"]) for r in findings.scan(df).collect()] == want


HINTED = [
    "https://github.com/ann-dev/proj raw.githubusercontent.com/ann/x", "ann.lee@ example", "12345678:" + "Ab-_" * 9, "anns-laptop-2 bob-server", "/home/ann/src/x.py", "/Users/bob/work",
    "10.٣.2.1 172.16.0.1 172.40.0.1 192.168.٤.5", "AA-BB-CC-DD-EE-FF", "١٢٣-45-6789", "+49 (30) 1234-56789", "db.prod.INTERNAL x.ıntranet y.localnet", "http://172.20.1.1:80/x https://10.0.0.1",
    "http://127.0.0.1/x", "@scope/pkg-a lib/core@1.2.3-rc1", "gitlab.com/a-b/c/d bitbucket.org/aa/b", "arn:aws:s3:eu:123456789012:x", "123456789012.dkr.ecr.eu-1.amazonaws.com", "projects/abc-defgh1", "4111 1111-1111 1111", "nothing", "",
]


def test_hints_lose_no_finding(spark, small):
    df = spark.createDataFrame(list(enumerate(HINTED)), "doc_id long, text string")
    every = [lambda d, h=h: sorted(map(tuple, findings.scan(d, hints=h).collect())) for h in (findings.HINTS, {})]
    assert every[0](df) == every[1](df)
    assert {r[1] for r in every[0](df)} >= {"personal_hostname", "aws_arn", "telegram_bot_token", "internal_tld_host", "credit_card", "mac_address", "gcp_project_id"}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert every[0](docs) == every[1](docs)


def test_rows_without_an_id_are_scanned(spark):
    df = spark.createDataFrame([(None, "at 10.1.2.3"), (1, "x@"), (2, None)], "doc_id long, text string")
    assert [r["entity"] for r in findings.scan(df).collect() if r["doc_id"] is None] == ["10.1.2.3"]


def test_spans_point_into_the_text(spark):
    df = spark.createDataFrame([(1, "é 10.1.2.3")], "doc_id long, text string")
    r = findings.scan(df).first()
    assert "é 10.1.2.3"[r["start"] : r["end"]] == "10.1.2.3"


def test_alternating_and_budget(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("b", 3, 9), ("b", 4, 1)], "pool string, id long, size long")
    assert [r["id"] for r in ranking.alternating(df, "pool", [F.col("id")], 3).collect()] == [1, 3, 2]
    assert sorted(r["id"] for r in ranking.within_budget(df, "pool", [F.col("id")], "size", 5).collect()) == [1]


def test_interval_children_of_spans_that_start_at_once(spark):
    """Rows are not paired; results as by looking at all pairs, also with repeated ids, nulls and spans that end before they start."""
    import random

    rng = random.Random(3)
    at = lambda m: None if m is None else datetime(2026, 1, 1, m // 60, m % 60)
    rows = []
    for i in range(400):
        start = rng.choice([0, 0, 60, 60, 61, rng.randrange(600)])
        rows.append((i, rng.choice([1, 2, None]), start, rng.choice([None, start, start - 1 if start else 0, start + rng.randrange(200)])))
    schema = "id long, p int, started timestamp, ended timestamp"
    for more in ([], [(7, 1, 30, 400), (8, 2, 0, 500), (8, 2, 90, 95), (9, 1, 0, 300), (9, 1, 0, 300)]):
        spans = rows + more
        best = {}
        for c in spans:
            own = [(p[2], p[0]) for p in spans if c[1] is not None and p[1] == c[1] and p[0] != c[0] and p[3] is not None and p[2] <= c[2] <= p[3] and (p[2], p[0]) < (c[2], c[0])]
            if own:
                best[c[0]] = min([*own, *([best[c[0]]] if c[0] in best else [])])
        df = graph.interval_children(spark.createDataFrame([(i, p, at(s), at(e)) for i, p, s, e in spans], schema), "p")
        assert sorted(map(tuple, df.collect())) == sorted((c, p) for c, (_, p) in best.items())
        if not more:
            assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
