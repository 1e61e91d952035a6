"""File types, outcomes of tests, first sentences, steps and their lines."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import workflow
from tracelake.operators.workflow import oneliners


def told(spark, column, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_file_types(spark):
    cases = {
        "a/B.PY": "python file", "test_x.rs": "test file", "x_test.go": "test file", "a/tests/b": "test file", "tests/b": "file", "__tests__/a.js": "javascript file", "a/__tests__/b.css": "test file", "Makefile": "build file", "x/CMakeLists.txt": "text file",
        "Dockerfile": "dockerfile", "a.dockerfile": "dockerfile", ".env": "config file", "yarn.lock": "lockfile", "x.h": "header file", "sh": "file", "": "file", "a.tar.gz": "file",
    }
    assert told(spark, workflow.file_type, cases) == list(cases.values())


def test_outcomes_and_line_counts(spark):
    cases = {
        "5 passed": "5/5 passed", "3 passed, 2 failed in 1s": "3/5 passed", "3 passed\n2 failed": "3/3 passed", "Tests: 3 passed, 1 failed, 4 total": "3/4 passed", "All PASSED": "passed", "passed with error": "failed", "Failed": "failed",
        "": None, None: None, "quiet": None, "9" * 30 + " passed": "passed",
    }
    assert told(spark, workflow.outcome_of_tests, cases) == list(cases.values())
    lines = {"": 0, None: 0, "a": 1, "a\n": 1, "a\nb": 2, "\n\n": 2}
    assert told(spark, workflow.count_lines, lines) == list(lines.values())
    commands = {"npm test": True, "Cargo Test -q": True, "python3 -m unittest x": True, "make": False, "": False}
    assert told(spark, workflow.runs_tests, commands) == list(commands.values())


def test_first_sentences(spark):
    many = " ".join(f"w{i}" for i in range(40))
    cases = {
        "Fix it. Then go! Now": "Fix it.", "Why? Oh! Well. Done": "Why? Oh! Well.", "Go! Why? x": "Go!", "a  b\nrest": "a  b", " <b>bold</b> words ": "bold words", "see `x y` at https://a.b/c.d and src/é/a.py": "see [code] at [url] and [file]",
        many: " ".join(f"w{i}" for i in range(15)) + "...", "": "", "\nlater": "", None: None, "x" * 100_000: "x" * 100_000,
    }
    assert told(spark, workflow.first_sentence, cases) == list(cases.values())


@pytest.fixture(scope="module")
def steps(spark):
    calls = [
        ("Read", {"file_path": "a.py"}, "x\ny", ("read", "a.py", 2, None)), ("view", {}, "", ("read", "", None, None)), ("cat", {"path": "b", "command": "c"}, "z", ("read", "b", None, None)), ("Write", {"file_path": "a", "content": "1\n2\n"}, "ok", ("edit", "a", 2, None)),
        ("Edit", {"file_path": "a", "old_string": "1", "new_string": "1\n2\n3"}, "", ("edit", "a", 3, None)), ("Bash", {"command": "ls; go test ./..."}, "error", ("test", "ls; go test ./...", None, "failed")), ("terminal", {"command": "cd a && /usr/bin/rg x"}, "5 passed", ("search", "cd a && /usr/bin/rg x", None, None)),
        ("bash", {}, "", ("other", "", None, None)), ("Glob", {"pattern": "*"}, "", ("search", "*", None, None)), ("find", {"query": True}, "", ("search", "true", None, None)), ("Task", {"description": "d" * 99}, "", ("agent", "d" * 80, None, None)),
        ("WebFetch", {"url": "u", "name": "n" * 90}, "", ("webfetch", "n" * 80, None, None)), (None, "plain", "", ("unknown", "plain", None, None)), ("Read", None, None, ("read", "", None, None)), ("Odd", {"file_path": None, "path": 3}, "", ("odd", "3", None, None)),
    ]
    rows = [(i, t, None if a is None else json.dumps(a), o) for i, (t, a, o, _) in enumerate(calls)]
    df = spark.createDataFrame(rows, "i int, tool string, input string, output string")
    return calls, df.select("i", workflow.step(F.col("tool"), F.col("input"), F.col("output")).alias("step"))


def test_steps(steps):
    calls, df = steps
    assert [tuple(r.step) for r in df.orderBy("i").collect()] == [c[3] for c in calls]


def test_step_texts_at_two_depths(steps):
    calls, df = steps
    rows = df.orderBy("i").select(workflow.step_text(F.col("step"), "summary"), workflow.step_text(F.col("step"), "full")).collect()
    assert tuple(rows[0]) == ("Read python file (2 lines)", "Read a.py (2 lines)") and tuple(rows[1]) == ("Read", "Read")
    assert tuple(rows[5]) == ("Test (failed)", "Test ls; go test ./... (failed)") and tuple(rows[12]) == ("Unknown", "Unknown plain")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 30])
def test_lines_show_both_ends(spark, n):
    df = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("at"), F.struct(F.concat(F.lit("t"), F.col("id")).alias("tool"), F.lit("").alias("detail"), F.lit(None).cast("int").alias("lines"), F.lit(None).cast("string").alias("outcome")).alias("step"))
    names = [f"T{i}" for i in range(n)]
    want = names if n <= 7 else [*names[:5], f"... {n - 7} more ...", *names[-2:]]
    got = oneliners(df, "s", ["at"], ("full",)).collect()
    assert [(r.steps, r.full) for r in got] == ([(n, " → ".join(want))] if n else [])
