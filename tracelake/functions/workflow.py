"""What a tool call did, as columns: file types, test commands and their outcomes, first sentences, steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import command_category
from tracelake.functions.variant import at, json_value, kind_at, text_at

# Types by a file's ending, commands that run tests, names of tools.
FILE_TYPES = {
    "python file": ("py",), "javascript file": ("js", "jsx"), "typescript file": ("ts", "tsx"), "rust file": ("rs",), "go file": ("go",), "java file": ("java",), "ruby file": ("rb",),
    "c file": ("c",), "c++ file": ("cpp",), "header file": ("h",), "c# file": ("cs",), "swift file": ("swift",), "kotlin file": ("kt",), "shell script": ("sh", "bash", "zsh"),
    "html file": ("html",), "css file": ("css", "scss"), "config file": ("json", "yaml", "yml", "toml", "ini", "cfg", "env", "xml"), "docs file": ("md", "rst"), "text file": ("txt",),
    "sql file": ("sql",), "protobuf file": ("proto",), "graphql file": ("graphql",), "dockerfile": ("dockerfile",), "lockfile": ("lock",),
}
TEST_COMMANDS = ("pytest", "jest", "vitest", "mocha", "cargo test", "go test", "npm test", "yarn test", "make test", "python -m unittest", "python3 -m unittest")
READS, EDITS, SHELLS = ("read", "view"), ("edit", "write", "notebookedit"), ("bash", "execute", "terminal", "command")
SEARCHES, AGENTS = ("grep", "search", "glob"), ("agent", "task")
OTHER_DETAILS = ("file_path", "path", "command", "query", "name")
SENTENCE_ENDS = (". ", "! ", "? ")
DETAIL, HEAD, TAIL = 80, 5, 2


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def file_type(path: Column) -> Column:
    """``test file`` by name or folder, else the type of the ending, else ``build file``, ``dockerfile`` or ``file``."""
    low = F.lower(path)
    name = F.regexp_extract(low, r"(?s)[^/]*\z", 0)
    ending = F.regexp_extract(low, r"\.([a-z]+)\z", 1)
    test = name.startswith("test_") | name.contains("_test.") | low.contains("/test/") | low.contains("/tests/") | low.contains("/__tests__/")
    types = reduce(lambda c, kv: c.when(ending.isin(*kv[1]), kv[0]), FILE_TYPES.items(), F.when(test, "test file"))
    return types.when(name == "dockerfile", "dockerfile").when(name.isin("makefile", "cmakelists.txt"), "build file").otherwise("file")


def runs_tests(command: Column) -> Column:
    return F.lower(command).rlike("|".join(TEST_COMMANDS))


def outcome_of_tests(output: Column) -> Column:
    """``passed/all passed`` where the output counts, else passed or failed, else null; numbers beyond 18 digits count as none."""
    counts = r"(?<![0-9])([0-9]+)\s+passed(?:.*?(?<![0-9])([0-9]+)\s+failed)?"
    passed, failed = (F.regexp_extract(output, counts, i).try_cast("bigint") for i in (1, 2))
    every = passed + F.coalesce(failed, F.lit(0))
    low = F.lower(output)
    good = low.contains("passed") & ~low.contains("failed") & ~low.contains("error")
    return F.when(passed.isNotNull(), F.concat(passed.cast("string"), F.lit("/"), every.cast("string"), F.lit(" passed"))).when(good, "passed").when(low.rlike("failed|error"), "failed")


def first_sentence(text: Column, words: int = 15) -> Column:
    """The first line up to its first sentence's end or so many words, without tags; code, URLs and files by name only."""
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    ends = lambda line: reduce(lambda c, sep: c.when(line.contains(sep), F.concat(F.substring_index(line, sep, 1), F.lit(sep[0]))), SENTENCE_ENDS[1:], F.when(line.contains(". "), F.concat(F.substring_index(line, ". ", 1), F.lit(".")))).otherwise(line)
    cut = let(strip(F.regexp_replace(strip(F.substring_index(text, "\n", 1)), "<[^>]+>", "")), ends)
    shorten = lambda c: F.when(F.size(F.split(c, r"\s+")) > words, F.concat(F.array_join(F.slice(F.split(c, r"\s+"), 1, words), " "), F.lit("..."))).otherwise(c)
    short = let(cut, shorten)
    named = F.regexp_replace(F.regexp_replace(short, "`[^`]+`", "[code]"), r"https?://\S+", "[url]")
    return F.regexp_replace(named, r"(?U)(?<![\w./\-])[\w./\-]+/[\w./\-]+\.\w+", "[file]")


def count_lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1))


def step(tool: Column, arguments: Column, output: Column) -> Column:
    """(tool, detail, lines, outcome) of a call; ``arguments`` are JSON, details of unlisted tools have 80 characters at most."""
    name = F.lower(F.coalesce(tool, F.lit("unknown")))
    return let(json_value(arguments), lambda v: let(F.coalesce(text_at(v, "$.command"), F.lit("")), lambda command: _step(name, v, command, output)))


def _step(name: Column, v: Column, command: Column, output: Column) -> Column:
    given = lambda key: F.coalesce(text_at(v, f"$.{key}"), F.lit(""))
    some = lambda t: F.when(t != "", t)
    old, new, content = given("old_string"), given("new_string"), given("content")
    shell = name.isin(*SHELLS)
    kind = (
        F.when(shell & runs_tests(command), "test").when(shell, command_category(command)).when(name.isin(*READS, "cat"), "read").when(name.isin(*EDITS), "edit")
        .when(name.isin(*SEARCHES, "find"), "search").when(name.isin(*AGENTS), "agent").otherwise(name)
    )
    rendered = lambda x: F.coalesce(text_at(x, "$"), F.to_json(x))
    loose = F.when(kind_at(v, "$").startswith("OBJECT"), F.coalesce(*(some(F.when(~kind_at(v, f"$.{k}").isin("VOID"), rendered(at(v, f"$.{k}")))) for k in OTHER_DETAILS))).otherwise(rendered(v))
    detail = (
        F.when(name.isin(*READS, *EDITS), given("file_path")).when(shell, command).when(name.isin(*SEARCHES), given("pattern"))
        .when(name.isin(*AGENTS), F.substring(given("description"), 1, DETAIL)).otherwise(F.substring(F.coalesce(loose, F.lit("")), 1, DETAIL))
    )
    changed = F.when((old != "") | (new != ""), F.greatest(count_lines(old), count_lines(new))).when(content != "", count_lines(content))
    lines = F.when(name.isin(*READS), F.when(F.coalesce(output, F.lit("")) != "", count_lines(output))).when(name.isin(*EDITS), changed)
    outcome = F.when(shell & runs_tests(command), outcome_of_tests(output))
    return F.struct(kind.alias("tool"), detail.alias("detail"), lines.cast("int").alias("lines"), outcome.alias("outcome"))


def step_text(step: Column, depth: str) -> Column:
    """A step in words; below ``full`` depth a read or edited file shows as its type and nothing else shows a detail."""
    return let(step, lambda s: _text(s, depth))


def _text(s: Column, depth: str) -> Column:
    shown = s["detail"] if depth == "full" else F.when(s["tool"].isin("read", "edit") & (s["detail"] != ""), file_type(s["detail"]))
    head = F.concat(F.upper(F.substring(s["tool"], 1, 1)), F.lower(F.substring(s["tool"], 2, 1 << 30)))
    lines = F.when(s["lines"] > 0, F.concat(F.lit("("), s["lines"].cast("string"), F.lit(" lines)")))
    return F.concat_ws(" ", head, F.when(shown != "", shown), lines, F.concat(F.lit("("), s["outcome"], F.lit(")")))
