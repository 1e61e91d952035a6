"""Text rules as columns. Java's regular expressions run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that outcome texts are normalised by, in this order.
ISO_TIMESTAMP = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
PATH_ROOT = r"/(?:Users|home|var|private|tmp)/"
PATH_CHARS = r"[^/\s\"'<>(){}\[\],;]"
QUOTED_PATH = PATH_ROOT + r"[^\"'`]+"
# Parts of a path may hold single blanks, its last one none. Possessive, so that long texts need no stack.
PLAIN_PATH = rf"{PATH_ROOT}(?:{PATH_CHARS}++(?: {PATH_CHARS}++)*+/(?={PATH_CHARS}))*+{PATH_CHARS}+"
HOME_PATH = rf"(?<=[\"'`]){QUOTED_PATH}(?=[\"'`])|{PLAIN_PATH}"
PID_INLINE = r"(?i)\b(pid|process)\s*[:=]?\s*\d+\b"
PID_BRACKETED = r"\[(\d{2,7})\]"
OUTCOME_STEPS = ((ISO_TIMESTAMP, "<TS>"), (HOME_PATH, "<PATH>"), (PID_INLINE, "$1 <PID>"), (PID_BRACKETED, "[<PID>]"), (r"\s+", " "))

# Terminal control sequences (7- and 8-bit CSI, OSC, DCS/SOS/PM/APC, other escapes) and control characters.
ANSI = (
    r"(?:\x1b\[|\x9b)[0-?]*[ -/]*[@-~]"
    r"|(?:\x1b\]|\x9d)[^\x07\x1b\x9c]*(?:\x07|\x1b\\|\x9c)"
    r"|(?:\x1b[PX^_]|[\x90\x98\x9e\x9f])[^\x1b\x9c]*(?:\x1b\\|\x9c)"
    r"|\x1b[@-Z\\^_]"
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"

# What makes a user's turn a correction, read in its first 600 characters, and turns that no user wrote.
CORRECTION_HEAD = 600
CORRECTION_STRONG = (
    r"(?i)that'?s not|that is not|not what i (?:asked|meant|want)|i asked (?:for|you)|"
    r"you (?:missed|forgot|didn'?t|should have)|still (?:fail|break|broken|wrong|not work)"
    r"|(?:doesn'?t|didn'?t|does not|did not) work|\brevert\b|undo (?:that|this)|"
    r"\bwrong\b|re-?read|fix it in|"
    r"fix (?:it|this|that) (?:properly|correctly|right|again)|try again|\bredo\b"
)
CORRECTION_LEAD = r"(?i)^(?:no\b|nope\b|wait\b|stop\b|actually\b|hmm+,? no|don'?t\b|not\b|wrong\b)"
CORRECTION_INSTEAD = r"(?i)\binstead\b"
QUESTION_LEAD = (
    r"(?i)^(?:another question|how\b|what\b|can (?:we|you|i)\b|could\b|should\b|would\b|"
    r"is\b|are\b|do\b|does\b|did\b|why\b|when\b|where\b|which\b|who\b)"
)
SYSTEM_REMINDER = r"(?s)<system-reminder>.*?</system-reminder>"
NOT_BY_USER = (
    r"(?m)\A(?:<command-|<local-command|<task-notification|Caveat:|\[Request interrupted)"
    r"|^Invoke: |<command-name>|^Base directory for this skill|"
    r"^This session is being continued from a previous conversation|<teammate-message"
)

# Error lines that tell nothing, and outputs that are no errors to learn from.
GENERIC_ERRORS = ("exit code #", "error", "error:", "failed")
ERROR_PREAMBLES = ("traceback (most recent call last)", 'file "')
BENIGN_ERROR = r"(?i)no matches found|file does not exist|is a directory\b|eisdir|shorter than the provided offset"
HUMAN_REJECTION = (
    r"(?i)permission (?:to use|for this action)|denied by the|doesn'?t want to (?:take this action|proceed)|"
    r"request interrupted|rejected the tool|tool use will be skipped"
)

# Categories of commands.
COMMAND_CATEGORIES = {
    "test": "pytest jest vitest mocha",
    "build": "cargo go make cmake tsc webpack vite esbuild gradle mvn",
    "package": "npm yarn pnpm pip brew apt apt-get",
    "vcs": "git gh svn",
    "run": "python python3 node ruby",
    "container": "docker podman docker-compose",
    "infra": "terraform kubectl helm aws gcloud az",
    "network": "curl wget httpie",
    "filesystem": "mkdir rm mv cp chmod ln touch ls pwd cd",
    "read": "cat head tail less",
    "search": "grep rg find fd",
    "edit": "sed awk",
}

# Signals of outcomes in outputs. Of a pair both must be found.
BUILD_FAILED = (r"BUILD FAILED|build failed", r"(?i)(?:compile|compilation)\s+(?:error|failed)", r"error\[E\d+\]", r"error TS\d+:")
TESTS_FAILED = (r"(?<!BUILD\s)FAILED\s+\S+::", r"\d+\s+failed", r"AssertionError|FAIL:|Tests?:\s*\d+\s+failed", r"FAILURES|failures=\d*[1-9]")
TESTS_PASSED = (
    r"\d+\s+passed",
    (r"\bpassed\b", r"(?i)pytest|jest|mocha|vitest"),
    (r"\bOK\b", r"(?i)tests?\s+run|Ran\s+\d+"),
    r"Tests?:\s+\d+\s+passed,\s+\d+\s+total",
    r"✓|All tests passed|BUILD SUCCESSFUL",
)
LATE_ERROR = r"\b(?:Error|Exception|Traceback|FAILED|FATAL|panic|Segmentation fault|Permission denied|No such file|command not found)\b"

# Addresses that only an inner network knows, names of persons, and pairs of words that are none.
PRIVATE_URL = (
    r"https?://(?:[a-zA-Z0-9._-]+\.(?:local|internal|corp|intranet|lan)"
    r"|localhost(?::\d+)?|(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+)\b"
)
PROPER_NAME = r"(?<![A-Za-z])[A-Z][a-z]{1,7}\s+[A-Z][a-z]{1,12}(?![A-Za-z])"
NO_NAMES = (
    r"\b(?:United States|New York|San Francisco|Los Angeles|Open Source|Visual Studio|Stack Overflow|Pull Request|Merge Request"
    r"|Hello World|Status Code|Type Error|Value Error|Key Error|Content Type|Access Control|No Content|Not Found"
    r"|Read Only|File System|Data Frame|Data Set|Machine Learning|Deep Learning|Neural Network"
    r"|Test Case|Test Suite|Base Class|Default Value|File Path|Error Message|Return Type|Input Type"
    r"|Output Format|Source Code|Ground Truth|Command Line|Build Failed|Task Type|Review Status"
    r"|Start Time|End Time|Display Title|Session Detail|Quality Score|Bundle Preview|Token Usage"
    r"|Claude Code|Trace Card|Badge Chip|Stage Complete|Stage Failed|Translation Pipeline|Output Directory|Input Directory|Current Branch"
    r"|Final Output|First Pass|Second Pass|Next Steps|Last Updated|Not Applicable)\b"
)

# Outcomes as judged, and what the badge of an unjudged session stands for.
JUDGED_OUTCOMES = ("resolved", "partial", "failed", "abandoned", "exploratory", "trivial")
BADGE_OUTCOMES = {
    "tests_passed": "resolved", "tests_failed": "failed", "build_failed": "failed", "errored": "failed",
    "completed": "inconclusive", "partial": "interrupted", "analysis_only": "exploratory",
}

# Task types and the words that speak for them; earlier types win ties.
TASK_WORDS = {
    "debugging": r"fix|bug|error|broken|crash|issue|traceback|exception|failing|segfault|debug|diagnose|troubleshoot|not working|doesn't work|won't work",
    "feature": r"add|implement|create|build|new feature|introduce|support for|develop|make a|write a|generate|produce",
    "refactor": r"refactor|clean\s*up|reorganize|rename|move|restructure|simplify|optimize|improve|update|change|modify|rewrite|rework|adjust|revise",
    "analysis": r"analyze|analyse|investigate|explore|understand|look at|inspect|audit|figure out|find out|determine|assess|evaluate|compare|benchmark",
    "testing": r"write tests?|add tests?|test coverage|spec|unit test|integration test|e2e test|end.to.end|test case|test suite|test plan",
    "documentation": r"document|readme|docstring|comment|changelog|update docs|write docs|api docs|jsdoc|typedoc|sphinx|mkdocs|translate|translation|convert|transform",
    "review": r"review|check|verify|validate|code review|pull request|pr review|look over|go over|proofread",
    "configuration": r"set\s*up|setup|configure|install|deploy|provision|initialize|init|bootstrap|scaffold|ci/?cd|docker|kubernetes",
    "migration": r"migrate|migration|upgrade|downgrade|port|transition|move to|switch to|bump|deprecate",
    "exploration": r"how does|what is|explain|show me|walk me through|help me understand|tell me about|what are|where is|can you explain|describe",
}


def normalized_outcome(text: Column) -> Column:
    """Timestamps, home paths and process ids as placeholders, single spaces."""
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, *s), OUTCOME_STEPS, F.coalesce(text, F.lit(""))))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ANSI, ""), CONTROL, "")


def anonymized(text: Column, user: Column | str) -> Column:
    """Home paths and the bare name (4 characters or more) of a user, or of each row's, as placeholders.

    Boundaries are ASCII, so that a name next to other scripts is found.
    """
    user = F.lit(user) if isinstance(user, str) else user
    quoted = F.concat(F.lit("\\Q"), F.replace(user, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9_])"))
    paths = F.regexp_replace(text, F.concat(F.lit("(?i)(/(?:Users|home)/)"), quoted), F.lit("$1[USER]"))
    names = F.regexp_replace(paths, F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), quoted), F.lit("[USER]"))
    return F.when(F.length(user) >= 4, names).when(F.length(user) > 0, paths).otherwise(text)


def task_type(first: Column, rest: Column) -> Column:
    """The type with most words found, the first message counting twice; ``general`` without any."""
    score = {k: 2 * F.regexp_count(first, F.lit(rf"(?i)\b(?:{w})\b")) + F.regexp_count(rest, F.lit(rf"(?i)\b(?:{w})\b")) for k, w in TASK_WORDS.items()}
    entries = F.array(*(F.struct((-F.coalesce(s, F.lit(0))).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(score.items())))
    best = F.array_min(entries)
    return F.when(best["s"] < 0, best["k"]).otherwise("general")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def error_signature(text: Column) -> Column:
    """The first line that tells of an error, in lower case, with paths, hex and numbers collapsed, at most 110 characters; empty without one."""

    def collapsed(line: Column) -> Column:
        steps = ((r"(?:/[\p{L}\p{N}_.\-]+){2,}", "<path>"), (r"\b[0-9a-f]{7,}\b", "<hex>"), (r"\p{Nd}+", "#"))
        return F.lower(reduce(lambda t, s: F.regexp_replace(t, *s), steps, stripped(line)))

    def telling(line: Column) -> Column:
        preamble = reduce(lambda x, y: x | y, (F.startswith(line, F.lit(p)) for p in ERROR_PREAMBLES))
        return (F.length(line) >= 8) & ~line.isin(*GENERIC_ERRORS) & ~preamble

    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), collapsed), telling)
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, 110), F.lit(""))


def teachable_error(text: Column) -> Column:
    """The signature of an output's error; empty for routine probing and for what a person refused."""
    return F.when(~text.rlike(HUMAN_REJECTION) & ~text.rlike(BENIGN_ERROR), error_signature(text)).otherwise("")


def by_user(text: Column) -> Column:
    """What the user wrote in a turn, without reminders of the system; empty if another wrote it."""
    own = stripped(F.regexp_replace(text, SYSTEM_REMINDER, ""))
    return F.when(own.rlike(NOT_BY_USER), "").otherwise(F.coalesce(own, F.lit("")))


def is_correction(text: Column) -> Column:
    """A redirect by its first words, by a strong phrase, or by ``instead`` outside of a question."""
    head = F.substring(text, 1, CORRECTION_HEAD)
    return head.rlike(CORRECTION_LEAD) | head.rlike(CORRECTION_STRONG) | (head.rlike(CORRECTION_INSTEAD) & ~head.rlike(QUESTION_LEAD))


def signalled(text: Column, signals: tuple) -> Column:
    """Whether one of the signals is found; of a pair both."""
    found = (reduce(lambda x, y: x & y, (text.rlike(p) for p in ((s,) if isinstance(s, str) else s))) for s in signals)
    return F.coalesce(reduce(lambda x, y: x | y, found), F.lit(False))


def proper_names(text: Column, no_names: str = NO_NAMES, no_first: tuple[str, ...] = ()) -> Column:
    """Pairs of words that read as a person's name. ``no_first``: lower-case words that open phrases of code."""
    found = F.regexp_extract_all(text, F.lit(PROPER_NAME), F.lit(0))
    first = lambda x: F.lower(F.regexp_extract(x, r"^(\S+)", 1))
    return F.filter(found, lambda x: ~x.rlike(no_names) & ~first(x).isin(*no_first) if no_first else ~x.rlike(no_names))


def sensitivity(secrets: Column, names: Column, urls: Column) -> Column:
    """Risk from 0 to 1: each kind's weighted count up to 1, and their sum up to 1."""
    capped = [F.least(n * w, F.lit(1.0)) for n, w in ((secrets, 0.3), (names, 0.1), (urls, 0.15))]
    return F.least(capped[0] + capped[1] + capped[2], F.lit(1.0))


def normalized_badge(judged: Column, badge: Column) -> Column:
    """A session's outcome: as judged, else what its badge stands for."""
    known = F.when(judged.isin(*JUDGED_OUTCOMES), judged).when(judged.isNotNull(), "unknown")
    for name, outcome in BADGE_OUTCOMES.items():
        known = known.when(badge == name, outcome)
    return known.otherwise("unscored")


def display_title(text: Column) -> Column:
    """First line without mark-up, cut at a word before 80 characters."""
    line = F.trim(F.regexp_replace(F.regexp_extract(F.trim(text), r"^([^\n]*)", 1), r"^[#>*\-\s]+", ""))
    return F.when(F.length(line) <= 80, line).otherwise(F.concat(F.regexp_extract(F.substring(line, 1, 79), r"^(.*)\s", 1), F.lit("…")))


def command_category(command: Column) -> Column:
    """The category of what the last part of a command line runs; ``other`` where none is known."""
    last = stripped(F.element_at(F.split(command, r"\s*&&\s*|\s*;\s*|\s*\|\|\s*"), -1))
    program = F.regexp_extract(last, r"^(?:\S*/)?([^\s/]*)", 1)
    out = F
    for name, programs in COMMAND_CATEGORIES.items():
        out = out.when(program.isin(*programs.split()), name)
    return out.otherwise("other")


def _accented() -> tuple[str, str]:
    """Latin letters with marks, and the same letters without."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(map(unicodedata.combining, marks)):
            pairs.append((c, base))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accented()


def without_marks(text: Column) -> Column:
    """Latin letters without diacritics; other texts are not looked at closer."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, ACCENTED, BARE), r"\p{Mn}+", "")).otherwise(text)


def tokens(text: Column) -> Column:
    """Search terms: lower case, without diacritics; hyphens and underscores kept."""
    return F.filter(F.split(F.lower(without_marks(text)), r"[^\p{L}\p{N}_-]+"), lambda t: t != "")


def shannon_entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))
