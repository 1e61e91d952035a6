"""Model names and token prices as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dollars per million tokens by (family, tier):
# input, output, cache read, cache write, reasoning.
PRICES = {
    ("claude", "opus"): (15.00, 75.00, 1.50, 18.75, 75.00),
    ("claude", "sonnet"): (3.00, 15.00, 0.30, 3.75, 15.00),
    ("claude", "haiku"): (1.00, 5.00, 0.10, 1.25, 5.00),
    ("gpt", "5.4"): (2.50, 15.00, 0.25, 0.0, 15.00),
    ("gpt", "5.4-mini"): (0.75, 4.50, 0.075, 0.0, 4.50),
    ("gpt", "5.4-nano"): (0.20, 1.25, 0.02, 0.0, 1.25),
    ("gpt", "5.3-codex"): (1.75, 14.00, 0.175, 0.0, 14.00),
    ("gpt", "5.2"): (1.75, 14.00, 0.175, 0.0, 14.00),
    ("gpt", "5.2-codex"): (1.75, 14.00, 0.175, 0.0, 14.00),
    ("gpt", "5.1"): (1.25, 10.00, 0.125, 0.0, 10.00),
    ("gpt", "5.1-codex"): (1.25, 10.00, 0.125, 0.0, 10.00),
    ("gpt", "5.1-codex-max"): (1.25, 10.00, 0.125, 0.0, 10.00),
    ("gpt", "5"): (1.25, 10.00, 0.125, 0.0, 10.00),
    ("gpt", "5-codex"): (1.25, 10.00, 0.125, 0.0, 10.00),
    ("gpt", "5-mini"): (0.25, 2.00, 0.025, 0.0, 2.00),
    ("gpt", "5-nano"): (0.05, 0.40, 0.005, 0.0, 0.40),
    ("gpt", "5-pro"): (15.00, 120.00, 0.0, 0.0, 120.00),
    ("gpt", "4.1"): (2.00, 8.00, 0.50, 0.0, 8.00),
    ("gpt", "4.1-mini"): (0.40, 1.60, 0.10, 0.0, 1.60),
    ("gpt", "4o"): (2.50, 10.00, 1.25, 0.0, 10.00),
    ("gpt", "4o-mini"): (0.15, 0.60, 0.075, 0.0, 0.60),
    ("o", "1"): (15.00, 60.00, 0.0, 0.0, 60.00),
    ("o", "1-mini"): (3.00, 12.00, 0.0, 0.0, 12.00),
    ("o", "3"): (2.00, 8.00, 0.0, 0.0, 8.00),
    ("o", "3-mini"): (1.10, 4.40, 0.0, 0.0, 4.40),
    ("o", "4-mini"): (1.10, 4.40, 0.0, 0.0, 4.40),
    ("gemini", "pro"): (1.25, 10.00, 0.0, 0.0, 0.0),
    ("gemini", "flash"): (0.30, 2.50, 0.0, 0.0, 0.0),
    ("gemini", "ultra"): (7.00, 21.00, 0.0, 0.0, 0.0),
}

# Dollars per million input and output tokens by name prefix.
PREFIX_PRICES = {
    "claude-opus-4": (15.00, 75.00),
    "claude-sonnet-4": (3.00, 15.00),
    "claude-haiku-4": (1.00, 5.00),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4o": (2.50, 10.00),
    "o3": (2.00, 8.00),
    "o4-mini": (1.10, 4.40),
    "gemini-2.5-pro": (1.25, 10.00),
    "gemini-2.5-flash": (0.30, 2.50),
    "deepseek-r1": (0.70, 2.50),
    "deepseek-v3": (0.27, 1.10),
}
CACHE_READ, CACHE_CREATE = 0.1, 1.25

# Tiers that a model name may state, longer ones first.
GPT_TIERS = (
    "5.4-mini", "5.4-nano", "5.4", "5.3-codex", "5.2-codex", "5.2", "5.1-codex-max", "5.1-codex", "5.1", "5-codex",
    "5-pro", "5-mini", "5-nano", "5", "4.1-mini", "4.1", "4o-mini", "4o", "4-turbo", "4", "3.5",
)
O_TIERS = ("4-mini", "3-mini", "1-mini", "4", "3", "1")
CLAUDE_TIERS, GEMINI_TIERS = ("opus", "sonnet", "haiku"), ("flash", "pro", "ultra")


def short_name(model: Column) -> Column:
    """Lower case without provider prefixes."""
    return F.substring_index(F.lower(F.trim(model)), "/", -1)


def _tier(name: Column, prefix: str, tiers: tuple[str, ...]) -> Column:
    """The first tier that the name states after its prefix as a whole word, else the empty text."""
    words = "|".join(t.replace(".", r"\.") for t in tiers)
    return F.regexp_extract(name, rf"^{prefix}({words})(?:$|[-_])", 1)


def _contained(name: Column, tiers: tuple[str, ...]) -> Column:
    """The first of the tiers that the name contains, else the name."""
    return F.coalesce(*(F.when(name.contains(t), t) for t in tiers), name)


def model_info(model: Column) -> Column:
    """struct(family, tier, provider); unknown models keep their name as tier."""
    raw, name = F.coalesce(F.trim(model), F.lit("")), short_name(F.coalesce(model, F.lit("")))
    o, gpt = _tier(name, "o", O_TIERS), _tier(name, "gpt-", GPT_TIERS)
    claude, gemini = name.contains("claude"), name.contains("gemini")
    family = F.when(claude, "claude").when(o != "", "o").when(name.contains("gpt"), "gpt").when(gemini, "gemini").otherwise("unknown")
    tier = (
        F.when(claude, _contained(name, CLAUDE_TIERS)).when(o != "", o).when(name.contains("gpt"), F.when(gpt != "", gpt).otherwise(name))
        .when(gemini, _contained(name, GEMINI_TIERS)).otherwise(raw)
    )
    provider = F.when(claude, "anthropic").when((o != "") | name.contains("gpt"), "openai").when(gemini, "google").otherwise("unknown")
    return F.struct(family.alias("family"), tier.alias("tier"), provider.alias("provider"))


def price_table(spark: SparkSession) -> DataFrame:
    """A few dozen rows, so it may be broadcast; literals, so no Python task makes them."""
    names = ("family", "tier", "p_input", "p_output", "p_read", "p_write", "p_reasoning")
    rows = (F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (*k, *v), strict=True))) for k, v in PRICES.items())
    return spark.range(1).select(F.inline(F.array(*rows)))


def exact_cost(usage: DataFrame, model: str = "model") -> DataFrame:
    """Adds family, tier, provider and cost_estimate; null when the model has no price.

    ``usage`` has the token columns input, output, cache_read, cache_write, reasoning.
    """
    named = usage.withColumn("_m", model_info(F.col(model)))
    named = named.select("*", "_m.family", "_m.tier", "_m.provider").drop("_m")
    priced = named.join(F.broadcast(price_table(usage.sparkSession)), ["family", "tier"], "left")
    pairs = (("input", "p_input"), ("output", "p_output"), ("cache_read", "p_read"), ("cache_write", "p_write"), ("reasoning", "p_reasoning"))
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(t), F.lit(0)) * F.col(p) for t, p in pairs))
    return priced.withColumn("cost_estimate", total / 1e6).drop(*(p for _, p in pairs))


def prefix_price(model: Column) -> Column:
    """struct(prefix, input, output) of the longest prefix that the name starts with, else null."""
    name = short_name(model)
    entry = lambda p: F.struct(F.lit(p).alias("prefix"), F.lit(PREFIX_PRICES[p][0]).alias("input"), F.lit(PREFIX_PRICES[p][1]).alias("output"))
    ordered = sorted(PREFIX_PRICES, key=len, reverse=True)
    return reduce(lambda w, p: w.when(name.startswith(p), entry(p)), ordered[1:], F.when(name.startswith(ordered[0]), entry(ordered[0])))


def session_cost(model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_create: Column) -> Column:
    """Dollars with cache reads at a tenth and cache writes at 1.25 of the input rate."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = prefix_price(model)
    return (zero(tokens_in) * p["input"] + zero(tokens_out) * p["output"] + zero(cache_read) * p["input"] * CACHE_READ + zero(cache_create) * p["input"] * CACHE_CREATE) / 1e6
