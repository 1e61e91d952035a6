"""Declarative aggregation: dimensions, metrics, filters, a time bound, top buckets.

A spec names registered dimensions and fields only; it becomes one grouped
query whose order and limit Spark runs as a distributed top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_DIMS, DEFAULT_LIMIT, MAX_LIMIT = 3, 10, 1000
OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(*v),
}


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: object

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")


@dataclass(frozen=True)
class Metric:
    """``count``, or ``sum`` or ``avg`` of a registered field."""

    fn: str
    field: str | None = None

    @property
    def name(self) -> str:
        return self.fn if self.field is None else f"{self.fn}_{self.field}"

    def column(self, fields: dict[str, Column]) -> Column:
        if self.fn == "count":
            return F.count(F.lit(1)).alias(self.name)
        value = {"sum": F.sum, "avg": F.avg}[self.fn](fields[self.field])
        return F.coalesce(value, F.lit(0)).alias(self.name)


@dataclass(frozen=True)
class Domain:
    """What a spec may name: dimensions, numeric fields, the time column."""

    dims: dict[str, Column]
    fields: dict[str, Column] = field(default_factory=dict)
    time: Column | None = None
    #: A dimension that is prepended unless the spec isolates one value of it.
    partition_by: str | None = None


@dataclass(frozen=True)
class Spec:
    dims: tuple[str, ...]
    metrics: tuple[Metric, ...] = (Metric("count"),)
    filters: tuple[Predicate, ...] = ()
    since: object = None
    limit: int = DEFAULT_LIMIT

    def __post_init__(self) -> None:
        if not 1 <= len(self.dims) <= MAX_DIMS or len(set(self.dims)) < len(self.dims):
            raise ValueError(f"one to {MAX_DIMS} different dimensions")
        if not self.metrics:
            raise ValueError("at least one metric")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"a limit from 1 to {MAX_LIMIT}")
        if self.since is not None and any(p.op in (">", ">=") and p.field == "time" for p in self.filters):
            raise ValueError("either since or a lower bound on time")


def partitioned(spec: Spec, domain: Domain) -> Spec:
    """Prepends the domain's partition dimension unless it is there or one value is filtered."""
    own = domain.partition_by
    if own is None or own in spec.dims or any(p.field == own and p.op == "=" for p in spec.filters):
        return spec
    if len(spec.dims) == MAX_DIMS:
        raise ValueError(f"no room for the dimension {own}; filter it to one value")
    return replace(spec, dims=(own, *spec.dims))


def _filtered(df: DataFrame, spec: Spec, domain: Domain) -> DataFrame:
    known = domain.dims | domain.fields | ({"time": domain.time} if domain.time is not None else {})
    wanted = [OPERATORS[p.op](known[p.field], p.value) for p in spec.filters]
    if spec.since is not None:
        wanted.append(domain.time >= F.lit(spec.since))
    return df.where(reduce(lambda a, b: a & b, wanted)) if wanted else df


def aggregate(df: DataFrame, spec: Spec, domain: Domain) -> DataFrame:
    """Top buckets by the first metric, descending; ties by dimensions, nulls last."""
    spec = partitioned(spec, domain)
    grouped = _filtered(df, spec, domain).groupBy(*(domain.dims[d].alias(d) for d in spec.dims))
    buckets = grouped.agg(*(m.column(domain.fields) for m in spec.metrics))
    order = [F.col(spec.metrics[0].name).desc(), *(F.col(d).asc_nulls_last() for d in spec.dims)]
    return buckets.orderBy(*order).limit(spec.limit)


def with_totals(df: DataFrame, spec: Spec, domain: Domain) -> DataFrame:
    """The buckets, each with the grand total of the first metric, rows_scanned and other_count."""
    spec = partitioned(spec, domain)
    kept = _filtered(df, spec, domain)
    total = kept.agg(spec.metrics[0].column(domain.fields).alias("total"), F.count(F.lit(1)).alias("rows_scanned"))
    buckets = aggregate(df, spec, domain)
    # Over the buckets that the limit left.
    shown = F.sum(spec.metrics[0].name).over(Window.partitionBy(F.lit(0)))
    other = F.greatest(F.col("total") - F.coalesce(shown, F.lit(0)), F.lit(0)).alias("other_count")
    # One row of totals, so the product has as many rows as there are buckets.
    return buckets.crossJoin(F.broadcast(total)).select(*buckets.columns, "total", "rows_scanned", other)
