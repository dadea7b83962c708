"""Feeder extracts from a table of rules: projections, CASE arms, defaults and filters as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One output column.

    Exactly one of: ``column`` (copied), ``parts`` (concatenated: text beginning
    with = is literal, other names are columns, null ones count as ``default`` or
    empty), ``value`` (a literal), or ``arms`` (CASE: the first (column, value,
    result) whose column has the value, else ``default``).  ``default`` stands for
    null, ``kind`` is what the result is cast to, ``upper`` and ``cut`` (first,
    length) work on text.
    """

    name: str
    column: str | None = None
    parts: Sequence[str] = ()
    value: object = None
    arms: Sequence[tuple[str, object, object]] = ()
    default: object = None
    kind: str | None = None
    upper: bool = False
    cut: tuple[int, int] | None = None

    def columns(self) -> list[str]:
        return [*([self.column] if self.column else []), *[p for p in self.parts if not p.startswith("=")], *[a[0] for a in self.arms]]


@dataclass(frozen=True)
class Extract:
    """Rules and filters: column -> values it may have, and columns that must not be null."""

    rules: Sequence[Rule]
    among: Mapping[str, Sequence] = field(default_factory=dict)
    present: Sequence[str] = ()


def _name(column: str) -> Column:
    return F.col(".".join("`" + p.replace("`", "``") + "`" for p in column.split(".")))


def compiled(rule: Rule) -> Column:
    """The rule as a column expression."""
    if sum(bool(x) for x in (rule.column, rule.parts, rule.arms)) + (rule.value is not None) > 1:
        raise ValueError(f"rule {rule.name} says more than one thing")
    if rule.parts:
        blank = F.lit("" if rule.default is None else rule.default)
        out = F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.coalesce(_name(p).cast("string"), blank) for p in rule.parts])
    elif rule.arms:
        out = None
        for column, value, result in rule.arms:
            arm = _name(column).isNull() if value is None else _name(column) == F.lit(value)
            out = F.when(arm, F.lit(result)) if out is None else out.when(arm, F.lit(result))
        out = out.otherwise(F.lit(rule.default))
    else:
        out = _name(rule.column) if rule.column else F.lit(rule.value)
    out = F.upper(out.cast("string")) if rule.upper else out
    out = F.substring(out.cast("string"), *rule.cut) if rule.cut else out
    if rule.default is not None and not rule.parts:
        out = F.coalesce(out, F.lit(rule.default))
    return (out.cast(rule.kind) if rule.kind else out).alias(rule.name)


def run_extract(df: DataFrame, extract: Extract) -> DataFrame:
    """The rows that pass the filters, with a column per rule.

    All of it is one projection and one filter, so both reach the scan.  Rules
    and filters are checked against the table first: unknown columns, repeated
    names and empty lists of values are errors.
    """
    names = [r.name for r in extract.rules]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"names repeat: {sorted(n for n in names if names.count(n) > 1)}")
    known = {c.lower() for c in df.columns}
    used = [c for r in extract.rules for c in r.columns()] + list(extract.among) + list(extract.present)
    unknown = sorted({c for c in used if c.lower() not in known and c.split(".")[0].lower() not in known})
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    empty = [c for c, values in extract.among.items() if not values]
    if empty:
        raise ValueError(f"no values for {empty}")
    for column, values in extract.among.items():
        df = df.where(_name(column).isin(list(values)))
    for column in extract.present:
        df = df.where(_name(column).isNotNull())
    return df.select(*map(compiled, extract.rules))
