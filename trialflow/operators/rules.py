"""Rules over rows: reasons, violations, gates.

A rule names a condition that *fails* a row. Conditions are strict: an unknown
(NULL) test result counts as failed unless the rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    failed: Column

    def column(self) -> Column:
        return F.when(F.coalesce(self.failed, F.lit(True)), F.lit(self.name))


def rule(name: str, failed: Column) -> Rule:
    """A rule that fails where ``failed`` is true or NULL."""
    return Rule(name, failed)


def needs(name: str, holds: Column) -> Rule:
    """A rule that fails unless ``holds`` is true."""
    return Rule(name, ~F.coalesce(holds, F.lit(False)))


def reasons(rules: Sequence[Rule], ordered: bool = False) -> Column:
    """Array of the names of the failed rules, in rule order or sorted."""
    # text joined and cut again stays in generated code; a filter over an array would not
    joined = F.concat_ws("\u0001", *[r.column() for r in rules])
    names = F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\u0001"))
    return F.array_sort(names) if ordered else names


def check(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """One row ``keys..., rule`` per failed rule; narrow, no shuffle."""
    return df.select(*keys, F.explode(reasons(rules)).alias("rule"))


def split(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows that pass, violations)``: the quarantine form of a contract."""
    marked = df.withColumn("_failed", reasons(rules))
    good = marked.where(F.size("_failed") == 0).drop("_failed")
    bad = marked.select(*keys, F.explode("_failed").alias("rule"))
    return good, bad


def rule_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


class ContractError(ValueError):
    """Raised by :func:`gate`; carries counts per rule and a sample."""


def gate(violations: DataFrame, what: str = "input") -> None:
    """Fail closed: raise when any violation exists (counts plus 20 sample rows)."""
    counts = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()
    if counts:
        sample = [row.asDict() for row in violations.limit(20).collect()]
        totals = {row["rule"]: row["n"] for row in counts}
        raise ContractError(f"{what} rejected: {totals}; sample: {sample}")
