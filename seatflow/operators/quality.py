"""Declarative data rules. A rule passes when it has no violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def unique(df: DataFrame, col: str | Sequence[str]) -> DataFrame:
    """Values that occur more than once; NULL keys are not checked."""
    cols = [col] if isinstance(col, str) else list(col)
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def not_null(df: DataFrame, col: str, where: Column | str | None = None) -> DataFrame:
    df = df if where is None else df.filter(where)
    return df.filter(F.col(col).isNull())


def accepted(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is known but not in the list."""
    return df.filter(~F.col(col).isin(*values))


def relationship(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child values without a parent, with their row count.

    Children are counted per value before the join, so the join sees every
    value once and a hot value cannot skew it.
    """
    values = child.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_col).alias("_known"))
    return values.join(known, F.col(col) == F.col("_known"), "left_anti")


def row_gate(df: DataFrame, where: Column | str | None = None) -> DataFrame:
    """One row with the count and whether any row is there at all."""
    df = df if where is None else df.filter(where)
    return df.agg(F.count("*").alias("n_rows")).withColumn("passed", F.col("n_rows") > 0)


@dataclass(frozen=True)
class Rule:
    """One check on a column of a named table.

    ``kind`` is unique, not_null, accepted, relationship or row_gate; ``arg``
    holds the accepted values or the (parent table, parent column) pair.
    """

    table: str
    kind: str
    column: str = ""
    where: str | None = None
    arg: tuple = ()

    @property
    def name(self) -> str:
        base = f"{self.kind}:{self.column}" if self.column else self.kind
        return f"{base} where {self.where}" if self.where else base


def _scan_measure(rule: Rule) -> Column:
    """Violations of a rule that a single pass can count."""
    where = F.expr(rule.where) if rule.where else F.lit(True)
    if rule.kind == "not_null":
        return F.count_if(where & F.col(rule.column).isNull())
    if rule.kind == "accepted":
        return F.count_if(where & ~F.col(rule.column).isin(*rule.arg))
    return F.when(F.count_if(where) > 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint")


def _session(tables: dict[str, DataFrame]) -> SparkSession:
    return next((df.sparkSession for df in tables.values()), None) or SparkSession.active()


def _entry(rule: Rule, value: Column) -> Column:
    return F.struct(F.lit(rule.name).alias("rule"), value.cast("string").alias("value"))


def _counted_values(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, value, n: how often each known value of a checked column occurs."""
    entries = [
        F.when(F.expr(r.where), _entry(r, F.col(r.column))) if r.where else _entry(r, F.col(r.column))
        for r in rules
    ]
    rows = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return rows.filter(F.col("value").isNotNull()).groupBy("rule", "value").agg(F.count("*").alias("n"))


def _known_values(tables: dict[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """rule, value of the parents; one scan for all columns of a parent."""
    parents = dict.fromkeys(r.arg[0] for r in rules)
    return reduce(
        DataFrame.unionByName,
        [
            tables[p].select(
                F.explode(F.array(*[_entry(r, F.col(r.arg[1])) for r in rules if r.arg[0] == p])).alias("e")
            ).select("e.*")
            for p in parents
        ],
    )


def run_checks(tables: dict[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Report of all rules: table, rule, violations, status.

    The rules a scan can answer share one pass per table. So do all its unique rules, and all
    its relationship rules: their columns are stacked as (rule, value) rows and counted once.
    Without rules the report is empty.
    """
    if not rules:
        empty = "table_name string, rule string, violations long, status string"
        return _session(tables).createDataFrame([], empty)
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        df = tables[table]
        own = [r for r in rules if r.table == table]
        scans = [r for r in own if r.kind in ("not_null", "accepted", "row_gate")]
        if scans:
            counted = df.agg(
                F.array(
                    *[
                        F.struct(
                            F.lit(r.name).alias("rule"), _scan_measure(r).alias("violations")
                        )
                        for r in scans
                    ]
                ).alias("checks")
            )
            parts.append(counted.select(F.lit(table).alias("table_name"), F.inline("checks")))
        for kind in ("unique", "relationship"):
            stacked = [r for r in own if r.kind == kind]
            if not stacked:
                continue
            bad = _counted_values(df, stacked)
            if kind == "unique":
                bad = bad.filter("n > 1")
            else:
                bad = bad.join(_known_values(tables, stacked), ["rule", "value"], "left_anti")
            counts = [
                F.struct(F.lit(r.name).alias("rule"), F.count_if(F.col("rule") == r.name).alias("violations"))
                for r in stacked
            ]
            counted = bad.agg(F.array(*counts).alias("checks"))
            parts.append(counted.select(F.lit(table).alias("table_name"), F.inline("checks")))
    report = reduce(DataFrame.unionByName, parts)
    return report.withColumn(
        "status", F.when(F.col("violations") == 0, "pass").otherwise("fail")
    )


class GateError(RuntimeError):
    """A table that was written breaks a rule."""


class Gates:
    """Rules that are counted by the job that writes a table, without another scan.

    Rules of a kind that one pass can answer are watched: not_null, accepted and row_gate.
    """

    KINDS = ("not_null", "accepted", "row_gate")

    def __init__(self, rules: Sequence[Rule], stop: bool = True) -> None:
        self.rules, self.stop = [r for r in rules if r.kind in self.KINDS], stop
        self.seen: dict[str, Observation] = {}

    def watch(self, table: str, df: DataFrame) -> DataFrame:
        """The frame, counted as it is written. Place it last before the write, so that no task
        of an earlier stage that is repeated counts twice."""
        own = [r for r in self.rules if r.table == table]
        if not own:
            return df
        self.seen[table] = Observation(f"gates of {table}")
        measures = [_scan_measure(r).alias(f"m{i}") for i, r in enumerate(own)]
        return df.observe(self.seen[table], *measures)

    def violations(self) -> list[tuple[str, str, int]]:
        """table, rule, violations of all tables written so far."""
        out = []
        for table, found in self.seen.items():
            own = [r for r in self.rules if r.table == table]
            out += [(table, r.name, found.get[f"m{i}"]) for i, r in enumerate(own)]
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """As ``run_checks`` gives it."""
        rows = spark.createDataFrame(self.violations(), "table_name string, rule string, violations long")
        return rows.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))

    def check(self) -> None:
        """Raise if a rule is broken, unless broken rules are only reported."""
        if self.stop and (broken := [f"{t} {r}: {n}" for t, r, n in self.violations() if n]):
            raise GateError("; ".join(broken))
