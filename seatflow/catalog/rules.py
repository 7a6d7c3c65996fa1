"""Data-quality rules."""

from seatflow.catalog import standins as S
from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import CELLS, WITH_MART, cells, table
from seatflow.operators import quality
from seatflow.operators.quality import Rule
from seatflow.plans import ballots
from seatflow.plans.table_rules import rules_for
from seatflow.session import fresh_path

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql


@query(
    "dq_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dq_unique(spark, sf):
    return quality.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_not_null", f"WITH {CELLS} SELECT entity, category, year FROM cells WHERE taken IS NULL")
def dq_not_null(spark, sf):
    return quality.not_null(cells(spark, sf), "taken").select("entity", "category", "year")


@query(
    "dq_not_null_where",
    f"WITH {CELLS} SELECT entity, category, year FROM cells WHERE taken IS NULL AND applied IS NOT NULL",
)
def dq_not_null_where(spark, sf):
    bad = quality.not_null(cells(spark, sf), "taken", "applied is not null")
    return bad.select("entity", "category", "year")


@query(
    "dq_relationship",
    """SELECT l_orderkey, count(*) AS n FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""",
)
def dq_relationship(spark, sf):
    parent = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return quality.relationship(table(spark, sf, "lineitem"), "l_orderkey", parent, "o_orderkey")


@query(
    "dq_accepted",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def dq_accepted(spark, sf):
    bad = quality.accepted(
        table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    )
    return bad.select("o_orderkey", "o_orderpriority")


@query(
    "dq_row_gate",
    "SELECT count(*) AS n_rows, count(*) > 0 AS passed FROM orders WHERE year(o_orderdate) = 2001",
)
def dq_row_gate(spark, sf):
    return quality.row_gate(table(spark, sf, "orders"), "year(o_orderdate) = 2001")


RULES = (
    Rule("lineitem", "unique", "l_orderkey"),
    Rule("lineitem", "not_null", "l_partkey"),
    Rule("lineitem", "accepted", "l_returnflag", arg=("A", "N")),
    Rule("lineitem", "relationship", "l_orderkey", arg=("orders", "o_orderkey")),
    Rule("lineitem", "row_gate", where="year(l_shipdate) = 2001"),
    Rule("lineitem", "row_gate", where="year(l_shipdate) = 2021"),
    Rule("orders", "unique", "o_orderkey"),
    Rule("orders", "not_null", "o_custkey", where="o_orderstatus = 'F'"),
    Rule("orders", "relationship", "o_custkey", arg=("customer", "c_custkey")),
    Rule("cells", "not_null", "vacancy"),
    Rule("cells", "not_null", "taken", where="applied is not null"),
    Rule("cells", "accepted", "code", arg=("SC<1", "SC<1#")),
)

MEASURES = {
    RULES[0]: "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)",
    RULES[1]: "SELECT count(*) FROM lineitem WHERE l_partkey IS NULL",
    RULES[2]: "SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')",
    RULES[3]: "SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    RULES[4]: "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM lineitem WHERE year(l_shipdate) = 2001",
    RULES[5]: "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM lineitem WHERE year(l_shipdate) = 2021",
    RULES[6]: "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)",
    RULES[7]: "SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NULL",
    RULES[8]: "SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    RULES[9]: "SELECT count(*) FROM cells WHERE vacancy IS NULL",
    RULES[10]: "SELECT count(*) FROM cells WHERE taken IS NULL AND applied IS NOT NULL",
    RULES[11]: "SELECT count(*) FROM cells WHERE code NOT IN ('SC<1', 'SC<1#')",
}


def _report_sql():
    def text(value):
        return "'" + value.replace("'", "''") + "'"

    rows = " UNION ALL ".join(
        f"SELECT '{rule.table}' AS table_name, {text(rule.name)} AS rule, CAST(({sql}) AS BIGINT) AS violations"
        for rule, sql in MEASURES.items()
    )
    return f"WITH {CELLS}, r AS ({rows}) SELECT *, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM r"


@query("dq_report", _report_sql())
def dq_report(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer")}
    return quality.run_checks({**tables, "cells": cells(spark, sf)}, RULES)


PIPELINE_TABLES = {
    "dim_school": """SELECT *, CASE WHEN address IS NOT NULL THEN 'PRIMARY' END AS mainlevel_code FROM dim""",
    "dim_school_generalinfo": """SELECT md5(school_name_clean) AS school_key, email_address, telephone_no,
        'https://example.com/' || k AS url_address, principal_name, NULL AS first_vp_name
      FROM primary_schools""",
    "fact_balloting": "SELECT * FROM fact",
    "mart_school_analysis": "SELECT * FROM mart",
    "balloting_codes": "SELECT * FROM codes",
    "school_lifecycle": "SELECT * FROM lifecycle",
}


def _rule_sql(rule):
    column, table, where = rule.column, rule.table, rule.where or "true"
    if rule.kind == "not_null":
        count = f"SELECT count(*) FROM {table} WHERE ({where}) AND {column} IS NULL"
    elif rule.kind == "row_gate":
        count = f"SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM {table} WHERE {where}"
    elif rule.kind == "unique":
        count = f"""SELECT count(*) FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL
            GROUP BY 1 HAVING count(*) > 1)"""
    elif rule.kind == "accepted":
        listed = ", ".join(f"'{v}'" for v in rule.arg)
        count = f"SELECT count(*) FROM {table} WHERE {column} NOT IN ({listed})"
    else:
        parent, key = rule.arg
        count = f"""SELECT count(DISTINCT {column}) FROM {table} WHERE {column} IS NOT NULL
            AND {column} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)"""
    name = rule.name.replace("'", "''")
    return f"SELECT '{table}' AS table_name, '{name}' AS rule, CAST(({count}) AS BIGINT) AS violations"


def _tables_sql(rules):
    views = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in PIPELINE_TABLES.items())
    rows = " UNION ALL ".join(map(_rule_sql, rules))
    return f"""{WITH_MART}, {views}, report AS ({rows})
      SELECT *, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM report"""


@query("dq_tables", _tables_sql(rules_for(PIPELINE_TABLES)))
def dq_tables(spark, sf):
    """The rules of the admission tables on the stored pipeline tables."""
    seeds = S.seeds(spark, sf)
    tables = ballots.build_tables(
        S.raw_ballots(spark, sf),
        S.raw_schools(spark, sf),
        seeds,
        fresh_path(spark, "checked"),
        S.PIPELINE_AS_OF,
        S.PIPELINE_RISK,
    )
    tables |= {"balloting_codes": seeds.balloting_codes, "school_lifecycle": seeds.lifecycle}
    return quality.run_checks(tables, rules_for(tables))


BUILT = ("dim_school", "dim_school_generalinfo", "fact_balloting", "mart_school_analysis")
GATES = [Rule(t, "row_gate") for t in BUILT] + [
    r for r in rules_for(PIPELINE_TABLES) if r.table in BUILT and r.kind in quality.Gates.KINDS
]


@query("dq_gates", _tables_sql(GATES))
def dq_gates(spark, sf):
    """Row gates, missing and unexpected values, counted by the jobs that write the tables."""
    gates = quality.Gates(GATES, stop=False)
    ballots.build_tables(
        S.raw_ballots(spark, sf), S.raw_schools(spark, sf), S.seeds(spark, sf), fresh_path(spark, "gated"),
        S.PIPELINE_AS_OF, S.PIPELINE_RISK, gates=gates,
    )
    return gates.report(spark)
