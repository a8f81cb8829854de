"""Golden values of the column expressions, and properties of the queries built on them."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.operators.budget import grade, health
from ledgerlake.plans.registry import Roles
from ledgerlake.sources.roles import fy_label, fy_start, share


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.kes_amount, "KES 1,200 million was lost", 1.2e9), (T.kes_amount, "Ksh. 3.5 billion", 3.5e9), (T.kes_amount, "KES 450,000", 450000.0), (T.kes_amount, "nothing", None), (T.kes_amount, None, None),
        (T.suffix_amount, "KES 2.5B", 2.5e9), (T.suffix_amount, "300M", 3e8), (T.suffix_amount, "n/a", 0.0), (T.plain_kes, "KES 1,500,000 of 2", 1.5e6), (T.plain_kes, "USD 3", None),
        (T.percentage, "75%", 75.0), (T.percentage, "N/A", None), (T.percentage, "", None), (T.currency_code, "USD 5", "USD"), (T.currency_code, "5", "KES"),
        (T.accounting_number, "(1,234.5)", -1234.5), (T.accounting_number, "−987", -987.0), (T.accounting_number, "x", None), (T.decimal_comma, "12,5", 12.5), (T.decimal_comma, "1,234,567", 1234567.0),
        (T.fiscal_label, "for FY2023/24", "FY2023/24"), (T.fiscal_label, "2021/2022 report", "FY2021/22"), (T.fiscal_label, "in 1999", "FY1999/00"), (T.fiscal_label, "none", None), (T.fiscal_confidence, "2021/22", 0.9), (T.fiscal_confidence, "2021", 0.5),
        (T.period_date, "2022-Q3", datetime.date(2022, 7, 1)), (T.period_date, "2021-07", datetime.date(2021, 7, 1)), (T.period_date, "2020", datetime.date(2020, 1, 1)), (T.period_date, "x", None),
        (T.slug, "Health & Sanitation", "health-and-sanitation"), (T.name_key, "MURANG'A county", "muranga"), (T.name_key, "Trans-Nzoia  County", "trans nzoia"),
        (T.opinion, "Disclaimer of Opinion", "Disclaimer"), (T.opinion, "an adverse opinion", "Adverse"), (T.opinion, "Unqualified opinion", "Unqualified"), (T.opinion, "qualified opinion", "Qualified"), (T.opinion, "none", None),
        (T.query_type, "tender irregular", "Procurement"), (T.query_type, "ghost worker on the payroll", "Payroll/HR"), (T.query_type, "unaccounted assets", "Financial Irregularity"), (T.query_type, "Contrary to the plan", "Non-Compliance"), (T.query_type, "nothing", None), (T.strict_amount, "KES 2.5B", 2.5e9), (T.strict_amount, "KES 1,200", 1200.0), (T.strict_amount, "1.5 bn", 0.0), (T.bill_amount, "Ksh. 1,200.5", 1200.5), (T.bill_amount, "nil", None), (T.bill_amount, "-", None), (T.flexible_time, "2021-07", datetime.datetime(2021, 7, 1)), (T.flexible_time, "2021-07-02T08:30:00", datetime.datetime(2021, 7, 2, 8, 30)), (T.flexible_time, "0086400000", datetime.datetime(1972, 9, 27)), (T.flexible_time, "soon", None), (T.document_kind, "Budget estimates", "budget"), (T.document_kind, "Expenditure of 2020", "report"), (T.document_kind, "Auditor on loans", "audit"),
        (T.lender_kind, "Treasury Bond", "domestic_bonds"), (T.lender_kind, "Eurobond", "external_commercial"), (T.lender_kind, "Central Bank", "domestic_overdraft"), (T.lender_kind, "x", "other"), (T.lender_type, "World Bank", "Multilateral"), (T.lender_type, "Green Bond", "Commercial"), (T.lender_type, "x", "Other"),
        (T.bill_kind, "Court award", "court_awards"), (T.bill_kind, "x", "supplier_arrears"), (T.opinion_after_heading, "Opinion: qualified", "Unknown"), (T.opinion_after_heading, "OPINION\nUnqualified" + " x" * 100, "Unqualified"), (T.opinion_after_heading, "opinion" + " x" * 100 + " adverse", "Unknown"),
        (T.recommendation, "Recommendation: recover it ", "recover it"), (T.recommendation, "nothing", None), (lambda c: T.similarity(c, "nairobi"), "nairobbi", 87.5), (lambda c: T.similarity(c, "nairobi"), "kwale", None),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, text, f) == want


@pytest.mark.parametrize(("amount", "want"), [(6e7, "critical"), (6e6, "warning"), (10.0, "info"), (None, "info")])
def test_severity_by_amount(spark, amount, want):
    assert one(spark, "x", lambda c: T.severity(c, F.lit(amount).cast("double"))) == want


@pytest.mark.parametrize(("u", "score", "letter"), [(50.0, 50.0, "B-"), (96.0, 90.0, "A"), (94.9, 94.9, "A"), (130.0, 50.0, "B-"), (200.0, 0.0, "C")])
def test_health(spark, u, score, letter):
    r = spark.range(1).select(health(F.lit(u)).alias("h")).withColumn("g", grade(F.col("h"))).first()
    assert (r["h"], r["g"]) == (score, letter)


@pytest.mark.parametrize(("url", "title", "want"), [("/wp-content/uploads/Budget.pdf?x", "Annual report", 43), ("/logo.png", "County logo", -5), (None, None, 0), ("/a.pdf/b", "", 0)])
def test_candidate_score(spark, url, title, want):
    df = spark.createDataFrame([(url, title)], "u string, t string")
    assert df.select(T.candidate_score(F.col("u"), F.col("t")).alias("v")).first()["v"] == want


def test_fiscal_year(spark):
    days = [(datetime.date(2024, 6, 30), "FY2023/24"), (datetime.date(2024, 7, 1), "FY2024/25"), (datetime.date(1999, 12, 1), "FY1999/00")]
    got = spark.createDataFrame(days, "d date, want string").select("want", fy_label(fy_start(F.col("d"))).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_share_of_zero_is_null(spark):
    assert spark.range(1).select(share(F.lit(1), F.lit(0), 2).alias("v")).first()["v"] is None


def test_waterfall_and_ageing_add_up(spark, sf):
    from ledgerlake.operators.budget import money_flow_entity, national_budget_sectors
    from ledgerlake.operators.debt import pending_aging

    r = Roles(spark, sf)
    for x in money_flow_entity(r).collect():
        assert x["allocated"] >= x["spent"] and (x["released"] is None or abs(x["allocated"] - x["released"] - x["gap_released"]) < 0.02)
    total = r.bills.agg(F.sum("amount")).first()[0]
    assert abs(sum(x["amount"] for x in pending_aging(r).collect()) - float(total)) < 0.1
    assert abs(sum(x["percentage"] for x in national_budget_sectors(r).collect()) - 100) < 1


def test_plans_have_no_python_and_read_few_columns(spark, sf):
    from ledgerlake.operators.audit import audit_summary, worst_entities
    from ledgerlake.operators.budget import national_budget_sectors

    for f in (audit_summary, worst_entities, national_budget_sectors):
        plan = f(Roles(spark, sf))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    plan = national_budget_sectors(Roles(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "p_name" not in plan and "o_orderkey" not in plan


def test_streams_take_up_where_they_stopped(spark, tmp_path):
    from ledgerlake.streaming.jobs import drain

    src, got = str(tmp_path / "in"), []
    s = spark.readStream.schema("k long").parquet(src + "*")
    spark.range(3).toDF("k").write.parquet(src)
    drain(s, "append", lambda df, n: got.extend(r["k"] for r in df.collect()), str(tmp_path / "cp"))
    spark.range(3, 5).toDF("k").write.mode("append").parquet(src)
    drain(s, "append", lambda df, n: got.extend(r["k"] for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(got) == [0, 1, 2, 3, 4]
