"""Totals per date and product, added up in as many pieces as the lines ask for."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from dimloom.plans import facts, views
from dimloom.plans.staging import TABLES, Staging
from tests.conftest import rows


@pytest.fixture
def lines(spark):
    """A frequent key, orders with several lines of a key, and nulls among the measures."""
    i = F.col("id")
    return spark.range(400).select(
        F.when(i < 150, 20200131).otherwise(F.lit(20200100) + i % 28 + 1).cast("int").alias("date_key"),
        F.when(i < 150, 1).otherwise(i % 9).alias("product_key"), F.floor(i / 3).alias("sales_order_id"),
        F.when(i % 11 != 0, i % 5).alias("order_qty"), F.when(i % 13 != 0, i - 20).cast("decimal(18,4)").alias("line_total"))


@pytest.mark.parametrize("distinct", [True, False])
def test_totals_in_pieces(spark, lines, distinct):
    keys = ["date_key", "product_key"]
    count = F.count_distinct("sales_order_id") if distinct else F.count(F.lit(1))
    wanted = lines.groupBy(*keys).agg(F.sum("order_qty"), F.sum("line_total"), count)
    found = views.distinct_order_totals(lines, keys, 7, distinct)
    assert rows(found) == rows(wanted)
    assert found.rdd.getNumPartitions() == 7


@pytest.mark.parametrize("dialect, count, having", [
    ("postgres", "COUNT(DISTINCT sales_order_id)", "r > 0"),
    ("sqlserver", "COUNT(DISTINCT sales_order_id)", "q > 0 OR top = 1"),
    ("oracle", "COUNT(*)", "top = 0")])
def test_rollup_stays_in_its_pieces(spark, lines, monkeypatch, dialect, count, having):
    monkeypatch.setattr(views, "LINES", 40)
    days = lines.select("date_key").distinct().where("date_key <> 20200105").select(
        "date_key", F.lit(2020).alias("year_number"), F.lit(1).alias("quarter_number"), F.lit(1).alias("month_number"))
    t = SimpleNamespace(spark=spark, dim_date=days, fact=lambda *columns: lines.select(*columns), table=lambda name: lines)
    found = facts.sales_summary(t, dialect)
    lines.join(days, "date_key").createOrReplaceTempView("summary_lines")
    wanted = spark.sql(f"""SELECT date_key, product_key, q, r, n FROM (
        SELECT date_key, product_key, SUM(order_qty) AS q, SUM(line_total) AS r, {count} AS n, GROUPING(year_number) AS top FROM summary_lines
        GROUP BY date_key, product_key, ROLLUP (year_number, quarter_number, month_number)) WHERE {having}""")
    assert rows(found) == rows(wanted)
    assert found.rdd.getNumPartitions() == 10


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def deals(df):
    return sum("RepartitionByExpression" in line for line in plan(df))


@pytest.mark.parametrize("most", [40, 1000])
@pytest.mark.parametrize("distinct", [True, False])
def test_only_frequent_keys_are_moved_twice(spark, lines, monkeypatch, most, distinct):
    monkeypatch.setattr(views, "LINES", most)
    keys = ["date_key", "product_key"]
    found = views.frequent_buckets(lines, keys)
    assert len(found) == (most == 40)
    totals = views.distinct_order_totals(lines, keys, 7, distinct, frequent=found)
    assert rows(totals) == rows(views.distinct_order_totals(lines, keys, 7, distinct))
    assert deals(totals) == (3 if found else 1)


@pytest.mark.parametrize("most", [40, 1000])
def test_summary_of_a_stored_fact(spark, lines, monkeypatch, most):
    monkeypatch.setattr(views, "LINES", most)
    days = lines.select("date_key").distinct().select(
        "date_key", F.lit(2020).alias("year_number"), F.lit(1).alias("quarter_number"), F.lit(1).alias("month_number"))
    parts = {"spark": spark, "dim_date": days, "fact": lambda *columns: lines.select(*columns), "table": lambda name: lines}
    found = facts.sales_summary(SimpleNamespace(**parts, fct_sales=lines))
    assert rows(found) == rows(facts.sales_summary(SimpleNamespace(**parts)))
    assert deals(found) == (3 if most == 40 else 1)
    above = plan(found)[:[("Generate explode" in line) for line in plan(found)].index(True)]
    assert not any("Aggregate" in line for line in above)


def test_lines_are_moved_by_product_before_they_are_wide(spark, tmp_path):
    """An unknown product counts in its order's average, a repeated one does not count twice; both rules of the order keep that."""
    given = {
        "customer": [(1, "Customer#1", 3, 10.0, "BUILDING"), (2, "Customer#2", 4, -1.0, "MACHINERY")],
        "supplier": [(1, "Supplier#1", 1, 5.0)],
        "part": [(k, "red gear", "Brand#11", "ECONOMY", 7, 10.0) for k in (1, 2, 2)],
        "orders": [(1, 1, "O", 9.0, datetime(1998, 3, 1), "5-LOW"), (2, 2, "F", 9.0, datetime(1998, 3, 2), "1-URGENT"),
                   (3, 7, "F", 9.0, datetime(1998, 3, 2), "1-URGENT")],
        "lineitem": [(o, p, 4, n, 3.0, 100.25, d, 0.0, "N", "O", datetime(1998, 4, 1)) for o, p, n, d in [
            (1, 1, 1, 0.9), (1, 9, 2, 0.0), (1, 9, 3, 0.0), (1, 2, 4, 0.1), (2, 2, 1, 0.5), (2, 1, 2, None), (2, None, 3, 0.2), (3, 1, 1, 0.1)]]}
    for name, table in given.items():
        spark.createDataFrame(table, TABLES[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Staging(spark, str(tmp_path))

    def ids(df):
        return sorted((r["sales_order_id"], r["sales_order_detail_id"], r["product_key"], str(r["line_total"])) for r in df.collect())

    # order 1: an average of 0.25 lets 0.9 fail; the known lines alone, or a line per repeated product, would have let it pass or not
    assert ids(facts.load_fct_sales_full(t)) == [(1, 2000044, 3, "90.2250")] * 2 + [(2, 2000041, 3, "50.1250")] * 2
    assert ids(facts.load_fct_sales_max_discount(t)) == [
        (1, 1000041, 2, "10.0250")] + [(1, 2000044, 3, "90.2250")] * 2 + [(2, 2000041, 3, "50.1250")] * 2
    wide = [line for line in plan(facts.load_fct_sales_full(t)) if "Join Inner" in line]
    assert "sales_order_id" in wide[0] and "product_id" not in wide[0]
