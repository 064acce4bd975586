"""Fact loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimloom.functions.scalar import date_key
from dimloom.operators.dimensions import role_play
from dimloom.operators.loads import accumulating_snapshot, as_of_join, dedup, incremental_append, periodic_snapshot
from dimloom.operators.relational import allocate, apply_aggregate, assign_batches, partition_aggregate, top_k_per_group
from dimloom.plans.catalog import query
from dimloom.plans.staging import NOW, Staging, ntz
from dimloom.plans.views import DETAIL_KEY, distinct_order_totals, frequent_buckets, line_pieces

FACT_COLUMNS = [
    "sales_order_id", "sales_order_detail_id", "customer_key", "product_key", "date_key", "address_key",
    "credit_card_key", "order_status_key", "order_qty", "unit_price", "unit_price_discount", "line_total",
]
FACT_OUT = """
    sales_order_id, sales_order_detail_id, customer_key, product_key, CAST(date_key AS BIGINT) AS date_key,
    address_key, credit_card_key, CAST(order_status_key AS BIGINT) AS order_status_key, order_qty,
    CAST(unit_price AS DOUBLE) AS unit_price, CAST(unit_price_discount AS DOUBLE) AS unit_price_discount,
    CAST(line_total AS DOUBLE) AS line_total"""


def sales_fact_rows(t: Staging, lines: DataFrame | None = None, *, address: str = "left",
                    header: DataFrame | None = None, columns: Sequence[str] = FACT_COLUMNS) -> DataFrame:
    """Sale lines with the keys of the current dimension rows.

    The dimensions that hang off the order are resolved on the header, before the join
    with the many times larger lines. Only the six-row status table has a broadcast hint.
    Address and card are left joins on unique keys: they change no rows, so a reader that
    does not want their key does not pay for them. Lines meet the products first, while they are
    narrow, and lie by order from then on; what follows from their other columns comes last.
    """
    h = (header if header is not None else t.stg_sales_order_header).select(
        "sales_order_id", "customer_id", "bill_to_address_id", "credit_card_id", "status",
        date_key("order_date").alias("date_key"))
    h = h.join(t.customer_keys, "customer_id").join(
        F.broadcast(t.dim_order_status.select(F.col("order_status").alias("status"), "order_status_key")), "status")
    if "address_key" in columns or address != "left":
        h = h.join(t.dim_address.where("is_current").select(F.col("address_id").alias("bill_to_address_id"), "address_key"),
                   "bill_to_address_id", address)
    if "credit_card_key" in columns:
        h = h.join(t.dim_credit_card.where("is_current").select("credit_card_id", "credit_card_key"), "credit_card_id", "left")
    if lines is None:
        lines = t.sale_lines if "unit_price" in columns else t.stg_sales_order_detail
    rows = (lines if "product_key" in lines.columns else with_product_keys(t, lines)).join(h, "sales_order_id")
    return (t.detail_columns(rows) if "_line" in lines.columns else rows).select(*columns)


def with_product_keys(t: Staging, lines: DataFrame) -> DataFrame:
    return lines.join(t.product_keys.drop("product_name"), "product_id")


def lines_with_order(t: Staging, aggs: dict[str, Column]) -> DataFrame:
    """Sale lines with their product's key and aggregates over all lines of their order, whether their product is known or not."""
    grouped = t.stg_sales_order_detail.groupBy("sales_order_id").agg(*[expr.alias(name) for name, expr in aggs.items()])
    return with_product_keys(t, t.sale_lines).join(grouped, "sales_order_id")


def discount_filtered(t: Staging, rule: str) -> DataFrame:
    """Lines that pass the correlated test of each dialect, one aggregate per order or product."""
    if rule == "avg_order_discount":  # at most the order's average + 0.5
        kept = lines_with_order(t, {"_sum": F.sum("unit_price_discount"), "_n": F.count("unit_price_discount")})
        return kept.where(F.col("unit_price_discount") <= F.col("_sum") / F.col("_n") + F.lit(0.5)).drop("_sum", "_n")
    if rule == "max_order_discount":  # at most the order's maximum
        kept = lines_with_order(t, {"_max": F.max("unit_price_discount")})
        return kept.where(F.col("unit_price_discount") <= F.col("_max")).drop("_max")
    if rule == "product_price":  # at least one hundredth of the product's average price
        agg = {"_sum": F.sum("unit_price"), "_n": F.count("unit_price")}
        kept = partition_aggregate(t.stg_sales_order_detail, ["product_id"], agg, keys_not_null=True)
        return kept.where(F.col("unit_price").cast("double") >= F.col("_sum").cast("double") / F.col("_n") * F.lit(0.01)
                          ).drop("_sum", "_n")
    raise ValueError(f"unknown rule {rule}")


PG_FACT = """
    SELECT f.* FROM fct_sales f JOIN (
        SELECT sales_order_id, SUM(unit_price_discount) AS s, COUNT(unit_price_discount) AS n
        FROM stg_sales_order_detail GROUP BY 1) a ON a.sales_order_id = f.sales_order_id
    WHERE f.unit_price_discount <= a.s / a.n + 0.5"""


@query("load_fct_sales_full", "N6 M1 P17 J1 J2 J8 Q4 P2", f"SELECT {FACT_OUT} FROM ({PG_FACT}) f")
def load_fct_sales_full(t: Staging) -> DataFrame:
    """FULL mode. The lateral MAX of the source adds no column and drops no row: every line
    has its own order, so it is not computed."""
    return sales_fact_rows(t, discount_filtered(t, "avg_order_discount"))


def loaded_fact_keys(t: Staging) -> DataFrame:
    """What an earlier load left in the fact: the lines of finished orders."""
    done = t.table("orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("sales_order_id"))
    return t.stg_sales_order_detail.join(done, "sales_order_id", "left_semi").select(*DETAIL_KEY)


NOT_LOADED = """
    NOT EXISTS (SELECT 1 FROM stg_sales_order_detail d JOIN orders o ON o.o_orderkey = d.sales_order_id
                WHERE o.o_orderstatus = 'F' AND d.sales_order_id = f.sales_order_id
                  AND d.sales_order_detail_id = f.sales_order_detail_id)"""


@query("load_fct_sales_incremental", "N6 M3 J15 P17", f"SELECT {FACT_OUT} FROM ({PG_FACT} AND {NOT_LOADED}) f")
def load_fct_sales_incremental(t: Staging) -> DataFrame:
    """INCREMENTAL mode: the anti join comes first, so loaded lines reach no other join."""
    fresh = incremental_append(loaded_fact_keys(t), t.detail_columns(discount_filtered(t, "avg_order_discount")), DETAIL_KEY)
    return sales_fact_rows(t, fresh)


@query("load_fct_sales_lookback", "N6 M4 J13 Q4 Q5 T3", f"""
    SELECT {FACT_OUT} FROM (
        SELECT f.* FROM fct_sales f
        JOIN stg_sales_order_detail d0 ON d0.sales_order_id = f.sales_order_id
                                      AND d0.sales_order_detail_id = f.sales_order_detail_id
        JOIN stg_sales_order_header h ON h.sales_order_id = f.sales_order_id
        JOIN (SELECT product_id, CAST(SUM(unit_price) AS DOUBLE) / COUNT(*) AS p
              FROM stg_sales_order_detail GROUP BY 1) a ON a.product_id = d0.product_id
        JOIN (SELECT sales_order_id, unnest(range(least(COUNT(*), 3))) AS copy
              FROM stg_sales_order_detail GROUP BY 1) c ON c.sales_order_id = f.sales_order_id
        WHERE f.address_key IS NOT NULL AND h.order_date >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY - INTERVAL 4 YEAR
          AND CAST(f.unit_price AS DOUBLE) >= a.p * 0.01 AND {NOT_LOADED}) f""")
def load_fct_sales_lookback(t: Staging) -> DataFrame:
    """The variant with a look-back window, an inner address join, a price test per product and
    a CROSS APPLY of the order's top three lines, which repeats each line up to three times."""
    since = F.col("order_date") >= ntz(NOW) - F.expr("interval 1 day") - F.expr("interval 4 year")
    header = t.stg_sales_order_header.where(since)
    fresh = incremental_append(loaded_fact_keys(t), discount_filtered(t, "product_price"), DETAIL_KEY)
    copies = top_k_per_group(t.stg_sales_order_detail, ["sales_order_id"],
                             ["-line_total", "sales_order_detail_id"], 3).select("sales_order_id")
    return sales_fact_rows(t, fresh, address="inner", header=header).join(copies, "sales_order_id").select(*FACT_COLUMNS)


@query("load_fct_sales_max_discount", "N6 Q4", f"""
    SELECT {FACT_OUT} FROM fct_sales f WHERE f.unit_price_discount <= (
        SELECT MAX(d.unit_price_discount) FROM stg_sales_order_detail d WHERE d.sales_order_id = f.sales_order_id)""")
def load_fct_sales_max_discount(t: Staging) -> DataFrame:
    return sales_fact_rows(t, discount_filtered(t, "max_order_discount"))


@query("orders_with_returned_peak", "J12", """
    SELECT o_orderkey, o_custkey, r.peak, r.n FROM orders JOIN (
        SELECT l_orderkey, MAX(l_discount) AS peak, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON l_orderkey = o_orderkey""")
def orders_with_returned_peak(t: Staging) -> DataFrame:
    """CROSS APPLY of an aggregate over each order's returned lines: orders without one go."""
    returned = t.table("lineitem", ["l_orderkey", "l_discount", "l_returnflag"]).where("l_returnflag = 'R'")
    return apply_aggregate(t.table("orders", ["o_orderkey", "o_custkey"]), returned, {"o_orderkey": "l_orderkey"},
                           {"peak": F.max("l_discount"), "n": F.count(F.lit(1))}, keep_unmatched=False)


@query("load_fct_sales_historical", "N7 M1 Q7", f"SELECT {FACT_OUT} FROM fct_sales")
def load_fct_sales_historical(t: Staging) -> DataFrame:
    """The rebuild. Batches only bound a transaction there; the union of all batches is one job here."""
    return t.fct_sales


@query("fct_sales_batches", "M9 W2 T2", """
    SELECT (rn - 1) // 1000 + 1 AS batch_id, COUNT(*) AS batch_rows, CAST(SUM(order_qty) AS BIGINT) AS total_qty
    FROM (SELECT order_qty, ROW_NUMBER() OVER (ORDER BY sales_order_id, sales_order_detail_id) AS rn
          FROM stg_sales_order_detail) d GROUP BY 1""")
def fct_sales_batches(t: Staging) -> DataFrame:
    """Which batch of 1,000 each line falls into."""
    lines = t.stg_sales_order_detail.select(*DETAIL_KEY, "order_qty")
    batched = assign_batches(lines, DETAIL_KEY, 1000, keys_from=t.table("lineitem", ["l_orderkey"]))
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("batch_rows"), F.sum("order_qty").alias("total_qty"))


CALENDAR_LEVELS = ["year_number", "quarter_number", "month_number"]


def sales_summary(t: Staging, dialect: str = "postgres") -> DataFrame:
    """GROUP BY ROLLUP (year, quarter, month), product, date. The fact is added up per (date, product) once; the concatenated
    grouping sets then expand those sums, not the lines. Product and date are in every set, so each row of a level is a group of
    its own: a row per level takes the columns of its set, and nothing is moved or grouped again."""
    days = F.broadcast(t.dim_date.select("date_key", *CALENDAR_LEVELS))  # a calendar: some tens of thousands of rows
    base = t.fact("date_key", "product_key", "sales_order_id", "order_qty", "line_total").join(days.select("date_key"), "date_key")
    keys = ["product_key", "date_key"]
    # A stored fact is read once more to find its frequent keys; one that is still to be joined is not joined twice for that.
    often = frequent_buckets(base, keys) if "fct_sales" in vars(t) else None
    totals = distinct_order_totals(base, keys, line_pieces(t), distinct=dialect != "oracle", frequent=often)
    measures = ["total_qty", "total_revenue", "order_count"]
    level = F.explode(F.array(*[F.lit(n) for n in range(len(CALENDAR_LEVELS), -1, -1)])).alias("_level")
    rolled = totals.join(days, "date_key").select("*", level).withColumns(
        {c: F.when(F.col("_level") > n, F.col(c)) for n, c in enumerate(CALENDAR_LEVELS)}).withColumn(
        "_no_year", (F.col("_level") == 0).cast("int"))
    having = {"postgres": F.col("total_revenue") > 0, "sqlserver": (F.col("total_qty") > 0) | (F.col("_no_year") == 1),
              "oracle": F.col("_no_year") == 0}
    if dialect not in having:
        raise ValueError(f"unknown dialect {dialect}")
    return rolled.where(having[dialect]).select("date_key", "product_key", *measures)


def _summary_sql(count: str, having: str) -> str:
    return f"""
    SELECT CAST(COALESCE(dd.date_key, 0) AS BIGINT) AS date_key, COALESCE(fs.product_key, 0) AS product_key,
           CAST(SUM(fs.order_qty) AS BIGINT) AS total_qty, CAST(SUM(fs.line_total) AS DOUBLE) AS total_revenue,
           {count} AS order_count
    FROM fct_sales fs JOIN dim_date dd ON fs.date_key = dd.date_key
    GROUP BY ROLLUP (dd.year_number, dd.quarter_number, dd.month_number), fs.product_key, dd.date_key
    HAVING {having}"""


@query("load_fct_sales_summary", "N8 A8 A2 A4", _summary_sql("COUNT(DISTINCT fs.sales_order_id)", "SUM(fs.line_total) > 0"))
def load_fct_sales_summary(t: Staging) -> DataFrame:
    return sales_summary(t)


@query("load_fct_sales_summary_qty", "N8 A8 A11", _summary_sql(
    "COUNT(DISTINCT fs.sales_order_id)", "SUM(fs.order_qty) > 0 OR GROUPING(dd.year_number) = 1"))
def load_fct_sales_summary_qty(t: Staging) -> DataFrame:
    return sales_summary(t, "sqlserver")


@query("load_fct_sales_summary_rows", "N8 A8 A3", _summary_sql("COUNT(*)", "GROUPING(dd.year_number) = 0"))
def load_fct_sales_summary_rows(t: Staging) -> DataFrame:
    return sales_summary(t, "oracle")


def sales_by_channel(t: Staging) -> DataFrame:
    """Both channels in one pass: the flag becomes the label instead of two scans and a union."""
    header = t.stg_sales_order_header.where(F.col("online_order_flag").isNotNull()).select(
        "sales_order_id", date_key("order_date").alias("date_key"),
        F.when(F.col("online_order_flag"), "Online").otherwise("Store").alias("channel"))
    return distinct_order_totals(header.join(t.stg_sales_order_detail, "sales_order_id"), ["date_key", "channel"])


@query("load_fct_sales_by_channel", "N9 U1 A1 A2 A6", """
    SELECT CAST(date_key AS BIGINT) AS date_key, 'Online' AS channel, CAST(SUM(order_qty) AS BIGINT) AS total_qty,
           CAST(SUM(line_total) AS DOUBLE) AS total_revenue, COUNT(DISTINCT sales_order_id) AS order_count
    FROM (SELECT CAST(strftime(h.order_date, '%Y%m%d') AS INTEGER) AS date_key, h.sales_order_id, d.order_qty, d.line_total
          FROM stg_sales_order_header h JOIN stg_sales_order_detail d ON h.sales_order_id = d.sales_order_id
          WHERE h.online_order_flag) a GROUP BY 1
    UNION ALL
    SELECT CAST(date_key AS BIGINT), 'Store', CAST(SUM(order_qty) AS BIGINT), CAST(SUM(line_total) AS DOUBLE),
           COUNT(DISTINCT sales_order_id)
    FROM (SELECT CAST(strftime(h.order_date, '%Y%m%d') AS INTEGER) AS date_key, h.sales_order_id, d.order_qty, d.line_total
          FROM stg_sales_order_header h JOIN stg_sales_order_detail d ON h.sales_order_id = d.sales_order_id
          WHERE NOT h.online_order_flag) b GROUP BY 1""")
def load_fct_sales_by_channel(t: Staging) -> DataFrame:
    return t.fct_sales_by_channel


@query("load_reseller_sales", "N25 D5 J18 W6", """
    SELECT d.product_id AS product_key,
           CAST(CAST(strftime(h.order_date, '%Y%m%d') AS INTEGER) AS BIGINT) AS order_date_key,
           CAST(CAST(strftime(COALESCE(h.ship_date, h.order_date), '%Y%m%d') AS INTEGER) AS BIGINT) AS ship_date_key,
           CAST(CAST(strftime(h.due_date, '%Y%m%d') AS INTEGER) AS BIGINT) AS due_date_key,
           h.customer_id AS customer_key, d.order_qty AS order_quantity,
           CAST(d.unit_price AS DOUBLE) AS unit_price, CAST(d.line_total AS DOUBLE) AS sales_amount,
           ((2 * CAST(h.tax_amt * 10000 AS BIGINT) + n) // (2 * n)) / 10000 AS tax_amt,
           ((2 * CAST(h.freight * 10000 AS BIGINT) + n) // (2 * n)) / 10000 AS freight
    FROM stg_sales_order_header h
    JOIN (SELECT *, COUNT(*) OVER (PARTITION BY sales_order_id) AS n FROM stg_sales_order_detail) d
      ON h.sales_order_id = d.sales_order_id""")
def load_reseller_sales(t: Staging) -> DataFrame:
    header = t.stg_sales_order_header.select(
        "sales_order_id", "customer_id", "tax_amt", "freight", date_key("order_date").alias("order_date_key"),
        date_key(F.coalesce("ship_date", "order_date")).alias("ship_date_key"), date_key("due_date").alias("due_date_key"))
    rows = header.join(t.stg_sales_order_detail, "sales_order_id")
    return allocate(rows, ["sales_order_id"], ["tax_amt", "freight"]).select(
        F.col("product_id").alias("product_key"), "order_date_key", "ship_date_key", "due_date_key",
        F.col("customer_id").alias("customer_key"), F.col("order_qty").alias("order_quantity"), "unit_price",
        F.col("line_total").alias("sales_amount"), "tax_amt", "freight")


@query("reseller_sales_by_role", "D5 J18", """
    SELECT od.year_number AS order_year, sd.quarter_number AS ship_quarter, dd.is_weekend AS due_is_weekend,
           COUNT(*) AS orders
    FROM stg_sales_order_header h
    LEFT JOIN dim_date od ON od.date_key = CAST(strftime(h.order_date, '%Y%m%d') AS INTEGER)
    LEFT JOIN dim_date sd ON sd.date_key = CAST(strftime(COALESCE(h.ship_date, h.order_date), '%Y%m%d') AS INTEGER)
    LEFT JOIN dim_date dd ON dd.date_key = CAST(strftime(h.due_date, '%Y%m%d') AS INTEGER)
    GROUP BY ALL""")
def reseller_sales_by_role(t: Staging) -> DataFrame:
    header = t.stg_sales_order_header.select(
        date_key("order_date").alias("order_date_key"),
        date_key(F.coalesce("ship_date", "order_date")).alias("ship_date_key"), date_key("due_date").alias("due_date_key"))
    roles = role_play(header, t.dim_date, "date_key",
                      {"order": "order_date_key", "ship": "ship_date_key", "due": "due_date_key"},
                      ["year_number", "quarter_number", "is_weekend"], small=True)
    return roles.groupBy(F.col("order_year_number").alias("order_year"), F.col("ship_quarter_number").alias("ship_quarter"),
                         F.col("due_is_weekend").alias("due_is_weekend")).agg(F.count(F.lit(1)).alias("orders"))



@query("load_order_fulfillment", "N22 M11 F1", """
    WITH before AS (
        SELECT sales_order_id, customer_id AS customer_key, order_date,
               CASE WHEN total_due > 250000 THEN ship_date END AS ship_date,
               CAST(NULL AS TIMESTAMP) AS delivery_date, CAST(NULL AS TIMESTAMP) AS invoice_date, total_due AS order_amount
        FROM stg_sales_order_header WHERE order_date < TIMESTAMP '1999-01-01'),
    filled AS (
        SELECT COALESCE(b.sales_order_id, h.sales_order_id) AS sales_order_id,
               COALESCE(b.customer_key, h.customer_id) AS customer_key,
               COALESCE(b.order_date, h.order_date) AS order_date,
               COALESCE(b.ship_date, h.ship_date) AS ship_date, b.delivery_date, b.invoice_date,
               COALESCE(b.order_amount, h.total_due) AS order_amount
        FROM stg_sales_order_header h FULL JOIN before b ON b.sales_order_id = h.sales_order_id),
    delivered AS (SELECT * REPLACE (COALESCE(delivery_date, ship_date + INTERVAL 5 DAY) AS delivery_date) FROM filled),
    invoiced AS (SELECT * REPLACE (COALESCE(invoice_date, delivery_date) AS invoice_date) FROM delivered)
    SELECT sales_order_id, customer_key, order_date, ship_date, delivery_date, invoice_date,
           CAST(order_amount AS DOUBLE) AS order_amount,
           date_diff('day', order_date, ship_date) AS days_to_ship,
           date_diff('day', order_date, invoice_date) AS days_to_invoice
    FROM invoiced""")
def load_order_fulfillment(t: Staging) -> DataFrame:
    header = t.stg_sales_order_header
    none = F.lit(None).cast("timestamp_ntz")
    before = header.where(F.col("order_date") < ntz("1999-01-01 00:00:00")).select(
        "sales_order_id", F.col("customer_id").alias("customer_key"), "order_date",
        F.when(F.col("total_due") > 250000, F.col("ship_date")).alias("ship_date"),
        none.alias("delivery_date"), none.alias("invoice_date"), F.col("total_due").alias("order_amount"))
    source = header.select("sales_order_id", F.col("customer_id").alias("customer_key"), "order_date", "ship_date",
                           F.col("total_due").alias("order_amount"))
    return accumulating_snapshot(
        before, source, ["sales_order_id"], ["ship_date", "delivery_date", "invoice_date"],
        derived=[("delivery_date", lambda c: c + F.expr("interval 5 days"), "ship_date"),
                 ("invoice_date", lambda c: c, "delivery_date")],
        lags={"days_to_ship": ("order_date", "ship_date"), "days_to_invoice": ("order_date", "invoice_date")})


@query("load_inventory_snapshot", "N23 M12", """
    SELECT * FROM (
        SELECT p_partkey AS product_key, CAST(1 AS BIGINT) AS warehouse_key, DATE '2001-07-31' AS snapshot_date,
               CAST(p_size AS BIGINT) AS units_on_hand, p_retailprice AS unit_cost FROM part
        UNION ALL
        SELECT p_partkey, 1, DATE '2001-08-01', CAST(p_size AS BIGINT) * 2, p_retailprice FROM part) s""")
def load_inventory_snapshot(t: Staging) -> DataFrame:
    """Replaces the slice of today, which an earlier run already wrote, and keeps yesterday's."""
    def slice_of(day: str, factor: int) -> DataFrame:
        return t.table("part").select(
            F.col("p_partkey").alias("product_key"), F.lit(1).cast("bigint").alias("warehouse_key"),
            F.lit(day).cast("date").alias("snapshot_date"),
            (F.col("p_size").cast("bigint") * factor).alias("units_on_hand"), F.col("p_retailprice").alias("unit_cost"))

    earlier = slice_of("2001-07-31", 1).unionByName(slice_of("2001-08-01", 1))
    return periodic_snapshot(earlier, slice_of("2001-08-01", 2), "snapshot_date", F.lit("2001-08-01").cast("date"))


HISTORY_SQL = f"""
    SELECT customer_id, customer_key, 'Old ' || full_name AS full_name, TIMESTAMP '1995-01-01' AS valid_from,
           TIMESTAMP '1998-06-15' AS valid_to, FALSE AS is_current FROM dim_customer WHERE territory_id IS NOT NULL
    UNION ALL
    SELECT customer_id, customer_key + 100000000, full_name,
           CASE WHEN territory_id IS NOT NULL THEN TIMESTAMP '1998-06-15' ELSE TIMESTAMP '1995-01-01' END,
           CAST(NULL AS TIMESTAMP), TRUE FROM dim_customer"""


def customer_history(t: Staging) -> DataFrame:
    """dim_customer with a closed version for every customer that has a territory."""
    start, cut = ntz("1995-01-01 00:00:00"), ntz("1998-06-15 00:00:00")
    versions = F.when(F.col("territory_id").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    return t.dim_customer.select(
        "customer_id", "customer_key", "full_name", "territory_id", F.explode(versions).alias("_old")).select(
        "customer_id",
        F.when(F.col("_old"), F.col("customer_key")).otherwise(F.col("customer_key") + 100000000).alias("customer_key"),
        F.when(F.col("_old"), F.concat(F.lit("Old "), "full_name")).otherwise(F.col("full_name")).alias("full_name"),
        F.when(~F.col("_old") & F.col("territory_id").isNotNull(), cut).otherwise(start).alias("valid_from"),
        F.when(F.col("_old"), cut).alias("valid_to"), (~F.col("_old")).alias("is_current"))


@query("late_facts_as_of", "J19 M17 X4", f"""
    WITH hist AS ({HISTORY_SQL})
    SELECT h.sales_order_id, d.customer_key, d.full_name FROM stg_sales_order_header h
    JOIN hist d ON h.customer_id = d.customer_id AND h.order_date >= d.valid_from
               AND (d.valid_to IS NULL OR h.order_date < d.valid_to)""")
def late_facts_as_of(t: Staging) -> DataFrame:
    """Late facts take the dimension version of their own date."""
    header = t.stg_sales_order_header.select("sales_order_id", "customer_id", "order_date")
    return as_of_join(header, customer_history(t), {"customer_id": "customer_id"}, "order_date",
                      {"customer_key": "customer_key", "full_name": "full_name"}, mode="as_of").select(
        "sales_order_id", "customer_key", "full_name")


@query("late_facts_current", "J8 M17", f"""
    WITH hist AS ({HISTORY_SQL})
    SELECT h.sales_order_id, d.customer_key, d.full_name FROM stg_sales_order_header h
    JOIN hist d ON h.customer_id = d.customer_id AND d.is_current""")
def late_facts_current(t: Staging) -> DataFrame:
    """The same lookup as the load routines do it: always the current version."""
    header = t.stg_sales_order_header.select("sales_order_id", "customer_id", "order_date")
    return as_of_join(header, customer_history(t), {"customer_id": "customer_id"}, "order_date",
                      {"customer_key": "customer_key", "full_name": "full_name"}).select(
        "sales_order_id", "customer_key", "full_name")


@query("dedup_staging_lines", "M13 W8 A17 S6", """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey,
                                     l_extendedprice, l_quantity) AS rn FROM lineitem) x WHERE rn = 1""")
def dedup_staging_lines(t: Staging) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = t.table("lineitem", [*columns, "l_shipdate"])
    return dedup(lines, ["l_orderkey", "l_linenumber"],
                 ["-l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select(*columns)


