"""Dimension loads and dimension builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimloom.functions.scalar import after_separator, date_key, left_pad
from dimloom.operators import dimensions as D
from dimloom.operators import loads as L
from dimloom.operators.relational import apply_aggregate, apply_top_k, update_from
from dimloom.plans.catalog import query
from dimloom.plans.staging import FIRST_LOAD, LOAD_TIME, NOW, Staging, ntz

DIM_CUSTOMER = ["customer_key", "customer_id", "person_id", "store_id", "full_name", "territory_id",
                "valid_from", "valid_to", "is_current"]


def customer_before(t: Staging) -> DataFrame:
    """dim_customer before the load: no customers of the AUTOMOBILE segment yet, another
    territory for one nation, another name for one segment, and one closed old version."""
    segment = t.table("customer", ["c_custkey", "c_mktsegment", "c_nationkey"])
    old = t.dim_customer.join(segment, F.col("customer_id") == F.col("c_custkey")).where(
        F.col("c_mktsegment") != "AUTOMOBILE")
    current = old.select(
        "customer_key", "customer_id", "person_id", "store_id",
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Old "), "full_name")).otherwise(F.col("full_name"))
        .alias("full_name"),
        F.when(F.col("c_nationkey") == 3, F.lit(99)).otherwise(F.col("territory_id")).alias("territory_id"),
        "valid_from", "valid_to", "is_current")
    closed = old.where(F.col("c_nationkey") == 5).select(
        (F.col("customer_key") + 50000000).alias("customer_key"), "customer_id", "person_id", "store_id",
        F.lit("First Name").alias("full_name"), "territory_id", ntz("2001-01-01 00:00:00").alias("valid_from"),
        F.col("valid_from").alias("valid_to"), F.lit(False).alias("is_current"))
    return current.unionByName(closed)


BEFORE_SQL = """
    SELECT d.customer_key, d.customer_id, d.person_id, d.store_id,
           CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Old ' || d.full_name ELSE d.full_name END AS full_name,
           CASE WHEN c.c_nationkey = 3 THEN 99 ELSE d.territory_id END AS territory_id,
           d.valid_from, d.valid_to, d.is_current
    FROM dim_customer d JOIN customer c ON c.c_custkey = d.customer_id WHERE c.c_mktsegment <> 'AUTOMOBILE'
    UNION ALL
    SELECT d.customer_key + 50000000, d.customer_id, d.person_id, d.store_id, 'First Name', d.territory_id,
           TIMESTAMP '2001-01-01', d.valid_from, FALSE
    FROM dim_customer d JOIN customer c ON c.c_custkey = d.customer_id
    WHERE c.c_mktsegment <> 'AUTOMOBILE' AND c.c_nationkey = 5"""


def scd2_sql(before: str, source: str, key: str, surrogate: str, columns: str, test: str, at: str = f"TIMESTAMP '{LOAD_TIME}'") -> str:
    """The load as set operations: close, keep, open."""
    cols = [c.strip() for c in columns.split(",")]
    shown = ", ".join(f"s.{c}" for c in cols)
    kept = ", ".join(f"b.{c}" for c in cols)
    return f"""
    WITH b0 AS ({before}), src AS ({source}),
    hit AS (SELECT b.{surrogate} FROM b0 b JOIN src s ON b.{key} = s.{key} AND b.is_current WHERE {test}),
    kept AS (SELECT b.{surrogate}, {kept}, b.valid_from,
                    CASE WHEN h.{surrogate} IS NOT NULL THEN {at.replace('s.', 's2.')} ELSE b.valid_to END AS valid_to,
                    b.is_current AND h.{surrogate} IS NULL AS is_current
             FROM b0 b LEFT JOIN hit h ON h.{surrogate} = b.{surrogate} LEFT JOIN src s2 ON s2.{key} = b.{key}),
    opened AS (SELECT {shown}, {at} AS valid_from FROM src s
               WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.{key} = s.{key} AND k.is_current))
    SELECT {surrogate}, {columns}, valid_from, valid_to, is_current FROM kept
    UNION ALL
    SELECT (SELECT MAX({surrogate}) FROM b0) + ROW_NUMBER() OVER (ORDER BY {key}), {columns}, valid_from,
           CAST(NULL AS TIMESTAMP), TRUE FROM opened"""


SENTINEL_TEST = """COALESCE(b.full_name, '') <> COALESCE(s.full_name, '')
    OR COALESCE(b.territory_id, -1) <> COALESCE(s.territory_id, -1) OR COALESCE(b.store_id, -1) <> COALESCE(s.store_id, -1)"""
CUSTOMER_COLS = "customer_id, person_id, store_id, full_name, territory_id"


@query("load_dim_customer", "N1 M8 M19 P7 J14 J15", scd2_sql(
    BEFORE_SQL, f"SELECT {CUSTOMER_COLS} FROM vw_stg_customer", "customer_id", "customer_key", CUSTOMER_COLS, SENTINEL_TEST))
def load_dim_customer(t: Staging) -> DataFrame:
    source = t.vw_stg_customer.select("customer_id", "person_id", "store_id", "full_name", "territory_id")
    return L.scd2_merge(
        customer_before(t), source, ["customer_id"],
        {"full_name": ("sentinel", ""), "territory_id": ("sentinel", -1), "store_id": ("sentinel", -1)},
        ntz(LOAD_TIME), surrogate="customer_key")


@query("load_dim_customer_source_time", "N1 M8 P7", scd2_sql(
    BEFORE_SQL, "SELECT customer_id, person_id, CAST(NULL AS BIGINT) AS store_id, full_name, territory_id, "
    "modified_date + INTERVAL 1 DAY AS modified_date FROM vw_stg_customer",
    "customer_id", "customer_key", CUSTOMER_COLS,
    "COALESCE(b.full_name, '~') <> COALESCE(s.full_name, '~') OR COALESCE(b.territory_id, -1) <> COALESCE(s.territory_id, -1)",
    at="s.modified_date"))
def load_dim_customer_source_time(t: Staging) -> DataFrame:
    """The variant whose versions start at the source row's own change time and which does not load the store."""
    source = t.vw_stg_customer.select(
        "customer_id", "person_id", F.lit(None).cast("bigint").alias("store_id"), "full_name", "territory_id",
        (F.col("modified_date") + F.expr("interval 1 day")).alias("modified_date"))
    return L.scd2_merge(customer_before(t), source, ["customer_id"],
                        {"full_name": ("sentinel", "~"), "territory_id": ("sentinel", -1)}, "modified_date",
                        surrogate="customer_key")


PRODUCT_COLS = ("product_id, product_name, product_number, color, class, product_line, standard_cost, list_price, "
                "product_subcategory, product_category, sell_start_date, sell_end_date")


def product_before(t: Staging) -> DataFrame:
    return t.dim_product.where(F.col("product_line") != "PROMO").select(
        "product_key", "product_id", "product_name", "product_number",
        F.when(F.col("class") == "gear", F.lit("grey")).otherwise(F.col("color")).alias("color"),
        "class", "product_line", "standard_cost",
        F.when(F.col("product_line") == "ECONOMY", F.col("list_price") + 1).otherwise(F.col("list_price"))
        .cast("decimal(18,4)").alias("list_price"),
        "product_subcategory", "product_category", "sell_start_date", "sell_end_date", "valid_from", "valid_to", "is_current")


PRODUCT_BEFORE_SQL = """
    SELECT product_key, product_id, product_name, product_number,
           CASE WHEN class = 'gear' THEN 'grey' ELSE color END AS color, class, product_line, standard_cost,
           CASE WHEN product_line = 'ECONOMY' THEN list_price + 1 ELSE list_price END AS list_price,
           product_subcategory, product_category, sell_start_date, sell_end_date, valid_from, valid_to, is_current
    FROM dim_product WHERE product_line <> 'PROMO'"""


@query("load_dim_product", "N2 M8 J1", "SELECT * REPLACE (CAST(standard_cost AS DOUBLE) AS standard_cost, "
       "CAST(list_price AS DOUBLE) AS list_price) FROM (" + scd2_sql(
           PRODUCT_BEFORE_SQL, f"SELECT {PRODUCT_COLS} FROM product_enriched", "product_id", "product_key", PRODUCT_COLS,
           """b.product_name <> s.product_name OR COALESCE(b.color, '') <> COALESCE(s.color, '')
              OR b.standard_cost <> s.standard_cost OR b.list_price <> s.list_price
              OR COALESCE(b.product_subcategory, '') <> COALESCE(s.product_subcategory, '')
              OR COALESCE(b.product_category, '') <> COALESCE(s.product_category, '')""") + ") x")
def load_dim_product(t: Staging) -> DataFrame:
    return L.scd2_merge(
        product_before(t), t.product_enriched.drop("discontinued_date"), ["product_id"],
        {"product_name": "plain", "color": ("sentinel", ""), "standard_cost": "plain", "list_price": "plain",
         "product_subcategory": ("sentinel", ""), "product_category": ("sentinel", "")},
        ntz(LOAD_TIME), surrogate="product_key")


EMP_COLS = ["employee_id", "national_id_number", "first_name", "last_name", "job_title", "current_flag"]


def employee_source(t: Staging) -> DataFrame:
    """Employees with their manager's name and number of direct reports."""
    manager = t.stg_employee.select(
        F.col("business_entity_id").alias("manager_id"),
        F.concat("first_name", F.lit(" "), "last_name").alias("_m"))
    named = t.stg_employee.join(manager, "manager_id", "left").withColumn(
        "manager_name", F.coalesce("_m", F.lit("No Manager"))).drop("_m")
    return apply_aggregate(named, t.stg_employee.where("manager_id IS NOT NULL"), {"business_entity_id": "manager_id"},
                           {"direct_reports_count": F.count(F.lit(1))}, {"direct_reports_count": 0})


@query("employee_source", "J6 Q2 P4", """
    SELECT e.business_entity_id AS employee_id, COALESCE(m.first_name || ' ' || m.last_name, 'No Manager') AS manager_name,
           (SELECT COUNT(*) FROM stg_employee sub WHERE sub.manager_id = e.business_entity_id) AS direct_reports_count
    FROM stg_employee e LEFT JOIN stg_employee m ON e.manager_id = m.business_entity_id""")
def employee_source_query(t: Staging) -> DataFrame:
    return employee_source(t).select(F.col("business_entity_id").alias("employee_id"), "manager_name", "direct_reports_count")


@query("load_dim_employee", "N3 M5 J6 Q2", f"""
    SELECT e.business_entity_id AS employee_id, e.national_id_number, e.first_name, e.last_name, e.job_title,
           e.current_flag, TIMESTAMP '{LOAD_TIME}' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current
    FROM stg_employee e
    UNION ALL
    SELECT -business_entity_id - 1, 'gone', first_name, last_name, job_title, FALSE, TIMESTAMP '{FIRST_LOAD}', NULL, TRUE
    FROM stg_employee WHERE NOT current_flag""")
def load_dim_employee(t: Staging) -> DataFrame:
    """Overwrites every matched row and restarts its validity; rows unknown to the source stay."""
    source = employee_source(t).withColumnRenamed("business_entity_id", "employee_id").select(*EMP_COLS)
    start, none = ntz(FIRST_LOAD), F.lit(None).cast("timestamp_ntz")
    validity = [start.alias("valid_from"), none.alias("valid_to"), F.lit(True).alias("is_current")]
    known = source.where("current_flag").select(
        "employee_id", "national_id_number", "first_name", "last_name", F.lit("old job").alias("job_title"),
        "current_flag", *validity)
    gone = source.where("NOT current_flag").select(
        (-F.col("employee_id") - 1).alias("employee_id"), F.lit("gone").alias("national_id_number"), "first_name",
        "last_name", "job_title", F.lit(False).alias("current_flag"), *validity)
    now = ntz(LOAD_TIME)
    return L.scd1_merge(known.unionByName(gone), source, ["employee_id"], set_matched={"valid_from": now},
                        set_inserted={"valid_from": now, "is_current": F.lit(True)})


@query("load_dim_product_category", "N4 M8 J14", scd2_sql(
    f"""SELECT product_category_id AS category_key, product_category_id,
               CASE WHEN product_category_id = 2 THEN 'Old Category' ELSE category_name END AS category_name,
               TIMESTAMP '{FIRST_LOAD}' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current
        FROM stg_product_category WHERE product_category_id <> 4""",
    "SELECT * FROM stg_product_category", "product_category_id", "category_key", "product_category_id, category_name",
    "b.category_name <> s.category_name"))
def load_dim_product_category(t: Staging) -> DataFrame:
    before = t.stg_product_category.where("product_category_id <> 4").select(
        F.col("product_category_id").alias("category_key"), "product_category_id",
        F.when(F.col("product_category_id") == 2, "Old Category").otherwise(F.col("category_name")).alias("category_name"),
        ntz(FIRST_LOAD).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    return L.scd2_merge(before, t.stg_product_category, ["product_category_id"], {"category_name": "plain"},
                        ntz(LOAD_TIME), surrogate="category_key")


ADDRESS_COLS = "address_id, address_line_1, city, state_province_id, postal_code"


def load_dim_address_and_credit_card(t: Staging) -> dict[str, DataFrame]:
    """One routine, two targets."""
    # The source also looks up each card's latest address and then does not use it; see latest_card_address.
    cards = t.stg_credit_card
    before = cards.where("card_type <> 'Vista'").select(
        (F.col("credit_card_id") + 1).alias("credit_card_key"), "credit_card_id",
        F.when(F.col("exp_month") == 12, "Old Type").otherwise(F.col("card_type")).alias("card_type"), "exp_month", "exp_year",
        ntz(FIRST_LOAD).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    return {
        "dim_address": L.scd2_merge(
            t.dim_address, t.stg_address, ["address_id"],
            {"address_line_1": "plain", "city": "plain", "postal_code": "plain"}, ntz(LOAD_TIME), surrogate="address_key"),
        "dim_credit_card": L.scd2_merge(
            before, cards, ["credit_card_id"], {"card_type": "plain", "exp_month": "plain", "exp_year": "plain"},
            ntz(LOAD_TIME), surrogate="credit_card_key"),
    }


@query("load_dim_address", "N5 M8 M10", scd2_sql(
    f"SELECT address_key, {ADDRESS_COLS}, valid_from, valid_to, is_current FROM dim_address",
    f"SELECT {ADDRESS_COLS} FROM stg_address", "address_id", "address_key", ADDRESS_COLS,
    "b.address_line_1 <> s.address_line_1 OR b.city <> s.city OR b.postal_code <> s.postal_code"))
def load_dim_address(t: Staging) -> DataFrame:
    return load_dim_address_and_credit_card(t)["dim_address"]


CARD_COLS = "credit_card_id, card_type, exp_month, exp_year"


@query("load_dim_credit_card", "N5 M8 M10", scd2_sql(
    f"""SELECT credit_card_id + 1 AS credit_card_key, credit_card_id,
               CASE WHEN exp_month = 12 THEN 'Old Type' ELSE card_type END AS card_type, exp_month, exp_year,
               TIMESTAMP '{FIRST_LOAD}' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current
        FROM stg_credit_card WHERE card_type <> 'Vista'""",
    f"SELECT {CARD_COLS} FROM stg_credit_card", "credit_card_id", "credit_card_key", CARD_COLS,
    "b.card_type <> s.card_type OR b.exp_month <> s.exp_month OR b.exp_year <> s.exp_year"))
def load_dim_credit_card(t: Staging) -> DataFrame:
    return load_dim_address_and_credit_card(t)["dim_credit_card"]


@query("latest_card_address", "J11 T4 Q6", """
    SELECT cc.credit_card_id, cc.card_type, la.bill_to_address_id, la.sales_order_id
    FROM stg_credit_card cc LEFT JOIN (
        SELECT * FROM (SELECT credit_card_id, bill_to_address_id, sales_order_id,
                              ROW_NUMBER() OVER (PARTITION BY credit_card_id ORDER BY order_date DESC, sales_order_id DESC) AS rn
                       FROM stg_sales_order_header) r WHERE rn = 1) la ON la.credit_card_id = cc.credit_card_id""")
def latest_card_address(t: Staging) -> DataFrame:
    header = t.stg_sales_order_header.where("credit_card_id IS NOT NULL").select(
        "credit_card_id", "bill_to_address_id", "sales_order_id", "order_date")
    return apply_top_k(t.stg_credit_card.select("credit_card_id", "card_type"), header, {"credit_card_id": "credit_card_id"},
                       ["-order_date", "-sales_order_id"], 1,
                       {"bill_to_address_id": "bill_to_address_id", "sales_order_id": "sales_order_id"}, keep_unmatched=True)


@query("load_dim_customer_full", "N26 J10 M1", """
    SELECT CAST(c.customer_id AS VARCHAR) AS customer_alternate_key, p.first_name, p.middle_name, p.last_name,
           p.email_promotion, CAST(h.first_order AS DATE) AS date_first_purchase
    FROM stg_customer c JOIN stg_person p ON c.person_id = p.business_entity_id
    LEFT JOIN (SELECT customer_id, MIN(order_date) AS first_order FROM stg_sales_order_header GROUP BY 1) h
      ON h.customer_id = c.customer_id""")
def load_dim_customer_full(t: Staging) -> DataFrame:
    people = t.stg_customer.join(t.stg_person.withColumnRenamed("business_entity_id", "person_id"), "person_id")
    first = apply_aggregate(people, t.stg_sales_order_header, {"customer_id": "customer_id"},
                            {"_first": F.min("order_date")})
    return first.select(F.col("customer_id").cast("string").alias("customer_alternate_key"), "first_name", "middle_name",
                        "last_name", "email_promotion", F.col("_first").cast("date").alias("date_first_purchase"))


@query("load_dim_customer_delta", "N26 M5", """
    SELECT CAST(c.customer_id AS VARCHAR) AS customer_alternate_key, p.first_name, p.last_name, p.email_promotion,
           CASE WHEN p.email_promotion = 0 THEN CAST(NULL AS DATE) ELSE DATE '1999-09-09' END AS date_first_purchase
    FROM stg_customer c JOIN stg_person p ON c.person_id = p.business_entity_id""")
def load_dim_customer_delta(t: Staging) -> DataFrame:
    """The merge writes its own columns only: the first purchase of a known customer survives."""
    source = t.stg_customer.join(t.stg_person.withColumnRenamed("business_entity_id", "person_id"), "person_id").select(
        F.col("customer_id").cast("string").alias("customer_alternate_key"), "first_name", "last_name", "email_promotion")
    target = source.where("email_promotion <> 0").select(
        "customer_alternate_key", F.lit("old").alias("first_name"), "last_name", "email_promotion",
        F.lit("1999-09-09").cast("date").alias("date_first_purchase"))
    return L.scd1_merge(target, source, ["customer_alternate_key"])


@query("enrich_customer_territory", "N29 P14", """
    SELECT d.customer_id, COALESCE(d.territory_id, c.c_nationkey) AS territory_id
    FROM dim_customer d JOIN customer c ON c.c_custkey = d.customer_id""")
def enrich_customer_territory(t: Staging) -> DataFrame:
    """Fills a missing territory from staging; every other row keeps its own."""
    dim = t.dim_customer.select("customer_id", "territory_id")
    nations = t.table("customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"))
    missing = dim.where(F.col("territory_id").isNull())
    filled = update_from(missing, nations, {"customer_id": "c_custkey"}, {"territory_id": "nation"})
    return dim.where(F.col("territory_id").isNotNull()).unionByName(filled)


@query("load_dim_contact", "N28", f"""
    SELECT CAST(c.customer_id AS VARCHAR) AS contact_alternate_key, p.first_name, p.last_name,
           lower(p.first_name || '.' || p.last_name || '@example.com') AS email_address,
           '555-' || right('0000' || c.customer_id, 4) || '-' || right('0000' || c.customer_id, 4) AS phone_number,
           right('000' || (c.customer_id % 1000), 3) || '-' || right('00' || ((c.customer_id // 1000) % 100), 2) || '-'
             || right('0000' || c.customer_id, 4) AS social_security_number,
           CAST(TIMESTAMP '{NOW}' - to_days(CAST(c.customer_id % 10000 AS INTEGER)) AS DATE) AS birth_date,
           c.customer_id || ' Main Street' AS street_address, 'Anytown' AS city,
           right('00000' || (c.customer_id % 100000), 5) AS postal_code
    FROM stg_customer c JOIN stg_person p ON c.person_id = p.business_entity_id""")
def load_dim_contact(t: Staging) -> DataFrame:
    return contacts(t)


def contacts(t: Staging) -> DataFrame:
    c = F.col("customer_id")
    people = t.stg_customer.join(t.stg_person.withColumnRenamed("business_entity_id", "person_id"), "person_id")
    return people.select(
        c.cast("string").alias("contact_alternate_key"), "first_name", "last_name",
        F.lower(F.concat("first_name", F.lit("."), "last_name", F.lit("@example.com"))).alias("email_address"),
        F.concat(F.lit("555-"), left_pad(c, 4), F.lit("-"), left_pad(c, 4)).alias("phone_number"),
        F.concat(left_pad(F.pmod(c, F.lit(1000)), 3), F.lit("-"), left_pad(F.expr("(customer_id div 1000) % 100"), 2),
                 F.lit("-"), left_pad(c, 4)).alias("social_security_number"),
        F.date_sub(ntz(NOW).cast("date"), F.pmod(c, F.lit(10000)).cast("int")).alias("birth_date"),
        F.concat(c.cast("string"), F.lit(" Main Street")).alias("street_address"), F.lit("Anytown").alias("city"),
        left_pad(F.pmod(c, F.lit(100000)), 5).alias("postal_code"))


@query("scd2_sentinel_end", "M8", f"""
    SELECT s_suppkey AS employee_key, after AS login, job_title, TIMESTAMP '{FIRST_LOAD}' AS valid_from,
           CASE WHEN changed THEN TIMESTAMP '{LOAD_TIME}' ELSE TIMESTAMP '9999-12-31' END AS valid_to, NOT changed AS is_current
    FROM (SELECT s_suppkey, substr(s_name, instr(s_name, '#') + 1, 50) AS after,
                 CASE WHEN s_acctbal < 5000 THEN 'Old' ELSE 'Job ' || s_nationkey END AS job_title, s_acctbal < 5000 AS changed
          FROM supplier) b
    UNION ALL
    SELECT s_suppkey, substr(s_name, instr(s_name, '#') + 1, 50), 'Job ' || s_nationkey, TIMESTAMP '{LOAD_TIME}',
           TIMESTAMP '9999-12-31', TRUE FROM supplier WHERE s_acctbal < 5000""")
def scd2_sentinel_end(t: Staging) -> DataFrame:
    """The form whose open versions end on 9999-12-31 instead of NULL."""
    end = ntz("9999-12-31 00:00:00")
    source = t.table("supplier").select(
        F.col("s_suppkey").alias("employee_key"), after_separator(F.col("s_name"), "#", 50).alias("login"),
        F.concat(F.lit("Job "), F.col("s_nationkey").cast("string")).alias("job_title"), "s_acctbal")
    before = source.select(
        "employee_key", "login", F.when(F.col("s_acctbal") < 5000, "Old").otherwise(F.col("job_title")).alias("job_title"),
        ntz(FIRST_LOAD).alias("valid_from"), end.alias("valid_to"), F.lit(True).alias("is_current"))
    return L.scd2_merge(before, source.drop("s_acctbal"), ["employee_key"], {"job_title": "plain"}, ntz(LOAD_TIME), open_end=end)


@query("scd1_delete_missing", "M7", """
    SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, 'source' AS origin FROM customer WHERE c_acctbal >= 0""")
def scd1_delete_missing(t: Staging) -> DataFrame:
    """WHEN NOT MATCHED BY SOURCE THEN DELETE."""
    customer = t.table("customer")
    target = customer.where("c_mktsegment <> 'BUILDING'").select(
        "c_custkey", F.lit(-1).cast("bigint").alias("nation"), F.lit("target").alias("origin"))
    source = customer.where("c_acctbal >= 0").select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), F.lit("source").alias("origin"))
    return L.scd1_merge(target, source, ["c_custkey"], on_missing="delete")


@query("scd2_expire_missing", "M7 M8", f"""
    SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, TIMESTAMP '{FIRST_LOAD}' AS valid_from,
           CASE WHEN c_acctbal < 0 THEN TIMESTAMP '{LOAD_TIME}' END AS valid_to, c_acctbal >= 0 AS is_current
    FROM customer""")
def scd2_expire_missing(t: Staging) -> DataFrame:
    """A key the source no longer has is closed."""
    base = t.table("customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"), "c_acctbal")
    target = base.select("c_custkey", "nation", ntz(FIRST_LOAD).alias("valid_from"),
                         F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    return L.scd2_merge(target, base.where("c_acctbal >= 0").drop("c_acctbal"), ["c_custkey"], {"nation": "null_safe"},
                        ntz(LOAD_TIME), on_missing="expire")


@query("merge_insert_only", "M6", """
    SELECT c_custkey, 'known' AS origin FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def merge_insert_only(t: Staging) -> DataFrame:
    customer = t.table("customer")
    known = customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("known").alias("origin"))
    return L.insert_only_merge(known, customer.select("c_custkey", F.lit("new").alias("origin")), ["c_custkey"])


@query("snapshot_timestamp", "M14", f"""
    SELECT c_custkey, 'old' AS segment, TIMESTAMP '2011-06-01' AS updated_at, TIMESTAMP '2011-06-01' AS valid_from,
           CASE WHEN c_acctbal > 0 THEN TIMESTAMP '{LOAD_TIME}' END AS valid_to, c_acctbal <= 0 AS is_current FROM customer
    UNION ALL
    SELECT c_custkey, c_mktsegment, TIMESTAMP '{LOAD_TIME}', TIMESTAMP '{LOAD_TIME}', NULL, TRUE FROM customer WHERE c_acctbal > 0""")
def snapshot_timestamp(t: Staging) -> DataFrame:
    base = t.table("customer")
    first = ntz("2011-06-01 00:00:00")
    target = base.select("c_custkey", F.lit("old").alias("segment"), first.alias("updated_at"), first.alias("valid_from"),
                         F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    source = base.select("c_custkey", F.col("c_mktsegment").alias("segment"),
                         F.when(F.col("c_acctbal") > 0, ntz(LOAD_TIME)).otherwise(first).alias("updated_at"))
    return L.snapshot(target, source, ["c_custkey"], "timestamp", updated_at="updated_at")


@query("snapshot_check", "M14", f"""
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'old' ELSE c_mktsegment END AS segment, TIMESTAMP '{FIRST_LOAD}' AS valid_from,
           CASE WHEN c_acctbal > 0 THEN TIMESTAMP '{LOAD_TIME}' END AS valid_to, c_acctbal <= 0 AS is_current FROM customer
    UNION ALL
    SELECT c_custkey, c_mktsegment, TIMESTAMP '{LOAD_TIME}', NULL, TRUE FROM customer WHERE c_acctbal > 0""")
def snapshot_check(t: Staging) -> DataFrame:
    base = t.table("customer")
    target = base.select("c_custkey", F.when(F.col("c_acctbal") > 0, "old").otherwise(F.col("c_mktsegment")).alias("segment"),
                         ntz(FIRST_LOAD).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
                         F.lit(True).alias("is_current"))
    return L.snapshot(target, base.select("c_custkey", F.col("c_mktsegment").alias("segment")), ["c_custkey"], "check",
                      check_cols="all", now=ntz(LOAD_TIME))


# ---- incremental strategies over orders: what is loaded, what arrives ---------
def _orders(t: Staging) -> DataFrame:
    return t.table("orders", ["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"])


def _loaded(t: Staging) -> DataFrame:
    return _orders(t).where("o_orderdate < '1999-01-01'").withColumn("o_orderstatus", F.lit("L"))


STRATEGY_SQL = """
    SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'L' ELSE o_orderstatus END
           AS o_orderstatus, o_totalprice FROM orders"""


@query("strategy_microbatch", "M15 X1", STRATEGY_SQL)
def strategy_microbatch(t: Staging) -> DataFrame:
    arriving = _orders(t).where("o_orderdate >= '1998-01-01'")
    return L.incremental(_loaded(t), arriving, "microbatch", keys=["o_orderkey"], watermark="o_orderdate")


@query("strategy_merge", "M15", STRATEGY_SQL)
def strategy_merge(t: Staging) -> DataFrame:
    return L.incremental(_loaded(t), _orders(t).where("o_orderdate >= '1998-01-01'"), "merge", keys=["o_orderkey"])


@query("strategy_delete_insert", "M15", STRATEGY_SQL)
def strategy_delete_insert(t: Staging) -> DataFrame:
    return L.incremental(_loaded(t), _orders(t).where("o_orderdate >= '1998-01-01'"), "delete+insert", keys=["o_orderkey"])


@query("strategy_append", "M2 M15", """
    SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'L' ELSE o_orderstatus END
           AS o_orderstatus, o_totalprice FROM orders""")
def strategy_append(t: Staging) -> DataFrame:
    """Appends what lies past the highest loaded watermark."""
    loaded = _loaded(t)
    return L.incremental(loaded, L.after_watermark(_orders(t), loaded, "o_orderdate"), "append")


@query("strategy_insert_overwrite", "M12 M15", """
    SELECT o_orderkey, o_orderdate, CASE WHEN year(o_orderdate) < 1998 THEN 'L' ELSE o_orderstatus END AS o_orderstatus,
           o_totalprice, CAST(year(o_orderdate) AS BIGINT) AS load_year FROM orders""")
def strategy_insert_overwrite(t: Staging) -> DataFrame:
    by_year = [df.withColumn("load_year", F.year("o_orderdate")) for df in (_loaded(t), _orders(t))]
    return L.incremental(by_year[0], by_year[1].where("load_year >= 1998"), "insert_overwrite", partition="load_year")


@query("strategy_choice", "M16", """
    SELECT * FROM (VALUES ('snapshot', 'merge', (SELECT COUNT(*) FROM customer)),
                          ('incremental', 'microbatch', (SELECT COUNT(*) FROM orders)),
                          ('table', 'none', (SELECT COUNT(*) FROM part))) v(materialization, strategy, row_count)""")
def strategy_choice(t: Staging) -> DataFrame:
    """The materialization and strategy for three table profiles, beside the rows they would govern."""
    parts = []
    for table, kind, mark, mark_type in (("customer", "dim_scd2", None, "bigint"), ("orders", "fact_transaction", "o_orderdate", None),
                                         ("part", "dim_non_scd", None, None)):
        df = t.table(table)
        mark_type = df.schema[mark].dataType.simpleString() if mark else mark_type
        strategy = L.choose_strategy(mark_type) if mark_type else "none"
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(L.choose_materialization(kind, mark)).alias("materialization"), F.lit(strategy).alias("strategy"), "row_count"))
    return reduce(DataFrame.unionByName, parts)


@query("apply_changes_feed", "X6 M5", """
    WITH feed AS (SELECT user_id, event_id, event_type, value FROM events),
    last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM feed) x WHERE rn = 1)
    SELECT COALESCE(l.user_id, c.user_id) AS user_id, CASE WHEN l.user_id IS NOT NULL THEN l.value ELSE c.value END AS value
    FROM (SELECT c_custkey AS user_id, -1.0::DOUBLE AS value FROM customer) c FULL JOIN last l ON l.user_id = c.user_id
    WHERE COALESCE(l.event_type, '') <> 'error'""")
def apply_changes_feed(t: Staging) -> DataFrame:
    """The last event per user wins; an error event deletes."""
    feed = t.table("events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
                                    "value")
    target = t.table("customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1.0).alias("value"))
    return L.apply_changes(target, feed, ["user_id"], "event_id", "op")


@query("surrogate_keys", "M19 W1", """
    SELECT c_custkey AS customer_id, 5000 + ROW_NUMBER() OVER (ORDER BY c_custkey) AS customer_key FROM customer""")
def surrogate_keys(t: Staging) -> DataFrame:
    return L.assign_surrogate_keys(t.table("customer").select(F.col("c_custkey").alias("customer_id")), "customer_key",
                                   ["customer_id"], 5000)


@query("unknown_members", "M18", """
    SELECT o.o_orderkey, COALESCE(d.customer_key, -1) AS customer_key FROM orders o
    LEFT JOIN (SELECT * FROM dim_customer WHERE territory_id IS NOT NULL) d ON d.customer_id = o.o_custkey""")
def unknown_members(t: Staging) -> DataFrame:
    """Orders whose customer has no row in the dimension point at the unknown member."""
    dim = L.with_unknown_members(t.dim_customer.where("territory_id IS NOT NULL"), "customer_key", "full_name")
    return L.resolve_key(t.table("orders", ["o_orderkey", "o_custkey"]), dim.where("is_current"),
                         {"o_custkey": "customer_id"}, "customer_key").select("o_orderkey", "customer_key")


# ---- builders ---------------------------------------------------------------
DATE_COLS = """CAST(date_key AS BIGINT) AS date_key, date_day, CAST(day_of_week AS BIGINT) AS day_of_week, day_of_week_name,
    CAST(day_of_month AS BIGINT) AS day_of_month, CAST(day_of_year AS BIGINT) AS day_of_year,
    CAST(week_of_year AS BIGINT) AS week_of_year, CAST(month_number AS BIGINT) AS month_number, month_name,
    CAST(quarter_number AS BIGINT) AS quarter_number, CAST(year_number AS BIGINT) AS year_number, is_weekend"""


@query("date_dimension", "D1 S14", f"SELECT {DATE_COLS} FROM dim_date")
def date_dimension(t: Staging) -> DataFrame:
    return t.dim_date


@query("date_dimension_fiscal", "D2", f"""
    SELECT CAST(date_key AS BIGINT) AS date_key, CAST((month_number + 5) % 12 + 1 AS BIGINT) AS fiscal_period,
           CAST(((month_number + 5) % 12) // 3 + 1 AS BIGINT) AS fiscal_quarter,
           CAST(year_number + CASE WHEN month_number >= 7 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year,
           date_day = last_day(date_day) AS is_month_end,
           date_day IN (SELECT CAST(o_orderdate AS DATE) FROM orders GROUP BY 1 HAVING SUM(o_totalprice) > 2000000) AS is_holiday,
           date_diff('day', date_day, DATE '{NOW[:10]}') BETWEEN 0 AND 29 AS is_last_30_days,
           year_number = {NOW[:4]} AS is_current_year
    FROM dim_date""")
def date_dimension_fiscal(t: Staging) -> DataFrame:
    """Fiscal year from July; the busiest days play the holidays."""
    busy = t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date_day")).agg(
        F.sum("o_totalprice").alias("s")).where("s > 2000000").select("date_day")
    return D.with_fiscal(t.dim_date, 7, busy, ntz(NOW).cast("date")).select(
        "date_key", "fiscal_period", "fiscal_quarter", "fiscal_year", "is_month_end", "is_holiday", "is_last_30_days",
        "is_current_year")


@query("scd_by_attribute", "D3", f"""
    WITH b AS (SELECT c_custkey, 'first' AS origin, CASE WHEN c_acctbal > 5000 THEN 'old' ELSE c_name END AS name,
                      CASE WHEN c_nationkey < 10 THEN -1 ELSE CAST(c_nationkey AS BIGINT) END AS nation,
                      'X' AS segment, CAST(NULL AS VARCHAR) AS prior_segment,
                      TIMESTAMP '{FIRST_LOAD}' AS valid_from, c_nationkey < 10 AS changed
               FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT b.c_custkey, b.origin, c.c_name AS name, b.nation, c.c_mktsegment AS segment, 'X' AS prior_segment, valid_from,
           CASE WHEN changed THEN TIMESTAMP '{LOAD_TIME}' END AS valid_to, NOT changed AS is_current
    FROM b JOIN customer c USING (c_custkey)
    UNION ALL
    SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'first' ELSE 'second' END, c_name, CAST(c_nationkey AS BIGINT),
           c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'X' END, TIMESTAMP '{LOAD_TIME}', NULL, TRUE
    FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 10""")
def scd_by_attribute(t: Staging) -> DataFrame:
    """Types 0 (origin), 1 (name), 2 (nation) and 3 (segment) in one dimension."""
    c = t.table("customer")
    nation = F.col("c_nationkey").cast("bigint")
    before = c.where("c_mktsegment <> 'BUILDING'").select(
        "c_custkey", F.lit("first").alias("origin"),
        F.when(F.col("c_acctbal") > 5000, "old").otherwise(F.col("c_name")).alias("name"),
        F.when(nation < 10, F.lit(-1).cast("bigint")).otherwise(nation).alias("nation"), F.lit("X").alias("segment"),
        F.lit(None).cast("string").alias("prior_segment"), ntz(FIRST_LOAD).alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    source = c.select("c_custkey", F.lit("second").alias("origin"), F.col("c_name").alias("name"), nation.alias("nation"),
                      F.col("c_mktsegment").alias("segment"))
    return D.apply_scd(before, source, ["c_custkey"], {"origin": 0, "name": 1, "nation": 2, "segment": 3}, ntz(LOAD_TIME))


FLAG_SQL = """SELECT o_orderkey, o_orderkey % 2 = 0 AS is_online, o_orderkey % 5 = 0 AS is_rush,
    o_totalprice > 200000 AS is_large, o_orderstatus IN ('O', 'P') AS is_open FROM orders"""
FLAGS = ["is_online", "is_rush", "is_large", "is_open"]


def order_flags(t: Staging) -> DataFrame:
    header = t.table("orders")
    key = F.col("o_orderkey")
    return header.select(
        "o_orderkey", (F.pmod(key, F.lit(2)) == 0).alias("is_online"), (F.pmod(key, F.lit(5)) == 0).alias("is_rush"),
        (F.col("o_totalprice") > 200000).alias("is_large"), F.col("o_orderstatus").isin("O", "P").alias("is_open"))


_FLAG_KEY = "md5(" + " || ".join(f"coalesce(length({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in FLAGS) + ")"


@query("junk_dimension", "D4 N24 A5", f"SELECT DISTINCT {_FLAG_KEY} AS flag_key, {', '.join(FLAGS)} FROM ({FLAG_SQL}) f")
def junk_dimension(t: Staging) -> DataFrame:
    return D.junk_dim(order_flags(t), FLAGS)


@query("junk_dimension_all", "D4 J5", f"""
    SELECT {_FLAG_KEY} AS flag_key, * FROM (SELECT DISTINCT is_online FROM ({FLAG_SQL}) f) a
    CROSS JOIN (SELECT DISTINCT is_rush FROM ({FLAG_SQL}) f) b CROSS JOIN (SELECT DISTINCT is_large FROM ({FLAG_SQL}) f) c
    CROSS JOIN (SELECT DISTINCT is_open FROM ({FLAG_SQL}) f) d""")
def junk_dimension_all(t: Staging) -> DataFrame:
    return D.junk_dim(order_flags(t), FLAGS, "cross")


@query("junk_dimension_fact", "D4", f"""
    SELECT {_FLAG_KEY} AS flag_key, COUNT(*) AS orders FROM ({FLAG_SQL}) f GROUP BY 1""")
def junk_dimension_fact(t: Staging) -> DataFrame:
    """Facts carry the flag key without a lookup."""
    return order_flags(t).groupBy(D.junk_key(FLAGS).alias("flag_key")).agg(F.count(F.lit(1)).alias("orders"))


@query("bridge_weighted_sum", "D6", """
    WITH pairs AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
    w AS (SELECT l_orderkey, 1.0::DOUBLE / COUNT(*) AS weight FROM pairs GROUP BY 1)
    SELECT p.l_suppkey, round(SUM(o.o_totalprice * w.weight), 2) AS revenue
    FROM orders o JOIN pairs p ON p.l_orderkey = o.o_orderkey JOIN w ON w.l_orderkey = o.o_orderkey GROUP BY 1""")
def bridge_weighted_sum(t: Staging) -> DataFrame:
    """Order totals shared among the suppliers of each order."""
    groups, members = D.bridge(t.table("lineitem", ["l_orderkey", "l_suppkey"]), "l_orderkey", "l_suppkey")
    fact = t.table("orders", ["o_orderkey", "o_totalprice"]).join(
        groups.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return D.weighted_sum(fact, members, "l_suppkey", "o_totalprice", "revenue").withColumn("revenue", F.round("revenue", 2))


@query("bridge_groups", "D6", """
    SELECT n AS members, COUNT(*) AS groups, CAST(SUM(entities) AS BIGINT) AS entities
    FROM (SELECT members, len(members) AS n, COUNT(*) AS entities
          FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS members FROM lineitem GROUP BY 1) a GROUP BY 1) b
    GROUP BY 1""")
def bridge_groups(t: Staging) -> DataFrame:
    groups, members = D.bridge(t.table("lineitem", ["l_orderkey", "l_suppkey"]), "l_orderkey", "l_suppkey")
    sizes = members.groupBy("group_key").agg(F.count(F.lit(1)).alias("members"))
    used = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("entities"))
    return sizes.join(used, "group_key").groupBy("members").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("entities").alias("entities"))


_BANDS = """CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance_band,
            CASE WHEN c_nationkey < 10 THEN 'near' ELSE 'far' END AS distance_band"""


@query("minidimension", "D7", f"""
    SELECT balance_band, distance_band, COUNT(*) AS customers FROM (SELECT {_BANDS} FROM customer) b GROUP BY ALL""")
def minidimension(t: Staging) -> DataFrame:
    keyed, mini = D.minidimension(t.table("customer"), {
        "balance_band": D.band("c_acctbal", [0, 5000], ["negative", "low", "high"]),
        "distance_band": D.band("c_nationkey", [10], ["near", "far"])})
    return keyed.groupBy("mini_key").agg(F.count(F.lit(1)).alias("customers")).join(mini, "mini_key").select(
        "balance_band", "distance_band", "customers")


@query("coverage_gaps", "D9", """
    SELECT CAST(n.n_nationkey AS BIGINT) AS n_nationkey, s.segment FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s
    WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.segment
                      AND c.c_acctbal > 9000)""")
def coverage_gaps(t: Staging) -> DataFrame:
    """Nation and segment pairs without a rich customer."""
    customer = t.table("customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return D.coverage_gaps([t.table("nation").select("n_nationkey"), customer.select("segment")],
                           customer.where("c_acctbal > 9000"), ["n_nationkey", "segment"])


_DAILY = """SELECT o_custkey % 10 + 1 AS territory_id, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
    SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS revenue FROM orders GROUP BY 1, 2"""


def _daily(t: Staging) -> DataFrame:
    return t.table("orders").groupBy((F.pmod("o_custkey", F.lit(10)) + 1).alias("territory_id"),
                                     date_key("o_orderdate").alias("date_key")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("revenue"))


@query("dense_snapshot_zero", "D10 J5", f"""
    WITH d AS ({_DAILY})
    SELECT e.territory_id, CAST(s.date_key AS BIGINT) AS date_key, CAST(COALESCE(d.revenue, 0) AS DOUBLE) AS revenue
    FROM (SELECT DISTINCT territory_id FROM d) e CROSS JOIN dim_date s
    LEFT JOIN d ON d.territory_id = e.territory_id AND d.date_key = s.date_key""")
def dense_snapshot_zero(t: Staging) -> DataFrame:
    daily = _daily(t)
    return D.densify(daily, t.dim_date, daily, "territory_id", "date_key", ["revenue"])


@query("dense_snapshot_carry", "D10", f"""
    WITH d AS ({_DAILY})
    SELECT territory_id, CAST(date_key AS BIGINT) AS date_key,
           CAST(last_value(revenue IGNORE NULLS) OVER (PARTITION BY territory_id ORDER BY date_key) AS DOUBLE) AS revenue
    FROM (SELECT e.territory_id, s.date_key, d.revenue FROM (SELECT DISTINCT territory_id FROM d) e CROSS JOIN dim_date s
          LEFT JOIN d ON d.territory_id = e.territory_id AND d.date_key = s.date_key) g""")
def dense_snapshot_carry(t: Staging) -> DataFrame:
    daily = _daily(t)
    return D.densify(daily, t.dim_date, daily, "territory_id", "date_key", ["revenue"], "carry")


@query("aggregate_fact", "D11", """
    WITH m AS (SELECT user_id, event_type, CAST(date_trunc('month', ts) AS DATE) AS month, ts, event_id,
                      CAST(value AS DECIMAL(18,4)) AS value FROM events),
    last AS (SELECT event_type, month, SUM(value) AS level FROM (
               SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type, month, user_id ORDER BY ts DESC) AS rn FROM m) x
             WHERE rn = 1 GROUP BY ALL)
    SELECT m.event_type, m.month, CAST(SUM(value) AS DOUBLE) AS flow, CAST(any_value(last.level) AS DOUBLE) AS level,
           CAST(SUM(value) AS DOUBLE) AS ratio_sum, COUNT(value) AS ratio_count
    FROM m JOIN last ON last.event_type = m.event_type AND last.month = m.month GROUP BY ALL""")
def aggregate_fact(t: Staging) -> DataFrame:
    value = F.col("value").cast("decimal(18,4)")
    events = t.table("events").select("user_id", "event_type", F.trunc("ts", "month").alias("month"), "ts",
                                      value.alias("flow"), value.alias("level"), value.alias("ratio"))
    return D.aggregate_fact(events, ["event_type", "month"],
                            {"flow": "additive", "level": "semi_additive", "ratio": "non_additive"},
                            period="ts", entity=["user_id"])


@query("split_by_type", "D12", """
    SELECT 'core' AS part, p_partkey, CAST(NULL AS BIGINT) AS attribute FROM part
    UNION ALL SELECT 'PROMO', p_partkey, CAST(p_size AS BIGINT) FROM part WHERE p_type = 'PROMO'
    UNION ALL SELECT 'LARGE', p_partkey, CAST(p_size AS BIGINT) FROM part WHERE p_type = 'LARGE'""")
def split_by_type(t: Staging) -> DataFrame:
    core, ext = D.split_by_type(t.table("part"), "p_type", "p_partkey", ["p_name"], {"PROMO": ["p_size"], "LARGE": ["p_size"]})
    parts = [core.select(F.lit("core").alias("part"), "p_partkey", F.lit(None).cast("bigint").alias("attribute"))]
    parts += [df.select(F.lit(k).alias("part"), "p_partkey", F.col("p_size").cast("bigint").alias("attribute")) for k, df in ext.items()]
    return reduce(DataFrame.unionByName, parts)


@query("null_density", "D12 F4", """
    SELECT product_line, "column", null_share, null_share >= 0.5 AS type_specific FROM (
        SELECT product_line, 'color' AS "column", CAST(COUNT(*) FILTER (color IS NULL) AS DOUBLE) / COUNT(*) AS null_share
        FROM stg_product GROUP BY 1
        UNION ALL SELECT product_line, 'sell_end_date', CAST(COUNT(*) FILTER (sell_end_date IS NULL) AS DOUBLE) / COUNT(*)
        FROM stg_product GROUP BY 1) x""")
def null_density(t: Staging) -> DataFrame:
    return D.null_density(t.stg_product, ["color", "sell_end_date"], "product_line")


@query("conformance", "D13", """
    WITH j AS (SELECT a.address_id AS ka, b.address_id AS kb, a.city AS ca, b.city AS cb, a.postal_code AS pa, b.postal_code AS pb
               FROM dim_address a FULL JOIN stg_address b ON a.address_id = b.address_id),
    n AS (SELECT COUNT(*) FILTER (kb IS NULL) AS only_a, COUNT(*) FILTER (ka IS NULL) AS only_b,
                 COUNT(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL) AS shared,
                 COUNT(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND ca IS DISTINCT FROM cb) AS city,
                 COUNT(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND pa IS DISTINCT FROM pb) AS postal FROM j)
    SELECT only_a, only_b, shared, attribute, mismatches, mismatches = 0 AND (only_a = 0 OR only_b = 0) AS conformed
    FROM (SELECT *, 'city' AS attribute, city AS mismatches FROM n UNION ALL SELECT *, 'postal_code', postal FROM n) x""")
def conformance(t: Staging) -> DataFrame:
    return D.conformance(t.dim_address, t.stg_address, "address_id", ["city", "postal_code"])


@query("drill_across", "D14", """
    SELECT COALESCE(a.nation, b.nation) AS nation, a.customers, b.suppliers, CAST(b.balance AS DOUBLE) AS balance
    FROM (SELECT CAST(c_nationkey AS BIGINT) AS nation, COUNT(*) AS customers FROM customer GROUP BY 1) a
    FULL JOIN (SELECT CAST(s_nationkey AS BIGINT) AS nation, COUNT(*) AS suppliers,
                      SUM(CAST(s_acctbal AS DECIMAL(18,4))) AS balance FROM supplier GROUP BY 1) b ON a.nation = b.nation""")
def drill_across(t: Staging) -> DataFrame:
    return D.drill_across({
        "customer": (t.table("customer").withColumnRenamed("c_nationkey", "nation"), {"customers": F.count(F.lit(1))}),
        "supplier": (t.table("supplier").withColumnRenamed("s_nationkey", "nation"),
                     {"suppliers": F.count(F.lit(1)), "balance": F.sum(F.col("s_acctbal").cast("decimal(18,4)"))}),
    }, ["nation"])


@query("bus_matrix", "D15 F6", """
    WITH l(fact, dimension, k) AS (
        SELECT 'sales', 'customer', o_custkey FROM orders UNION SELECT 'sales', 'part', o_custkey FROM orders
        UNION SELECT 'lines', 'part', l_partkey FROM lineitem UNION SELECT 'lines', 'supplier', l_suppkey FROM lineitem),
    d(dimension, k) AS (SELECT 'customer', c_custkey FROM customer UNION SELECT 'part', p_partkey FROM part
                        UNION SELECT 'supplier', s_suppkey FROM supplier)
    SELECT fact, l.dimension, COUNT(*) AS fact_keys, COUNT(d.k) AS found, COUNT(*) = COUNT(d.k) AS uses
    FROM l LEFT JOIN d ON d.dimension = l.dimension AND d.k = l.k GROUP BY ALL""")
def bus_matrix(t: Staging) -> DataFrame:
    return D.bus_matrix(
        {"sales": t.table("orders"), "lines": t.table("lineitem")},
        {"customer": (t.table("customer"), "c_custkey"), "part": (t.table("part"), "p_partkey"),
         "supplier": (t.table("supplier"), "s_suppkey")},
        {"sales": {"customer": "o_custkey", "part": "o_custkey"}, "lines": {"part": "l_partkey", "supplier": "l_suppkey"}})


@query("grain_check", "D16", """
    SELECT CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) AS keys, COUNT(*) FILTER (n > 1) AS repeated_keys,
           CAST(0 AS BIGINT) AS rows_with_null_key, COUNT(*) FILTER (n > 1) = 0 AS grain_holds
    FROM (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL) x""")
def grain_check(t: Staging) -> DataFrame:
    return D.check_grain(t.table("lineitem"), ["l_orderkey", "l_linenumber"])
