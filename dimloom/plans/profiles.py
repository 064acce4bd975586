"""Profiling queries: what the catalog would say, found in the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimloom.operators import profiling as P
from dimloom.operators.keys import find_composite_foreign_keys as composite_foreign_keys
from dimloom.operators.keys import find_keys as find_all_keys
from dimloom.operators.sketches import ProfileLog
from dimloom.plans.catalog import query
from dimloom.plans.dims import contacts, customer_before
from dimloom.plans.facts import customer_history
from dimloom.plans.staging import TABLES, Staging, ntz
from dimloom.session import scratch_path

CUSTOMER_COLUMNS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, '{kind}' AS type, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS distinct_values,
           CAST(MIN({c}) AS VARCHAR) AS least, CAST(MAX({c}) AS VARCHAR) AS greatest,
           CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) AS null_share, COUNT(DISTINCT {c}) BETWEEN 2 AND 5 AS flag_like
    FROM {table}""" for c, kind in columns)


@query("profile_columns", "F4", _profile_sql("customer", CUSTOMER_COLUMNS))
def profile_columns(t: Staging) -> DataFrame:
    return P.profile_columns(t.table("customer"))


@query("profile_columns_nulls", "F4", _profile_sql("stg_product", [
    ("product_id", "bigint"), ("color", "string"), ("product_line", "string"), ("sell_end_date", "timestamp_ntz")]))
def profile_columns_nulls(t: Staging) -> DataFrame:
    return P.profile_columns(t.stg_product.select("product_id", "color", "product_line", "sell_end_date"))


_ARRIVING = {"l_orderkey": True, "l_linenumber": True, "l_extendedprice": True, "l_returnflag": False}


@query("profile_by_arrival", "F4", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, {f'CAST(MIN({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS least,
           {f'CAST(MAX({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS greatest, TRUE AS distinct_close, TRUE AS quantiles_close FROM lineitem"""
                                               for c, number in _ARRIVING.items()))
def profile_by_arrival(t: Staging) -> DataFrame:
    """Four columns of the lines, recorded in a batch per year of shipping and merged: distinct counts within 8 % and quantiles within 3 % of their rank."""
    names = list(_ARRIVING)
    lines = t.table("lineitem")
    log = ProfileLog(t.spark, scratch_path(t.spark, "profile"))
    years = [r[0] for r in lines.select(F.year("l_shipdate").alias("y")).distinct().collect()]  # a handful of years
    for n, year in enumerate(sorted(years, key=str)):
        log.record(lines.where(F.year("l_shipdate").eqNullSafe(F.lit(year))).select(*names), n)
    exact = P.distinct_counts(lines.select(*names)).withColumnRenamed("distinct_values", "exact")
    merged = log.read().join(F.broadcast(exact), "column_name")
    middle = {r.column_name: r.quantiles[1] for r in merged.select("column_name", "quantiles").collect() if r.quantiles}
    # The share of rows up to the median that the sketch gives, and below it.
    ranks = lines.agg(*[F.struct((F.count_if(F.col(c) < v) / F.count(c)).alias("below"), (F.count_if(F.col(c) <= v) / F.count(c)).alias("upto")).alias(c)
                        for c, v in middle.items()])
    tested = ranks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), ((F.col(c)["below"] <= 0.53) & (F.col(c)["upto"] >= 0.47)).alias("near"))
                                             for c in middle])))
    number = lambda c: F.when(F.col("type") != "string", F.col(c)).cast("double").alias(c)
    return merged.join(F.broadcast(tested), "column_name", "left").select(
        "column_name", "rows", "nulls", number("least"), number("greatest"),
        (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.08 * F.col("exact")).alias("distinct_close"),
        F.coalesce("near", F.lit(True)).alias("quantiles_close"))


def _keys_sql(table: str) -> str:
    """Every set of the table's columns but the floating-point ones: unique, complete, and without a smaller set that is."""
    names = [c.split()[0] for c in TABLES[table].split(", ") if not c.endswith(" double")]
    sets = [[(i, c) for i, c in enumerate(names) if mask >> i & 1] for mask in range(1, 1 << len(names))]
    tests = " UNION ALL ".join(f"""SELECT {sum(1 << i for i, _ in s)} AS mask, '{"+".join(c for _, c in s)}' AS key, {len(s)} AS columns, COUNT(*) AS rows,
        COUNT(*) = COUNT(DISTINCT ({", ".join(c for _, c in s)},)) AND {" AND ".join(f"COUNT(*) = COUNT({c})" for _, c in s)} AS fits FROM {table}""" for s in sets)
    return f"""WITH tested AS ({tests}) SELECT key, CAST(columns AS BIGINT) AS columns, rows FROM tested t WHERE fits AND NOT EXISTS (
        SELECT 1 FROM tested u WHERE u.fits AND u.mask <> t.mask AND u.mask & t.mask = u.mask)"""


@query("find_keys", "F2", _keys_sql("orders"))
def find_keys(t: Staging) -> DataFrame:
    return find_all_keys(t.table("orders"))


@query("find_composite_keys", "F2", _keys_sql("conversations"))
def find_composite_keys(t: Staging) -> DataFrame:
    return find_all_keys(t.table("conversations"))


@query("find_line_keys", "F2", _keys_sql("lineitem"))
def find_line_keys(t: Staging) -> DataFrame:
    """Order and line number, and whatever else happens to be unique."""
    return find_all_keys(t.table("lineitem"))


@query("key_kinds", "F3", """
    SELECT 'customer_key' AS column_name, TRUE AS is_integer, MAX(c_custkey) - MIN(c_custkey) + 1 = COUNT(*) AS is_dense,
           CAST(2 + CAST(MAX(c_custkey) - MIN(c_custkey) + 1 = COUNT(*) AS INT) AS BIGINT) AS score, 'surrogate' AS kind FROM customer
    UNION ALL SELECT 'account_number', FALSE, FALSE, -1, 'natural'""")
def key_kinds(t: Staging) -> DataFrame:
    dim = t.dim_customer.select("customer_key", F.concat(F.lit("AW"), F.col("customer_id").cast("string")).alias("account_number"))
    return P.key_kind(dim, "customer_key").unionByName(P.key_kind(dim, "account_number"))


@query("find_watermark", "F5", """
    SELECT 'o_orderdate' AS column_name, 'timestamp_ntz' AS type, COUNT(*) = COUNT(o_orderdate) AS complete, TRUE AS name_match,
           CAST(4 AS BIGINT) AS score FROM orders""")
def find_watermark(t: Staging) -> DataFrame:
    return P.find_watermark(t.table("orders")).drop("distinct_values")


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
TRIED = [*KEYS, "lineitem"]


def _foreign_keys_sql() -> str:
    """Every integer column of every table against every key of its type."""
    def columns(table: str) -> dict[str, str]:
        return dict(c.split() for c in TABLES[table].split(", "))

    tests = [f"""SELECT '{child}' AS child, '{c}' AS column_name, '{parent}' AS parent, '{key}' AS key, COUNT(DISTINCT {c}) AS "values",
                        COUNT(DISTINCT CASE WHEN {c} IN (SELECT {key} FROM {parent}) THEN {c} END) AS found,
                        {str(c.split("_", 1)[1] == key.split("_", 1)[1])} AS name_match FROM {child}"""
             for child in TRIED for c, kind in columns(child).items() for parent, key in KEYS.items()
             if kind == columns(parent)[key] and (child, c) != (parent, key)]
    return f"""SELECT *, CAST(found AS DOUBLE) / "values" AS coverage FROM ({" UNION ALL ".join(tests)}) x WHERE found > 0 AND found = "values\""""


@query("find_foreign_keys", "F6", _foreign_keys_sql())
def find_foreign_keys(t: Staging) -> DataFrame:
    """Whole tables, all columns. Inclusion alone also finds small keys inside larger ones; the name tells them apart."""
    return P.find_foreign_keys({name: t.table(name) for name in TRIED}, KEYS)


def _composite_sql() -> str:
    """Every ordered pair of columns of the returned lines and of the orders against the key of the lines."""
    kinds = {"returned": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "orders": ["o_orderkey", "o_custkey"]}
    numbers = {"l_linenumber"}
    tests = [f"""SELECT '{child}' AS child, '{a}+{b}' AS columns, COUNT(*) AS n, COUNT(*) FILTER (WHERE EXISTS (
        SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.{a} AND l.l_linenumber = c.{b})) AS k FROM {source} c"""
             for child, source in (("returned", "(SELECT * FROM lineitem WHERE l_returnflag = 'R')"), ("orders", "orders"))
             for a in kinds[child] for b in kinds[child] if a != b and a not in numbers and b in numbers]
    return f"""SELECT child, columns, 'lineitem' AS parent, 'l_orderkey+l_linenumber' AS key FROM ({" UNION ALL ".join(tests)}) x WHERE n = k AND n > 0"""


@query("find_composite_foreign_keys", "F6", _composite_sql())
def find_composite_foreign_keys(t: Staging) -> DataFrame:
    lines = t.table("lineitem")
    return composite_foreign_keys({"returned": lines.where("l_returnflag = 'R'"), "orders": t.table("orders"), "lineitem": lines},
                                  {"lineitem": ["l_orderkey", "l_linenumber"]})


@query("foreign_key_types", "F7", """
    SELECT 'nation' AS parent, fk AS column_name, CASE WHEN fk = 'home' OR fk = 'work' THEN 'role_playing' ELSE 'standard' END AS fk_type,
           child FROM (VALUES ('home', 'people'), ('work', 'people'), ('s_nationkey', 'supplier')) v(fk, child)
    WHERE (SELECT COUNT(*) FROM customer) > 0""")
def foreign_key_types(t: Staging) -> DataFrame:
    people = t.table("customer").select(F.col("c_nationkey").alias("home"), F.pmod(F.col("c_nationkey") + 7, F.lit(25)).alias("work"))
    found = P.find_foreign_keys(
        {"people": people, "supplier": t.table("supplier", ["s_nationkey"]), "nation": t.table("nation")}, {"nation": "n_nationkey"},
        {"nation": []})
    return P.foreign_key_types(found).select("parent", "column_name", "fk_type", "child")


@query("find_degenerate", "F8 D8", """
    SELECT 'l_orderkey' AS column_name, COUNT(DISTINCT l_orderkey) AS distinct_values, COUNT(*) AS rows,
           COUNT(DISTINCT l_orderkey) >= 0.05 * COUNT(*) AND COUNT(DISTINCT l_orderkey) < COUNT(*) AS degenerate FROM lineitem
    UNION ALL SELECT 'l_linenumber', COUNT(DISTINCT l_linenumber), COUNT(*),
           COUNT(DISTINCT l_linenumber) >= 0.05 * COUNT(*) AND COUNT(DISTINCT l_linenumber) < COUNT(*) FROM lineitem""")
def find_degenerate(t: Staging) -> DataFrame:
    return P.find_degenerate(t.table("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_partkey"])


@query("find_pii", "F9", """
    SELECT column_name, by_name, by_value, 'mask' AS suggested_action FROM (VALUES
        ('first_name', 'first_name', NULL), ('last_name', 'last_name', NULL), ('email_address', 'email', 'email'),
        ('phone_number', 'phone', 'phone'), ('social_security_number', 'social_security', 'ssn'), ('birth_date', 'birth_date', NULL),
        ('street_address', 'address', NULL), ('postal_code', 'postal_code', NULL)) v(column_name, by_name, by_value)
    WHERE (SELECT COUNT(*) FROM customer) > 0""")
def find_pii(t: Staging) -> DataFrame:
    return P.find_pii(contacts(t))


@query("measure_additivity", "F10", """
    SELECT measure, by_name, semantics, additivity FROM (VALUES
        ('account_balance', 'balance', 'balance', 'semi_additive'), ('sales_amount', 'flow', 'flow', 'additive'),
        ('reading', NULL, 'balance', 'semi_additive')) v(measure, by_name, semantics, additivity)
    WHERE (SELECT COUNT(*) FROM events) > 0""")
def measure_additivity(t: Staging) -> DataFrame:
    """Two measures told by name and one, without a telling name, by how it moves."""
    rows = t.table("events").select(
        "user_id", "event_id", F.col("value").alias("account_balance"), F.col("value").alias("sales_amount"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("reading"))
    return P.measure_additivity(rows, ["account_balance", "sales_amount", "reading"], "user_id", "event_id").drop("autocorrelation")


@query("snapshot_density", "F11", """
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY ALL)
    SELECT CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) AS pairs, COUNT(DISTINCT user_id) AS entities, COUNT(DISTINCT day) AS periods,
           CAST(COUNT(*) AS DOUBLE) / (COUNT(DISTINCT user_id) * COUNT(DISTINCT day)) AS density,
           CASE WHEN CAST(COUNT(*) AS DOUBLE) / (COUNT(DISTINCT user_id) * COUNT(DISTINCT day)) > 0.8 AND SUM(n) = COUNT(*)
                THEN 'fact_periodic_snapshot' ELSE 'fact_transaction' END AS kind FROM d""")
def snapshot_density(t: Staging) -> DataFrame:
    return P.snapshot_density(t.table("events").select("user_id", F.col("ts").cast("date").alias("day")), "user_id", "day")


@query("scd2_health", "F12", """
    SELECT COUNT(*) + COUNT(territory_id) AS versions, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS inverted,
           CAST(0 AS BIGINT) AS flag_mismatch, COUNT(*) AS keys, COUNT(territory_id) AS versioned_keys, CAST(0 AS BIGINT) AS many_current,
           CAST(0 AS BIGINT) AS no_current, TRUE AS healthy FROM dim_customer""")
def scd2_health(t: Staging) -> DataFrame:
    return P.scd2_health(customer_history(t), ["customer_id"])


@query("scd2_health_broken", "F12", """
    SELECT 2 * COUNT(*) AS versions, COUNT(*) AS overlaps, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS inverted,
           CAST(0 AS BIGINT) AS flag_mismatch, COUNT(*) AS keys, COUNT(*) AS versioned_keys, COUNT(*) AS many_current,
           CAST(0 AS BIGINT) AS no_current, FALSE AS healthy FROM customer""")
def scd2_health_broken(t: Staging) -> DataFrame:
    """Two open versions per key."""
    late = t.dim_customer.withColumn("valid_from", ntz("2013-01-01 00:00:00"))
    return P.scd2_health(t.dim_customer.unionByName(late), ["customer_id"])


@query("table_kinds", "F1", """
    SELECT * FROM (VALUES ('customer_versions', 'dim_scd2', 'high'), ('flags', 'dim_junk', 'medium'), ('lines', 'fact_transaction', 'high'),
                          ('fulfilment', 'fact_accumulating_snapshot', 'medium'), ('inventory', 'fact_periodic_snapshot', 'high'),
                          ('summary', 'fact_aggregate', 'medium'), ('segments', 'dim_non_scd', 'medium'), ('employees', 'dim_scd1', 'medium'),
                          ('notes', 'unknown', 'low')) v(table_name, kind, confidence)
    WHERE (SELECT COUNT(*) FROM orders) > 0""")
def table_kinds(t: Staging) -> DataFrame:
    """One table of each kind, judged from its shape and its rows."""
    from dimloom.plans import dims, facts

    inventory = t.table("part").select(
        F.col("p_partkey").alias("product_id"), F.explode(F.expr("sequence(date'2001-07-01', date'2001-07-05')")).alias("snapshot_date"),
        F.col("p_size").alias("units_on_hand"))
    found = {
        "customer_versions": P.classify_table(customer_before(t), natural_key=["customer_id"]),
        "flags": P.classify_table(dims.junk_dimension(t).select("flag_key", *dims.FLAGS)),
        "lines": P.classify_table(facts.load_reseller_sales(t), foreign_keys=["product_key", "customer_key"]),
        "fulfilment": P.classify_table(facts.load_order_fulfillment(t), foreign_keys=["customer_key"]),
        "inventory": P.classify_table(inventory, entity="product_id", period="snapshot_date"),
        "summary": P.classify_table(t.fct_sales_by_channel, has_group_by=True),
        "segments": P.classify_table(t.table("customer", ["c_custkey", "c_name"]), natural_key=["c_custkey"]),
        "employees": P.classify_table(t.table("supplier").select(
            (F.col("s_suppkey") + 1).alias("employee_key"), F.col("s_suppkey").alias("employee_id"), "s_name"), natural_key=["employee_id"]),
        "notes": P.classify_table(t.table("documents", ["doc_id", "text"])),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "kind", "confidence") for name, df in found.items()])
