"""Reconciliation, quality, graph and input/output queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.functions import scalar as X
from dimloom.operators import compare as C
from dimloom.operators import hierarchy as H
from dimloom.operators import quality as Q
from dimloom.operators.digests import Snapshot, changed_rows
from dimloom.operators.loads import run_steps
from dimloom.operators.relational import with_scalar
from dimloom.plans.catalog import query
from dimloom.plans.dims import contacts
from dimloom.plans.staging import RETURN_REASONS, Staging, ntz
from dimloom.session import scratch_path
from dimloom.sources import tables as IO
from dimloom.sources.manifest import ManifestTable
from dimloom.sources.types import ColumnSpec, reject_counts, typed_ingest

# ---- reconciliation ----------------------------------------------------------------


@query("compare_equivalent", "C1 C2", """
    SELECT COUNT(*) AS a_count, COUNT(*) AS b_count, CAST(0 AS BIGINT) AS a_minus_b, CAST(0 AS BIGINT) AS b_minus_a, TRUE AS equivalent
    FROM customer""")
def compare_equivalent(t: Staging) -> DataFrame:
    """A correlated count and its join form give the same rows."""
    return C.compare_sql(
        t.spark,
        "SELECT c_custkey, (SELECT COUNT(*) FROM cmp_orders o WHERE o.o_custkey = c.c_custkey) AS n FROM cmp_customer c",
        """SELECT c_custkey, COALESCE(n, 0) AS n FROM cmp_customer c LEFT JOIN
           (SELECT o_custkey, COUNT(*) AS n FROM cmp_orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
        {"cmp_customer": t.table("customer"), "cmp_orders": t.table("orders")})


@query("compare_different", "C1 U5", """
    WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem), b AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
    SELECT (SELECT COUNT(*) FROM a) AS a_count, (SELECT COUNT(*) FROM b) AS b_count,
           (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x) AS a_minus_b,
           (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) x) AS b_minus_a, FALSE AS equivalent""")
def compare_different(t: Staging) -> DataFrame:
    """Copies count: a table and its distinct rows are not the same."""
    a = t.table("lineitem", ["l_orderkey", "l_linenumber"])
    return C.compare(a, a.distinct())


@query("multiset_difference", "U5 C1", """
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, COUNT(*) AS a_copies,
           CAST(1 AS BIGINT) AS b_copies FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1""")
def multiset_difference(t: Staging) -> DataFrame:
    a = t.table("lineitem", ["l_orderkey", "l_linenumber"])
    return C.multiset_diff(a, a.distinct())


@query("compare_scenarios", "C2", """
    SELECT 'all' AS scenario, COUNT(*) AS a_count, COUNT(DISTINCT p_brand) AS b_count, COUNT(*) - COUNT(DISTINCT p_brand) AS a_minus_b,
           CAST(0 AS BIGINT) AS b_minus_a, COUNT(*) = COUNT(DISTINCT p_brand) AS equivalent FROM part
    UNION ALL SELECT 'brands', COUNT(DISTINCT p_brand), COUNT(DISTINCT p_brand), 0, 0, TRUE FROM part""")
def compare_scenarios(t: Staging) -> DataFrame:
    part = t.table("part", ["p_brand"])
    return C.compare_scenarios(t.spark, "SELECT p_brand FROM cmp_part", "SELECT DISTINCT p_brand FROM cmp_part",
                               {"all": {"cmp_part": part}, "brands": {"cmp_part": part.distinct()}})


@query("normalized_rows", "C3", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate,
           COALESCE(ship, '__NULL__') AS ship, large FROM (
        SELECT o_orderkey, o_orderdate, CAST(CAST(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS DATE) AS VARCHAR) AS ship,
               CASE WHEN o_totalprice > 200000 THEN '1' ELSE '0' END AS large FROM orders) x""")
def normalized_rows(t: Staging) -> DataFrame:
    return C.normalize(t.table("orders").select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("SHIP"),
        (F.col("o_totalprice") > 200000).alias("large")))


@query("parity_report", "C4", """
    WITH pc AS (SELECT c_custkey, c_acctbal FROM customer),
    pp AS (SELECT p_partkey, p_size FROM part)
    SELECT 'customer' AS table_name, (SELECT COUNT(*) FROM pc) AS a_count, (SELECT COUNT(*) FROM pc) AS b_count,
           (SELECT COUNT(*) FROM pc WHERE c_acctbal < 0) AS only_a, (SELECT COUNT(*) FROM pc WHERE c_acctbal < 0) AS only_b,
           (SELECT COUNT(*) FROM pc WHERE c_acctbal < 0) = 0 AS ok
    UNION ALL SELECT 'part', (SELECT COUNT(*) FROM pp), (SELECT COUNT(*) FROM pp) * 2, 0, 0, TRUE""")
def parity_report(t: Staging) -> DataFrame:
    """Differences below the rounding are equal, copies are ignored, a changed value is not."""
    customer, part = t.table("customer", ["c_custkey", "c_acctbal"]), t.table("part", ["p_partkey", "p_size"])
    moved = F.when(F.col("c_acctbal") < 0, F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal") + 0.0001)
    return C.parity({"customer": customer, "part": part},
                    {"customer": customer.withColumn("c_acctbal", moved), "part": part.unionByName(part)})


@query("snapshot_difference", "C5", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' WHEN c_mktsegment = 'MACHINERY' THEN 'removed'
                           WHEN c_acctbal < 0 OR c_nationkey = 7 THEN 'changed' ELSE 'unchanged' END AS status FROM customer""")
def snapshot_difference(t: Staging) -> DataFrame:
    """Some rows get another nation, some the same segment in small letters."""
    customer = t.table("customer")
    old = customer.where("c_mktsegment <> 'BUILDING'")
    new = customer.where("c_mktsegment <> 'MACHINERY'").withColumn(
        "c_nationkey", F.when(F.col("c_acctbal") < 0, 99).otherwise(F.col("c_nationkey"))).withColumn(
        "c_mktsegment", F.when(F.col("c_nationkey") == 7, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return C.snapshot_diff(old, new, ["c_custkey"])


def _orders_before_and_after(t: Staging) -> tuple[DataFrame, DataFrame]:
    """The orders, and the orders after a day: the last day's are new, the first day's are gone, large urgent ones of one month have another price."""
    orders = t.table("orders")
    days = orders.agg(F.min("o_orderdate").alias("_first"), F.max("o_orderdate").alias("_last"))
    dated = with_scalar(orders, days)
    moved = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000) & (F.month("o_orderdate") == 5)
    price = F.when(moved, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice")
    return (dated.where("o_orderdate < _last").select(*orders.columns),
            dated.where("o_orderdate > _first").select(*[price if c == "o_totalprice" else c for c in orders.columns]))


@query("snapshot_changes_by_digest", "C5", """
    WITH days AS (SELECT MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day FROM orders),
    marked AS (SELECT o_orderkey, o_orderdate < last_day AS before, o_orderdate > first_day AS after,
                      o_orderpriority = '1-URGENT' AND o_totalprice > 400000 AND EXTRACT(month FROM o_orderdate) = 5 AS moved FROM orders, days)
    SELECT o_orderkey, CASE WHEN NOT before THEN 'new' WHEN NOT after THEN 'removed' ELSE 'changed' END AS status
    FROM marked WHERE before <> after OR (before AND moved)""")
def snapshot_changes_by_digest(t: Staging) -> DataFrame:
    """Two stored snapshots of the orders: only buckets whose digests differ are read."""
    old, new = [Snapshot(t.spark, scratch_path(t.spark, "snapshot")).write(df, ["o_orderkey"], 8) for df in _orders_before_and_after(t)]
    return changed_rows(old, new)


@query("row_fingerprints", "C6", r"""
    SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) || chr(31) || lower(trim(lang))) AS fingerprint
    FROM documents""")
def row_fingerprints(t: Staging) -> DataFrame:
    """White space and case do not change a row's fingerprint. Whole texts are hashed."""
    return t.table("documents").select("doc_id", X.row_hash(["text", "lang"]).alias("fingerprint"))


# ---- quality -------------------------------------------------------------------------
CONTRACTS = {
    "orders": Q.TableContract(["o_orderkey", "o_custkey"], [["o_orderkey"]], {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": Q.TableContract(["l_orderkey"], [["l_orderkey", "l_linenumber"]],
                                {"l_partkey": ("part", "p_partkey"), "l_orderkey": ("late_orders", "o_orderkey")}),
}


def contract_tables(t: Staging) -> dict[str, DataFrame]:
    return {"orders": t.table("orders"), "lineitem": t.table("lineitem"), "customer": t.table("customer"), "part": t.table("part"),
            "late_orders": t.table("orders").where("o_orderdate >= '1996-01-01'")}


_CONTRACT_SQL = """
    SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, 'not_null' AS test, CAST(0 AS BIGINT) AS failures
    UNION ALL SELECT 'orders', 'o_custkey', 'not_null', 0 UNION ALL SELECT 'orders', 'o_orderkey', 'unique', 0
    UNION ALL SELECT 'orders', 'o_custkey', 'relationships', 0 UNION ALL SELECT 'lineitem', 'l_orderkey', 'not_null', 0
    UNION ALL SELECT 'lineitem', 'l_orderkey+l_linenumber', 'unique', COUNT(*) FROM (
        SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) x
    UNION ALL SELECT 'lineitem', 'l_partkey', 'relationships', 0
    UNION ALL SELECT 'lineitem', 'l_orderkey', 'relationships', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (
        SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""


@query("contract_tests", "C7", _CONTRACT_SQL)
def contract_tests(t: Staging) -> DataFrame:
    return Q.check_contract(contract_tables(t), CONTRACTS)


@query("profile_tests", "C8", """
    SELECT 'part' AS table_name, 'p_partkey' AS column_name, 'not_null' AS test, CAST(0 AS BIGINT) AS failures
    UNION ALL SELECT 'part', 'p_partkey', 'unique', 0""")
def profile_tests(t: Staging) -> DataFrame:
    return Q.check_contract({"part": t.table("part")}, {"part": Q.contract_from_profile(["p_partkey"], {})})


@query("failed_load_report", "M20", """
    SELECT CAST(0 AS BIGINT) AS step, 'orders' AS name, 'ok' AS status, COUNT(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM orders
    UNION ALL SELECT 1, 'lineitem', CASE WHEN bad THEN 'error' ELSE 'ok' END, CASE WHEN NOT bad THEN n END, CASE WHEN bad THEN 'l_orderkey repeats' END
    FROM (SELECT COUNT(*) AS n, COUNT(*) > COUNT(DISTINCT l_orderkey) AS bad FROM lineitem) x
    UNION ALL SELECT 2, 'part', CASE WHEN bad THEN 'skipped' ELSE 'ok' END, CASE WHEN NOT bad THEN (SELECT COUNT(*) FROM part) END, NULL
    FROM (SELECT COUNT(*) > COUNT(DISTINCT l_orderkey) AS bad FROM lineitem) x""")
def failed_load_report(t: Staging) -> DataFrame:
    """A run that stops at a step whose key repeats: the report has the error, the step after it is skipped."""
    def keyed() -> int:
        counts = t.table("lineitem", ["l_orderkey"]).groupBy("l_orderkey").count().agg(F.sum("count"), F.max("count")).first()
        if counts[1] > 1:
            raise ValueError("l_orderkey repeats")
        return counts[0]

    return run_steps(t.spark, [("orders", lambda: t.table("orders").count()), ("lineitem", keyed), ("part", lambda: t.table("part").count())],
                     on_error="report")


@query("freshness", "C10", """
    SELECT MAX(o_orderdate) AS max_loaded_at, date_sub('hour', MAX(o_orderdate), TIMESTAMP '2001-08-03 12:00:00') AS age_hours,
           CASE WHEN date_sub('hour', MAX(o_orderdate), TIMESTAMP '2001-08-03 12:00:00') > 48 THEN 'error' ELSE 'warn' END AS status
    FROM orders""")
def freshness(t: Staging) -> DataFrame:
    return Q.freshness(t.table("orders", ["o_orderdate"]), "o_orderdate", ntz("2001-08-03 12:00:00"))


@query("pii_actions", "C11", """
    SELECT contact_alternate_key, regexp_replace(regexp_replace(regexp_replace(email, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g')
           AS email_address, sha256('pepper' || first_name) AS first_name, city
    FROM (SELECT CAST(c.customer_id AS VARCHAR) AS contact_alternate_key, p.first_name,
                 lower(p.first_name || '.' || p.last_name || '@example.com') AS email, 'Anytown' AS city
          FROM stg_customer c JOIN stg_person p ON c.person_id = p.business_entity_id) x""")
def pii_actions(t: Staging) -> DataFrame:
    people = contacts(t).select("contact_alternate_key", "email_address", "first_name", "last_name", "city")
    return Q.apply_pii(people, {"email_address": "mask", "first_name": "tokenize", "last_name": "drop", "city": "keep"}, "pepper")


@query("locked_schema", "C14", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def locked_schema(t: Staging) -> DataFrame:
    return Q.check_schema(t.table("nation"), T.StructType.fromDDL("n_nationkey int, n_name string, n_regionkey int"))


# ---- graphs ------------------------------------------------------------------------
_EDGES = """SELECT business_entity_id AS src, manager_id AS dst FROM stg_employee WHERE manager_id IS NOT NULL
    UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_acctbal > 5000 AND s_suppkey > 0"""


def edges(t: Staging) -> DataFrame:
    """Who reports to whom, and a second line for some; every edge points to a lower id."""
    first = t.stg_employee.where("manager_id IS NOT NULL").select(F.col("business_entity_id").alias("src"), F.col("manager_id").alias("dst"))
    second = t.table("supplier").where("s_acctbal > 5000 AND s_suppkey > 0").select(
        F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 2").alias("dst"))
    return first.unionByName(second).distinct()


def nodes(t: Staging) -> DataFrame:
    return t.table("supplier").select(F.col("s_suppkey").alias("node"))


def looped(t: Staging) -> DataFrame:
    """The same with some nodes that depend on themselves and some on unknown nodes."""
    own = t.table("supplier").where("s_nationkey = 13").select(F.col("s_suppkey").alias("src"), F.col("s_suppkey").alias("dst"))
    lost = t.table("supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("src"), (-F.col("s_suppkey") - 1).alias("dst"))
    return edges(t).unionByName(own).unionByName(lost)


_LOOPED = f"""{_EDGES} UNION SELECT s_suppkey, s_suppkey FROM supplier WHERE s_nationkey = 13
    UNION SELECT s_suppkey, -s_suppkey - 1 FROM supplier WHERE s_nationkey = 7"""


@query("transitive_closure", "H2", f"""
    WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT src, dst, CAST(1 AS BIGINT) AS depth FROM e
        UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src)
    SELECT src, dst, MIN(depth) AS depth FROM c GROUP BY 1, 2""")
def transitive_closure(t: Staging) -> DataFrame:
    """In the SQL no bound either: the edges point downwards."""
    return H.transitive_closure(edges(t))


@query("topological_levels", "H3", f"""
    WITH RECURSIVE e AS ({_LOOPED}),
    stuck AS (SELECT src AS node FROM e WHERE src = dst UNION SELECT e.src FROM e JOIN stuck s ON e.dst = s.node),
    l AS (SELECT s_suppkey AS node, CAST(0 AS BIGINT) AS level FROM supplier
          UNION SELECT e.src, l.level + 1 FROM e JOIN l ON e.dst = l.node WHERE e.src NOT IN (SELECT node FROM stuck))
    SELECT node, CASE WHEN node IN (SELECT node FROM stuck) THEN NULL ELSE MAX(level) END AS level FROM l GROUP BY 1""")
def topological_levels(t: Staging) -> DataFrame:
    return H.topological_levels(looped(t), nodes(t))


@query("edge_findings", "H4", f"""
    WITH RECURSIVE e AS ({_LOOPED}), c AS (SELECT src, dst, CAST(1 AS BIGINT) AS depth FROM e
        UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src WHERE c.src <> c.dst AND e.src <> e.dst),
    m AS (SELECT src, dst, MIN(depth) AS depth FROM c GROUP BY 1, 2)
    SELECT 'dangling' AS finding, src AS node, dst AS other, CAST(1 AS BIGINT) AS depth FROM e WHERE dst NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'cycle', src, dst, depth FROM m WHERE src = dst
    UNION ALL SELECT 'deep_nesting', src, NULL, MAX(depth) FROM m GROUP BY src HAVING MAX(depth) > 3""")
def edge_findings(t: Staging) -> DataFrame:
    return H.edge_findings(looped(t), nodes(t), deep=3)


@query("inverted_references", "H5", """
    SELECT l_partkey AS dst, l_suppkey AS src, bool_or(l_returnflag = 'R') AS is_read, bool_or(l_linestatus = 'F') AS is_written
    FROM lineitem GROUP BY ALL""")
def inverted_references(t: Staging) -> DataFrame:
    """Which suppliers touch which parts, flags OR-ed per pair."""
    return H.invert_references(t.table("lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("is_selected"),
        (F.col("l_linestatus") == "F").alias("is_updated")))


@query("indirect_writers", "H6", f"""
    WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
    w AS (SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) AS dst FROM supplier)
    SELECT DISTINCT c.src, w.dst FROM c JOIN w ON w.src = c.dst EXCEPT SELECT src, dst FROM w""")
def indirect_writers(t: Staging) -> DataFrame:
    writes = t.table("supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"))
    return H.indirect_writers(edges(t), writes)


# ---- sources and sinks -----------------------------------------------------------------
@query("scan_columns", "S1", "SELECT l_orderkey, l_quantity FROM lineitem")
def scan_columns(t: Staging) -> DataFrame:
    return t.table("lineitem", ["l_orderkey", "l_quantity"])


@query("capped_scan", "S2 S3 T1 T5", """
    SELECT p_partkey, p_name, p_brand FROM part WHERE p_size > 10 ORDER BY p_partkey, p_name, p_brand LIMIT 100""")
def capped_scan(t: Staging) -> DataFrame:
    """The capped copy's read; a bytes column is left out of the order."""
    with_bytes = t.table("part").where("p_size > 10").select("p_partkey", "p_name", "p_brand", F.encode("p_name", "UTF-8").alias("raw"))
    return IO.capped_scan(with_bytes, 100).drop("raw")


@query("replicate_capped", "S4 S2", """
    SELECT 'customer' AS fqn, 'ok' AS status, least(COUNT(*) FILTER (c_acctbal > 0), 10000) AS rows, CAST(NULL AS VARCHAR) AS error FROM customer
    UNION ALL SELECT 'part', 'ok', least(COUNT(*), 10000), NULL FROM part
    UNION ALL SELECT 'broken', 'error', NULL, 'no such table' FROM region WHERE r_regionkey = 0""")
def replicate_capped(t: Staging) -> DataFrame:
    """The bounded copy (at most 10,000 rows a table); one table fails and the others go on."""

    def broken() -> DataFrame:
        raise FileNotFoundError("no such table")

    root = scratch_path(t.spark, "replica")
    return IO.replicate(t.spark, {"customer": lambda: t.table("customer"), "part": lambda: t.table("part"), "broken": broken,
                                  "orders": lambda: t.table("orders")},
                        lambda name: f"{root}/{name}", limit=10_000, exclude=["Orders"], filters=["customer=c_acctbal > 0"])


@query("replicate_whole", "S4 S5", """
    SELECT 'lineitem' AS fqn, 'ok' AS status, COUNT(*) AS rows, CAST(NULL AS VARCHAR) AS error FROM lineitem
    UNION ALL SELECT 'orders', 'ok', COUNT(*), NULL FROM orders""")
def replicate_whole(t: Staging) -> DataFrame:
    root = scratch_path(t.spark, "replica")
    return IO.replicate(t.spark, {n: (lambda n=n: t.table(n)) for n in ("lineitem", "orders")}, lambda n: f"{root}/{n}")


@query("replace_by_manifest", "S5 S6", """
    SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT c_custkey, c_acctbal FROM customer""")
def replace_by_manifest(t: Staging) -> DataFrame:
    """A table loaded, replaced by rows read from itself, and added to; no data is moved or renamed."""
    table = ManifestTable(t.spark, scratch_path(t.spark, "manifest"))
    table.replace(t.table("orders"))
    table.replace(table.read().where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")))
    table.append(t.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")))
    return table.read()


@query("append_and_create", "S6 S8", """
    SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey::BIGINT, r_name FROM region""")
def append_and_create(t: Staging) -> DataFrame:
    path = scratch_path(t.spark, "created")
    IO.create_table(t.spark, path, T.StructType.fromDDL("n_nationkey int, n_name string"))
    IO.append_rows(t.table("nation", ["n_nationkey", "n_name"]), path)
    IO.append_rows(t.table("region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), path)
    return t.spark.read.parquet(path)


@query("seed_roundtrip", "S9", """
    SELECT p_partkey, p_name, p_brand, p_retailprice, TRUE AS first_written, FALSE AS second_written FROM part""")
def seed_roundtrip(t: Staging) -> DataFrame:
    """Export, export again without a change, read back."""
    path, df = scratch_path(t.spark, "seed"), t.table("part", ["p_partkey", "p_name", "p_brand", "p_retailprice"])
    first, _ = IO.export_seed(df, path)
    second, _ = IO.export_seed(df, path)
    return IO.read_seed(t.spark, path, df.schema).select("*", F.lit(first).alias("first_written"), F.lit(second).alias("second_written"))


SPECS = [ColumnSpec("id", "BIGINT"), ColumnSpec("price", "DECIMAL", precision=19, scale=4), ColumnSpec("name", "NVARCHAR", max_length=16),
         ColumnSpec("size", "INT")]


@query("typed_ingest", "S10 P2", """
    SELECT id, price, CASE WHEN length(name) <= 8 THEN name END AS name, TRY_CAST(size AS BIGINT) AS size,
           CAST(length(name) > 8 AS BIGINT) + CAST(TRY_CAST(size AS BIGINT) IS NULL AS BIGINT) AS _rejected
    FROM (SELECT p_partkey AS id, p_retailprice AS price, p_name AS name,
                 CASE WHEN p_size > 40 THEN 'large' ELSE CAST(p_size AS VARCHAR) END AS size FROM part) x""")
def typed_ingest_query(t: Staging) -> DataFrame:
    return typed_ingest(raw_parts(t), "sql_server", SPECS)


@query("typed_ingest_rejects", "S10", """
    SELECT COUNT(*) AS rows, CAST(SUM(CAST(length(p_name) > 8 AS INT) + CAST(p_size > 40 AS INT)) AS BIGINT) AS rejected_values,
           COUNT(*) FILTER (length(p_name) > 8 OR p_size > 40) AS rows_with_rejects FROM part""")
def typed_ingest_rejects(t: Staging) -> DataFrame:
    return reject_counts(typed_ingest(raw_parts(t), "sql_server", SPECS))


def raw_parts(t: Staging) -> DataFrame:
    return t.table("part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").cast("string").alias("price"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 40, "large").otherwise(F.col("p_size").cast("string")).alias("size"))


@query("referential_sample", "S11 T1 J14", """
    WITH head AS (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5000)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM head)""")
def referential_sample(t: Staging) -> DataFrame:
    """A sampling operator: the first 5,000 headers and exactly their lines."""
    _, lines = IO.referential_sample(t.table("orders").withColumnRenamed("o_orderkey", "l_orderkey"),
                                     t.table("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]), "l_orderkey", 5000,
                                     ["o_orderdate", "l_orderkey"])
    return lines


_DRAW = "CAST('0x' || substr(md5(concat_ws('|', sales_order_id, sales_order_detail_id, '42')), 1, 7) AS BIGINT)"


@query("derived_returns", "S12", f"""
    SELECT sales_order_id, sales_order_detail_id, modified_date + to_days(CAST(1 + pick % 30 AS INTEGER)) AS return_date,
           least(order_qty, pick % 3 + 1) AS return_qty,
           CASE pick % 5 {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RETURN_REASONS))} END AS return_reason
    FROM (SELECT *, {_DRAW} // 20 AS pick FROM stg_sales_order_detail WHERE {_DRAW} % 20 = 0) x""")
def derived_returns(t: Staging) -> DataFrame:
    """A sampling operator: returns for about one line in twenty, the same lines on every run."""
    return IO.derive_returns(t.stg_sales_order_detail, RETURN_REASONS)


@query("inline_values", "S14 J1", """
    SELECT status_name, COUNT(*) AS orders FROM orders JOIN (VALUES ('O', 'open'), ('F', 'finished'), ('P', 'pending')) v(code, status_name)
      ON code = o_orderstatus GROUP BY 1""")
def inline_values(t: Staging) -> DataFrame:
    names = IO.inline_values(t.spark, [("O", "open"), ("F", "finished"), ("P", "pending")], "code string, status_name string")
    counts = t.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    return counts.join(F.broadcast(names), F.col("code") == F.col("o_orderstatus")).select("status_name", "orders")


# ---- scalar functions --------------------------------------------------------------
@query("scalar_functions", "2.16", """
    SELECT c_custkey, concat(c_name, NULL, '!') AS concat_skip, CAST(c_name || NULL AS VARCHAR) AS concat_null,
           length(rtrim(c_name || '  ')) AS len, substr(c_name, strpos(c_name, '#') + 1, 50) AS after_hash,
           right('0000' || c_custkey, 4) AS padded, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low,
           NULLIF(c_mktsegment, 'BUILDING') AS not_building, CASE WHEN c_nationkey = 3 THEN 'three' ELSE 'other' END AS decoded,
           TRY_CAST(c_name AS BIGINT) AS not_a_number, c_custkey // 7 AS int_div, c_custkey % 7 AS modulo,
           CAST(ceil(c_acctbal) AS BIGINT) AS up_to, floor(c_acctbal) <= c_acctbal AS floor_ok, sha256(c_name) AS digest,
           lower(hex(c_name)) AS hex_name, CAST(c_acctbal > 0 AS BIGINT) AS flag, lower(c_name) = lower(upper(c_name)) AS same_text
    FROM customer""")
def scalar_functions(t: Staging) -> DataFrame:
    name, none = F.col("c_name"), F.lit(None).cast("string")
    return t.table("customer").select(
        "c_custkey", X.concat_skip_null(name, none, F.lit("!")).alias("concat_skip"), F.concat(name, none).alias("concat_null"),
        X.length_no_trailing_blanks(F.concat(name, F.lit("  "))).alias("len"), X.after_separator(name, "#", 50).alias("after_hash"),
        X.left_pad(F.col("c_custkey"), 4).alias("padded"), F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("not_building"),
        X.decode(F.col("c_nationkey"), [(3, "three")], "other").alias("decoded"), name.try_cast("bigint").alias("not_a_number"),
        X.int_div(F.col("c_custkey"), F.lit(7).cast("bigint")).alias("int_div"), (F.col("c_custkey") % 7).alias("modulo"),
        F.ceil("c_acctbal").alias("up_to"), (F.floor("c_acctbal") <= F.col("c_acctbal")).alias("floor_ok"), F.sha2("c_name", 256).alias("digest"),
        X.hex_text(name).alias("hex_name"), (F.col("c_acctbal") > 0).cast("int").alias("flag"),
        (F.collate(name, "UTF8_LCASE") == F.collate(F.upper(name), "UTF8_LCASE")).alias("same_text"))


@query("date_functions", "2.16", """
    SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS date_key, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month,
           CAST(strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS BIGINT) AS month_key, o_orderdate + INTERVAL 5 DAY AS plus_days,
           o_orderdate + INTERVAL 90 SECOND AS plus_seconds, CAST(o_orderdate - INTERVAL 2 YEAR AS TIMESTAMP) AS minus_years,
           o_orderdate - INTERVAL 365 DAY AS year_ago, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
           CAST(isodow(o_orderdate) AS BIGINT) AS weekday, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS age_days
    FROM orders""")
def date_functions(t: Staging) -> DataFrame:
    d = F.col("o_orderdate")
    return t.table("orders").select(
        "o_orderkey", X.date_key(d).alias("date_key"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month"),
        X.month_key(d).alias("month_key"), F.expr("o_orderdate + interval 5 days").alias("plus_days"),
        F.expr("o_orderdate + interval 90 seconds").alias("plus_seconds"), F.expr("o_orderdate - interval 2 years").alias("minus_years"),
        F.expr("o_orderdate - interval 365 days").alias("year_ago"), F.quarter(d).alias("quarter"), (F.weekday(d) + 1).alias("weekday"),
        F.datediff(ntz("2001-08-01 00:00:00"), d).alias("age_days"))


@query("change_modes", "P7", """
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, old IS DISTINCT FROM new AS null_safe, COALESCE(old, '') <> COALESCE(new, '') AS sentinel,
           COALESCE(old <> new, FALSE) AS plain
    FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS old,
                 CASE WHEN c_nationkey < 5 THEN '' WHEN c_nationkey < 20 THEN c_mktsegment END AS new FROM customer) x""")
def change_modes(t: Staging) -> DataFrame:
    """The three meanings of "changed" side by side."""
    pair = t.table("customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("old"),
        F.when(F.col("c_nationkey") < 5, "").when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("new"))
    both = [(F.col("old"), F.col("new"))]
    return pair.select("c_custkey", X.changed(both).alias("null_safe"), X.changed(both, "sentinel", [""]).alias("sentinel"),
                       X.changed(both, "plain").alias("plain"))
