"""The statement-pattern corpus: one query per pattern, over a product source, a key/value
config and a dimension that already has rows.

An INSERT returns the rows it adds; UPDATE, DELETE and MERGE return the whole new target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimloom.functions.scalar import register_functions
from dimloom.operators import loads as L
from dimloom.operators import relational as R
from dimloom.operators.ordered import row_numbers, running_sum
from dimloom.plans.catalog import query
from dimloom.plans.staging import Staging
from dimloom.session import scratch_path
from dimloom.sources.tables import create_table_as, read_table, replace_rows, staging_view, truncate_rows

SOURCE = "SELECT CAST(product_id AS VARCHAR) AS alternate_key, product_name FROM pat_product"


def source(t: Staging) -> DataFrame:
    return t.pat_product.select(F.col("product_id").cast("string").alias("alternate_key"), "product_name")


def with_config(t: Staging, how: str) -> DataFrame:
    """Products beside their config row: the key of the product is computed, then an equi join."""
    keyed = t.pat_product.withColumn("_k", F.col("product_id").cast("string"))
    return keyed.join(t.pat_config, F.col("config_key") == F.col("_k"), how)


@query("pat_01_insert_select", "M2 P1 P2", SOURCE)
def pat_01(t):
    return source(t)


MERGED = """SELECT s.alternate_key, s.product_name FROM ({0}) s
    UNION ALL SELECT t.alternate_key, t.product_name FROM pat_target t
    WHERE t.alternate_key IS NULL OR t.alternate_key NOT IN (SELECT alternate_key FROM ({0}) s)""".format(SOURCE)


@query("pat_02_merge", "M5", MERGED)
def pat_02(t):
    return L.scd1_merge(t.pat_target, source(t), ["alternate_key"])


@query("pat_03_cte_row_number", "P11 W1 W2 T1", """
    WITH ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY product_id) AS rn FROM pat_product)
    SELECT CAST(product_id AS VARCHAR) AS alternate_key, product_name FROM ranked WHERE rn <= 100""")
def pat_03(t):
    """The first 100 rows in an order need no numbering of the rest: each task keeps 100."""
    top = t.pat_product.orderBy("product_id").limit(100)
    return top.select(F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("pat_04_multi_cte_not_in", "P11 J16", """
    SELECT CAST(product_id AS VARCHAR) AS alternate_key, product_name FROM pat_product
    WHERE product_id NOT IN (SELECT CAST(alternate_key AS BIGINT) FROM pat_target WHERE product_name IS NOT NULL AND alternate_key IS NOT NULL)""")
def pat_04(t):
    loaded = t.pat_target.where("product_name IS NOT NULL AND alternate_key IS NOT NULL").select(
        F.col("alternate_key").cast("bigint").alias("id"))
    fresh = R.not_in(t.pat_product, "product_id", loaded, "id")
    return fresh.select(F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("not_in_with_null", "J16", """
    SELECT 'null on the right' AS test, product_id FROM pat_product
    WHERE product_id NOT IN (SELECT CAST(alternate_key AS BIGINT) FROM pat_target)
    UNION ALL SELECT 'null on the left', CAST(alternate_key AS BIGINT) FROM pat_target
    WHERE alternate_key NOT IN (SELECT config_key FROM pat_config)
    UNION ALL SELECT 'empty right', CAST(alternate_key AS BIGINT) FROM pat_target
    WHERE alternate_key NOT IN (SELECT config_key FROM pat_config WHERE config_key = 'none')""")
def not_in_with_null(t):
    """The three NULL cases of NOT IN."""
    target = t.pat_target.select(F.col("alternate_key").cast("bigint").alias("product_id"))
    config = t.pat_config.select(F.col("config_key").cast("bigint").alias("k"))
    parts = [("null on the right", R.not_in(t.pat_product.select("product_id"), "product_id", target, "product_id")),
             ("null on the left", R.not_in(target, "product_id", config, "k")),
             ("empty right", R.not_in(target, "product_id", config.where("k < 0"), "k"))]
    return L.append_batch(*[df.select(F.lit(name).alias("test"), "product_id") for name, df in parts])


@query("pat_05_case", "P3", """
    SELECT CAST(product_id AS VARCHAR) AS alternate_key, CASE WHEN product_name IS NULL THEN 'Unknown' ELSE product_name END
           AS product_name FROM pat_product""")
def pat_05(t):
    name = F.when(F.col("product_name").isNull(), "Unknown").otherwise(F.col("product_name"))
    return source(t).withColumn("product_name", name)


JOINED = """SELECT CAST(p.product_id AS VARCHAR) AS alternate_key, COALESCE(c.config_value, p.product_name) AS product_name
    FROM pat_product p {} JOIN pat_config c ON c.config_key = CAST(p.product_id AS VARCHAR)"""


def joined(df: DataFrame) -> DataFrame:
    return df.select(F.col("product_id").cast("string").alias("alternate_key"),
                     F.coalesce("config_value", "product_name").alias("product_name"))


@query("pat_06_left_join", "J2 J9", JOINED.format("LEFT"))
def pat_06(t):
    return joined(with_config(t, "left"))


def reload_or_merge(t: Staging, flag: DataFrame) -> DataFrame:
    """IF EXISTS (flag) full reload, ELSE merge: the test is one look at a filtered row."""
    if flag.isEmpty():
        return L.scd1_merge(t.pat_target, source(t), ["alternate_key"])
    return source(t)


@query("pat_07_conditional_merge", "P17 P18 M5", f"""
    SELECT 'reload' AS branch, * FROM ({SOURCE}) a UNION ALL SELECT 'merge', * FROM ({MERGED}) b""")
def pat_07(t):
    """Both branches: with the flag row and without."""
    with_flag = reload_or_merge(t, t.pat_config.where("config_key = '0'"))
    without = reload_or_merge(t, t.pat_config.where("config_key = 'full_reload'"))
    return with_flag.select(F.lit("reload").alias("branch"), "*").unionByName(without.select(F.lit("merge").alias("branch"), "*"))


@query("pat_08_try_catch", "M2 M20", f"SELECT 'ok' AS status, * FROM ({SOURCE}) a")
def pat_08(t):
    """A load that fails leaves an error row instead of data."""
    try:
        path = scratch_path(t.spark, "try_catch")
        replace_rows(source(t), path)
        return read_table(t.spark, path).select(F.lit("ok").alias("status"), "*")
    except Exception as error:  # noqa: BLE001 - the pattern catches everything
        return t.spark.createDataFrame([("error", None, str(error))], "status string, alternate_key string, product_name string")


@query("pat_09_correlated_max", "Q5 W10", """
    SELECT CAST(p.product_id AS VARCHAR) AS alternate_key, p.product_name FROM pat_product p
    WHERE p.product_id = (SELECT MAX(p2.product_id) FROM pat_product p2 WHERE p2.product_name = p.product_name)""")
def pat_09(t):
    latest = R.compare_to_group(t.pat_product.where("product_name IS NOT NULL"), ["product_name"], F.max("product_id"), "_max")
    return latest.where(F.col("product_id") == F.col("_max")).select(
        F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("pat_10_sequential_with", "W2 T1 P11", """
    WITH dim AS (SELECT * FROM pat_target UNION ALL
                 SELECT CAST(product_id AS VARCHAR), product_name FROM pat_product WHERE product_name IS NOT NULL),
    enriched AS (SELECT d.* FROM dim d, pat_config c WHERE c.config_key = '0' AND d.alternate_key IS NOT NULL),
    ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY alternate_key, product_name) AS rn FROM enriched)
    SELECT 'product_' || alternate_key AS config_key, product_name AS config_value FROM ranked WHERE rn <= 5""")
def pat_10(t):
    """The second statement reads what the first one added."""
    dim = t.pat_target.unionByName(source(t).where("product_name IS NOT NULL")).where("alternate_key IS NOT NULL")
    found = t.pat_config.where("config_key = '0'").agg(F.count(F.lit(1)).alias("_hits"))
    enriched = R.with_scalar(dim, found).where("_hits > 0")
    return enriched.orderBy("alternate_key", "product_name").limit(5).select(
        F.concat(F.lit("product_"), "alternate_key").alias("config_key"), F.col("product_name").alias("config_value"))


UPDATED = """SELECT t.alternate_key, CASE WHEN s.alternate_key IS NOT NULL THEN s.product_name ELSE t.product_name END AS product_name
    FROM pat_target t LEFT JOIN ({0}) s ON t.alternate_key = s.alternate_key""".format(SOURCE)


@query("pat_11_update_join", "P14", UPDATED)
def pat_11(t):
    return R.update_from(t.pat_target, source(t), {"alternate_key": "alternate_key"}, {"product_name": "product_name"})


@query("update_join_inner", "P14", f"""
    SELECT t.alternate_key, s.config_value AS product_name FROM pat_target t JOIN pat_config s ON t.alternate_key = s.config_key""")
def update_join_inner(t):
    """The inner form: rows without a match are not returned."""
    return R.update_from(t.pat_target, t.pat_config, {"alternate_key": "config_key"}, {"product_name": "config_value"},
                         keep_unmatched=False)


@query("pat_12_delete", "P15", "SELECT * FROM pat_target WHERE alternate_key IS NOT NULL")
def pat_12(t):
    return R.delete_where(t.pat_target, F.col("alternate_key").isNull())


@query("delete_null_aware", "P15", "SELECT * FROM pat_target WHERE product_name <> 'old red bolt' OR product_name IS NULL")
def delete_null_aware(t):
    """DELETE … WHERE name = x keeps the rows without a name."""
    return R.delete_where(t.pat_target, F.col("product_name") == "old red bolt")


@query("pat_13_delete_top", "P16", """
    SELECT product_id, size FROM pat_product WHERE product_id NOT IN (
        SELECT product_id FROM pat_product WHERE size < 25 ORDER BY size, product_id LIMIT 500)""")
def pat_13(t):
    return R.delete_top(t.pat_product.select("product_id", "size"), F.col("size") < 25, 500, ["size", "product_id"], ["product_id"])


@query("pat_14_truncate", "S7 M1", "SELECT * FROM pat_target WHERE FALSE")
def pat_14(t):
    path = scratch_path(t.spark, "truncate")
    replace_rows(t.pat_target, path)
    truncate_rows(t.spark, path)
    return read_table(t.spark, path)


@query("pat_15_select_into", "S15", "SELECT product_id, product_name FROM pat_product WHERE product_name IS NOT NULL")
def pat_15(t):
    kept = t.pat_product.where("product_name IS NOT NULL").select("product_id", "product_name")
    return create_table_as(kept, scratch_path(t.spark, "select_into"))


@query("pat_16_right_join", "J3", JOINED.format("LEFT"))
def pat_16(t):
    keyed = t.pat_product.withColumn("_k", F.col("product_id").cast("string"))
    return joined(t.pat_config.join(keyed, F.col("config_key") == F.col("_k"), "right"))


@query("pat_17_scalar_in_where", "Q1 P5", f"""
    SELECT CAST(product_id AS VARCHAR) AS alternate_key, product_name FROM pat_product
    WHERE size > (SELECT AVG(size) FROM pat_product)""")
def pat_17(t):
    mean = t.pat_product.agg(F.avg("size"))
    return t.pat_product.where(F.col("size") > mean.scalar()).select(
        F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("pat_18_window_top", "W2 W6 T1", """
    SELECT CAST(product_id AS VARCHAR) AS alternate_key, product_name, total FROM (
        SELECT *, ROW_NUMBER() OVER (ORDER BY product_id DESC) AS rn, COUNT(*) OVER () AS total FROM pat_product) r WHERE rn <= 10""")
def pat_18(t):
    top = t.pat_product.orderBy(F.col("product_id").desc()).limit(10)
    return R.with_scalar(top, t.pat_product.agg(F.count(F.lit(1)).alias("total"))).select(
        F.col("product_id").cast("string").alias("alternate_key"), "product_name", "total")


SMALL, LARGE = "size <= 20", "size > 20"
_PART = "SELECT CAST(product_id AS VARCHAR) AS alternate_key, product_name FROM pat_product WHERE size {}"


def part_where(t: Staging, cond) -> DataFrame:
    return t.pat_product.where(cond).select(F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("pat_19_union_all", "U1", f"{_PART.format('<= 20')} UNION ALL {_PART.format('> 20')}")
def pat_19(t):
    return part_where(t, SMALL).unionByName(part_where(t, LARGE))


@query("pat_20_union", "U2", f"{_PART.format('<= 20')} UNION {_PART.format('> 10')}")
def pat_20(t):
    return part_where(t, SMALL).union(part_where(t, F.col("size") > 10)).distinct()


@query("pat_21_intersect", "U4", f"{_PART.format('<= 20')} INTERSECT {_PART.format('>= 10')}")
def pat_21(t):
    return part_where(t, SMALL).intersect(part_where(t, F.col("size") >= 10))


@query("pat_22_except", "U3", f"{SOURCE} EXCEPT SELECT alternate_key, product_name FROM pat_target")
def pat_22(t):
    return source(t).subtract(t.pat_target)


@query("pat_23_union_all_cte", "U1 P11", f"{_PART.format('<= 20')} UNION ALL {_PART.format('> 20')}")
def pat_23(t):
    combined = t.pat_product.where(SMALL).unionByName(t.pat_product.where(LARGE))
    return combined.select(F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("pat_24_inner_join", "J1", JOINED.format("INNER"))
def pat_24(t):
    return joined(with_config(t, "inner"))


@query("pat_25_full_outer_join", "J4", """
    SELECT CAST(COALESCE(p.product_id, 0) AS VARCHAR) AS alternate_key, COALESCE(p.product_name, c.config_value) AS product_name
    FROM (SELECT * FROM pat_product WHERE size > 10) p FULL JOIN pat_config c ON c.config_key = CAST(p.product_id AS VARCHAR)""")
def pat_25(t):
    large = t.pat_product.where("size > 10").withColumn("_k", F.col("product_id").cast("string"))
    return large.join(t.pat_config, F.col("config_key") == F.col("_k"), "full_outer").select(
        F.coalesce("product_id", F.lit(0)).cast("string").alias("alternate_key"),
        F.coalesce("product_name", "config_value").alias("product_name"))


@query("pat_26_cross_join", "J5", """
    SELECT CAST(p.product_id AS VARCHAR) AS config_key, r.r_name AS config_value FROM pat_product p CROSS JOIN region r""")
def pat_26(t):
    """One side is bounded (the regions), so its values travel to the rows."""
    return R.explode_axis(t.pat_product.select("product_id"), t.table("region"), "r_name", 1000).select(
        F.col("product_id").cast("string").alias("config_key"), F.col("r_name").alias("config_value"))


def top_config(t: Staging, keep: bool) -> DataFrame:
    keyed = t.pat_product.withColumn("_k", F.col("product_id").cast("string"))
    return R.apply_top_k(keyed, t.pat_config, {"_k": "config_key"}, ["config_value"], 1, {"config_value": "config_value"}, keep)


@query("pat_27_cross_apply", "J13", """
    SELECT CAST(p.product_id AS VARCHAR) AS alternate_key, c.config_value AS product_name
    FROM pat_product p JOIN pat_config c ON c.config_key = CAST(p.product_id AS VARCHAR)""")
def pat_27(t):
    return top_config(t, False).select(F.col("product_id").cast("string").alias("alternate_key"),
                                       F.col("config_value").alias("product_name"))


@query("pat_28_outer_apply", "J11", JOINED.format("LEFT"))
def pat_28(t):
    return joined(top_config(t, True))


@query("cross_apply_top_3", "J13 T3", """
    SELECT c_custkey, o_orderkey, o_totalprice FROM (
        SELECT c.c_custkey, o.o_orderkey, o.o_totalprice,
               ROW_NUMBER() OVER (PARTITION BY c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS rn
        FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey) x WHERE rn <= 3""")
def cross_apply_top_3(t):
    return R.apply_top_k(t.table("customer", ["c_custkey"]), t.table("orders", ["o_custkey", "o_orderkey", "o_totalprice"]),
                         {"c_custkey": "o_custkey"}, ["-o_totalprice", "o_orderkey"], 3,
                         {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"})


@query("pat_29_self_join", "J6 J9", """
    SELECT CAST(a.product_id AS VARCHAR) AS config_key, b.product_name AS config_value
    FROM pat_product a JOIN pat_product b ON a.product_id = b.product_id + 1""")
def pat_29(t):
    """The shifted key is computed first, so this is an equi join."""
    before = t.pat_product.select((F.col("product_id") + 1).alias("product_id"), F.col("product_name").alias("config_value"))
    return t.pat_product.select("product_id").join(before, "product_id").select(
        F.col("product_id").cast("string").alias("config_key"), "config_value")


@query("pat_30_derived_table", "Q7", f"""
    SELECT s.alternate_key, s.product_name FROM ({SOURCE} WHERE product_name IS NOT NULL) s
    JOIN pat_config c ON c.config_key = s.alternate_key""")
def pat_30(t):
    named = source(t).where("product_name IS NOT NULL")
    return named.join(t.pat_config, F.col("config_key") == F.col("alternate_key")).select("alternate_key", "product_name")


@query("pat_31_scalar_subquery", "Q6 J10", """
    SELECT CAST(p.product_id AS VARCHAR) AS alternate_key,
           (SELECT MAX(c.config_value) FROM pat_config c WHERE c.config_key = CAST(p.product_id AS VARCHAR)) AS product_name
    FROM pat_product p""")
def pat_31(t):
    return R.apply_aggregate(source(t).select("alternate_key"), t.pat_config, {"alternate_key": "config_key"},
                             {"product_name": F.max("config_value")})


@query("pat_32_exists", "J14", f"SELECT * FROM ({SOURCE}) s WHERE EXISTS (SELECT 1 FROM pat_config c WHERE c.config_key = s.alternate_key)")
def pat_32(t):
    return source(t).join(t.pat_config, F.col("config_key") == F.col("alternate_key"), "left_semi")


@query("pat_33_not_exists", "J15 J17", f"SELECT * FROM ({SOURCE}) s WHERE NOT EXISTS (SELECT 1 FROM pat_target d WHERE d.alternate_key = s.alternate_key)")
def pat_33(t):
    return source(t).join(t.pat_target.select("alternate_key"), "alternate_key", "left_anti")


@query("pat_34_in", "J14", """
    SELECT CAST(p.product_id AS VARCHAR) AS alternate_key, p.product_name FROM pat_product p
    WHERE p.product_id IN (SELECT CAST(config_key AS BIGINT) FROM pat_config WHERE config_value IS NOT NULL)""")
def pat_34(t):
    keys = t.pat_config.where("config_value IS NOT NULL").select(F.col("config_key").cast("bigint").alias("product_id"))
    return t.pat_product.join(keys, "product_id", "left_semi").select(
        F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("pat_35_not_in", "J16", """
    SELECT CAST(p.product_id AS VARCHAR) AS alternate_key, p.product_name FROM pat_product p
    WHERE p.product_id NOT IN (SELECT CAST(alternate_key AS BIGINT) FROM pat_target WHERE alternate_key IS NOT NULL)""")
def pat_35(t):
    """With the NULL guard and a key that is never NULL, NOT IN is an anti join."""
    keys = t.pat_target.where("alternate_key IS NOT NULL").select(F.col("alternate_key").cast("bigint").alias("product_id"))
    return t.pat_product.join(keys, "product_id", "left_anti").select(
        F.col("product_id").cast("string").alias("alternate_key"), "product_name")


@query("pat_36_recursive_cte", "H1", """
    WITH RECURSIVE h AS (
        SELECT product_id, product_name, 1 AS lvl FROM pat_product WHERE size <= 5
        UNION ALL SELECT p.product_id, p.product_name, h.lvl + 1 FROM pat_product p JOIN h ON p.product_id = h.product_id + 5
        WHERE h.lvl < 3)
    SELECT CAST(product_id AS VARCHAR) AS alternate_key, product_name, CAST(lvl AS BIGINT) AS lvl FROM h""")
def pat_36(t):
    """A recursion of known depth unrolls into that many joins."""
    level = t.pat_product.where("size <= 5").select("product_id", "product_name", F.lit(1).alias("lvl"))
    found = level
    for depth in (2, 3):
        nxt = level.select((F.col("product_id") + 5).alias("product_id"))
        level = t.pat_product.select("product_id", "product_name").join(nxt, "product_id").withColumn("lvl", F.lit(depth))
        found = found.unionByName(level)
    return found.select(F.col("product_id").cast("string").alias("alternate_key"), "product_name", "lvl")


@query("pat_37_update_cte", "P14 P11", UPDATED)
def pat_37(t):
    latest = source(t).withColumnRenamed("product_name", "new_name")
    return R.update_from(t.pat_target, latest, {"alternate_key": "alternate_key"}, {"product_name": "new_name"})


@query("pat_38_delete_cte", "P15 J15", """
    SELECT * FROM pat_target WHERE alternate_key IS NULL
        OR alternate_key NOT IN (SELECT alternate_key FROM pat_target WHERE product_name IS NULL AND alternate_key IS NOT NULL)""")
def pat_38(t):
    stale = t.pat_target.where("product_name IS NULL").select("alternate_key")
    return t.pat_target.join(stale, "alternate_key", "left_anti")


@query("pat_39_merge_cte", "M5 P11", MERGED)
def pat_39(t):
    src = t.pat_product.select(F.col("product_id").cast("string").alias("alternate_key"), "product_name")
    return L.scd1_merge(t.pat_target, src, ["alternate_key"], ["product_name"])


LABELLED = """SELECT CASE WHEN GROUPING(kind) = 1 THEN 'ALL' ELSE kind END AS config_key, CAST(COUNT(*) AS VARCHAR) AS config_value
    FROM pat_product GROUP BY {}"""


def labelled(grouped) -> DataFrame:
    out = grouped.agg(F.count(F.lit(1)).alias("_n"), F.grouping("kind").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col("kind")).alias("config_key"),
                      F.col("_n").cast("string").alias("config_value"))


@query("pat_40_grouping_sets", "A10 A12", LABELLED.format("GROUPING SETS ((kind), ())"))
def pat_40(t):
    return labelled(t.pat_product.groupingSets([[F.col("kind")], []], "kind"))


@query("pat_41_cube", "A9", LABELLED.format("CUBE (kind)"))
def pat_41(t):
    return labelled(t.pat_product.cube("kind"))


@query("pat_42_rollup", "A7", LABELLED.format("ROLLUP (kind)"))
def pat_42(t):
    return labelled(t.pat_product.rollup("kind"))


@query("pat_43_pivot", "R1", """
    SELECT product_name AS config_key, COUNT(*) FILTER (kind = 'PROMO') AS promo, COUNT(*) FILTER (kind = 'LARGE') AS large
    FROM pat_product GROUP BY product_name""")
def pat_43(t):
    counted = t.pat_product.groupBy("product_name").pivot("kind", ["PROMO", "LARGE"]).agg(F.count("product_id"))
    return counted.select(F.col("product_name").alias("config_key"), F.coalesce("PROMO", F.lit(0)).alias("promo"),
                          F.coalesce("LARGE", F.lit(0)).alias("large"))


@query("pat_44_unpivot", "R4", """
    SELECT * FROM (SELECT CAST(product_id AS VARCHAR) AS config_key, product_name AS config_value FROM pat_product
                   UNION ALL SELECT CAST(product_id AS VARCHAR), product_number FROM pat_product) u WHERE config_value IS NOT NULL""")
def pat_44(t):
    return R.unpivot_pairs(t.pat_product.withColumn("config_key", F.col("product_id").cast("string")), ["config_key"],
                           {"product_name": "name", "product_number": "number"}, "_column", "config_value").drop("_column")


# ---- control flow, calls and cursors ------------------------------------------------
@query("pat_45_while_delete", "P15 M9", "SELECT product_id, product_name FROM pat_product WHERE product_name IS NOT NULL")
def pat_45(t):
    """WHILE rows are left DELETE TOP (100): the fixed point is one filter."""
    return R.delete_where(t.pat_product.select("product_id", "product_name"), F.col("product_name").isNull())


@query("pat_46_nested_control_flow", "P18 M20", f"SELECT * FROM ({MERGED}) m")
def pat_46(t):
    report = []

    def step():
        report.append(reload_or_merge(t, t.pat_config.where("config_key = 'full_reload'")))

    L.run_steps(t.spark, [("load", step)])
    return report[0]


@query("pat_47_call", "M20", SOURCE)
def pat_47(t):
    return pat_01(t)


@query("pat_48_dynamic_sql", "M20 P5 P6", "SELECT CAST(product_id AS VARCHAR) AS alternate_key FROM pat_product WHERE size BETWEEN 10 AND 40")
def pat_48(t):
    """Dynamic SQL with bound parameters."""
    staging_view(t.pat_product, "dimloom_product")
    return t.spark.sql("SELECT CAST(product_id AS STRING) AS alternate_key FROM dimloom_product WHERE size BETWEEN :lo AND :hi",
                       args={"lo": 10, "hi": 40})


@query("pat_49_load_from_view", "S13", SOURCE)
def pat_49(t):
    staging_view(source(t), "dimloom_product_catalog")
    return t.spark.table("dimloom_product_catalog")


@query("pat_50_scalar_function", "UDF", """
    SELECT CAST(c_custkey AS VARCHAR) AS alternate_key, upper(c_name) AS name, CAST(c_nationkey % 5 AS BIGINT) AS region FROM customer""")
def pat_50(t):
    """SQL functions, which Catalyst inlines into the plan."""
    register_functions(t.spark)
    return t.table("customer").select(F.col("c_custkey").cast("string").alias("alternate_key"),
                                      F.expr("format_name(c_name)").alias("name"), F.expr("region_code(c_nationkey)").alias("region"))


@query("table_function", "UDF", """
    SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000""")
def table_function(t):
    """A SQL table function with a parameter, called per query."""
    staging_view(t.table("orders"), "dimloom_orders")
    t.spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION orders_above(least DOUBLE)
                   RETURNS TABLE (o_custkey BIGINT, o_orderkey BIGINT)
                   RETURN SELECT o_custkey, o_orderkey FROM dimloom_orders WHERE o_totalprice > least""")
    big = t.spark.sql("SELECT o_custkey, o_orderkey FROM orders_above(CAST(400000 AS DOUBLE))")
    return t.table("customer", ["c_custkey"]).join(big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("row_generator", "UDF", """
    SELECT part, COUNT(*) AS orders FROM (
        SELECT unnest(string_split(o_orderpriority, '-')) AS part FROM orders) x GROUP BY 1""")
def row_generator(t):
    """A function that yields several rows per row: a generator, inside the JVM."""
    return t.table("orders").select(F.explode(F.split("o_orderpriority", "-")).alias("part")).groupBy("part").agg(
        F.count(F.lit(1)).alias("orders"))


@query("pat_51_cursor_running_total", "W7", """
    SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)
           AS DOUBLE) AS running_total FROM orders""")
def pat_51(t):
    """The cursor's running total, with SQL's default frame: orders of one day share a total."""
    orders = t.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,4)").alias("v"))
    return running_sum(orders, ["o_custkey"], ["o_orderdate"], "v", "running_total").select("o_orderkey", "o_custkey", "running_total")


@query("running_total_rows", "W7", """
    SELECT o_orderkey, o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey
           ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM orders""")
def running_total_rows(t):
    orders = t.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,4)").alias("v"))
    return running_sum(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "v", "running_total", frame="rows").select(
        "o_orderkey", "o_custkey", "running_total")


@query("pat_52_bulk_collect", "M2", "SELECT alternate_key, upper(product_name) AS product_name FROM pat_target WHERE alternate_key IS NOT NULL")
def pat_52(t):
    """BULK COLLECT … FORALL: the arrays in memory become one projection."""
    return t.pat_target.where("alternate_key IS NOT NULL").select("alternate_key", F.upper("product_name").alias("product_name"))


@query("pat_53_temp_table_chain", "P12 P13", """
    SELECT product_id, CASE WHEN size > 40 THEN 'big' ELSE kind END AS kind, size * 2 AS size FROM pat_product WHERE size > 3""")
def pat_53(t):
    """SELECT INTO #a, UPDATE #a, SELECT INTO #b: one chain of relations."""
    a = t.pat_product.where("size > 3").select("product_id", "kind", "size")
    a = R.update_where(a, F.col("size") > 40, {"kind": F.lit("big")})
    return a.withColumn("size", F.col("size") * 2)


@query("row_number_all", "W1 W2", """
    SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders""")
def row_number_all(t):
    return row_numbers(t.table("orders", ["o_orderkey", "o_totalprice"]), ["-o_totalprice", "o_orderkey"], "position").select(
        "o_orderkey", "position")


@query("paging", "T2 T5 S2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(t):
    return R.page(t.table("orders", ["o_orderkey", "o_totalprice"]), ["-o_totalprice", "o_orderkey"], 100, 50)


@query("audit_columns", "P19", """
    SELECT c_custkey, 'run-7' AS _run_id, TIMESTAMP '2012-01-01' AS _loaded_at FROM customer""")
def audit_columns(t):
    return R.with_audit(t.table("customer", ["c_custkey"]), "run-7", F.lit("2012-01-01 00:00:00").cast("timestamp_ntz"))
