"""Hierarchies and dependency graphs held as edge tables.

Walks double their reach with every round, and each round is written out, so a plan never holds
more than one round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimloom.operators.relational import apply_aggregate
from dimloom.session import materialize, scratch_path


def hierarchy(df: DataFrame, key: str, parent: str, name: str, *, separator: str = " > ", path_length: int | None = None,
              max_depth: int | None = None) -> DataFrame:
    """Every row below a row without a parent: level, parent's name, path of names.

    By pointer jumping: each row carries the stretch of its path up to some ancestor, and a round puts that ancestor's stretch before it, so
    stretches double and a tree of depth d takes log2(d) rounds. ``max_depth`` leaves deeper rows out on purpose. Rows on or below a
    cycle, or below an unknown parent, are never reached, as with a recursive query. More levels than rows mean that repeated keys form a
    cycle the walk can enter: that is an error. Direct reports are counted over all rows. Paths are whole unless ``path_length`` cuts them.
    """
    base = materialize(df.select(
        F.col(key).alias("_id"), F.col(parent).alias("_up"), F.col(name).alias("_name")))
    most = base.count()
    # _top: the row above the stretch, null once it starts at a root.
    rows = base.select("_id", "_up", "_name", F.lit(None).cast("string").alias("_up_name"), F.col("_up").alias("_top"),
                       F.lit(1).alias("_level"), F.col("_name").alias("_path"))
    reach = 1
    while reach <= min(most, max_depth or most) and not rows.where("_top IS NOT NULL").isEmpty():
        above = rows.select(F.col("_id").alias("_aid"), F.col("_name").alias("_aname"), F.col("_top").alias("_atop"),
                            F.col("_level").alias("_alevel"), F.col("_path").alias("_apath"))
        longer = rows.where("_top IS NOT NULL").join(above, F.col("_top") == F.col("_aid")).select(
            "_id", "_up", "_name", (F.col("_aname") if reach == 1 else F.col("_up_name")).alias("_up_name"), F.col("_atop").alias("_top"),
            (F.col("_level") + F.col("_alevel")).alias("_level"), F.concat("_apath", F.lit(separator), "_path").alias("_path"))
        rows = materialize(rows.where("_top IS NULL").unionByName(longer))
        reach *= 2
        if max_depth is None and not rows.where((F.col("_level") > most) & F.col("_top").isNull()).isEmpty():
            raise ValueError("the hierarchy has a cycle through a repeated key")
    found = rows.where("_top IS NULL")
    if max_depth is not None:
        found = found.where(F.col("_level") <= max_depth)
    reports = base.where("_up IS NOT NULL")
    path = F.col("_path") if path_length is None else F.substring("_path", 1, path_length)
    return apply_aggregate(found, reports, {"_id": "_up"}, {"direct_reports_count": F.count(F.lit(1))},
                           {"direct_reports_count": 0}).select(
        F.col("_id").alias(key), F.col("_name").alias(name), F.col("_up").alias(parent),
        F.col("_up_name").alias("manager_name"), F.col("_level").alias("hierarchy_level"),
        path.alias("manager_path"), "direct_reports_count")


def transitive_closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every (src, dst) connected by a path, with its shortest length; src = dst marks a cycle.

    Rounds double the reach: a shortest path longer than r and up to 2r has a node at r from its start, so the pairs at just
    r meet the pairs within r. Each round appends what is new to a table of its own. The walk ends when a round finds nothing, or at
    ``max_depth`` on purpose.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "closure")
    step = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("depth", F.lit(1))
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in step.schema.fields])
    step.write.parquet(f"{root}/round=0")

    def found() -> DataFrame:
        return spark.read.schema(kinds).parquet(root).select(*kinds.names)

    for turn in count(1):
        reach = 1 << (turn - 1)
        if max_depth is not None and reach >= max_depth:
            break
        half = found().where(F.col("depth") == reach).select("src", F.col("dst").alias("_mid"))
        rest = found().select(F.col("src").alias("_mid"), "dst", "depth")
        grown = half.join(rest, "_mid").groupBy("src", "dst").agg((F.min("depth") + reach).alias("depth"))
        if max_depth is not None:
            grown = grown.where(F.col("depth") <= max_depth)
        grown.join(found().select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "depth").write.parquet(f"{root}/round={turn}")
        if spark.read.schema(kinds).parquet(f"{root}/round={turn}").isEmpty():
            break
    return found()


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Parallel batches: level 0 depends on nothing, each later level only on earlier ones.

    ``src`` depends on ``dst``. Nodes on or behind a cycle get no level.
    """
    nodes = materialize(nodes.select("node").distinct())
    known = nodes.withColumnRenamed("node", "_n")
    # Dependencies on nodes outside the set do not block.
    inside = edges.select("src", "dst").distinct().join(known, F.col("dst") == F.col("_n"), "left_semi")
    waiting, blocking = nodes, materialize(inside.join(known, F.col("src") == F.col("_n"), "left_semi"))
    out = None
    for level in count():
        ready = materialize(waiting.join(blocking.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            break
        done = ready.withColumn("level", F.lit(level))
        out = done if out is None else out.unionByName(done)
        gone = ready.select(F.col("node").alias("_n"))
        waiting = materialize(waiting.join(ready, "node", "left_anti"))
        blocking = materialize(blocking.join(gone, F.col("dst") == F.col("_n"), "left_anti"))
    stuck = waiting.withColumn("level", F.lit(None).cast("int"))
    return stuck if out is None else out.unionByName(stuck)


def edge_findings(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None, deep: int = 5) -> DataFrame:
    """Cycles, references to unknown nodes and chains deeper than ``deep``, one row per finding."""
    known = nodes.select(F.col("node").alias("_n")).distinct()
    dangling = edges.join(known, F.col("dst") == F.col("_n"), "left_anti").select(
        F.lit("dangling").alias("finding"), F.col("src").alias("node"), F.col("dst").alias("other"),
        F.lit(1).alias("depth")).distinct()
    closure = transitive_closure(edges, max_depth)
    cycles = closure.where("src = dst").select(F.lit("cycle").alias("finding"), F.col("src").alias("node"),
                                               F.col("dst").alias("other"), "depth")
    nesting = closure.groupBy("src").agg(F.max("depth").alias("depth")).where(F.col("depth") > deep).select(
        F.lit("deep_nesting").alias("finding"), F.col("src").alias("node"), F.lit(None).cast("bigint").alias("other"),
        "depth")
    return dangling.unionByName(cycles).unionByName(nesting)


def invert_references(refs: DataFrame) -> DataFrame:
    """(referrer, object, reads, writes) as who reads or writes each object, flags OR-ed per pair."""
    return refs.groupBy(F.col("dst"), F.col("src")).agg(
        F.coalesce(F.bool_or("is_selected"), F.lit(False)).alias("is_read"),
        F.coalesce(F.bool_or("is_updated"), F.lit(False)).alias("is_written"))


def indirect_writers(calls: DataFrame, writes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Routines that write a table only through the routines they call."""
    closure = transitive_closure(calls, max_depth)
    direct = writes.select("src", "dst").distinct()
    through = closure.select("src", F.col("dst").alias("_callee")).join(
        direct.select(F.col("src").alias("_callee"), "dst"), "_callee").select("src", "dst").distinct()
    return through.join(direct, ["src", "dst"], "left_anti")
