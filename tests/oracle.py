"""Compare a registered query with its check SQL: names, types, row count and every value."""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, width: int) -> list[tuple]:
    def value(v):
        return "NULL" if v is None else repr(v)

    return sorted(tuple(value(v) for v in row[:width]) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs; an empty list means the two agree."""
    names = sorted(df.columns)
    duck = con.sql(sql)
    if names != sorted(duck.columns):
        return [f"columns {names} != {sorted(duck.columns)}"]
    kinds = dict(zip(duck.columns, [str(x) for x in duck.types]))
    out = [f"type of {f.name}: {f.dataType.simpleString()} != {kinds[f.name]}" for f in df.schema.fields
           if DUCK_TYPES.get(f.dataType.simpleString()) != kinds[f.name]]
    ours = canonical([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()], len(names))
    theirs = canonical(con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql}) q").fetchall(), len(names))
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    if ours != theirs:
        a, b = set(ours) - set(theirs), set(theirs) - set(ours)
        out.append(f"values differ: {len(a)} / {len(b)}; e.g. {sorted(a)[:2]} vs {sorted(b)[:2]}")
    return out


def main(sf_dir: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from dimloom.session import local_session, release

    spark = local_session("oracle-check", 8)
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            problems = differences(df, con, sqls[name]) if name in sqls else []
            rows = df.count() if name not in sqls else ""
        except Exception as error:  # noqa: BLE001
            problems, rows = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        release(spark)
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  ' if name in sqls else 'rows'} {name} {time.time() - start:.1f}s {rows}", flush=True)
        for p in problems:
            print("     ", p[:900])
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
