"""Run registered queries next to their SQL and compare the rows."""

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def engine(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(df, con, sql):
    """None when equal, else a short text."""
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return f"columns {columns} vs {sorted(rel.columns)}"
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(repr, con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()))
    if got == want:
        return None
    left, right = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} vs {len(want)} rows; ours {sorted(left)[:3]}; theirs {sorted(right)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, checks = engine(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            result = difference(query(spark, sf_dir), con, checks[name]) if name in checks else "no check"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:32s} {time.time() - start:6.1f}s  {result or 'equal'}", flush=True)
