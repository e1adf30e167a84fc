"""Run every query against its SQL: python tests/compare.py SF_DIR [NAME...]"""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if type(v).__name__ == "Decimal" else v


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    heads = [d[0] for d in rel.description]
    if sorted(heads) != names:
        return f"columns {names} and {sorted(heads)}"
    at = [heads.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return None
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), connection(sys.argv[1])
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = compare(spark, con, queries[name], oracles[name], sys.argv[1]) if name in oracles else f"no SQL; {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
