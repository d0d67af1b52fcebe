"""Compare queries with their SQL as the driver does: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def session(name: str = "tests") -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool | int | str) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names: list[str], data: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def oracle(folder: str, sql: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def compare(spark: SparkSession, folder: str, query, sql: str) -> str:
    """'' or what differs."""
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    names, data = oracle(folder, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows(names, data)
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only mine {sum((mine - theirs).values())}: {list((mine - theirs))[:3]}; only SQL {sum((theirs - mine).values())}: {list((theirs - mine))[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    assert not set(o) - set(q), set(o) - set(q)
    for n in sys.argv[2:] or q:
        t = time.time()
        try:
            said = compare(spark, sys.argv[1], q[n], o[n]) if n in o else f"{q[n](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__} {str(x)[:1500]}"
        print(f"{n}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
