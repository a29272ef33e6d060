"""Compare registered queries with their oracle SQL, row multiset by row multiset."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("httploom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.extraJavaOptions", "-Dlog4j2.level=ERROR")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty string when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    wanted_columns, wanted = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}"
    if got != wanted:
        extra, lacking = got - wanted, wanted - got
        return (
            f"rows {sum(got.values())} vs {sum(wanted.values())}; extra {sum(extra.values())} {list(extra)[:2]}; "
            f"lacking {sum(lacking.values())} {list(lacking)[:2]}"
        )
    return "" if got else "empty result"


def main():
    from workload import catalogue

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = session(), oracle(sf_dir)
    bad = []
    for name, fn in catalogue.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            if name in catalogue.ORACLE:
                message = compare(spark, con, name, fn, catalogue.ORACLE[name], sf_dir)
            else:
                message = "" if fn(spark, sf_dir).count() else "empty result"
        except Exception as error:
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL' if message else 'ok':4} {name:32} {time.time() - started:6.2f}s {message}", flush=True)
        if message:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
