"""Compare queries with their SQL twins: python -m geoloom.plans.check FOLDER [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from geoloom.plans import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def compare(spark, folder: str, names=None):
    queries, oracles = all_queries()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            got = df.toPandas()
            took = time.time() - began
            if name not in oracles:
                yield name, "rows-only", len(got), took, ""
                continue
            began = time.time()
            want = con.execute(oracles[name]).df()
            sql_took = time.time() - began
            a, b = _rows(got), _rows(want)
            if sorted(got.columns) != sorted(want.columns):
                yield name, "COLUMNS", len(got), took, f"{sorted(got.columns)} != {sorted(want.columns)}"
            elif a != b:
                sa, sb = set(a), set(b)
                only_a, only_b = [r for r in a if r not in sb][:2], [r for r in b if r not in sa][:2]
                yield name, "DIFFERS", len(got), took, f"{len(a)} vs {len(b)} rows; spark {only_a} sql {only_b} cols {sorted(got.columns)}"
            else:
                yield name, "same", len(got), took, f"sql {sql_took:.1f}s"
        except Exception as exc:  # one broken query must not hide the others
            yield name, "ERROR", 0, time.time() - began, str(exc)[:1500]


def _rows(pdf):
    def norm(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float) and v.is_integer():
            return int(v)
        return str(v) if hasattr(v, "isoformat") else v
    cols = sorted(pdf.columns)
    return sorted((tuple(norm(v) for v in row) for row in pdf[cols].itertuples(index=False)), key=repr)


if __name__ == "__main__":
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for row in compare(session, sys.argv[1], sys.argv[2:] or None):
        bad += row[1] not in ("same", "rows-only")
        print("%-28s %-9s rows=%-7d %5.1fs %s" % row, flush=True)
    print("bad:", bad)
