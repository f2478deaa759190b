"""Runs registered queries beside their DuckDB SQL: python tests/oracle.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(frame, sql, connection, places=9):
    """None if equal, else what differs."""
    got = frame.toPandas()
    want = connection.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    text = lambda v: None if v is None or str(v) == "<NA>" or v != v else f"{v:.{places}g}" if isinstance(v, float) else str(v)
    rows = lambda d: sorted((tuple(map(text, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr)
    a, b = rows(got), rows(want)
    kinds = [(c, got[c].dtype, want[c].dtype) for c in sorted(got.columns) if got[c].dtype != want[c].dtype and got[c].dtype != object and got[c].dtype.kind != "M"]
    if kinds:
        return f"types {kinds}"
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only in one: {only}"
    return None


def main(sf, names):
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            said = compare(queries[name](spark, sf), oracles[name], c) if name in oracles else f"no SQL, {len(queries[name](spark, sf).collect())} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not str(said).startswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
