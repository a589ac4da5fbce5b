"""Run registered queries on Spark and their SQL twins on DuckDB and compare."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(norm(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("--no-oracle", action="store_true")
    args = parser.parse_args()

    import duckdb
    from lectern.plans import registry
    from lectern.session import build_session

    registry.load_all()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    wanted = [w for w in args.only.split(",") if w]
    bad = 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            got = fn(spark, args.sf)
            types = dict(got.dtypes)
            gframe = got.toPandas()
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:500]}")
            continue
        took = time.time() - started
        sql = registry.ORACLES.get(name)
        if sql is None or args.no_oracle:
            print(f"rows {name}: {len(gframe)} rows {took:.2f}s {types if args.show else ''}")
            if args.show:
                print(gframe.head(5).to_string())
            continue
        try:
            started = time.time()
            rel = con.execute(sql)
            wtypes = {d[0]: str(d[1]) for d in rel.description}
            wframe = rel.df()
            dtook = time.time() - started
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: oracle {str(error)[:900]}")
            continue
        gcols, grows = rows_of(gframe)
        wcols, wrows = rows_of(wframe)
        same = gcols == wcols and grows == wrows
        dt = {c: (types[c], wtypes.get(c)) for c in types}
        odd = {c: t for c, t in dt.items() if not compatible(*t)}
        if not same or odd:
            bad += 1
        print(f"{'ok  ' if same and not odd else 'DIFF'} {name}: {len(grows)}/{len(wrows)} rows spark {took:.2f}s duck {dtook:.2f}s {odd or ''}")
        if not len(grows):
            print("     (empty result)")
        if not same:
            print("   cols", gcols, wcols)
            gset, wset = set(map(repr, grows)), set(map(repr, wrows))
            print("   only spark:", [r[:400] for r in sorted(gset - wset)[:3]])
            print("   only duck: ", [r[:400] for r in sorted(wset - gset)[:3]])
        elif args.show:
            print(gframe.head(5).to_string())
    print("bad:", bad)
    return 1 if bad else 0


def compatible(spark_type: str, duck_type: str | None) -> bool:
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]"}
    return pairs.get(spark_type) == duck_type


if __name__ == "__main__":
    raise SystemExit(main())
