"""Compare every catalogue query with its SQL on DuckDB: names, kinds, row count, values.

    python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import pathlib
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from pitpanel.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return {int: "int", float: "double", str: "text"}.get(type(value), type(value).__name__)


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(row) for row in df.select(*names).collect()]


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], [tuple(row[k] for k in order) for row in cursor.fetchall()]


def compare(query, spark, con, sf: str) -> str:
    names, rows = spark_rows(query.build(spark, sf))
    if query.sql is None:
        return f"rows only ({len(rows)})"
    want_names, want = duck_rows(con, query.sql)
    if names != want_names:
        return f"COLUMNS {names} != {want_names}"
    if len(rows) != len(want):
        return f"ROWS {len(rows)} != {len(want)}"
    for k, name in enumerate(names):
        kinds = {kind(row[k]) for row in rows} - {"null"}
        want_kinds = {kind(row[k]) for row in want} - {"null"}
        if kinds != want_kinds:
            return f"KIND of {name}: {kinds} != {want_kinds}"
    ours, theirs = Counter(map(repr, rows)), Counter(map(repr, want))
    if ours != theirs:
        extra, lacking = list((ours - theirs).elements()), list((theirs - ours).elements())
        return f"VALUES differ in {len(extra)} rows; ours {sorted(extra)[:2]} theirs {sorted(lacking)[:2]}"
    return f"ok ({len(rows)})" if rows else "ok but EMPTY"


def main(argv: list[str]) -> int:
    from pitpanel.catalog import catalog

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries = catalog()
    wanted = argv[1:] or list(queries)
    spark, con, bad = local_session("check", cpus=8), connect(sf), 0
    for name in wanted:
        start = time.time()
        try:
            verdict = compare(queries[name], spark, con, sf)
        except Exception as error:  # report and go on to the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("ok (", "rows only"))
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    spark.stop()
    print(f"{len(wanted) - bad} of {len(wanted)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
