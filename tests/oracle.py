"""Run a registered query and its SQL side by side and compare rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", repr(v + 0.0))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return v


def compare(spark, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    spent = time.time() - start
    if sql is None:
        return {"name": name, "ok": len(got) > 0, "rows": len(got), "sec": spent, "why": "rows only"}
    start = time.time()
    cur = connect(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    dtypes = {x[0]: str(x[1]) for x in cur.description}
    if sorted(names) != cols:
        return {"name": name, "ok": False, "rows": len(got), "sec": spent, "why": f"columns {cols} vs {sorted(names)}"}
    order = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    sql_sec = time.time() - start
    bad_types = [(c, types[c], dtypes[c]) for c in cols if KINDS.get(types[c], types[c]) != dtypes[c]]
    why = ""
    if got != want:
        extra = [g for g in got if g not in set(want)][:3] if len(got) < 60000 else got[:2]
        missing = [w for w in want if w not in set(got)][:3] if len(want) < 60000 else want[:2]
        why = f"rows {len(got)} vs {len(want)}; cols {cols}; only spark {extra}; only sql {missing}"
    elif bad_types:
        why = f"types {bad_types}"
    return {"name": name, "ok": not why, "rows": len(got), "sec": spent, "sql_sec": sql_sec, "why": why}
