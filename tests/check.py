"""Command line twin of the oracle tests: ``python -m tests.check [name ...]``."""

import os
import sys

from fieldmarch.session import local_session
from tests.oracle import compare

if __name__ == "__main__":
    import __spark_entry__ as entry

    spark = local_session(8)
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = [a for a in sys.argv[1:]] or list(entry.queries())
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for pattern in names:
        for name in [n for n in q if n == pattern or (pattern.endswith("*") and n.startswith(pattern[:-1]))]:
            try:
                r = compare(spark, sf, name, q[name], o.get(name))
            except Exception as exc:  # report and go on with the next query
                r = {"name": name, "ok": False, "rows": -1, "sec": 0, "why": str(exc)[:1500]}
            bad += not r["ok"]
            print("ok " if r["ok"] else "BAD", name, r["rows"], f"{r['sec']:.1f}s", f"sql {r.get('sql_sec', 0):.1f}s", r["why"], flush=True)
    print("bad:", bad)
