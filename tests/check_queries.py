"""Run queries against DuckDB by hand: ``python tests/check_queries.py <sf> [name-part …]``."""

import importlib
import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
import oracle  # noqa: E402

from lobspark.session import local_session  # noqa: E402

entry = importlib.import_module("__spark_entry__")


def main() -> int:
    path = f"/root/testdata/sf{sys.argv[1]}"
    want = sys.argv[2:]
    spark = local_session(8)
    con = oracle.connect(path)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if want and not any(w[1:] == name if w.startswith("=") else w in name for w in want):
            continue
        t0 = time.time()
        try:
            df = fn(spark, path)
            rows = [tuple(x) for x in df.collect()]
            t1 = time.time()
            note = None
            if name in sqls:
                cur = con.execute(sqls[name])
                note = oracle.compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())
            t2 = time.time()
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        bad += bool(note)
        flag = "DIFF" if note else ("ok  " if name in sqls else "rows")
        print(f"{flag} {name} n={len(rows)} spark={t1 - t0:.2f}s sql={t2 - t1:.2f}s {note or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
