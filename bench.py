"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lobspark.plans import catalog
from lobspark.plans.tables import Tables
from lobspark.session import clear_intermediates, local_session

#: Headline queries and the rows that each of them goes through.
HEADLINE = {"book_asof_grid": "deltas_clean", "dollar_bars": "trades", "triple_barrier": "trades", "trade_day_metrics": "trades", "cpcv_splits": "orders", "book_replay_seeded": "deltas"}


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    t = Tables(spark, path)
    rows = {x: (t.raw(x) if x == "orders" else getattr(t, x)).count() for x in set(HEADLINE.values())}  # also starts the readers
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        clear_intermediates(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows_per_sec": {q: round(rows[HEADLINE[q]] / s) for q, s in times.items()}, "sf": os.path.basename(path.rstrip("/"))}))


if __name__ == "__main__":
    main()
