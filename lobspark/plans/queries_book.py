"""Queries over reconstructed books."""

from pyspark.sql import functions as F

from lobspark.operators import book as B
from lobspark.operators.ordered import asof
from lobspark.operators.stats import abs_stats
from lobspark.plans.common import r
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, Tables, sql, topk_fragment
from lobspark.session import DAY_NS, materialize

LEVELS = [f"{s}_{i}_{f}" for s in ("bid", "ask") for i in range(2) for f in ("price", "size")]
TOPK = (
    "symbol, sample_ts, round(mid,6)+0.0 mid, round(microprice,6)+0.0 microprice, bid_depth, ask_depth, "
    + ", ".join(LEVELS)
)


def rounded_topk(df):
    return df.withColumns({"mid": r("mid"), "microprice": r("microprice")})


FRAGMENTS["book_at_trades_v"] = (
    ("deltas_clean_v", "trades_v"),
    topk_fragment("deltas_clean_v", grid="trades_v", ts="origin_ns"),
)
FRAGMENTS["quotes_v"] = (
    ("deltas_clean_v",),
    "SELECT symbol, origin_ns ts, bid_0_price best_bid, ask_0_price best_ask FROM ("
    + topk_fragment("deltas_clean_v", grid="deltas_clean_v", ts="origin_ns", k=1)
    + ")",
)
FRAGMENTS["opens_grid_v"] = (("days_v",), "SELECT symbol, dt, epoch_us(cast(dt AS timestamp))*1000 ts FROM days_v")
FRAGMENTS["opens_v"] = (
    ("deltas_clean_v", "opens_grid_v"),
    "SELECT q.symbol, o.dt, q.ts, bid_0_price best_bid, ask_0_price best_ask FROM ("
    + topk_fragment("deltas_clean_v", grid="opens_grid_v", ts="ts", k=1)
    + ") q JOIN opens_grid_v o USING (symbol, ts)",
)
FRAGMENTS["mid_path_v"] = (
    ("quotes_v", "opens_v"),
    """SELECT symbol, ts, arg_max(mid, k) mid FROM (
        SELECT symbol, ts, (best_bid+best_ask)/2.0::DOUBLE mid, 1 k FROM quotes_v WHERE best_bid < best_ask
        UNION ALL SELECT symbol, ts, (best_bid+best_ask)/2.0::DOUBLE, 0 FROM opens_v WHERE best_bid < best_ask)
       GROUP BY 1, 2""",
)
FRAGMENTS["invalid_v"] = (
    ("quotes_v", "opens_v"),
    f"""WITH p AS (
        SELECT symbol, cast(make_timestamp(ts//1000) AS date) dt, ts, arg_max(coalesce(b < a, false), k) valid FROM (
          SELECT symbol, ts, best_bid b, best_ask a, 1 k FROM quotes_v
          UNION ALL SELECT symbol, ts, best_bid, best_ask, 0 FROM opens_v) GROUP BY 1, 2, 3),
      c AS (SELECT *, coalesce(lag(valid) OVER w, NOT valid) <> valid chg FROM p WINDOW w AS (PARTITION BY symbol, dt ORDER BY ts)),
      s AS (SELECT symbol, dt, ts start_ns, valid,
                   coalesce(lead(ts) OVER (PARTITION BY symbol, dt ORDER BY ts), epoch_us(cast(dt AS timestamp))*1000+{DAY_NS}) end_ns
            FROM c WHERE chg)
      SELECT symbol, dt, start_ns, end_ns FROM s WHERE NOT valid""",
)


@query("book_asof_grid", sql(f"SELECT {TOPK} FROM topk_a", "topk_a"))
def book_asof_grid(t: Tables):
    return rounded_topk(t.topk_a)


@query("book_asof_grid_crossed", sql(f"SELECT {TOPK} FROM topk_b", "topk_b"))
def book_asof_grid_crossed(t: Tables):
    return rounded_topk(t.topk_b)


@query(
    "book_at_trades",
    sql(
        f"""SELECT t.symbol, t.origin_ns, t.seq, t.side, t.quantity, t.price,
            {TOPK.replace('symbol, sample_ts, ', '')}
            FROM book_at_trades_v b JOIN trades_v t USING (symbol, origin_ns)""",
        "book_at_trades_v",
    ),
)
def book_at_trades(t: Tables):
    out = B.book_asof(
        t.deltas_clean,
        t.trades,
        k=2,
        probe_ts="origin_ns",
        probe_seq="seq",
        carry={"side": "string", "price": "double", "quantity": "double"},
    )
    return rounded_topk(out)


@query(
    "merge_events",
    sql(
        """SELECT symbol, origin_ns, kind, seq, side, tick, amount,
                  row_number() OVER (PARTITION BY symbol ORDER BY origin_ns, kind, seq) pos
           FROM (SELECT symbol, origin_ns, 0::BIGINT kind, seq, side, tick, size amount FROM deltas_v
                 UNION ALL SELECT symbol, origin_ns, 1, seq, side, tick, quantity FROM trades_v)""",
        "deltas_v",
        "trades_v",
    ),
)
def merge_events(t: Tables):
    from lobspark.operators.ordered import rank

    m = B.merge_events(t.deltas, t.trades).drop("dt", "received_ns")
    return rank(m, ["symbol"], ["origin_ns", "kind", "seq"], name="pos")


@query(
    "level_intervals",
    sql(
        """SELECT symbol, side, tick, size, origin_ns valid_from, nxt valid_to FROM (
             SELECT *, lead(origin_ns) OVER (PARTITION BY symbol, side, tick ORDER BY origin_ns, seq) nxt FROM deltas_v)
           WHERE size > 0 AND (nxt IS NULL OR nxt > origin_ns)""",
        "deltas_v",
    ),
)
def level_intervals(t: Tables):
    return B.level_intervals(t.deltas)


@query(
    "book_metrics",
    sql(
        """SELECT symbol, sample_ts, bid_0_price best_bid, ask_0_price best_ask, round((bid_0_price+ask_0_price)/2,6)+0.0 mid,
             round((ask_0_size*bid_0_price+bid_0_size*ask_0_price)/(bid_0_size+ask_0_size),6)+0.0 microprice,
             round(ask_0_price-bid_0_price,6)+0.0 spread
           FROM topk_b""",
        "topk_b",
    ),
)
def book_metrics(t: Tables):
    m = t.topk_b.withColumns(B.touch_metrics())
    return m.select(
        "symbol", "sample_ts", F.col("bid_0_price").alias("best_bid"), F.col("ask_0_price").alias("best_ask"),
        r("mid").alias("mid"), r("microprice").alias("microprice"),
        r(F.col("ask_0_price") - F.col("bid_0_price")).alias("spread"),
    )


@query(
    "topk_wide",
    sql(
        """SELECT symbol, side, tick, size, rn FROM (
             SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side='bid' THEN -tick ELSE tick END) rn
             FROM (SELECT symbol, side, tick, arg_max(size, row(origin_ns, seq)) size FROM deltas_v GROUP BY 1,2,3)
             WHERE size > 0) WHERE rn <= 5""",
        "deltas_v",
    ).replace(
        "SELECT symbol, side, tick, size, rn FROM (",
        "SELECT symbol, "
        + ", ".join(
            f"max({c}) FILTER (WHERE side='{s}' AND rn={i + 1}) {s}_{i}_{n}"
            for s in ("bid", "ask")
            for i in range(5)
            for n, c in (("price", "tick/100.0::DOUBLE"), ("size", "size"))
        )
        + " FROM (",
        1,
    )
    + " GROUP BY symbol",
)
def topk_wide(t: Tables):
    from pyspark.sql.window import Window as W

    levels = t.deltas.groupBy("symbol", "side", "tick").agg(F.max_by("size", F.struct("origin_ns", "seq")).alias("size"))
    key = F.when(F.col("side") == "bid", -F.col("tick")).otherwise(F.col("tick"))
    top = (
        levels.filter("size > 0")
        .withColumn("rn", F.row_number().over(W.partitionBy("symbol", "side").orderBy(key)))
        .filter("rn <= 5")
    )
    cols = []
    for s in ("bid", "ask"):
        for i in range(5):
            hit = (F.col("side") == s) & (F.col("rn") == i + 1)
            cols.append(F.max(F.when(hit, F.col("tick") / 100.0)).alias(f"{s}_{i}_price"))
            cols.append(F.max(F.when(hit, F.col("size"))).alias(f"{s}_{i}_size"))
    return top.groupBy("symbol").agg(*cols)


@query(
    "seq_anomalies",
    sql(
        """SELECT symbol, count(*) n_deltas, count(*) FILTER (WHERE seq <= p) n_anomalies FROM (
             SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY received_ns, origin_ns) p FROM deltas_v) GROUP BY 1""",
        "deltas_v",
    ),
)
def seq_anomalies(t: Tables):
    return B.seq_anomalies(t.deltas.withColumn("pos", F.col("origin_ns")), ts="received_ns")


@query(
    "book_top_validity",
    sql(
        """SELECT symbol, sample_ts, CASE WHEN bid_0_price IS NULL AND ask_0_price IS NULL THEN 'missing_book'
             WHEN bid_0_price IS NULL OR ask_0_price IS NULL THEN 'one_sided_book'
             WHEN bid_0_price >= ask_0_price THEN 'crossed_book' ELSE 'ok' END validity FROM topk_b""",
        "topk_b",
    ),
)
def book_top_validity(t: Tables):
    return t.topk_b.select("symbol", "sample_ts", B.top_validity().alias("validity"))


@query("true_mid_path", sql("SELECT symbol, ts, round(mid,6)+0.0 mid FROM mid_path_v", "mid_path_v"))
def true_mid_path(t: Tables):
    return B.coalesce_path(t.mid_points).select("symbol", "ts", r("mid").alias("mid"))


@query("book_invalid_intervals", sql("SELECT * FROM invalid_v", "invalid_v"))
def book_invalid_intervals(t: Tables):
    return B.invalid_intervals(t.stored("quotes"), t.stored("opens"))


@query(
    "quote_asof_compare",
    sql(
        """SELECT symbol, count(d) n, round(quantile_cont(d,0.5),6)+0.0 median, round(avg(d),6)+0.0 mean,
             round(quantile_cont(d,0.95),6)+0.0 p95, round(quantile_cont(d,0.99),6)+0.0 p99, round(max(d),6)+0.0 max, round(corr(a,b),6)+0.0 corr
           FROM (SELECT g.symbol, p.mid a, t.price b, abs(p.mid-t.price) d FROM grid_v g
                 ASOF JOIN mid_path_v p ON p.symbol=g.symbol AND p.ts<=g.sample_ts
                 ASOF JOIN trades_v t ON t.symbol=g.symbol AND t.origin_ns<=g.sample_ts) GROUP BY symbol""",
        "grid_v",
        "mid_path_v",
        "trades_v",
    ),
)
def quote_asof_compare(t: Tables):
    a = asof(
        t.grid, B.coalesce_path(t.stored("mid_points")), ["symbol"], left_ts="sample_ts", right_ts="ts", cols={"a": F.col("mid")}
    )
    ab = asof(
        materialize(a), t.trades, ["symbol"], left_ts="sample_ts", right_ts="origin_ns", right_order=["seq"], cols={"b": F.col("price")}
    ).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ab = materialize(ab)
    s = abs_stats(ab, ["symbol"], {"d": F.abs(F.col("a") - F.col("b"))})
    c = ab.groupBy("symbol").agg(F.corr("a", "b").alias("corr"))
    return s.join(c, "symbol").select(
        "symbol", "n", *[r(x).alias(x) for x in ("median", "mean", "p95", "p99", "max", "corr")]
    )


@query(
    "snapshot_lookup_asof",
    sql(
        """SELECT t.symbol, t.seq, t.origin_ns, s.sample_ts snapshot_ts, s.bid_0_price, s.ask_0_price FROM trades_v t
           ASOF LEFT JOIN topk_a s ON s.symbol=t.symbol AND s.sample_ts<=t.origin_ns""",
        "trades_v",
        "topk_a",
    ),
)
def snapshot_lookup_asof(t: Tables):
    return asof(
        t.trades.select("symbol", "seq", "origin_ns"),
        t.topk_a,
        ["symbol"],
        left_ts="origin_ns",
        right_ts="sample_ts",
        cols={"snapshot_ts": F.col("sample_ts"), "bid_0_price": F.col("bid_0_price"), "ask_0_price": F.col("ask_0_price")},
    )


@query(
    "snapshots_from_topk",
    sql(
        """SELECT symbol, count(*) n_samples, count(*) FILTER (WHERE p IS DISTINCT FROM c) n_changed,
             round(count(*) FILTER (WHERE p IS DISTINCT FROM c) / count(*)::DOUBLE, 6) changed_fraction FROM (
           SELECT symbol, c, lag(c) OVER (PARTITION BY symbol ORDER BY sample_ts) p FROM (
             SELECT symbol, sample_ts, row(%s) c FROM topk_a)) GROUP BY symbol"""
        % ", ".join(LEVELS),
        "topk_a",
    ),
)
def snapshots_from_topk(t: Tables):
    from lobspark.operators.ordered import shift

    cur = t.topk_a.select("symbol", "sample_ts", F.struct(*LEVELS).alias("c"))
    cur = shift(cur, ["symbol"], ["sample_ts"], {"p": F.col("c")})
    changed = F.count_if(~F.col("p").eqNullSafe(F.col("c")))
    return cur.groupBy("symbol").agg(
        F.count("*").alias("n_samples"),
        changed.alias("n_changed"),
        F.round(changed / F.count("*"), 6).alias("changed_fraction"),
    )


@query(
    "book_at_instant",
    sql(
        """SELECT symbol, side, tick, size FROM (
             SELECT symbol, side, tick, arg_max(size, row(origin_ns, seq)) size FROM deltas_v
             WHERE origin_ns <= 1705320000000000000 GROUP BY 1,2,3) WHERE size > 0""",
        "deltas_v",
    ),
)
def book_at_instant(t: Tables):
    return B.book_at_instant(t.deltas, F.lit(1_705_320_000_000_000_000))

