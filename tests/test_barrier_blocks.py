"""Triple barriers over blocks: same labels whatever the block, and as a plain search says."""

import numpy as np
import pandas as pd

from lobspark.operators.labels import triple_barrier


def test_labels_do_not_depend_on_the_block(spark):
    g = np.random.default_rng(9)
    paths, anchors = [], []
    for key, n, span in (("a", 900, 20_000), ("b", 40, 20_000), ("c", 1, 20_000)):
        ts = np.sort(g.choice(span, n, replace=False)) + 1000
        mid = 100 + np.cumsum(g.normal(0, 0.05, n)).round(3)
        paths.append(pd.DataFrame({"k": key, "ts": ts, "mid": mid}))
        for i in g.integers(0, n, 60):
            for name, h in (("short", 50), ("mid", 900), ("long", 15_000)):
                anchors.append((key, int(ts[i]), float(mid[i]), float(g.choice([1.0, 6.0, 40.0, 1e9])), name, h))
    path = pd.concat(paths)
    a = pd.DataFrame(anchors, columns=["k", "t_event", "p0", "width_bps", "horizon", "horizon_ns"]).drop_duplicates(["k", "t_event", "horizon"])
    want = []
    for r in a.itertuples():
        p = path[(path.k == r.k) & (path.ts > r.t_event) & (path.ts <= r.t_event + r.horizon_ns)]
        ret = (p.mid - r.p0) / r.p0 * 1e4
        hit = np.flatnonzero(ret.abs() >= r.width_bps)
        j = hit[0] if len(hit) else -1
        y = ret.iloc[j] if len(ret) else 0.0
        want.append((r.k, r.t_event, r.horizon, y, int(np.sign(y)) if len(hit) else 0, int(p.ts.iloc[j]) if len(hit) else r.t_event + r.horizon_ns))
    want = pd.DataFrame(want, columns=["k", "t_event", "horizon", "y_fwd_bps", "label", "t_barrier"]).sort_values(["k", "t_event", "horizon"]).reset_index(drop=True)
    assert set(want.label) == {-1, 0, 1}
    sp, sa = spark.createDataFrame(path), spark.createDataFrame(a)
    for width in (None, 20_000, 1000, 130):
        got = triple_barrier(sp, sa, ["k"], width).toPandas()[want.columns].sort_values(["k", "t_event", "horizon"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)
