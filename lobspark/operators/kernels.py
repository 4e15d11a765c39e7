"""Vectorised numpy helpers used inside tasks, on one Arrow batch at a time."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).min


class Side:
    """One side of a book: sorted ticks and their sizes. ``sign`` is +1 for bids, -1 for asks."""

    def __init__(self, sign: int):
        self.sign = sign
        self.tick = np.empty(0, np.int64)
        self.size = np.empty(0, np.float64)

    def reset(self, tick, size) -> None:
        o = np.argsort(tick, kind="stable")
        self.tick, self.size = np.asarray(tick, np.int64)[o], np.asarray(size, np.float64)[o]

    def best(self) -> int:
        if len(self.tick) == 0:
            return NONE
        return int(self.tick[-1] if self.sign > 0 else self.tick[0])

    def prepare(self, pos, tick, size) -> "Block":
        return Block(self, np.asarray(pos, np.int64), np.asarray(tick, np.int64), np.asarray(size, np.float64))


class Block:
    """Events of one side inside a block of ``n`` merged events; position p = state after p events."""

    def __init__(self, side: Side, pos, tick, size):
        self.side, self.pos, self.size = side, pos, size
        self.univ = np.unique(np.concatenate([side.tick, tick]))
        self.lvl = np.searchsorted(self.univ, tick)
        self.init = np.zeros(len(self.univ))
        self.init[np.searchsorted(self.univ, side.tick)] = side.size

    def best_path(self, n: int) -> np.ndarray:
        """Best tick after each of 0..n events (``NONE`` if the side is empty).

        Every level's live stretch is a half-open interval of positions; the best price is the
        maximum over covering intervals, filled by doubling (sparse-table) chmax.
        """
        sign = self.side.sign
        alive0 = np.flatnonzero(self.init > 0)
        o = np.lexsort((self.pos, self.lvl))
        lv, ps, sz = self.lvl[o], self.pos[o] + 1, self.size[o]
        nxt = np.full(len(o), n + 1, np.int64)
        if len(o) > 1:
            same = lv[1:] == lv[:-1]
            nxt[:-1][same] = ps[1:][same]
        first = np.full(len(self.univ), n + 1, np.int64)
        if len(o):
            head = np.concatenate([[True], lv[1:] != lv[:-1]])
            first[lv[head]] = ps[head]
        keep = sz > 0
        a = np.concatenate([np.zeros(len(alive0), np.int64), ps[keep]])
        b = np.concatenate([first[alive0], nxt[keep]])
        v = sign * self.univ[np.concatenate([alive0, lv[keep]])]
        ok = b > a
        a, b, v = a[ok], b[ok], v[ok]
        m = n + 1
        levels = max(1, int(m).bit_length())
        table = np.full((levels, m), NONE, np.int64)
        if len(a):
            j = np.floor(np.log2(b - a)).astype(np.int64)
            np.maximum.at(table, (j, a), v)
            np.maximum.at(table, (j, b - (1 << j)), v)
        for lvl in range(levels - 1, 0, -1):
            h = 1 << (lvl - 1)
            np.maximum(table[lvl - 1], table[lvl], out=table[lvl - 1])
            np.maximum(table[lvl - 1][h:], table[lvl][:-h], out=table[lvl - 1][h:])
        out = table[0]
        return np.where(out == NONE, NONE, sign * out)

    def top(self, probe_pos: np.ndarray, k: int, chunk: int = 256):
        """Top-k ``(tick, size, live level count)`` of the state after ``probe_pos`` events."""
        p_all = np.asarray(probe_pos, np.int64)
        ticks = np.full((len(p_all), k), NONE, np.int64)
        sizes = np.full((len(p_all), k), np.nan)
        depth = np.zeros(len(p_all), np.int64)
        order = np.argsort(p_all, kind="stable")
        state = self.init.copy()
        done = 0
        flip = self.side.sign > 0
        for lo in range(0, len(order), chunk):
            idx = order[lo : lo + chunk]
            pp = p_all[idx]
            hi = np.searchsorted(self.pos, pp[-1], side="left")
            lv, sz, ps = self.lvl[done:hi], self.size[done:hi], self.pos[done:hi]
            last = np.full((len(idx), len(self.univ)), -1, np.int64)
            row = np.searchsorted(pp, ps + 1, side="left")
            np.maximum.at(last, (row, lv), np.arange(len(lv)))
            np.maximum.accumulate(last, axis=0, out=last)
            szx = np.append(sz, 0.0)
            dense = np.where(last >= 0, szx[last], state)
            state = dense[-1].copy()
            done = hi
            live = dense > 0
            depth[idx] = live.sum(axis=1)
            view = live[:, ::-1] if flip else live
            r, c = np.nonzero(view)
            start = np.searchsorted(r, np.arange(len(idx)), side="left")
            rk = np.arange(len(r)) - start[r]
            sel = rk < k
            r, c, rk = r[sel], c[sel], rk[sel]
            col = len(self.univ) - 1 - c if flip else c
            ticks[idx[r], rk] = self.univ[col]
            sizes[idx[r], rk] = dense[r, col]
        return ticks, sizes, depth

    def apply_until(self, n: int) -> None:
        """Advance the side past the first ``n`` positions of the block."""
        hi = np.searchsorted(self.pos, n, side="left")
        state = self.init.copy()
        state[self.lvl[:hi]] = self.size[:hi]
        live = state > 0
        self.side.tick, self.side.size = self.univ[live], state[live]
