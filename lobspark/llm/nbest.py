"""N-best piece segmentation: forward Viterbi scores are exact heuristics of a backward A* search over the piece lattice.

No piece reaches across the first blank of a run of blanks, so a text's lattice is a chain of small lattices. Best
segmentations of all distinct parts come from one forward pass over many parts side by side; a backward pass
tells how much a part's second best costs. The N best of a text can differ from its best only in the N-1 places where a
change is cheapest: only those parts are searched with A*, and their lists are combined.

The vocabulary is a public one made for merging; its scores (minus the merge rank) are taken as additive. Characters
without a piece become byte pieces, so decoding gives every text back exactly.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobspark.llm.common import chunks
from lobspark.llm.packing import vocabulary
from lobspark.llm.pieces import Pieces, by_length, gather, load, steps
from lobspark.llm.words import ragged, split_before_blanks

VOCABULARY = "piece_bpe_32k.model"
TEXT_AT_ONCE = 3_000_000


def best_parts(pieces: Pieces, buffer: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Best score of every part, what its second best costs (infinite if it has none), its best ids and their bounds."""
    n = len(start)
    score, cost = np.zeros(n), np.full(n, np.inf)
    who, rank, chosen = [], [], []
    for some in by_length(start, end):
        flat, bounds = gather(buffer, start[some], end[some])
        at, size, ids = pieces.edges(flat, bounds)
        of, order = steps(at, size, bounds)
        last, begin, value = np.diff(bounds), at - bounds[of], pieces.score[ids]
        lane = np.arange(len(some))
        ahead = np.full((last.max() + 1, len(some)), -np.inf)
        back, via = np.full_like(ahead, -np.inf), np.zeros(ahead.shape, dtype=np.int64)
        ahead[0], back[last, lane] = 0, 0
        for g in order:
            b = begin[g[0]]
            e, new = b + size[g[0]], ahead[b, of[g]] + value[g]
            up = new > ahead[e, of[g]]
            ahead[e, of[g[up]]], via[e, of[g[up]]] = new[up], g[up]
        for g in sorted(order, key=lambda g: -begin[g[0]]):
            b = begin[g[0]]
            back[b, of[g]] = np.maximum(back[b, of[g]], value[g] + back[b + size[g[0]], of[g]])
        on_path = np.zeros(len(at), dtype=bool)
        place, k = last.copy(), 0
        live = lane
        while len(live):
            e = via[place[live], live]
            on_path[e] = True
            who.append(some[live])
            rank.append(np.full(len(live), -k))
            chosen.append(ids[e])
            place[live] = begin[e]
            live = live[place[live] > 0]
            k += 1
        total = ahead[last, lane]
        through = ahead[begin, of] + value + back[begin + size, of]
        other = np.full(len(some), -np.inf)
        np.maximum.at(other, of[~on_path], through[~on_path])
        score[some], cost[some] = total, total - other
    if not who:
        return score, cost, np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    who, rank, chosen = np.concatenate(who), np.concatenate(rank), np.concatenate(chosen)
    order = np.lexsort((rank, who))
    return score, cost, chosen[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])


def search(pieces: Pieces, part: bytes, most: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``most`` best segmentations of a part, best first: A* from the end, guided by exact scores from the beginning.

    A heap entry holds its last step, linked to the step before it, so memory grows with the length of the part. Of equal
    scores the entry nearer to the beginning is followed first, then the one pushed first; the segmentations found are given by score, then by ids.
    """
    ending: list[list[tuple[int, int, float]]] = [[] for _ in range(len(part) + 1)]
    for a, s, i in pieces.edges_of_one(part):
        ending[a + s].append((a, i, float(pieces.score[i])))
    ahead = [0.0] + [-np.inf] * len(part)
    for e in range(1, len(part) + 1):
        for a, _, v in ending[e]:
            ahead[e] = max(ahead[e], ahead[a] + v)
    heap: list[tuple[float, int, int, float, tuple | None]] = [(-ahead[-1], len(part), 0, 0.0, None)]
    pushed = 0
    out: list[tuple[float, tuple[int, ...]]] = []
    while heap and len(out) < most:
        f, place, _, done, step = heapq.heappop(heap)
        if place == 0:
            ids = []
            while step is not None:
                i, step = step
                ids.append(i)
            out.append((-f, tuple(ids)))
            continue
        for a, i, v in ending[place]:
            if ahead[a] > -np.inf:
                pushed += 1
                heapq.heappush(heap, (-(done + v + ahead[a]), a, pushed, done + v, (i, step)))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def combined(lists: list[list[tuple[float, tuple[int, ...]]]], most: int) -> list[tuple[float, tuple[int, ...]]]:
    """The best choices of one entry from each list: what each choice loses against the best, and the entries' numbers."""
    seen = {(0,) * len(lists)}
    heap = [(0.0, (0,) * len(lists))]
    out = []
    while heap and len(out) < most:
        loss, at = heapq.heappop(heap)
        out.append((loss, at))
        for k, choices in enumerate(lists):
            nxt = (*at[:k], at[k] + 1, *at[k + 1 :])
            if nxt[k] < len(choices) and nxt not in seen:
                seen.add(nxt)
                heapq.heappush(heap, (sum(c[0][0] - c[i][0] for c, i in zip(lists, nxt)), nxt))
    return out


def _answers(pieces: Pieces, texts: list[bytes], most: int) -> list[list[tuple[float, np.ndarray]]]:
    """For every text its best segmentations, best first: score and ids."""
    w = split_before_blanks(texts)
    s, e = w.distinct()
    score, cost, ids, bounds = best_parts(pieces, w.buffer, s, e)
    size = np.diff(bounds)[w.which]
    flat = ids[ragged(bounds[w.which], size)].astype("<i4")
    ends = np.concatenate([[0], np.cumsum(size)])
    found: dict[int, list] = {}
    out = []
    for d in range(len(texts)):
        x, y = w.bounds[d], w.bounds[d + 1]
        if x == y:
            out.append([(0.0, flat[:0])])
            continue
        which = w.which[x:y]
        losses = cost[which]
        cheap = np.argsort(losses, kind="stable")[: most - 1]
        cheap = np.sort(cheap[np.isfinite(losses[cheap])])
        lists = []
        for k in cheap:
            p = int(which[k])
            if p not in found:
                # of several best ones, the one of the forward pass is choice 0
                one, own = search(pieces, w.buffer[s[p] : e[p]].tobytes(), most), tuple(ids[bounds[p] : bounds[p + 1]].tolist())
                found[p] = [(one[0][0], own), *(x for x in one if x[1] != own)][:most]
            lists.append(found[p])
        best = float(score[which].sum())
        whole = flat[ends[x] : ends[y]]
        answers = []
        for loss, at in combined(lists, most):
            cuts, last = [], 0
            for k, choice, options in zip(cheap, at, lists):
                if choice:
                    cuts += [whole[last : ends[x + k] - ends[x]], np.array(options[choice][1], dtype="<i4")]
                    last = ends[x + k + 1] - ends[x]
            answers.append((best - loss, np.concatenate([*cuts, whole[last:]]) if cuts else whole))
        out.append(answers)
    return out


def _encoder(path: str | None, most: int, finish):
    """Batches of ``finish(pieces, texts, answers)``'s columns behind ``row``, some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path or vocabulary(VOCABULARY))
        for b in batches:
            texts = [t or b"" for t in b["text"].to_pylist()]
            for i, j in chunks([len(t) + 1 for t in texts], TEXT_AT_ONCE):
                names, columns = finish(pieces, texts[i:j], _answers(pieces, texts[i:j], most))
                yield pa.RecordBatch.from_arrays([b["row"].slice(i, j - i), *columns], names=["row", *names])

    return run


def _as_lists(pieces: Pieces, texts: list[bytes], answers: list) -> tuple[list[str], list]:
    flat = [x for found in answers for x in found]
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[1]) for x in flat)]), pa.int32()), pa.array(np.concatenate([x[1] for x in flat])))
    both = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.float64()), ids], names=["score", "ids"])
    return ["segmentations"], [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, answers)]), pa.int32()), both)]


def _as_digests(pieces: Pieces, texts: list[bytes], answers: list) -> tuple[list[str], list]:
    cols: list[list] = [[] for _ in range(8)]
    for text, found in zip(texts, answers):
        every = 0
        for _, ids in found:
            every = zlib.crc32(ids.tobytes(), every)
        want = b" " + text if text else b""
        same = all(b"".join(map(pieces.text.__getitem__, ids.tolist())) == want for _, ids in found)
        for col, v in zip(cols, (len(text.decode()), len(found[0][1]), found[0][0], len(found), found[-1][0], zlib.crc32(found[0][1].tobytes()), every, same)):
            col.append(v)
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    return ["n_chars", "n_pieces", "best_score", "n_found", "last_score", "ids_crc32", "nbest_crc32", "round_trip"], [pa.array(c, t) for c, t in zip(cols, kinds)]


def _encoded(docs: DataFrame, carry: list[str] | None, kinds: str, run) -> DataFrame:
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or ["doc_id"])]).alias("row"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, {kinds}")


def encode(docs: DataFrame, most: int = 4, carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``row, segmentations``: the ``most`` best segmentations of every text, best first, with scores and piece ids.

    Defined cases: a null or empty text has the one segmentation without pieces; of equal scores found, the smaller ids
    come first within a part (``search`` tells which are found); fewer segmentations than asked for are given where no more exist; an empty table gives no rows.
    """
    return _encoded(docs, carry, "segmentations array<struct<score: double, ids: array<int>>>", _encoder(path, most, _as_lists))


def decode(df: DataFrame, column: str = "ids", path: str | None = None) -> DataFrame:
    """All columns and ``decoded``, the text (binary) that the piece ids in ``column`` stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path or vocabulary(VOCABULARY))
        for b in batches:
            out = [None if ids is None else b"".join(map(pieces.text.__getitem__, ids))[1:] for ids in b[column].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encode_digests(docs: DataFrame, most: int = 4, carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``encode`` with digests in place of ids: ``row, n_chars, n_pieces, best_score, n_found, last_score, ids_crc32, nbest_crc32, round_trip``.

    The checksums are over little-endian 32-bit ids: of the best, and of all segmentations one after another.
    ``round_trip``: every segmentation decodes to the text.
    """
    kinds = "n_chars long, n_pieces long, best_score double, n_found int, last_score double, ids_crc32 long, nbest_crc32 long, round_trip boolean"
    return _encoded(docs, carry, kinds, _encoder(path, most, _as_digests))
