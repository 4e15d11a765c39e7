"""Language ID with segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's likelihood is the sum over all ways
to cut it into pieces, computed by the forward algorithm; a text's likelihood is the product over its words.

Learning takes every training row: the expected count of a piece is taken over all segmentations (forward and backward pass
with equal piece probabilities), and counts are summed by language and piece, so the model has one number for each
piece and language, however large the corpus. Long words are cut at the last character
that begins within every ``LONGEST`` bytes, so that sums stay in range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import chunks
from lobspark.llm.packing import vocabulary
from lobspark.llm.pieces import by_length, gather, load, steps
from lobspark.llm.words import Words, split_at_space
from lobspark.session import materialize

VOCABULARY = "piece_bpe_32k.model"
TEXT_AT_ONCE = 1_500_000
LONGEST = 40
#: Weight of the all-language distribution, in pieces, and of every piece in it.
PRIOR, EACH = 2000.0, 0.5
#: More labels than this are no set of languages.
MOST_LANGUAGES = 1000


def _parts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) distinct words behind a blank each, cut into parts: buffer, start, end, distinct word of each part."""
    s, e = w.distinct()
    low = w.buffer.copy()
    low[(low >= 65) & (low <= 90)] += 32
    size = e - s + 1
    base = np.cumsum(size) - size
    buffer = np.full(size.sum(), 32, dtype=np.uint8)
    mask = np.ones(len(buffer), dtype=bool)
    mask[base] = False
    buffer[mask] = gather(low, s, e)[0]
    n = -(-size // LONGEST)
    word = np.repeat(np.arange(len(s)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    start = base[word] + k * LONGEST
    for _ in range(3):  # a part begins with a character: back over up to three bytes inside one
        start = start - ((buffer[start] & 0xC0) == 0x80)
    end = np.append(start[1:], len(buffer))  # words stand in a row
    return buffer, start, end, word


def _expected(pieces, w: Words, per_word: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces by language; ``per_word`` has the occurrences of each distinct word by language."""
    out = np.zeros((len(pieces.text), per_word.shape[1]))
    buffer, start, end, word = _parts(w)
    p = 1.0 / len(pieces.text)
    for some in by_length(start, end):
        flat, bounds = gather(buffer, start[some], end[some])
        at, size, ids = pieces.edges(flat, bounds)
        of, order = steps(at, size, bounds)
        last = np.diff(bounds)
        begin = at - bounds[of]
        ahead = np.zeros((last.max() + 1, len(some)))
        back = np.zeros_like(ahead)
        ahead[0], back[last, np.arange(len(some))] = 1, 1
        for g in order:
            ahead[begin[g[0]] + size[g[0]], of[g]] += p * ahead[begin[g[0]], of[g]]
        for g in sorted(order, key=lambda g: -begin[g[0]]):
            # edges with one end and one size also share their beginning
            back[begin[g[0]], of[g]] += p * back[begin[g[0]] + size[g[0]], of[g]]
        share = ahead[begin, of] * p * back[begin + size, of] / ahead[last[of], of]
        share = np.where(np.isfinite(share), share, 0)
        for lang in range(per_word.shape[1]):
            out[:, lang] += np.bincount(ids, weights=share * per_word[word[some]][of, lang], minlength=len(out))
    return out


def _log_likelihood(pieces, w: Words, prob: np.ndarray) -> np.ndarray:
    """Log likelihood of every distinct word in every language, over all its segmentations."""
    buffer, start, end, word = _parts(w)
    out = np.zeros((len(w.first), prob.shape[1]))
    for some in by_length(start, end):
        flat, bounds = gather(buffer, start[some], end[some])
        at, size, ids = pieces.edges(flat, bounds)
        of, order = steps(at, size, bounds)
        last, begin = np.diff(bounds), at - bounds[of]
        ahead = np.zeros((last.max() + 1, len(some), prob.shape[1]))
        ahead[0] = 1
        for g in order:
            ahead[begin[g[0]] + size[g[0]], of[g]] += prob[ids[g]] * ahead[begin[g[0]], of[g]]
        np.add.at(out, word[some], np.log(np.maximum(ahead[last, np.arange(len(some))], 1e-300)))
    return out


def _counts(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path or vocabulary(VOCABULARY))
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b["text"].to_pylist(), b["lang"].to_pylist()
            for i, j in chunks([len(t) + 1 for t in texts], TEXT_AT_ONCE):
                w = split_at_space(texts[i:j])
                if not len(w.start):
                    continue
                names, number = np.unique(langs[i:j], return_inverse=True)
                per_word = np.zeros((len(w.first), len(names)))
                np.add.at(per_word, (w.which, np.repeat(number, np.diff(w.bounds))), 1)
                found = _expected(pieces, w, per_word)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + found[:, k]
        for name, x in total.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(x[some])], names=["lang", "piece", "n"])

    return run


def learn(rows: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces x languages) from rows ``(text, lang)``; rows without either are left out."""
    d = rows.where("text is not null and lang is not null").select(F.col("text").cast("binary").alias("text"), "lang")
    found = materialize(d.mapInArrow(_counts(path), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in found.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    t = found.toPandas()  # at most one row for each piece of the vocabulary and language
    pieces = load(path or vocabulary(VOCABULARY))
    n = np.zeros((len(pieces.text), max(1, len(langs))))
    n[t["piece"].to_numpy(dtype=np.int64), t["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = np.round(t["n"], 6)
    every = n.sum(axis=1, keepdims=True) + EACH
    every /= every.sum()
    return langs, (n + PRIOR * every) / (n.sum(axis=0) + PRIOR)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def identify(docs: DataFrame, langs: list[str], prob: np.ndarray, carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``row, lang_pred, score`` for every row: the likeliest language and its posterior probability.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing was
    learned; ties go to the first language in alphabetical order; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path or vocabulary(VOCABULARY))
        for b in batches:
            texts = [t or b"" for t in (b["text"] if alone else pc.struct_field(b["row"], "text").cast(pa.binary())).to_pylist()]
            pred, score = [], []
            for i, j in chunks([len(t) + 1 for t in texts], TEXT_AT_ONCE):
                w = split_at_space(texts[i:j])
                logs = _log_likelihood(pieces, w, prob)[w.which] if len(w.start) else np.zeros((0, prob.shape[1]))
                of = np.stack([logs[x:y].sum(axis=0) for x, y in zip(w.bounds[:-1], w.bounds[1:])])
                odds = np.exp(of - of.max(axis=1, keepdims=True))
                best = of.argmax(axis=1)
                known = [bool(langs) and _has_letter(t) for t in texts[i:j]]
                pred += [langs[k] if ok else "und" for k, ok in zip(best, known)]
                score += [float(p) if ok else 0.0 for p, ok in zip(odds[np.arange(len(best)), best] / odds.sum(axis=1), known)]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    carry = carry or ["doc_id"]
    alone = "text" not in carry  # a text that is carried is not sent twice
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *([F.col("text").cast("binary").alias("text")] if alone else []))
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """A fifth of the documents, by the checksum of the id, never used for learning; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_id(docs: DataFrame, carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Learn from the labelled rows that are not held out, predict for all: ``row, lang_pred, score``."""
    langs, prob = learn(docs.where(~held_out()).select("text", "lang"), path)
    return identify(docs, langs, prob, carry, path)
