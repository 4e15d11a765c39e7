"""License scans by template-markup matching.

A template is wording with optional regions and replaceable regions; it is compiled into a token automaton that reads a
text's words. A place is accepted when all mandatory words stand there exactly, in order. A text is only read by the
automaton around places of a template's anchor (its longest run of mandatory words).

One row in, one row out: no shuffle at any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.wordings import WORDINGS

# Phrases whose every place is counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# One-line notices as templates. ((x|y)) is an optional region with alternatives, {n} a replaceable region of up to n words.
NOTICES = (
    ("mit", "((this work is|this software is)) ((released|licensed|distributed)) under the ((terms of the)) mit license"),
    ("apache", "((this work is|this software is)) licensed under the apache license ((version {3}))"),
    ("cc-by-nc", "((this work is)) licensed under ((a|the)) ((creative commons)) cc by nc {2}"),
    ("cc-by-sa", "((this work is)) licensed under ((a|the)) ((creative commons)) cc by sa {2}"),
    ("gnu-gpl", "((this work is|this program is)) licensed under the gnu ((lesser|affero)) general public license ((version {3}))"),
    ("bsd", "((this work is|this software is)) ((released|licensed|distributed)) under the bsd ((2|3)) ((clause)) license"),
)
TEMPLATES = NOTICES + WORDINGS

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Automaton:
    """``arcs[state]``: pairs of a word (None: any) and the next state; ``skips[state]``: states reached without a word."""

    label: str
    arcs: tuple
    skips: tuple
    accept: int
    anchor: bytes
    before: int

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted stretch from ``start``, or -1."""
        states, end, i = self._closed({0}), -1, start
        while states:
            if self.accept in states:
                end = i
            if i >= len(words):
                break
            states = self._closed({t for s in states for word, t in self.arcs[s] if word is None or word == words[i]})
            i += 1
        return end


def compile_template(label: str, text: str) -> Automaton:
    """Read the markup: mandatory words, ``((a|b))`` optional, ``{n}`` any up to n words."""
    arcs: list[list] = [[]]
    skips: list[list] = [[]]
    runs: list[tuple[int, list[str]]] = []  # mandatory runs, with the most words that can stand before them

    def state() -> int:
        arcs.append([])
        skips.append([])
        return len(arcs) - 1

    def words_from(at: int, words: list[str]) -> int:
        for w in words:
            if w.startswith("{"):
                for _ in range(int(w[1:-1])):
                    nxt = state()
                    arcs[at].append((None, nxt))
                    skips[at].append(nxt)
                    at = nxt
            else:
                nxt = state()
                arcs[at].append((w.encode(), nxt))
                at = nxt
        return at

    length = lambda words: sum(int(w[1:-1]) if w.startswith("{") else 1 for w in words)
    at, most, fresh = 0, 0, True
    for part in text.replace("((", "\n((").replace("))", "))\n").split("\n"):
        part = part.strip()
        if part.startswith("(("):
            choices = [c.split() for c in part[2:-2].split("|")]
            out = state()
            skips[at].append(out)
            for c in choices:
                skips[words_from(at, c)].append(out)
            at, most, fresh = out, most + max(map(length, choices)), True
        else:
            for w in part.split():
                if w.startswith("{"):
                    fresh = True
                elif fresh:
                    runs.append((most, [w]))
                    fresh = False
                else:
                    runs[-1][1].append(w)
                at = words_from(at, [w])
                most += length([w])
    before, anchor = max(runs, key=lambda r: len(" ".join(r[1])))
    return Automaton(label, tuple(map(tuple, arcs)), tuple(map(tuple, skips)), at, f" {' '.join(anchor)} ".encode(), before)


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase (with blanks around it) begins."""
    out, at, seen, last = [], joined.find(phrase), 0, 0
    while at >= 0:
        seen += joined.count(b" ", last, at)
        last = at
        out.append(seen)
        at = joined.find(phrase, at + 1)
    return out


def scan_text(text: bytes, automata: list[Automaton]):
    """Word count, places of base phrases, base labels, and accepted template places ``(label, start, end)`` of one text."""
    words = text.translate(_KEEP).split()
    joined = b" " + b" ".join(words) + b" "
    places, base, accepted = [], set(), []
    for phrase, label in BASE:
        if found := _places(joined, f" {phrase} ".encode()):
            places += found
            base.add(label)
    for a in automata:
        taken = -1
        for anchor in _places(joined, a.anchor):
            for start in range(max(0, anchor - a.before, taken), anchor + 1):
                end = a.longest(words, start)
                if end > anchor:
                    accepted.append((a.label, start, end))
                    taken = end
                    break
    return len(words), places, base, accepted


def template_regex(text: str) -> str:
    """The same markup as a regular expression over words with one blank after each, for SQL that states the result independently."""
    words = lambda part: "".join(f"(?:[^ ]+ ){{0,{w[1:-1]}}}" if w.startswith("{") else f"{w} " for w in part.split())
    out = ""
    for i, part in enumerate(re.split(r"\(\((.*?)\)\)", text)):
        out += f"(?:{'|'.join(words(c) for c in part.split('|'))})?" if i % 2 else words(part)
    return f" {out}"


def license_scan(docs: DataFrame, carry: list[str] | None = None, templates=TEMPLATES) -> DataFrame:
    """One row per input row: ``row, n_words, n_base, first_word, last_word, base_labels, labels, score, places``.

    ``places`` lists the accepted template places (label, first word, word after the last). ``score`` is 1 where a whole
    template is accepted, one half where only base phrases stand, else 0.

    Defined cases: a null or empty text has no words, no labels (empty strings) and null first and last word; of
    overlapping places of one template the first and longest is taken; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(*t) for t in templates]
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in b["text"].to_pylist():
                n, places, base, accepted = scan_text(text or b"", automata)
                row = (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {a[0] for a in accepted})), 1.0 if accepted else 0.5 if base else 0.0, [{"label": x, "start": s, "end": e} for x, s, e in accepted])
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([b["row"], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or ["doc_id"])]).alias("row"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, start: bigint, end: bigint>>")
