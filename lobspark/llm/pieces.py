"""A fixed public piece vocabulary and the lattice of its pieces over many words at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from lobspark.llm.common import Rolling, mix
from lobspark.llm.words import LIFT, ragged

_BASE = 0xC2B2AE3D27D4EB4F


class Pieces:
    """Pieces as bytes, ``▁`` as one blank. Pieces for single bytes stand only where a character has no piece of its own.

    ``score`` of a byte piece is ``byte_cost`` below the lowest score of the vocabulary.
    """

    def __init__(self, path: str, byte_cost: float = 10.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [b""] * n
        self.score = np.zeros(n)
        for i in range(n):
            if model.is_byte(i):
                self.text[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.text[i] = model.id_to_piece(i).replace("▁", " ").encode()
            self.score[i] = model.get_score(i)
        is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.byte = np.full(256, -1)
        for i in np.flatnonzero(is_byte):
            self.byte[self.text[i][0]] = i
        real = [i for i in range(n) if self.text[i] and not is_byte[i]]
        # scores of pieces that cannot be merged (single characters of a merge vocabulary) are no probabilities: they rank last
        floor = self.score[real][self.score[real] > -1e8].min()
        self.score[real] = np.maximum(self.score[real], floor - 1)
        self.score[is_byte] = floor - 1 - byte_cost
        self.by_text = {self.text[i]: i for i in real}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(self.text[i]) for i in real}):
            ids = np.array([i for i in real if len(self.text[i]) == size])
            flat = LIFT[np.frombuffer(b"".join(self.text[i] for i in ids), dtype=np.uint8)]
            at = np.arange(len(ids)) * size
            h = Rolling(flat, _BASE).stretches(at, at + size)
            order = np.argsort(h)
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[h & np.uint64(0xFFFF)] = True
            self.tables[size] = h[order], ids[order], maybe
        self.longest = max(self.tables)

    def edges(self, buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, sizes and ids of all pieces in a row of words; ``bounds`` are the words' ends, from 0."""
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(buffer))  # bytes up to the word's end
        roll = Rolling(LIFT[buffer], _BASE)
        at, sizes, ids = [], [], []
        for size, (known, names, maybe) in self.tables.items():
            if size > len(buffer):
                break
            start = np.flatnonzero(left >= size)
            h = roll.stretches(start, start + size)
            some = maybe[h & np.uint64(0xFFFF)]
            start, h = start[some], h[some]
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[i] == h
            at.append(start[hit])
            sizes.append(np.full(hit.sum(), size))
            ids.append(names[i[hit]])
        at, sizes, ids = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (at, sizes, ids))
        # characters without a piece: their bytes stand alone
        lead = (buffer & 0xC0) != 0x80
        head = np.flatnonzero(lead)
        width = np.diff(np.append(head, len(buffer)))
        char = np.zeros(len(buffer), dtype=np.int64)
        char[head] = width
        own = np.zeros(len(buffer), dtype=bool)
        own[at[sizes == char[at]]] = True
        lone = ~own[head]
        bare = ragged(head[lone], width[lone])
        return np.concatenate([at, bare]), np.concatenate([sizes, np.ones(len(bare), dtype=np.int64)]), np.concatenate([ids, self.byte[buffer[bare]]])


    def edges_of_one(self, word: bytes) -> list[tuple[int, int, int]]:
        """The same for one short word, as (place, size, id)."""
        out = []
        for a in range(len(word)):
            for size in self.tables:
                if size > len(word) - a:
                    break
                i = self.by_text.get(word[a : a + size])
                if i is not None:
                    out.append((a, size, i))
            if word[a] & 0xC0 != 0x80:
                end = a + 1
                while end < len(word) and word[end] & 0xC0 == 0x80:
                    end += 1
                if word[a:end] not in self.by_text:
                    out += [(k, 1, int(self.byte[word[k]])) for k in range(a, end)]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def steps(at: np.ndarray, size: np.ndarray, bounds: np.ndarray):
    """Edges in the order of a forward pass over all words side by side: groups with one end and one size, so no word is met twice."""
    word = np.searchsorted(bounds, at, side="right") - 1
    end = at + size - bounds[word]
    key = end * (size.max() + 1 if len(size) else 1) + size
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.diff(key)) + 1
    return word, np.split(order, cut) if len(order) else []


def by_length(start: np.ndarray, end: np.ndarray, most: int = 300_000):
    """Numbers of words of similar length, together about ``most`` cells of a table that is as wide as the longest."""
    order = np.argsort(end - start, kind="stable")
    width = (end - start)[order] + 1
    i = 0
    while i < len(order):
        j = min(len(order), i + max(1, most // int(width[i])))
        while j > i + 1 and (j - i) * int(width[j - 1]) > 2 * most:
            j = i + (j - i) // 2
        yield order[i:j]
        i = j


def gather(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes in a row, and their bounds."""
    size = end - start
    return buffer[ragged(start, size)], np.concatenate([[0], np.cumsum(size)])
