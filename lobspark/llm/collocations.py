"""Phrase collocations by top-order marginalisation.

Only windows of the longest order are counted: the words from one place on, as lead columns, padded where the piece ends.
Spark's ROLLUP then sums them over successively shorter prefixes, which gives the frequency of every shorter phrase (and, with
no word left, of all words) without an n-gram explosion per order.

Scale: a window need not reach beyond two or three words that are too rare together for any phrase. A first pass counts pairs and triples
by hash into a table of fixed size; only slots that reach the threshold keep their bit. A slot never counts less than what falls into it, so
windows are cut at most where no phrase can be, and what the slots let pass too much is counted exactly afterwards: results don't depend on the
table, which is 16 MB for any corpus (from about 10**10 words on it lets most windows pass, and these are shuffled). Windows are pre-counted inside
the tasks, and hot words are one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import mix
from lobspark.session import materialize

#: Slots of the bit table that is sent to every task: 2**27 bits, 16 MB; and slots that travel together.
SLOT_BITS, CHUNK = 27, 1 << 15
#: Words after which a task counts what it has read, and different words after which it starts a new word list.
READ_WORDS, LISTED_WORDS = 1_000_000, 400_000
#: Different windows that a task adds up before it gives them out.
HELD_WINDOWS = 500_000
SALTS = 8
_SPLIT = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" \n\n\n\n\n\n\n\n\n")


class _Listed(dict):
    """Numbers words as they come; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, list[str]]]:
    """Word list, word numbers in order (0 after each piece), the language number of each, and the languages' names."""
    listed, langs, ids, tags, n = _Listed(), {}, [], [], 0
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"]):
            words = text.as_py().lower().translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")
            got = np.fromiter((listed[w] for w in words if w), dtype=np.int64)
            ids += [got, np.zeros(1, dtype=np.int64)]
            tags.append((langs.setdefault(lang, len(langs)), len(got) + 1))
            n += len(got) + 1
            if n >= READ_WORDS or len(listed) > LISTED_WORDS:
                yield list(listed), np.concatenate(ids), np.repeat(*np.array(tags).T), list(langs)
                listed, langs, ids, tags, n = _Listed(), {}, [], [], 0
    if n:
        yield list(listed), np.concatenate(ids), np.repeat(*np.array(tags).T), list(langs)


def _slots(listed: list[bytes], ids: np.ndarray, tags: np.ndarray, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For two and for three words from each place on: their slot, and whether they stand in one piece. The last places have none."""
    word = np.array([xxhash.xxh64_intdigest(w) for w in listed], dtype=np.uint64)[ids]
    word += np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], dtype=np.uint64)[tags]
    cut, factor = np.uint64(64 - SLOT_BITS), np.uint64(0x9E3779B97F4A7C15)
    out, h, inside = [], word, ids > 0
    for k in (1, 2):
        h, inside = h[:-1] * factor + word[k:], inside[:-1] & (ids[k:] > 0)
        out.append(((mix(h) >> cut).astype(np.int64), inside))
    return out


def _count_slots(least: int):
    """One row per chunk of slots and list of words: the slots seen (two bytes each) and how often, counted up to the threshold."""
    small = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for read in _read(batches):
            slot, c = np.unique(np.concatenate([s[inside] for s, inside in _slots(*read)]), return_counts=True)
            edge = np.flatnonzero(np.diff(slot // CHUNK, prepend=-1))
            at = np.append(edge, len(slot)).astype(np.int32)
            packed = [pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(at * x.itemsize), pa.py_buffer(x)]) for x in ((slot % CHUNK).astype(np.uint16), np.minimum(c, least).astype(small))]
            yield pa.RecordBatch.from_arrays([pa.array((slot[edge] // CHUNK).astype(np.int32)), *packed], names=["chunk", "slots", "counts"])

    return run


def _add_slots(least: int):
    """Bits of the chunks dealt to a task; it keeps one array per chunk, whatever comes in."""
    small = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            for chunk, slots, counts in zip(b["chunk"].to_pylist(), b["slots"].to_pylist(), b["counts"].to_pylist()):
                have = sums.setdefault(chunk, np.zeros(CHUNK, dtype=np.int32))
                slots = np.frombuffer(slots, dtype=np.uint16)
                have[slots] = np.minimum(have[slots] + np.frombuffer(counts, dtype=small), least)
        for chunk, have in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(have >= least, bitorder="little").tobytes()])], names=["chunk", "bits"])

    return run


def frequent_slots(texts: DataFrame, least: int) -> np.ndarray:
    """The bit table (bytes): slots whose pairs and triples stand at least ``least`` times in all texts."""
    seen = texts.mapInArrow(_count_slots(least), "chunk int, slots binary, counts binary")
    chunks = seen.repartition(64, "chunk").mapInArrow(_add_slots(least), "chunk int, bits binary")
    table = np.zeros((2**SLOT_BITS // CHUNK, CHUNK // 8), dtype=np.uint8)
    for chunk, bits in chunks.collect():  # at most 4,096 rows of 4 kB
        table[chunk] = np.frombuffer(bits, dtype=np.uint8)
    return table.ravel()


def _windows(bits, longest: int):
    names = [f"w{k}" for k in range(1, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = bits.value, None
        for listed, ids, tags, langs in _read(batches):
            here = np.flatnonzero(ids)
            frequent = []
            for s, inside in _slots(listed, ids, tags, langs):
                frequent.append(np.zeros(len(ids) + longest, dtype=bool))
                frequent[-1][: len(s)] = (table[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1) & inside
            two, three = frequent
            ids = np.append(ids, np.zeros(longest, dtype=np.int64))
            on = np.ones(len(here), dtype=bool)
            columns = [ids[here]]  # number 0 pads
            for k in range(1, longest):
                on = on & two[here + k - 1] & (three[here + k - 2] if k > 1 else True)
                columns.append(np.where(on, ids[here + k], 0))
            counted = pa.table([pa.array(tags[here]), *map(pa.array, columns)], names=["lang", *names]).group_by(["lang", *names], use_threads=False).aggregate([([], "count_all")])
            word = pa.array([b"", *listed[1:]], pa.binary()).cast(pa.string())
            new = pa.table([pa.array(langs, pa.string()).take(counted["lang"]), *(word.take(counted[c]) for c in names), counted["count_all"]], names=["lang", *names, "c"])
            # frequent words and pairs come back in every list: add them up over the task
            held = new if held is None else pa.concat_tables([held, new]).group_by(["lang", *names], use_threads=False).aggregate([("c", "sum")]).rename_columns(["lang", *names, "c"])
            if held.num_rows > HELD_WINDOWS:
                yield from held.combine_chunks().to_batches(50_000)
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches(50_000)

    return run


def frequencies(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, k, words, f``: phrases of k words that stand at least ``least`` times; the row of k = 0 counts all words."""
    spark: SparkSession = texts.sparkSession
    names = [f"w{k}" for k in range(1, longest + 1)]
    bits = spark.sparkContext.broadcast(frequent_slots(texts, least))
    counted = texts.mapInArrow(_windows(bits, longest), f"lang string, {', '.join(f'{c} string' for c in names)}, c long").groupBy("lang", *names).agg(F.sum("c").alias("c"))
    rolled = counted.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    # grouping_id has a set bit for every column summed over: 2**j - 1 for the last j
    k = F.lit(longest) - F.bit_count("g").cast("int")
    words = F.slice(F.array(*names), F.lit(1), F.greatest("k", F.lit(0)))
    rows = rolled.withColumn("k", k).where("k >= 0").withColumn("words", words)
    return rows.where((F.col("k") == 0) | ((F.element_at("words", -1) != "") & (F.col("f") >= least))).select("lang", "k", "words", "f")


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """Best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``text`` and ``lang``. Texts (A-Z in lower case) are cut into pieces at ``[.,;:!?`` and line ends``]`` and these into words at blanks and
    tabs. Phrases of 2 to ``longest`` words that stand ``a >= least`` times are scored by their weakest cut, floor(1000 a n / (l r)), exactly;
    a phrase inside a longer one that is as frequent is left out. The first ``top`` of each language come back: that is the report's length.

    Defined cases: a null language is ``und``; null or empty texts have no words; a text of any length is read whole; repeated rows count as often as they
    stand; ties go to the more frequent phrase, then to UTF-8 order; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = materialize(frequencies(texts, longest, least).withColumn("phrase", F.array_join("words", " ")))
    total = found.where("k = 0").select("lang", F.col("f").alias("n"))
    known = found.where("k > 0").select("lang", "phrase", "f")
    phrases = found.where("k > 1").select("lang", "phrase", "k", "words", F.col("f").alias("a"))
    # a first part like "the" stands under very many phrases: both sides of that join are salted
    cuts = phrases.withColumn("j", F.explode(F.expr("sequence(1, k - 1)"))).select(
        "lang", "phrase", "k", "a", "j", F.expr("array_join(slice(words, 1, j), ' ')").alias("first"), F.expr("array_join(slice(words, j + 1, k - j), ' ')").alias("rest"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt")
    )
    parts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cuts = cuts.join(parts.select("lang", "salt", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "salt", "first"])
    cuts = cuts.join(parts.select("lang", "salt", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "salt", "rest"]).join(total, "lang")
    exact = lambda c: f"cast({c} as decimal(18,0))"
    cuts = cuts.withColumn("score", F.expr(f"cast((cast(1000 as decimal(4,0)) * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')}) as long)"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "j", "l", "r")).alias("cut"))
    inside = phrases.where("k > 2").withColumn("size", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - size + 1)")))
    inside = inside.groupBy("lang", F.expr("array_join(slice(words, at, size), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")  # Spark cuts to the first rows before the shuffle, too
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
