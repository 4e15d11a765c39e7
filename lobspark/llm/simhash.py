"""SimHash near-dedup with deletion-variant signatures.

Fingerprints within 3 bits agree up to one bit in one of their two halves. Each half is indexed under its 32
one-wildcard variants (one bit struck out), so such a pair meets in an equality join and is then verified on all 64
bits. A pair whose halves are equal would meet under every wildcard: for wildcards other than the first, only values
with the bit set meet values without it, so it meets once.

Scale: only distinct fingerprints are joined, copies stay with their class. A variant that very many fingerprints
share is cut again in the same way on the other half (two quarters, one of which differs by at most one bit), so its
join key gains 15 more bits.

``near_groups`` links by similarity instead of bits. Its first candidates are the same: fingerprints of the sets of shingles, joined over their
deletion variants. But sets with a Jaccard similarity of 0.8 differ in about 15 % of their bits, far beyond three of 64, and variants wide
enough for that (256 for every text) need several times the input on disk, so bands of smallest hashes give the further
candidates. Each is decided on its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import components, mix
from lobspark.session import materialize

#: Fingerprints under one variant beyond which it is cut again.
HOT_BUCKET = 2000
MAX_BITS = 3


def _fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()  # bytes: only A-Z change, split at exactly 0x20 and 0x09-0x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    n = max(1, len(words) - size + 1)
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=n))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones, n = np.zeros(64, dtype=np.int64), len(hashes)
    for i in range(0, n, 1 << 18):
        ones += np.unpackbits(hashes[i : i + (1 << 18)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, carry: list[str], size: int = 3) -> DataFrame:
    """``(row, fp)``: the carried columns of every row and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["row"], pa.array([_fingerprint(t or b"", size) for t in b["text"].to_pylist()], pa.int64())], names=["row", "fp"])

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, fp long")


def _variants(value: Column, bits: int, tag: int) -> Column:
    """One-wildcard variants of the low ``bits`` of ``value``: structs of key, the struck bit's value, and whether it is the first."""
    low = value.bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(
        *[
            F.struct(F.lit(tag * bits + i).cast("int").alias("tag"), low.bitwiseAND(F.lit(~(1 << i))).alias("rest"), F.shiftright(low, i).bitwiseAND(F.lit(1)).cast("int").alias("bit"), F.lit(i == 0).alias("first"))
            for i in range(bits)
        ]
    )


def _met(rows: DataFrame, keys: list[str], bit: str, first: str) -> DataFrame:
    left = rows.where(f"{first} or {bit} = 0").select(*keys, F.col("fp").alias("a"), first)
    right = rows.where(f"{first} or {bit} = 1").select(*keys, F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    # merged, not broadcast: before the explode the sides look 32 times smaller than they are
    return left.join(right.hint("merge"), keys).where((~F.col(first) | (F.col("a") < F.col("b"))) & close).select("a", "b")


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """All pairs ``(a, b)`` of distinct fingerprints (column ``fp``) with at most three differing bits, each at least once."""
    halves = F.concat(_variants(F.col("fp"), 32, 0), _variants(F.shiftrightunsigned("fp", 32), 32, 1))
    v = fps.select("fp", F.explode(halves).alias("v")).select("fp", "v.*")
    hot = materialize(v.groupBy("tag", "rest").agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket).drop("n"))
    if hot.isEmpty():
        return _met(v, ["tag", "rest"], "bit", "first")
    # the other half differs by at most three bits: one of its quarters by at most one
    cold = _met(v.join(hot, ["tag", "rest"], "left_anti"), ["tag", "rest"], "bit", "first")
    other = F.when(F.col("tag") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    quarters = F.concat(_variants(other, 16, 0), _variants(F.shiftrightunsigned(other, 16), 16, 1))
    # a first-wildcard pair may have equal bits, any other pair differs in the struck bit: the side is part of the outer condition
    deep = v.join(hot, ["tag", "rest"]).select("fp", "tag", "rest", "bit", "first", F.explode(quarters).alias("w")).select("fp", "tag", "rest", "bit", "first", F.col("w.tag").alias("tag2"), F.col("w.rest").alias("rest2"))
    return cold.union(_met(deep, ["tag", "rest", "tag2", "rest2"], "bit", "first").distinct())


def simhash_dedup(docs: DataFrame, carry: list[str] | None = None, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Fingerprint and component of every row: ``row, fingerprint, component_id``.

    ``docs`` has ``doc_id`` and ``text``; the columns named by ``carry`` (``doc_id`` if none) come back in ``row``.
    ``fingerprint`` has 16 lowercase hex digits, ``component_id`` is the smallest ``doc_id`` reachable over links of at
    most three differing bits.

    Defined cases: a text without words, or null, has fingerprint zero and is linked like any other; shorter texts than
    a shingle count as one; repeated rows share a fingerprint; a null ``doc_id`` takes part but never names a component
    unless no other id does (then null); an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, carry or ["doc_id"]))
    classes = materialize(rows.groupBy("fp").agg(F.min("row.doc_id").alias("first_id")))
    comp = materialize(components(links(classes.select("fp"), hot_bucket)))
    named = comp.join(classes, comp["node"] == classes["fp"]).groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = comp.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    ids = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(ids, "fp").select("row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: ``near_groups``: bands of smallest hashes; at similarity 0.8 all bands miss a pair in 0.2 % of the cases.
BANDS, BAND_ROWS = 16, 5
#: Shingles of one band key that are compared in one task, two blocks at a time.
BLOCK_SHINGLES = 300_000
SALTS = 16
_LIFT = mix(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)


def _shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=max(1, len(words) - size + 1)))


def _bands(hashes: np.ndarray) -> list[int]:
    """Keys of a set's bands; two sets share a smallest hash with the probability of their Jaccard similarity."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 4096):
        for k, (a, b) in enumerate(_LIFT.T):
            least[k] = min(least[k], ((hashes[i : i + 4096] ^ a) * (b | np.uint64(1))).min())
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), n) for n, x in enumerate(least.reshape(BANDS, -1))], dtype=np.uint64).view(np.int64).tolist()


def shingle_classes(docs: DataFrame, carry: list[str], size: int = 5) -> DataFrame:
    """``(row, text_hash, cls, n, fp, bands)``: ``cls`` names the set of the ``n`` shingles of a text, ``fp`` is the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingle_set(t or b"", size) for t in b["text"].to_pylist()]
            cls = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
            n = pa.array([len(x) for x in sets], pa.int64())
            fp = pa.array([_majority(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b["row"], b["text_hash"], pa.array(cls), n, fp, pa.array([_bands(x) for x in sets], pa.list_(pa.int64()))], names=["row", "text_hash", "cls", "n", "fp", "bands"])

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, text_hash long, cls long, n long, fp long, bands array<long>")


def with_simhash(classes: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Classes with one band more, the first: fingerprints that deletion variants join, over any number of others, have the same key there."""
    fps = classes.where("n > 0").select("fp").distinct()
    joined = components(links(fps, hot_bucket)).toDF("fp", "near")
    key = F.array(F.coalesce("near", "fp"))
    return classes.join(joined, "fp", "left").select("cls", "text_hash", "n", F.when(F.col("n") > 0, F.concat(key, "bands")).otherwise(F.col("bands")).alias("bands"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Stretches of rows with equal keys in sorted batches, also where one goes over several batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        codes = np.stack([b[k].to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and any(held[-1][k][-1].as_py() != b[k][0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(edges, edges[1:]):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _links_of(group: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between the sets of one band key, as few as join what is similar; a pair counts in the first band that it shares."""
    band, cross = group["band"][0].as_py(), group["i"][0].as_py() != group["j"][0].as_py()
    cls, own = group["cls"].to_numpy(), group["block"].to_numpy()
    bands = np.array(group["bands"].to_pylist(), dtype=np.int64)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["hashes"].to_pylist()]
    size = np.array([len(x) for x in sets])
    root, out = np.arange(len(sets)), []
    for a in range(len(sets)):
        rest = np.arange(a + 1, len(sets))
        low, high = np.minimum(size[rest], size[a]), np.maximum(size[rest], size[a])
        ok = (root[rest] != root[a]) & (low >= similarity * high) & ~(bands[rest, :band] == bands[a, :band]).any(axis=1)
        if cross:
            ok &= own[rest] != own[a]
        rest = rest[ok]
        if not len(rest):
            continue
        flat = np.concatenate([sets[b] for b in rest])
        at = np.minimum(np.searchsorted(sets[a], flat), size[a] - 1)
        both = np.add.reduceat((sets[a][at] == flat).astype(np.int64), np.cumsum(size[rest]) - size[rest])
        for b in rest[both >= similarity * (size[a] + size[rest] - both)]:
            if root[a] != root[b]:
                out.append((int(cls[a]), int(cls[b])))
                root[root == root[b]] = root[a]
    return out


def near_groups(docs: DataFrame, carry: list[str] | None = None, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``row, group``: rows have the same group (a long) if a chain of texts joins them, each next one at least this similar by its shingles.

    Candidates are texts whose fingerprints deletion variants join (``with_simhash``), then those that share a band of smallest hashes. Texts that
    share a key are compared where they meet, on their sets of shingle hashes, which come once per text and key. A key with more than
    ``BLOCK_SHINGLES`` is cut into blocks, and pairs of blocks meet. A task gives only links between what it has not yet joined, fewer than it has texts.

    Defined cases: equal sets of shingles are one class; a text shorter than a shingle is one shingle; texts without
    words, or null, are one class and near nothing else; an empty table gives no rows.
    """
    rows = materialize(shingle_classes(docs, carry or ["doc_id"], size))
    classes = materialize(rows.groupBy("cls").agg(F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    classes = materialize(with_simhash(classes))
    keys = classes.select("cls", "n", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("m > 1").drop("m")
    met = materialize(keys.join(shared, ["band", "key"]).select("band", "key", "cls", "blocks"))
    wanted = classes.join(met.select("cls").distinct(), "cls", "left_semi").select("cls", "text_hash", "bands")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(wanted, "text_hash").dropDuplicates(["cls"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["cls"], b["bands"], pa.array([_shingle_set(t, size).tobytes() for t in b["text"].to_pylist()], pa.binary())], names=["cls", "bands", "hashes"])

    sets = materialize(texts.select("cls", "bands", "text").mapInArrow(hashed, "cls long, bands array<long>, hashes binary"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["band", "key", "i", "j"]):
            found = _links_of(group, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    dealt = met.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), "cls", "block")
    pairs = dealt.join(sets.hint("merge"), "cls").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "cls")
    links = materialize(pairs.mapInArrow(linked, "a long, b long"))
    # copies of one text are one class: the few classes with a group go to them under a salt
    named = components(links).toDF("cls", "c").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return salted.join(named, ["cls", "salt"], "left").select("row", F.coalesce("c", "cls").alias("group"))
