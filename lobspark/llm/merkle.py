"""Merkle manifest of a table as a persistent tree: a changed row makes a version that shares every node it leaves alone.

Rows are leaves, ordered inside their group; sixteen consecutive nodes become one, up to one node per group, and the
groups' nodes in turn up to the root. A version of the tree copies the ancestors of its changed leaf and nothing else.

Scale: places come from a range sort and the counts of its partitions, so a group with a third of all rows lies over
many tasks. Three levels are built at a time inside aligned blocks of 4,096 nodes, one task each; a block's node goes on to
the next tier, so a tier has 1/4,096 of the rows of the one below. On the way down a block gets the siblings above it, once,
and the versions of its leaves are continued through the upper levels there: copied digests are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.session import materialize

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
_NODE = "grp string, pos long, n long, digest string"
_PATH = "grp string, pos long, path array<string>"


def field_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of fields written one after another: ``-`` where null, else UTF-8 byte count, colon, value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def _levels(digests: list[str], up: int) -> list[list[str]]:
    """The given nodes and ``up`` levels above them."""
    out = [digests]
    for _ in range(up):
        last = out[-1]
        out.append([_hash("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return out


def _siblings(levels: list[list[str]], at: int) -> list[str]:
    """What stands left and right of a node and its ancestors in their runs, level by level: left, right, left, right, ..."""
    out = []
    for level in levels[:-1]:
        start = at - at % FAN
        out += ["".join(level[start:at]), "".join(level[at + 1 : start + FAN])]
        at //= FAN
    return out


def _copies(digest: str, siblings: list[str]) -> list[str]:
    """A node's copied ancestors, from below, when its digest is as given and all siblings are as they were."""
    out = []
    for left, right in zip(siblings[::2], siblings[1::2]):
        digest = _hash(left + digest + right)
        out.append(digest)
    return out


def _block(nodes: pa.Table) -> tuple[np.ndarray, list[list[str]]]:
    """A block's nodes in order (as row numbers) and its levels."""
    order = np.argsort(nodes["pos"].to_numpy(), kind="stable")
    return order, _levels(nodes["digest"].take(pa.array(order)).to_pylist(), min(LEVELS, _height(nodes["n"][0].as_py())))


def _up(nodes: pa.Table) -> pa.Table:
    _, levels = _block(nodes)
    n = nodes["n"][0].as_py()
    return pa.table({"grp": nodes["grp"][:1], "pos": pa.array([nodes["pos"][0].as_py() // BLOCK], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": levels[-1]})


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ``order`` inside each ``grp``) and ``n``, the group's rows; equal rows keep one fixed order."""
    cut = materialize(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()))
    cut = cut.withColumn("part", F.shiftright("at", 33))
    parts = cut.groupBy("grp", "part").agg(F.min("at").alias("at0"), F.count("*").alias("c"))
    before = F.coalesce(F.expr("sum(c) over (partition by grp order by part rows between unbounded preceding and 1 preceding)"), F.lit(0))
    parts = parts.select("grp", "part", (before - F.col("at0")).alias("shift"), F.expr("sum(c) over (partition by grp)").alias("n"))  # at most one row per group and partition
    return cut.join(parts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Nodes at every third level from the given ones upwards, until each group has one; a tier holds the groups not finished below."""
    out = [nodes]
    while True:
        open_ = out[-1] if len(out) == 1 else out[-1].where("n > 1")
        out.append(materialize(open_.groupBy("grp", F.expr(f"pos div {BLOCK}")).applyInArrow(_up, _NODE)))
        if out[-1].where("n > 1").isEmpty():
            return out


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Siblings on the way to the root for each node, given those of the blocks they stand in."""

    def run(block: pa.Table, path: pa.Table) -> pa.Table:
        order, levels = _block(block)
        rest = path["path"][0].as_py()
        return pa.table({"grp": block["grp"], "pos": block["pos"].take(pa.array(order)), "path": pa.array([_siblings(levels, i) + rest for i in range(len(order))], pa.list_(pa.string()))})

    return nodes.groupBy("grp", F.expr(f"pos div {BLOCK}")).cogroup(above.groupBy("grp", "pos")).applyInArrow(run, _PATH)


def _paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the lowest tier's blocks; ``tops`` has the path of each group's last node."""
    path = None
    for tier in reversed(tiers[1:]):
        own = tier.where("n = 1").select("grp", "pos").join(tops, "grp").select("grp", "pos", "path")
        path = own if path is None else own.union(_down(tier.where("n > 1").select("grp", "pos", "n", "digest"), path))
    return path


@dataclass
class Manifest:
    """``leaves`` (row, grp, pos, n, leaf, edited), their ``tiers``, ``subroots`` (grp, subroot) with their ``tops`` (grp, path), and ``root`` (one row)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    subroots: DataFrame
    tops: DataFrame
    root: DataFrame


def manifest(docs: DataFrame, fields: list[str], group: str, key: str, edits: dict[str, Column] | None = None, where: Column | None = None, carry: list[str] | None = None) -> Manifest:
    """Tree over all rows: leaves of ``fields``, grouped by ``group`` and ordered by ``key``.

    ``edits`` gives new values of fields, in the rows that fulfil ``where``: each such row is a version of its own. Ties in ``key``
    are ordered by leaf and edited leaf; a null group or key comes first. No rows: no subroots and no root.
    """
    now = [F.col(f"`{c}`") for c in fields]
    new = [(edits or {}).get(c, F.col(f"`{c}`")) for c in fields]
    edited = F.when(where if where is not None else F.lit(False), field_digest(new)).alias("edited") if edits else F.lit(None).cast("string").alias("edited")
    grp = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp")  # null before all others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or [key])]).alias("row"), grp, F.col(f"`{key}`").alias("key"), field_digest(now).alias("leaf"), edited)
    leaves = materialize(placed(materialize(rows), ["key", "leaf", "edited"]).drop("key"))
    tiers = _tiers(leaves.select("grp", "pos", "n", F.col("leaf").alias("digest")))
    ends = tiers[1].where("n = 1")
    for t in tiers[2:]:
        ends = ends.union(t.where("n = 1"))
    subroots = materialize(ends.select("grp", F.col("digest").alias("subroot")))
    top = materialize(placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "subroot"), ["name"]))
    upper = _tiers(top.select("grp", "pos", "n", F.col("subroot").alias("digest")))
    last = upper[-1].select(F.lit("").alias("grp"), F.array().cast("array<string>").alias("path"))
    paths = _down(top.select("grp", "pos", "n", F.col("subroot").alias("digest")), _paths(upper, last))
    tops = materialize(top.select("pos", F.col("name")).join(paths.select("pos", "path"), "pos").select(F.col("name").alias("grp"), "path"))
    return Manifest(leaves, tiers, subroots, tops, upper[-1].select(F.col("digest").alias("root")))


def proofs(tree: Manifest) -> DataFrame:
    """For every leaf: ``row, leaf, subroot, root, proof_sha256, edited, copies, folded_root, verified``.

    ``proof_sha256`` is the digest of the leaf's siblings up to the root. ``copies`` are the ancestors of the row's version, from below
    (for a row without edit: the tree's own nodes on this way), the last one is ``folded_root``; a lone leaf is its own root.
    """
    kind = tree.leaves.schema["row"].dataType.simpleString()

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        order, levels = _block(block.rename_columns(["digest" if c == "leaf" else c for c in block.column_names]))
        rest, subroot, root = (above[c][0].as_py() for c in ("path", "subroot", "root"))
        block = block.take(pa.array(order))
        proof, copies, folded = [], [], []
        for i, (leaf, new) in enumerate(zip(block["leaf"].to_pylist(), block["edited"].to_pylist())):
            siblings = _siblings(levels, i) + rest
            proof.append(_hash("".join(siblings)))
            copies.append(_copies(new or leaf, siblings))
            folded.append(copies[-1][-1] if copies[-1] else new or leaf)
        n = len(proof)
        return pa.table([block["row"], block["leaf"], pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), block["edited"], pa.array(copies, pa.list_(pa.string())), pa.array(folded), pa.array([x == root for x in folded])], names=["row", "leaf", "subroot", "root", "proof_sha256", "edited", "copies", "folded_root", "verified"])

    above = _paths(tree.tiers, tree.tops).join(tree.subroots, "grp").crossJoin(F.broadcast(tree.root))  # one row
    pairs = tree.leaves.groupBy("grp", F.expr(f"pos div {BLOCK}")).cogroup(above.groupBy("grp", "pos"))
    return pairs.applyInArrow(run, f"row {kind}, leaf string, subroot string, root string, proof_sha256 string, edited string, copies array<string>, folded_root string, verified boolean")


def copied_nodes(proofs_: DataFrame) -> DataFrame:
    """The store of all versions: ``row, level, digest`` of each node copied for an edited row, level 0 being the leaf."""
    return proofs_.where("edited is not null").select("row", F.posexplode(F.concat(F.array("edited"), "copies")).alias("level", "digest"))


def document_manifest(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Manifest of documents by source and id; every document whose id's CRC-32 is divisible by five has a version with its text's A-Z in lower case.

    Defined cases: null fields are written ``-``, an empty text ``0:``; a null source or id comes first; equal ids are ordered by leaf,
    repeated rows stand side by side; a null id has no changed version, a null text keeps its leaf; an empty table gives no rows.
    """
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return proofs(manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": lower}, chosen, carry))
