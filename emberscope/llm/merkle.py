"""Merkle manifest of a dataset, and inclusion proofs of all its rows by octopus multiproofs.

One tree a language over the digests of its rows, ordered by id, and one tree over the roots of those trees; a node is
the digest of up to ``ARITY`` children.  Everything is spread out:

1. ``placed``: rows are sorted by ranges; a row's index in its tree is its number in the range plus the rows of the
   tree in earlier ranges, so no task sees a whole tree.
2. ``interiors``: ``HEIGHT`` levels a round, built inside aligned chunks of ``ARITY ** HEIGHT`` nodes.
3. ``missing``: the proofs of a unit of consecutive leaves share most nodes.  Each unit works out the smallest set of
   coordinates it lacks (two ragged borders and one path), and these are fetched once, by one equality join.
4. ``proofs``: inside its task a unit derives the shared interiors from its leaves and the fetched nodes, up to the
   root, and expands the proof of each leaf from them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberscope.llm.common import saved, whole_groups

ARITY = 8
#: Levels that a round builds.
HEIGHT = 4
#: Leaves of a sorted range, and of a unit that makes one multiproof; a unit is a part of a range.
RANGE_ROWS, UNIT_BITS = 1 << 20, 14
#: The tree over the roots of the languages; a language's tree is ``0`` (no language) or ``1`` and the language.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """``leaves``: ``(tree, index, size, unit, doc_id, digest, forged)``; ``nodes``: ``(tree, level, index, digest)`` of
    all trees and levels; ``roots``: ``(tree, place, places, subroot)``; ``root``: hex, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: str | None


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(text: Column) -> Column:
    """SHA-256 of a row, with ``text`` in place of its text."""
    return F.unhex(F.sha2(F.concat(*(encoded(text if name == "text" else F.col(name)) for name in FIELDS)), 256))


def leaf_rows(documents: DataFrame) -> DataFrame:
    """``(tree, doc_id, digest, forged)``; ``forged`` is the digest after tampering, null where nothing was tampered with.

    Tampered with are rows whose id's CRC-32 is divisible by 3; a null id is not.
    """
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, row_digest(F.translate("text", _UPPER, _LOWER)))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return documents.select(tree.alias("tree"), "doc_id", row_digest(F.col("text")).alias("digest"), lowered.alias("forged"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``index`` (in the tree), ``size`` (of the tree) and ``unit``; rows that are equal may swap places.

    Equal rows get a number of their own as the last sort key, so that ranges can cut many copies of one row.
    """
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    keys = ["tree", *order, "_copy"]
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id())
    sorted_rows = numbered.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_copy")
    at = saved(sorted_rows.withColumn("at", F.monotonically_increasing_id()))  # range number << 33, plus row number
    part = F.shiftright("at", 33).alias("part")
    counts = at.groupBy(part, "tree").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = W.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "part", "tree", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")
    )
    return saved(
        at.withColumn("part", part).join(starts, ["part", "tree"])
        .select(*rows.columns, (F.col("at") + F.col("shift")).alias("index"), "size", F.shiftright("at", UNIT_BITS).alias("unit"))
    )


def interiors(leaves: DataFrame) -> DataFrame:
    """``(tree, level, index, size, digest)`` of the levels above ``leaves`` (``tree``, ``index``, ``size``, ``digest``).

    ``size`` is the number of nodes of the tree on that level; a tree ends where it is 1.
    """
    level, grown = 0, None
    layer = leaves.select("tree", "index", "size", "digest")
    while True:
        chunked = layer.where("size > 1").withColumn("chunk", F.floor(F.col("index") / ARITY**HEIGHT))
        near = chunked.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "index")
        done = saved(near.mapInArrow(lambda batches, base=level: _climbed(batches, base), _NODE))
        grown = done if grown is None else grown.unionByName(done)
        level += HEIGHT
        layer = done.where(F.col("level") == level)
        if layer.where("size > 1").isEmpty():
            return grown


_NODE = "tree string, level int, index long, size long, digest binary"


def _climbed(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    for part in whole_groups(batches, ["tree", "chunk"]):
        chunks, trees = part.column("chunk").to_numpy(), part.column("tree").to_numpy()
        starts = np.flatnonzero(np.append(True, (chunks[1:] != chunks[:-1]) | (trees[1:] != trees[:-1])))
        names, levels, indexes, sizes, digests = [], [], [], [], []
        sizes_in = part.column("size").to_numpy()
        values = [x.hex() for x in part.column("digest").to_pylist()]
        for start, end in zip(starts, np.append(starts[1:], part.num_rows)):
            nodes, size, first = values[start:end], int(sizes_in[start]), int(chunks[start]) * ARITY**HEIGHT
            for level in range(base + 1, base + HEIGHT + 1):
                if size == 1:
                    break
                nodes = [digest("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]
                size, first = -(-size // ARITY), first // ARITY
                names += [trees[start]] * len(nodes)
                levels += [level] * len(nodes)
                sizes += [size] * len(nodes)
                indexes += range(first, first + len(nodes))
                digests += map(bytes.fromhex, nodes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(levels, pa.int32()), pa.array(indexes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
            names=["tree", "level", "index", "size", "digest"],
        )


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(documents: DataFrame) -> Manifest:
    """All trees over ``documents`` (columns ``FIELDS``; others are not read).

    Repeated ids of a language are ordered by digest, null ids come first; rows that are equal in all fields are leaves
    each.  A null language is a tree of its own, the first.  Empty texts are not null texts.
    """
    leaves = placed(saved(leaf_rows(documents)), "doc_id", "digest")
    inner = interiors(leaves)
    ends = inner.where("size = 1").unionByName(leaves.where("size = 1").select("tree", F.lit(0).alias("level"), "index", "size", "digest"))
    tops = placed(ends.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    above = interiors(tops)
    root = above.where("size = 1").unionByName(tops.where("size = 1").select("tree", F.lit(0).alias("level"), "index", "size", "digest"))
    found = root.select("digest").collect()  # one row, none without documents
    columns = ["tree", "level", "index", "digest"]
    nodes = leaves.withColumn("level", F.lit(0)).select(columns)
    for more in (inner, tops.withColumn("level", F.lit(0)), above):
        nodes = nodes.unionByName(more.select(columns))
    roots = tops.select(F.col("name").alias("tree"), F.col("index").alias("place"), F.col("size").alias("places"), F.col("digest").alias("subroot"))
    return Manifest(leaves, nodes, roots, found[0].digest.hex() if found else None)


def missing(known: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level by level, the indexes that the proofs of the ``known`` leaves need and that do not follow from them."""
    level = 0
    while size > 1:
        runs = np.unique(known // ARITY)
        children = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(children[children < size], known, assume_unique=True)
        known, size, level = runs, -(-size // ARITY), level + 1


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinates each unit lacks, in the trees of its leaves and in the tree above them."""
    for part in whole_groups(batches, ["unit"]):
        units, trees, levels, indexes = [], [], [], []
        rows = part.to_pylist()
        above: dict[int, tuple[list[int], int]] = {}
        for row in rows:
            lacks = [(row["tree"], x) for x in missing(np.arange(row["first"], row["last"] + 1), row["size"])]
            for tree, (level, index) in lacks:
                units += [row["unit"]] * len(index)
                trees += [tree] * len(index)
                levels += [level] * len(index)
                indexes += index.tolist()
            above.setdefault(row["unit"], ([], row["places"]))[0].append(row["place"])
        for unit, (places, size) in above.items():
            for level, index in missing(np.array(sorted(places)), size):
                units += [unit] * len(index)
                trees += [TOP] * len(index)
                levels += [level] * len(index)
                indexes += index.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(units, pa.int64()), pa.array(trees, pa.string()), pa.array(levels, pa.int32()), pa.array(indexes, pa.int64())],
            names=["unit", "tree", "level", "index"],
        )


def proofs(made: Manifest, bodies: bool = False) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row per document.

    The proof of a leaf: the siblings' digests, level by level from the leaf to the root, left to right; with ``bodies``
    the digests themselves are added as ``proof``, put together.  ``folded_root`` is what the proof makes of the forged
    leaf, or of the leaf itself where there is none.  No rows for an empty dataset.
    """
    leaves, nodes, roots, root = made
    spans = saved(
        leaves.groupBy("unit", "tree").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.first("size").alias("size"))
        .join(roots, "tree")
    )
    wanted = saved(spans.repartition("unit").sortWithinPartitions("unit", "tree").mapInArrow(_wanted, "unit long, tree string, level int, index long"))
    ident = leaves.schema["doc_id"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["unit", "kind", "tree", "level", "index", "size", "doc_id", "digest", "forged", "place", "places"]
    heads = spans.select(
        "unit", F.lit(0).alias("kind"), "tree", F.lit(0).alias("level"), F.col("first").alias("index"), "size",
        none(ident).alias("doc_id"), F.col("subroot").alias("digest"), none("binary").alias("forged"), "place", "places",
    )
    fetched = wanted.join(nodes, ["tree", "level", "index"]).select(
        "unit", F.lit(1).alias("kind"), "tree", "level", "index", none("long").alias("size"), none(ident).alias("doc_id"), "digest",
        none("binary").alias("forged"), none("long").alias("place"), none("long").alias("places"),
    )
    own = leaves.select(
        "unit", F.lit(2).alias("kind"), "tree", F.lit(0).alias("level"), "index", "size", "doc_id", "digest", "forged",
        none("long").alias("place"), none("long").alias("places"),
    )
    rows = heads.select(columns).unionByName(fetched.select(columns)).unionByName(own.select(columns))
    near = rows.repartition("unit").sortWithinPartitions("unit", "kind", "tree", "level", "index")
    hashed = ["leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["proof"] * bodies
    out = near.mapInArrow(
        lambda batches: _expanded(batches, root, bodies), f"doc_id {ident.simpleString()}, " + ", ".join(f"{x} string" for x in hashed)
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


class _Tree:
    """The part of one tree that a unit knows: given nodes, derived interiors, and runs of siblings as texts."""

    def __init__(self, size: int):
        self.size, self.levels, self.runs = size, [{}], []

    def give(self, level: int, index: int, value: str) -> None:
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level][index] = value

    def derive(self, leaves: list[int]) -> None:
        """Interiors above ``leaves`` from the nodes given."""
        known, size, level = leaves, self.size, 0
        while size > 1:
            here = self.levels[level]
            texts = {}
            for run in dict.fromkeys(i // ARITY for i in known):
                texts[run] = "".join([here[i] for i in range(run * ARITY, min(size, run * ARITY + ARITY))])
                self.give(level + 1, run, digest(texts[run]))
            self.runs.append(texts)
            known, size, level = list(texts), -(-size // ARITY), level + 1

    def top(self) -> str:
        return self.levels[len(self.runs)][0]

    def siblings(self, index: int, level: int = 0) -> str:
        """Digests beside the path from a node to the top."""
        out = []
        for texts in self.runs[level:]:
            text, at = texts[index // ARITY], index % ARITY * 64
            out.append(text[:at] + text[at + 64 :])
            index //= ARITY
        return "".join(out)

    def folded(self, index: int, value: str) -> str:
        """The top that follows from another value of a leaf and its siblings."""
        for texts in self.runs:
            text, at = texts[index // ARITY], index % ARITY * 64
            value = digest(text[:at] + value + text[at + 64 :])
            index //= ARITY
        return value


def _expanded(batches: Iterator[pa.RecordBatch], root: str | None, bodies: bool) -> Iterator[pa.RecordBatch]:
    for part in whole_groups(batches, ["unit"]):
        units = part.column("unit").to_numpy()
        starts = np.flatnonzero(np.append(True, units[1:] != units[:-1]))
        for start, end in zip(starts, np.append(starts[1:], part.num_rows)):
            yield from _unit(part.slice(start, end - start), root, bodies)


def _unit(part: pa.Table, root: str | None, bodies: bool) -> Iterator[pa.RecordBatch]:
    kinds = part.column("kind").to_numpy()
    heads, given, own = (part.slice(a, b - a) for a, b in zip(np.searchsorted(kinds, [0, 1, 2]), np.searchsorted(kinds, [1, 2, 3])))
    heads = heads.to_pylist()
    trees = {x["tree"]: _Tree(x["size"]) for x in heads}
    above = _Tree(heads[0]["places"])
    for x in given.select(["tree", "level", "index", "digest"]).to_pylist():
        (above if x["tree"] == TOP else trees[x["tree"]]).give(x["level"], x["index"], x["digest"].hex())
    names, indexes = own.column("tree").to_pylist(), own.column("index").to_pylist()
    values = [x.hex() for x in own.column("digest").to_pylist()]
    forged = [x and x.hex() for x in own.column("forged").to_pylist()]
    mine: dict[str, list[int]] = {}
    for name, index, value in zip(names, indexes, values):
        trees[name].give(0, index, value)
        mine.setdefault(name, []).append(index)
    for head in heads:
        tree = trees[head["tree"]]
        tree.derive(mine[head["tree"]])
        above.give(0, head["place"], tree.top())
    above.derive([x["place"] for x in heads])
    derived = above.top()
    beyond = {x["tree"]: (x["place"], above.siblings(x["place"]), x["digest"].hex()) for x in heads}
    subroots, hashes, folded, whole, higher = [], [], [], [], {}
    for name, index, other in zip(names, indexes, forged):
        tree, (place, rest, subroot) = trees[name], beyond[name]
        upper = rest
        proof = ""
        if tree.runs:
            key = (name, index // ARITY)
            if key not in higher:
                higher[key] = tree.siblings(index // ARITY, 1) + rest
            text, at = tree.runs[0][index // ARITY], index % ARITY * 64
            upper, proof = higher[key], text[:at] + text[at + 64 :]
        proof += upper
        hashes.append(digest(proof))
        subroots.append(subroot)
        folded.append(derived if other is None else above.folded(place, tree.folded(index, other)))
        if bodies:
            whole.append(proof)
    strings = [values, subroots, [root] * len(values), hashes, folded] + [whole] * bodies
    yield pa.RecordBatch.from_arrays(
        [own.column("doc_id").combine_chunks(), *(pa.array(x, pa.string()) for x in strings)],
        names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] + ["proof"] * bodies,
    )


def proven_documents(documents: DataFrame) -> DataFrame:
    """Manifest, tampering and proofs of all documents in one."""
    return proofs(manifest(documents))


def _oracle(levels: int = 9, top_levels: int = 3) -> str:
    """The same in SQL, for trees of up to ``ARITY ** levels`` leaves and ``ARITY ** top_levels`` languages."""
    field = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if x == "text" else x) for x in FIELDS) + ")"
    crc = (  # CRC-32 bit by bit: a number of 0 or more is a byte to take in, -1 a shift
        "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(str_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
    )
    steps = [
        f"""base AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {leaf("text")} AS leaf,
          CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf("text")} END AS forged FROM documents)""",
        """walk0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, forged AS h, '' AS proof,
          count(*) OVER (PARTITION BY tree) AS size FROM base)""",
        "nodes0 AS (SELECT tree, pos, size, leaf AS node FROM walk0)",
    ]

    def climb(names: str, walk: str, i: int, size: str) -> None:
        steps.append(f"{names}runs{i} AS (SELECT tree, pos // {ARITY} AS run, list(node ORDER BY pos) AS kids FROM {names}nodes{i} WHERE size > 1 GROUP BY ALL)")
        steps.append(
            f"{names}nodes{i + 1} AS (SELECT n.tree, n.pos // {ARITY} AS pos, max((n.size + {ARITY - 1}) // {ARITY}) AS size, "
            f"CASE WHEN max(n.size) = 1 THEN max(n.node) ELSE sha256(string_agg(n.node, '' ORDER BY n.pos)) END AS node FROM {names}nodes{i} n GROUP BY ALL)"
        )
        steps.append(
            f"{walk}{i + 1} AS (SELECT w.* REPLACE (w.pos // {ARITY} AS pos, (w.{size} + {ARITY - 1}) // {ARITY} AS {size}, "
            f"CASE WHEN r.run IS NULL THEN h ELSE sha256(array_to_string(list_concat(kids[1:w.pos % {ARITY}], [h], kids[w.pos % {ARITY} + 2:]), '')) END AS h, "
            f"CASE WHEN r.run IS NULL THEN proof ELSE proof || array_to_string(list_concat(kids[1:w.pos % {ARITY}], kids[w.pos % {ARITY} + 2:]), '') END AS proof) "
            f"FROM {walk}{i} w LEFT JOIN {names}runs{i} r ON w.{'tree' if not names else 'top'} = r.tree AND w.pos // {ARITY} = r.run)"
        )

    for i in range(levels):
        climb("", "walk", i, "size")
    steps.append(f"topnodes0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size, node, tree AS name FROM nodes{levels})")
    steps.append(
        f"up0 AS (SELECT doc_id, leaf, '' AS top, h, proof, t.pos, t.size, t.node AS subroot FROM walk{levels} w JOIN topnodes0 t ON w.tree = t.name)"
    )
    for i in range(top_levels):
        climb("top", "up", i, "size")
    body = ",\n".join(steps)
    return f"""WITH {body}
SELECT doc_id, leaf, subroot, n.node AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = n.node AS verified
FROM up{top_levels}, topnodes{top_levels} n"""


ORACLE = _oracle()
