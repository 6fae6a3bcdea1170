"""Helpers the corpus operators share: saved tables, connected components, groups dealt out in blocks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.runtime import shared_folder

#: Characters of text that a task holds as numpy arrays at a time; longer single texts are taken alone.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str) -> str:
    """A column name that no table of a user has."""
    return f"_{name}_{uuid.uuid4().hex}"


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: ``(a long, b long)`` to ``(id, component)``, component the smallest id reachable.

    Nodes without an edge are not returned.  Alternating large-star and small-star steps (Kiveris et al. 2014): the
    number of edges never grows and no step gathers the members of a component; joins on a node with many neighbours
    are plain equality joins that AQE splits.  Between the steps edges are read by as many tasks as they make portions of
    ``FOLD``, and a task folds its portion to stars; components that have become stars take part in no further step.
    What fits one portion, 4 MB whatever the input, is finished by its fold.
    """
    # saved before they are folded: a task that makes edges in Python need not feed a second worker
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")))
    stars = []
    while True:
        portions = max(1, math.ceil(now.count() / FOLD))
        now = saved(_folded(now.coalesce(portions)))
        if portions == 1 or (restless := saved(_restless(now))).isEmpty():
            break
        moving = saved(
            now.join(restless, "v", "left_semi").select("m").unionByName(
                now.select("m").distinct().join(restless.withColumnRenamed("v", "m"), "m", "left_semi")
            ).distinct()
        )
        stars.append(saved(now.join(moving, "m", "left_anti").select("v", "m")))
        # saved, as each of the steps reads them more than once
        moved = saved(now.join(moving, "m", "left_semi").select("v", "m"))
        now = saved(_small_star(saved(_large_star(moved))))
    for part in stars:
        now = now.unionByName(part)
    return now.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(
        now.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
    )


def _restless(edges: DataFrame) -> DataFrame:
    """Nodes that hang on several others, and nodes that hang on one and have others hanging on them; none in a star."""
    several = edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    inner = edges.select(F.col("m").alias("v")).distinct().join(edges.select("v"), "v", "left_semi")
    return several.unionByName(inner).distinct()


#: Edges that a task folds at a time.
FOLD = 1 << 18


def _folded(edges: DataFrame) -> DataFrame:
    """Edges ``(v, m)`` with the same components and no more rows: stars of those a task holds together, ``FOLD`` at a time."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOLD:
                yield _stars(held)
                held, n = [], 0
        if n:
            yield _stars(held)

    return edges.mapInArrow(fold, "v long, m long")


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    v, m = (np.concatenate([x.column(c).to_numpy() for x in batches]) for c in ("v", "m"))
    ids, place = np.unique(np.concatenate([v, m]), return_inverse=True)
    label = roots(len(ids), place[: len(v)], place[len(v) :])
    below = np.flatnonzero(label != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(ids[label[below]])], names=["v", "m"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
        edges.select(F.col("m").alias("u"), F.col("v").alias("w"))
    )
    least = both.groupBy("u").agg(F.min("w").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("m").alias("least"))
    moved = edges.join(least, "v").where("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return moved.unionByName(least.select("v", F.col("least").alias("m"))).distinct()


#: Keys with more than this share of the rows, and more rows than ``HOT_ROWS``, are hot.
HOT_SHARE, HOT_ROWS = 1000, 10_000


def hot_join(rows: DataFrame, one: DataFrame, counts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join many rows to ``one`` row per key, whatever share of the rows a key has.

    ``counts``: the keys and ``n``, their number of rows.  At most ``HOT_SHARE`` keys can be hot, so their rows of
    ``one`` are broadcast; no other key has more than the thousandth part of all rows.  ``how``: inner or left.
    """
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    hot = F.broadcast(counts.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(*keys))
    few = F.broadcast(one.join(hot, keys, "left_semi"))
    cold = rows.join(hot, keys, "left_anti").join(one.join(hot, keys, "left_anti"), keys, how)
    return rows.join(hot, keys, "left_semi").join(few, keys, how).unionByName(cold)


def deal(df: DataFrame, key: str, ident: str, n: str, least: int = 256) -> DataFrame:
    """Deal the ``n`` members of each key into blocks, and every member to each pair of blocks it is part of.

    Adds ``lo``, ``hi`` (the pair of blocks) and ``second`` (whether the row is of block ``hi`` and not of ``lo``);
    the rows of one ``(key, lo, hi)`` hold all pairs of members of the two blocks, and each pair of members meets in
    exactly one of them.  A block has about ``max(least, 4 * sqrt(n))`` members, so neither the rows of a task nor the
    copies of a row grow faster than the square root of the group.
    """
    count = F.ceil(F.col(n) / F.greatest(F.lit(float(least)), 4 * F.sqrt(F.col(n)))).cast("int")
    block = F.pmod(F.xxhash64(F.col(ident), F.lit(7)), count).cast("int")
    out = df.withColumn("_blocks", count).withColumn("_block", block)
    out = out.withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    return out.select(
        *df.columns,
        F.least("_block", "_other").alias("lo"),
        F.greatest("_block", "_other").alias("hi"),
        (F.col("_block") > F.col("_other")).alias("second"),
    )


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Bring the rows of a dealt group next to each other, block ``lo`` before block ``hi``."""
    return df.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", "second")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a sorted stream of batches at group borders, so that no group is torn."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        if not part.num_rows:
            continue
        change = borders(part, keys)
        last = int(change[-1])
        if last:
            yield part.slice(0, last).combine_chunks()
        rest = part.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def borders(part: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a sorted table."""
    differs = np.zeros(part.num_rows, bool)
    differs[0] = True
    for key in keys:
        values = part.column(key).to_numpy()
        differs[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(differs)


def pairs_within(starts: np.ndarray, mids: np.ndarray, ends: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of groups ``[start, end)`` in chunks of about ``most``.

    ``mid == end``: all pairs of one block; else all pairs between ``[start, mid)`` and ``[mid, end)``.  A group that
    has only the second of two blocks has ``start == mid`` and no pairs.
    """
    sizes = ends - starts
    inner = mids == ends
    small = inner & (sizes <= 64)
    for size in np.unique(sizes[small & (sizes > 1)]):
        first, second = np.triu_indices(size, 1)
        some = starts[small & (sizes == size)]
        step = max(1, most // len(first))
        for at in range(0, len(some), step):
            base = some[at : at + step, None]
            yield (base + first).ravel(), (base + second).ravel()
    for start, mid, end in zip(starts[~small], mids[~small], ends[~small]):
        if mid == end:
            left = np.arange(start, end)
            step = max(1, most // len(left))
            for at in range(0, len(left), step):
                a, b = np.meshgrid(left[at : at + step], left[at + 1 :], indexing="ij")
                keep = a < b
                yield a[keep], b[keep]
        elif start < mid:
            right = np.arange(mid, end)
            step = max(1, most // len(right))
            for at in range(start, mid, step):
                a, b = np.meshgrid(np.arange(at, min(mid, at + step)), right, indexing="ij")
                yield a.ravel(), b.ravel()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number each of ``n`` rows is connected to by the edges ``a``, ``b``."""
    label = np.arange(n)
    while len(a):
        one, two = label[a], label[b]
        high, low = np.maximum(one, two), np.minimum(one, two)
        order = np.argsort(-low, kind="stable")  # of several writes the last stays: the smallest
        label[high[order]] = low[order]
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def group_bounds(part: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, first rows of the second block (the end if there is one block) and ends of dealt groups."""
    starts = borders(part, [*keys, "lo", "hi"])
    ends = np.append(starts[1:], part.num_rows)
    second = part.column("second").to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.append(0, np.cumsum(second))
    mids = ends - (firsts[ends] - firsts[starts])
    two = part.column("lo").to_numpy()[starts] != part.column("hi").to_numpy()[starts]
    mids = np.where(two, mids, ends)
    # only the first block of two is there: nothing to compare
    alone = two & (mids == ends)
    return starts[~alone], mids[~alone], ends[~alone]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose ``column`` holds about ``most`` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and the offsets of the texts; nulls are empty."""
    import pyarrow.compute as pc

    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEED = np.random.Generator(np.random.PCG64(20170411))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = int(_SEED.integers(1, 2**62)) * 2 + 1
_BACK = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class ByteHashes:
    """Hashes of any stretches of one array of bytes, A-Z taken as a-z."""

    def __init__(self, raw: np.ndarray):
        lowered = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self._total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[lowered] * _powers(_STEP, len(raw))[:-1], out=self._total[1:])
        self._back = _powers(_BACK, len(raw))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        plain = (self._total[ends] - self._total[starts]) * self._back[starts]
        return mix(plain + (ends - starts).astype(np.uint64))


def words(blank: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without blanks, and for each text the number of the first word; none spans texts."""
    fresh = np.zeros(len(blank) + 1, bool)
    fresh[offsets] = True
    before = np.append(True, blank[:-1]) | fresh[:-1]
    after = np.append(blank[1:], True) | fresh[1:]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
