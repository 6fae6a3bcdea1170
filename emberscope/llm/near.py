"""Near-duplicate engine: bands of signatures propose groups, full shingle sets confirm the links.

No step emits all pairs of a group, and none gathers a bucket of unbounded size:

1. ``multi_members``: bands are counted per key (combined on the map side); only keys with several members go on.
2. ``proposed_groups``: the members of a key are dealt to pairs of blocks (``common.deal``).  Inside a task signatures
   are compared; pairs whose estimate is not clearly below the threshold are joined to a spanning forest, and
   only its edges leave the task.  Their connected components are the proposed groups.
3. ``confirmed_links``: every member comes once to its proposed group with its whole text; the group is dealt in
   blocks again, full shingle sets are intersected (sparse columns of a 0/1 matrix, in column chunks of bounded
   size), and again only a spanning forest of the exact links leaves the task.

A link is therefore lost only if no band of its signatures agrees or its estimate is four standard deviations off.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import borders, by_group, components, deal, group_bounds, pairs_within, roots, saved, text_slices, whole_groups

EDGES = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])

#: Pairs that are folded into a forest at a time, and rows that are looked at together.
_FOLD, _ROWS = 1 << 18, 1 << 16
#: Columns of the 0/1 matrix of shingles that are multiplied at a time.
COLUMNS = 4096


def band_keys(signature: F.Column | str, bands: int, band_bytes: int) -> F.Column:
    """Array of one 64-bit key per band of a binary signature."""
    signature = F.col(signature) if isinstance(signature, str) else signature
    return F.array(*(F.xxhash64(F.lit(i), F.substring(signature, i * band_bytes + 1, band_bytes)) for i in range(bands)))


def multi_members(signed: DataFrame, bands: int, band_bytes: int) -> DataFrame:
    """``(id, signature)`` to ``(key, n, id)``: memberships in band buckets with several members."""
    member = signed.select("id", F.explode(band_keys("signature", bands, band_bytes)).alias("key"))
    counts = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return member.join(counts, "key").select("key", "n", "id")


def proposed_groups(signed: DataFrame, bands: int, band_bytes: int, width: int, least: float) -> DataFrame:
    """``(id, component)`` of ids connected by pairs that share a band and whose estimated similarity is ``least``.

    ``signed``: ``(id long, signature binary)``, ids distinct; ``width`` bytes are one coordinate of a signature.  Bands
    take whole coordinates; a member carries the first byte of each, which only adds to the estimate.
    """
    short = F.concat(*(F.substring("signature", i + 1, 1) for i in range(0, bands * band_bytes, width))) if width > 1 else F.col("signature")
    members = multi_members(signed, bands, band_bytes).join(signed.select("id", short.alias("signature")), "id")
    dealt = by_group(deal(members, "key", "id", "n").drop("n"), "key")
    coordinates = bands * band_bytes // width

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["key", "lo", "hi"]):
            ids = part.column("id").to_numpy()
            signatures = part.column("signature").combine_chunks()
            raw = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(len(ids), coordinates)
            yield _forest(ids, ((a, b) for a, b in _likely(raw, pairs_within(*group_bounds(part, ["key"])), least)))

    return components(dealt.mapInArrow(compare, EDGES))


def _likely(raw, pairs, least):
    for a, b in pairs:
        alike = (raw[a] == raw[b]).mean(axis=1) >= least
        yield a[alike], b[alike]


def _forest(ids: np.ndarray, pairs) -> pa.RecordBatch:
    """Edges of a spanning forest over the ids that the pairs of rows connect; pairs are folded in about ``_FOLD`` at a time."""
    label, held, n = np.arange(len(ids)), [], 0

    def folded() -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip(*held, (np.arange(len(ids)), label)))
        return roots(len(ids), a, b)

    for a, b in pairs:
        if len(a):
            held.append((a, b))
            n += len(a)
            if n >= _FOLD:
                label, held, n = folded(), [], 0
    if held:
        label = folded()
    moved = np.flatnonzero((label != np.arange(len(ids))) & (ids != ids[label]))
    edges = np.unique(np.stack([ids[moved], ids[label[moved]]], 1), axis=0) if len(moved) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=_EDGES)


#: Bits of a signature value that a member carries, and values to a 64-bit word; with ``WIDE`` bits there are 9 to a word.
FIELD, FIELDS, WIDE = 3, 18, 7
#: Proposed groups with more members are searched again with ``WIDE`` bits.  In a bucket of 100,000 lines ``FIELD`` bits take so
#: many unlike pairs for likely that most of its members hang together, and the exact step compares all pairs of a group.
CROWD = 1 << 12
#: Buckets with more members are counted and dealt in blocks; others are compared where they are met: at most 134 million
#: pairs of two words, a second or two of a task.
LARGE = 1 << 14
_PAIRS = 1 << 15  # pairs that are compared at a time, so that their words stay in the cache


def _packed(field: int) -> tuple[int, list[str]]:
    """How many values of ``field`` bits go to a word, and the names of the words of up to 36 values."""
    each = FIELDS if field == FIELD else 64 // field
    return each, [f"w{i}" for i in range(2 * FIELDS // each)]


def sketch_words(signatures: np.ndarray, field: int = FIELD) -> tuple[np.ndarray, ...]:
    """The lowest bits of up to 36 signature values a row, packed into two words, or four of ``WIDE`` bits."""
    each, names = _packed(field)
    low = signatures.astype(np.uint64) & np.uint64((1 << field) - 1)
    shifts = (np.arange(each, dtype=np.uint64) * np.uint64(field))[None, :]
    parts = [low[:, i * each : (i + 1) * each] for i in range(len(names))]
    return tuple((x << shifts[:, : x.shape[1]]).sum(axis=1, dtype=np.uint64).view(np.int64) for x in parts)


def _planes(part: pa.Table, field: int = FIELD) -> list[np.ndarray]:
    """For each bit of a packed value one word that has this bit of all values."""
    each, names = _packed(field)
    lowest = np.uint64(sum(1 << (field * i) for i in range(each)))
    words = [part.column(x).to_numpy().view(np.uint64) for x in names]
    return [reduce(np.bitwise_or, (((x >> np.uint64(i)) & lowest) << np.uint64(j) for j, x in enumerate(words))) for i in range(field)]


def _wide_words(batches: Iterator[pa.RecordBatch], value_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), f"<u{value_bytes}").reshape(batch.num_rows, -1)
        words = [pa.array(x) for x in sketch_words(raw, WIDE)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("signature"), *words], names=["id", "signature", *_packed(WIDE)[1]])


def sketch_floor(similarity: float, coordinates: int, field: int = FIELD) -> float:
    """Share of packed values that agree, four standard deviations below that of a pair at the threshold."""
    return estimate_floor(similarity + (1 - similarity) / (1 << field), coordinates)


def proposed_from_sketches(
    signed: DataFrame, bands: int, band_bytes: int, coordinates: int, similarity: float, field: int = FIELD
) -> DataFrame:
    """As ``proposed_groups`` for many small members: ``(id, component)`` of ids connected by likely pairs.

    ``signed``: ``(id long, signature binary, w0 long, w1 long, ...)``, ids distinct, words by ``sketch_words``.  Memberships move
    once, each with the words in place of a signature: buckets of one are seen and dropped where the bucket is compared,
    so nothing is counted beforehand.  Only buckets of more than ``LARGE`` members move again, dealt in blocks.
    """
    most = int((1 - sketch_floor(similarity, coordinates, field)) * coordinates)  # values that may differ
    words = _packed(field)[1]
    members = signed.select("id", *words, F.explode(band_keys("signature", bands, band_bytes)).alias("key"))
    near = members.repartition("key").sortWithinPartitions("key").select("key", "id", *words)
    schema = ", ".join(f"{x} long" for x in ("a", "b", "key", *words))
    found = saved(near.mapInArrow(lambda batches: _bucket_links(batches, most, field), schema))
    large = found.where("b is null").select("key", F.col("a").alias("id"), *words)
    counts = large.groupBy("key").agg(F.count("*").alias("n"))
    # rows are narrow: two blocks have as many as a bucket that is compared where it is met
    dealt = by_group(deal(large.join(counts, "key"), "key", "id", "n", LARGE // 2).drop("n"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["key", "lo", "hi"]):
            yield _forest(part.column("id").to_numpy(), _alike(_planes(part, field), *group_bounds(part, ["key"]), most))

    return components(found.where("b is not null").select("a", "b").unionByName(dealt.mapInArrow(compare, EDGES)))


def _alike(planes, starts, mids, ends, most):
    """Row pairs of groups (see ``pairs_within``) of which at most ``most`` values differ."""
    wide = (mids != ends) | (ends - starts > 64)
    for a, b in pairs_within(starts[~wide], mids[~wide], ends[~wide]):
        few = np.bitwise_count(reduce(np.bitwise_or, (x[a] ^ x[b] for x in planes))) <= most
        yield a[few], b[few]
    for start, mid, end in zip(starts[wide].tolist(), mids[wide].tolist(), ends[wide].tolist()):
        at, last = start, end if mid == end else mid
        while at < last:  # some rows against a stretch of rows, without a list of all their pairs
            first = at + 1 if mid == end else mid
            to = min(last, at + max(1, _PAIRS // max(1, end - first)))
            differing = planes[0][at:to, None] ^ planes[0][None, first:end]
            room = np.empty_like(differing)
            for x in planes[1:]:
                np.bitwise_xor(x[at:to, None], x[None, first:end], out=room)
                np.bitwise_or(differing, room, out=differing)
            found = np.flatnonzero(np.bitwise_count(differing) <= most)
            a, b = found // (end - first) + at, found % (end - first) + first if end > first else found
            yield (a, b) if mid < end else (a[a < b], b[a < b])
            at = to


def _bucket_links(batches: Iterator[pa.RecordBatch], most: int, field: int = FIELD) -> Iterator[pa.RecordBatch]:
    """Forests of the likely pairs of each bucket; the members of a large one instead, with a null in place of ``b``.

    Holds a batch and at most ``LARGE`` rows of a bucket.
    """
    large = None  # the key of the bucket that is being passed through
    rest: pa.Table | None = None
    for piece in _gathered(batches):
        part = piece if rest is None else pa.concat_tables([rest, piece])
        yield from _buckets(part.combine_chunks(), most, field, large, False)
        starts = borders(part, ["key"])
        last = int(starts[-1])
        key = part.column("key")[last].as_py()
        if key == large or part.num_rows - last > LARGE:
            large, rest = key, None
        else:
            large, rest = None, part.slice(last)
    if rest is not None:
        yield from _buckets(rest.combine_chunks(), most, field, large, True)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _buckets(part: pa.Table, most: int, field: int, large: int | None, ended: bool) -> Iterator[pa.RecordBatch]:
    """Buckets of a table; the last one is left for later, unless it is large or the stream has ended."""
    ids, keys = part.column("id").to_numpy(), part.column("key").to_numpy()
    starts = borders(part, ["key"])
    ends = np.append(starts[1:], part.num_rows)
    big = (ends - starts > LARGE) | (keys[starts] == large if large is not None else np.zeros(len(starts), bool))
    whole = ~big
    if not ended:
        whole[-1] = False
    edges = _forest(ids, _alike(_planes(part, field), starts[whole], ends[whole], ends[whole], most))
    words = _packed(field)[1]
    names = ["a", "b", "key", *words]
    yield pa.RecordBatch.from_arrays([*edges.columns, *[pa.nulls(edges.num_rows, pa.int64())] * (1 + len(words))], names=names)
    for start, end in zip(starts[big], ends[big]):
        some = part.slice(start, end - start)
        columns = [some.column(x).combine_chunks() for x in ("id", "key", *words)]
        yield pa.RecordBatch.from_arrays([columns[0], pa.nulls(len(some), pa.int64()), *columns[1:]], names=names)


def confirmed_links(
    grouped: DataFrame, shingles: Callable[[pa.Array], list[np.ndarray]], numerator: int, denominator: int
) -> DataFrame:
    """Spanning forest ``(a, b)`` of the exact links inside proposed groups.

    ``grouped``: ``(id long, component long, n long, text)``, one row per id, ``n`` the size of its group.  A link: shingle sets with
    ``denominator * intersection >= numerator * union``, both sets non-empty.
    """
    dealt = by_group(deal(grouped, "component", "id", "n").drop("n"), "component")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(_with_sets(batches, shingles), ["component", "lo", "hi"]):
            ids, place = part.column("id").to_numpy(), part.column("shingles").combine_chunks()
            values, offsets = place.values.to_numpy().view(np.uint64), place.offsets.to_numpy()
            links = []
            for start, mid, end in zip(*group_bounds(part, ["component"])):
                sets = [values[offsets[i] : offsets[i + 1]] for i in range(start, end)]
                a, b = linked(sets, mid - start, numerator, denominator)
                links.append((a + start, b + start))
            yield _forest(ids, links[:1] if len(links) == 1 else [tuple(map(np.concatenate, zip(*links)))] if links else [])

    return dealt.mapInArrow(confirm, EDGES)


def _with_sets(batches, shingles):
    """The batches with the distinct shingle hashes of each text in place of the text."""
    for batch in text_slices(batches, "text"):
        sets = shingles(batch.column("text"))
        offsets = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        place = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat))
        names = ["id", "component", "lo", "hi", "second"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), place], names=[*names, "shingles"])


def linked(sets: list[np.ndarray], mid: int, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets: all pairs if ``mid`` is their number, else those across ``mid``."""
    sizes = np.array([len(x) for x in sets])
    n = len(sets)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        common = np.count_nonzero(both[1:] == both[:-1])
        yes = sizes.all() and denominator * common >= numerator * (sizes.sum() - common)
        return (np.array([0]), np.array([1])) if yes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    rows, ordered = np.repeat(np.arange(n), sizes)[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set adds to no intersection
    rows, column = rows[shared], column[shared]
    if len(column):
        column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    first, second = (slice(0, n), slice(0, n)) if mid == n else (slice(0, mid), slice(mid, n))
    common = np.zeros((first.stop - first.start, second.stop - second.start), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, columns, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        block = np.zeros((n, min(COLUMNS, columns - at)), np.float32)
        block[rows[lo:hi], column[lo:hi] - at] = 1
        common += block[first] @ block[second].T
    common = common.astype(np.int64)
    union = sizes[first][:, None] + sizes[second][None, :] - common
    yes = (denominator * common >= numerator * union) & (union > 0)
    a, b = np.nonzero(np.triu(yes, 1) if mid == n else yes)
    return a, b if mid == n else b + mid


def estimate_floor(similarity: float, coordinates: int) -> float:
    """Four standard deviations below the threshold."""
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / coordinates)


def near_classes(
    signed: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    shingles: Callable[[pa.Array], list[np.ndarray]],
    numerator: int,
    denominator: int,
    bands: int,
    band_bytes: int,
    width: int,
) -> DataFrame:
    """``(id, component)`` of the ids with at least one exact link; ``texts`` adds ``text`` to ``(id, component, n)``.

    ``signed`` with words of ``sketch_words`` moves these in place of its signatures.
    """
    coordinates, similarity = bands * band_bytes // width, numerator / denominator
    if "w0" in signed.columns:
        sized = _sized(proposed_from_sketches(signed, bands, band_bytes, coordinates, similarity))
        crowd = sized.where(F.col("n") > CROWD).select("id")
        if not crowd.isEmpty():
            wide = signed.select("id", "signature").join(crowd, "id").mapInArrow(
                lambda batches: _wide_words(batches, width), "id long, signature binary, w0 long, w1 long, w2 long, w3 long"
            )
            again = _sized(proposed_from_sketches(wide, bands, band_bytes, coordinates, similarity, WIDE))
            sized = saved(sized.where(F.col("n") <= CROWD).unionByName(again))
    else:
        sized = _sized(proposed_groups(signed, bands, band_bytes, width, estimate_floor(similarity, coordinates)))
    return components(confirmed_links(texts(sized), shingles, numerator, denominator))


def _sized(groups: DataFrame) -> DataFrame:
    """``(id, component, n)``: counted without the texts, as these are fetched once; saved, so that a few groups are known to be few."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    return saved(groups.join(sizes, "component").select("id", "component", "n"))
