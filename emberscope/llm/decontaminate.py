"""Benchmark decontamination by q-gram lemma filtering.

If a pattern of m characters occurs in a text with at most k edits, at least ``m - q + 1 - k * q`` of its q-grams occur
there too, on diagonals (text position less pattern position) at most k apart.  So the q-grams a text shares with a
pattern are counted in bands of diagonals of twice the budget that overlap by half, and only bands that
reach the bound are aligned: a banded edit-distance table decides whether the region holds the pattern within its budget.

Texts and patterns are compared as UTF-8 bytes with A-Z lower-cased and each ASCII blank as a space, so an edited
character beyond ASCII may cost two.  An item longer than ``LONGEST`` is searched in overlapping windows.

A document may hold a part of an item only.  So of every item longer than ``PASSAGE`` its passages of that length,
``STEP`` bytes apart, are patterns too, by the same rule: a stretch of ``PASSAGE + STEP`` bytes of an item is found
however long the item is.  Passages have no q-grams of their own; they are counted from those of their item.

An item shorter than ``SHORTEST`` leaves no room for edits: it is searched as it is, between characters that are no letters
or digits, all such items at once by one automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.common import fresh, saved, text_slices, utf8

Q = 8
EDITS = 0.1
SHORTEST, LONGEST = 24, 1024
PASSAGE, STEP = 100, 50
#: The patterns of one pass; a larger benchmark is searched in several.
SHARD_BYTES = 16 << 20
SPANS = "array<struct<item_id:bigint,start:int,end:int,edits:int,covered:double>>"
_SPANS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("covered", pa.float64())]))
_GATE = 22
_CELLS = 1 << 22


def normal(raw: np.ndarray) -> np.ndarray:
    out = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    out[(raw >= 9) & (raw <= 13)] = 32
    return out


def grams(raw: np.ndarray) -> np.ndarray:
    """The ``Q`` bytes from each position on, as one number."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray(len(raw) - Q + 1, "<u8", np.ascontiguousarray(raw), strides=(1,)).astype(np.uint64)


def _gate(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _GATE)).astype(np.int64)


def budget(length: int) -> int:
    """Edits allowed in a pattern: a tenth of it, or as many as leave one q-gram for certain."""
    return max(0, min(int(EDITS * length), (length - Q) // Q))


class Patterns:
    """Patterns of benchmark items and the places of their q-grams.

    The first ``whole`` patterns are items or their windows, in the index; their passages follow.  ``spots`` has the item
    (its number among the distinct ones) and the stretch of it that a pattern is, ``lengths`` the bytes of each item.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.texts, self.spots, self.lengths = [], [], [], []
        self.short: dict[str, list[int]] = {}
        for ident, text in sorted(items):
            raw = normal(np.frombuffer((text or "").strip(" \t\n\x0b\x0c\r").encode(), np.uint8))
            if len(raw) < SHORTEST:
                if len(raw):
                    self.short.setdefault(raw.tobytes().decode("latin-1"), []).append(ident)
                continue
            starts = range(0, max(1, len(raw) - LONGEST // 2), LONGEST // 2) if len(raw) > LONGEST else (0,)
            for at in starts:
                self.items.append(ident)
                self.texts.append(raw[at : at + LONGEST])
                self.spots.append((len(self.lengths), at))
            self.lengths.append(len(raw))
        self.whole = len(self.texts)
        sizes = np.array([len(x) for x in self.texts], np.int64)
        # passages of a pattern: ``regular`` ones at multiples of STEP, and one at its end if that is no multiple;
        # ``base`` is the number of the first
        self.regular = np.where(sizes > PASSAGE, (sizes - PASSAGE) // STEP + 1, 0)
        self.tail = (sizes > PASSAGE) & ((sizes - PASSAGE) % STEP > 0)
        self.base = self.whole + np.cumsum(self.regular + self.tail) - self.regular - self.tail
        for j in range(self.whole):
            item, lead = self.spots[j]
            for at in [*(STEP * np.arange(self.regular[j])), *([sizes[j] - PASSAGE] if self.tail[j] else [])]:
                self.items.append(self.items[j])
                self.texts.append(self.texts[j][at : at + PASSAGE])
                self.spots.append((item, lead + int(at)))
        self.sizes = np.array([len(x) for x in self.texts], np.int64)
        self.budgets = np.array([budget(x) for x in self.sizes], np.int64)
        self.bounds = np.maximum(1, self.sizes - Q + 1 - self.budgets * Q)
        # what a text has to have of a whole pattern, so that it or one of its passages can be there
        self.least = np.minimum(self.bounds[: self.whole], np.where(sizes > PASSAGE, PASSAGE - Q + 1 - budget(PASSAGE) * Q, LONGEST))
        every = np.concatenate([np.zeros(0, np.uint64), *map(grams, self.texts[: self.whole])])
        owner = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - Q + 1))
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(max(0, x - Q + 1)) for x in sizes)])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.names, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.gate = np.zeros(1 << _GATE, bool)
        self.gate[_gate(self.names)] = True
        self.automaton = None
        if self.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, found in self.short.items():
                self.automaton.add_word(word, (len(word), found))
            self.automaton.make_automaton()

    def short_hits(self, plain: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, start, end)`` of the short items that stand between characters that are no letters or digits."""
        if self.automaton is None:
            return
        inner = ((plain >= 97) & (plain <= 122)) | ((plain >= 48) & (plain <= 57)) | (plain >= 128)
        whole = plain.tobytes().decode("latin-1")
        for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for last, (size, found) in self.automaton.iter(whole, begin, end):
                start, stop = last - size + 1, last + 1
                # an item that begins or ends with another character bounds itself
                before = start == begin or not inner[start - 1] or not inner[start]
                after = stop == end or not inner[stop] or not inner[stop - 1]
                if start >= begin and before and after:
                    yield from ((i, ident, start, stop) for ident in found)

    def regions(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(text, pattern, lowest diagonal, highest diagonal)`` of the bands that reach the bound, merged if they touch."""
        found = grams(raw)
        at = np.flatnonzero(self.gate[_gate(found)])
        name = np.searchsorted(self.names, found[at])
        some = (name < len(self.names)) & (self.names[np.minimum(name, len(self.names) - 1)] == found[at])
        at, name = at[some], name[some]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[text + 1]
        at, name, text = at[inside], name[inside], text[inside]
        times = self.first[name + 1] - self.first[name]
        row = np.repeat(np.arange(len(at)), times)
        entry = self.first[name][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        owner, place, text, at = self.owner[entry], self.place[entry], text[row], at[row]
        # two cheap cuts before the exact count, neither of which loses a band: all that a text has of a pattern, ...
        pair = (text - text[0]) * self.whole + owner if len(text) else text
        if len(pair) and pair.max() > 8 * len(pair):
            pair = np.unique(pair, return_inverse=True)[1]
        some = np.bincount(pair)[pair] >= self.least[owner]
        owner, place, text, at = self.with_passages(owner[some], place[some], text[some], at[some])
        width = self.budgets[owner] + 1
        band = np.floor_divide(at - place, width)
        # ... and what is in a band and the next one or the one before; bands that share a cell only add to it
        cell = ((text * len(self.texts) + owner).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
        cell = (cell + band) & (_CELLS - 1)
        full = np.bincount(cell, minlength=_CELLS)
        some = full[cell] + np.maximum(full[(cell + 1) & (_CELLS - 1)], full[cell - 1]) >= self.bounds[owner]
        owner, place, text, band = owner[some], place[some], text[some], band[some]
        keys = np.concatenate([np.stack([text, owner, band - shift, place], 1) for shift in (0, 1)])
        order = np.lexsort((keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
        keys = keys[order]
        if not len(keys):
            return []
        differs = keys[1:] != keys[:-1]
        new_band = np.append(True, differs[:, :3].any(1))
        new_place = np.append(True, differs.any(1))
        starts = np.flatnonzero(new_band)
        counts = np.add.reduceat(new_place.astype(np.int64), starts)
        out: list[tuple[int, int, int, int]] = []
        for text, owner, band in keys[starts[counts >= self.bounds[keys[starts, 1]]], :3]:
            width = int(self.budgets[owner]) + 1
            low, high = int(band) * width, (int(band) + 2) * width - 1
            if out and out[-1][:2] == (text, owner) and low <= out[-1][3]:
                out[-1] = (text, owner, out[-1][2], high)
            else:
                out.append((int(text), int(owner), low, high))
        return out

    def with_passages(self, owner: np.ndarray, place: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Occurrences of q-grams of whole patterns, and the same as those of the passages they lie in."""
        rows, owners, places = [np.arange(len(owner))], [owner], [place]
        regular, last = self.regular[owner], self.sizes[owner] - PASSAGE
        for back in range(-(-PASSAGE // STEP) + 1):
            if back:
                number = place // STEP - (back - 1)
                begin, there = number * STEP, (number >= 0) & (number < regular)
            else:
                number, begin, there = regular, last, self.tail[owner]
            inside = np.flatnonzero(there & (begin <= place) & (place <= begin + PASSAGE - Q))
            rows.append(inside)
            owners.append(self.base[owner[inside]] + number[inside])
            places.append(place[inside] - begin[inside])
        rows = np.concatenate(rows)
        return np.concatenate(owners), np.concatenate(places), text[rows], at[rows]

    def align(self, raw: np.ndarray, begin: int, end: int, pattern: int, low: int, high: int) -> tuple[int, int, int] | None:
        """``(start, end, edits)`` of the pattern in ``raw[begin:end]`` on the diagonals, if it is within its budget."""
        needle, k = self.texts[pattern], int(self.budgets[pattern])
        m, base = len(needle), low - k
        width = high + k - base + 1
        one, never = np.int64(1) << 32, np.int64(1) << 56
        column = base + np.arange(width)  # text position of row 0 on each diagonal
        usable = (column >= begin) & (column <= end) & (column >= low) & (column <= high)
        state = np.where(usable, column - begin, never)  # edits in the high half, where the match began in the low
        steps = np.arange(width) * one
        padded = np.zeros(width + m + 1, np.uint8)
        lo, hi = max(begin, base), min(end, base + width + m)
        if hi > lo:
            padded[lo - base : hi - base] = raw[lo:hi]
        for i in range(m):
            column = base + i + np.arange(width)
            inside = (column >= begin) & (column < end)
            taken = np.where(inside, state + (padded[i : i + width] != needle[i]) * one, never)
            skipped = np.append(state[1:], never) + one  # a pattern byte that the text lacks: the diagonal falls
            state = np.minimum(taken, skipped)
            reach = base + i + 1 + np.arange(width)
            state = np.minimum.accumulate(state - steps) + steps  # text bytes that the pattern lacks
            state = np.where((reach >= begin) & (reach <= end), np.minimum(state, never), never)
        best = int(state.min())
        if best >> 32 > k:
            return None
        last = int(np.flatnonzero(state == best)[0])
        return begin + (best & 0xFFFFFFFF), base + m + last, best >> 32

    def found(self, texts: pa.Array) -> list[list[dict]]:
        """For each text the items and passages it holds, with places in code points and the share of the item found in the text.

        Passages inside a whole pattern that was found, but for the width of a band, are not listed.
        """
        raw, offsets = utf8(texts)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not len(raw):
            return out
        plain = normal(raw)
        for text, item, start, end in self.short_hits(plain, offsets):
            begin = int(offsets[text])
            place = [int(np.count_nonzero((raw[begin:x] & 0xC0) != 0x80)) for x in (start, end)]
            out[text].append({"item_id": int(item), "start": place[0], "end": place[1], "edits": 0, "covered": 1.0})
        if not len(self.texts):
            return [sorted(row, key=lambda x: (x["start"], x["end"], x["item_id"])) for row in out]
        hits: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for text, pattern, low, high in sorted(self.regions(plain, offsets), key=lambda x: x[1] >= self.whole):
            begin, end = int(offsets[text]), int(offsets[text + 1])
            known = hits.setdefault((text, self.spots[pattern][0]), [])
            slack = 2 * (int(self.budgets[pattern]) + 1)  # the width of a band
            if pattern >= self.whole and any(p < self.whole and a - slack <= low and high + PASSAGE <= b + slack for p, a, b, _ in known):
                continue
            hit = self.align(plain, begin, end, pattern, low, high)
            if hit:
                known.append((pattern, *hit))
        for (text, item), known in hits.items():
            begin = int(offsets[text])
            lead = lambda x: int(np.count_nonzero((raw[begin:x] & 0xC0) != 0x80))
            covered = round(self.covered([p for p, *_ in known]) / self.lengths[item], 4) if known else 0.0
            out[text] += [
                {"item_id": int(self.items[p]), "start": lead(a), "end": lead(b), "edits": int(edits), "covered": covered} for p, a, b, edits in known
            ]
        return [sorted({tuple(x.items()): x for x in row}.values(), key=lambda x: (x["start"], x["end"], x["item_id"])) for row in out]

    def covered(self, patterns: list[int]) -> int:
        """Bytes of an item that its patterns cover together."""
        total, reach = 0, 0
        for at, size in sorted((self.spots[p][1], int(self.sizes[p])) for p in patterns):
            total += max(0, at + size - max(reach, at))
            reach = max(reach, at + size)
        return total


def shards(benchmark: DataFrame) -> Iterator[tuple[Patterns, bool]]:
    """The benchmark in parts of about ``SHARD_BYTES``, one at a time, and whether another follows."""
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // SHARD_BYTES))
    for i in range(count):
        yield Patterns([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i).collect()]), i + 1 < count


def leaks(documents: DataFrame, benchmark: DataFrame, columns: list[str], name: str = "leaks") -> DataFrame:
    """The columns asked for and ``leaks``, the benchmark items found in each row with their places and edits.

    An item, a window of a long one, or a passage of it is an entry; ``covered`` is the share of the item that all entries
    of the item in the row cover together.  Edits are those of the entry; items under ``SHORTEST`` bytes are found without any.
    A null text holds nothing; items that are null or empty are not searched; equal items count once.  ``start`` and
    ``end`` are code points, end exclusive.  Item ids are whole numbers.  Other columns are not read.

    A benchmark of several parts is searched a part at a time: the rows with what was found so far are written before
    the next part is read, so that the driver and the tasks hold one part.
    """
    body = fresh("text")
    out = documents.select(*columns, F.col("text").cast("string").alias(body), F.array().cast(SPANS).alias(name))
    schema = T.StructType(list(out.schema.fields))
    for patterns, more in shards(benchmark):
        known = documents.sparkSession.sparkContext.broadcast(patterns)  # bounded by SHARD_BYTES

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, body):
                before = batch.column(name).to_pylist()
                rows = [a + b for a, b in zip(before, known.value.found(batch.column(body)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, _SPANS)], names=schema.names)

        out = out.mapInArrow(search, schema)
        if more:
            out = saved(out)
            known.unpersist()
    return out.drop(body)


def leaks_by_document(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = leaks(documents, benchmark, ["doc_id"])
    listed = F.transform("leaks", lambda x: F.concat_ws(":", x["item_id"], x["start"], x["end"], x["edits"]))
    most = lambda i: F.array_max(F.transform(F.filter(found["leaks"], lambda x: x["item_id"] == i), lambda x: x["covered"]))
    items = F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_leaks"),
        items.alias("items"), F.array_join(listed, ",").alias("leaks"), F.transform(items, most).alias("covered"),
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item and no passage of one, all columns as they are."""
    name = fresh("leaks")
    return leaks(documents, benchmark, documents.columns, name).where(F.size(name) == 0).select(documents.columns)
