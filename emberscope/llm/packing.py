"""Bounded-space online packing of token sequences.

A document is its token ids and an end mark; stretches of a whole window are windows of their own, and what is left of
the document is a piece to be placed.  Each partition keeps ``OPEN`` windows open and reads its pieces once:

* a piece goes to the open window in which it leaves the least room (best fit);
* if it fits nowhere and a window is still to be had, it opens one;
* else the fullest open window is emitted.  If more than ``GAP`` places are free in it, the piece is cut and its
  beginning fills them; what is left of the piece is placed again.

At the end of a partition its open windows are leftovers.  Leftovers of ``FAN`` partitions are merged by the same
rule, round by round, until one task has the last ``FAN * OPEN`` of them; there the rest is cut to whole windows, and what remains
to windows of a power of two.  So no task holds more than a fixed number of windows, no row moves before the merging,
and only the windows left over at the end of a partition do.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import saved, text_slices

WINDOW, END_ID = 1024, 0
OPEN, GAP, FAN = 64, 4, 32
#: Characters that are tokenised at a time; longer texts are cut where no token can span.
STRETCH = 1 << 18
_BATCH_BYTES = 1 << 20
#: Between two characters that are no white space, a single blank or line feed always begins a new word of the tokenizer.
_SEAM = re.compile(r"(?<=[^\s])(?=[ \n][^\s])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranked(path: str):
    """The same vocabulary as ranks of byte strings, which tiktoken reads four times as fast; None if it is of another kind.

    Ranks say the same as merges if each merge makes the token of the next id.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    model, before = known["model"], known.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or known.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        return None
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or len(model["vocab"]) - len(set(made)) < 256:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    special = {x["content"] for x in known.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): number for token, number in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sorted(special)


#: Texts beyond Latin letters and common punctuation, where libraries may hold different versions of Unicode, and texts
#: with very long runs, where ranks are slow, go to the tokenizer itself.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u20ac]|\\S{1000}|\\s{1000}")


def _encode(text: str, path: str) -> list[int]:
    """Token ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""
    ranked = _ranked(path)
    if ranked and not _UNUSUAL.search(text) and not any(x in text for x in ranked[1]):
        return ranked[0].encode_ordinary(text)
    return _tokenizer(path).encode(text, add_special_tokens=False).ids


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``most`` characters whose token ids, put together, are those of the text."""
    at = 0
    while len(text) - at > most:
        seam = _SEAM.search(text, at + most)
        if seam is None:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def token_ids(text: str, path: str) -> np.ndarray:
    """Token ids of a text and the end mark."""
    parts = [np.array(_encode(x, path), np.uint32) for x in stretches(text)]
    return np.concatenate([*parts, np.array([END_ID], np.uint32)])


class Piece:
    """A stretch of the ids of a document."""

    __slots__ = ("doc", "start", "total", "ids")

    def __init__(self, doc, start: int, total: int, ids: np.ndarray):
        self.doc, self.start, self.total, self.ids = doc, start, total, ids

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.total, self.ids[:at]), Piece(self.doc, self.start + at, self.total, self.ids[at:])


class Packer:
    """Best fit into a fixed number of open windows; ``emitted`` takes full windows as lists of pieces."""

    def __init__(self, window: int = WINDOW, opened: int = OPEN, gap: int = GAP):
        self.window, self.opened, self.gap = window, opened, gap
        self.rooms: list[tuple[int, int]] = []  # (free places, number of the window), ascending
        self.windows: dict[int, list[Piece]] = {}
        self.next = 0
        self.emitted: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.window:
            whole, piece = piece.cut(self.window)
            self.emitted.append([whole])
        if piece.start:
            piece.ids = piece.ids.copy()  # so that an open window does not keep all ids of a long document
        while len(piece.ids):
            size = len(piece.ids)
            at = bisect_left(self.rooms, (size, -1))
            if at < len(self.rooms):
                room, number = self.rooms.pop(at)
                self._put(number, room, piece)
                return
            if len(self.rooms) < self.opened:
                self.windows[self.next] = []
                self._put(self.next, self.window, piece)
                self.next += 1
                return
            room, number = self.rooms.pop(0)
            if room > self.gap:
                head, piece = piece.cut(room)
                self.windows[number].append(head)
            self.emitted.append(self.windows.pop(number))

    def _put(self, number: int, room: int, piece: Piece) -> None:
        self.windows[number].append(piece)
        room -= len(piece.ids)
        if room:
            insort(self.rooms, (room, number))
        else:
            self.emitted.append(self.windows.pop(number))

    def leftovers(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        out = [self.windows[number] for _, number in self.rooms]
        self.rooms, self.windows = [], {}
        return out


def finished(left: list[list[Piece]], window: int = WINDOW) -> Iterator[list[Piece]]:
    """The last leftovers in windows without padding: whole ones, then one for each power of two of the rest."""
    pieces = [x for pieces in left for x in pieces]
    total = sum(len(x.ids) for x in pieces)
    sizes = [window] * (total // window) + [1 << i for i in reversed(range(window.bit_length())) if total % window >> i & 1]
    pieces.reverse()
    for size in sizes:
        out = []
        while size:
            piece = pieces.pop()
            if len(piece.ids) > size:
                piece, rest = piece.cut(size)
                pieces.append(rest)
            out.append(piece)
            size -= len(piece.ids)
        yield out


def pieces(
    documents: DataFrame, tokenizer: str | None = None, ident: str = "doc_id", text: str = "text", bodies: bool = True,
    window: int = WINDOW, opened: int = OPEN, gap: int = GAP, fan: int = FAN,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``, one row per piece.

    Every row of ``documents`` is a document: its ids by the tokenizer file, then the end mark.  A null text is empty, so
    it is the end mark alone; a null id stays null, and rows that share an id are packed each by itself.  ``start``
    counts the document's ids before the piece, ``offset`` the ids before it in its sequence; the pieces of a sequence
    lie without gaps from 0 and hold at most ``window`` ids.  ``ids`` is null unless ``bodies``.  An empty table gives
    no rows.  Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    kind = documents.schema[ident].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, window_no long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(window, opened, gap), _Rows(TaskContext.get().partitionId(), 0, bodies)
        doc_type = None
        for batch in text_slices(batches, "text", _BATCH_BYTES):
            doc_type = batch.column("doc_id").type
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = token_ids(body or "", path)
                packer.add(Piece(doc, 0, len(ids), ids))
            out.take(packer)
            yield out.batch(doc_type)
        if doc_type is not None:
            out.leave(packer.leftovers())
            yield out.batch(doc_type)

    source = documents.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text"))
    step = saved(source.mapInArrow(pack, schema))
    done, level = step.where("sequence_id is not null"), 0
    left = step.where("sequence_id is null")
    while (parts := left.agg(F.max("part").alias("n")).first().n) is not None:
        level += 1
        last = parts < fan

        def merge(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            packer = out = doc_type = None
            for batch in batches:
                doc_type = batch.column("doc_id").type
                for row in batch.to_pylist():
                    if out is None or out.part != row["part"] // fan:
                        if out is not None:
                            out.close(packer, last)
                        packer, out = Packer(window, opened, gap), _Rows(row["part"] // fan, level, bodies, out)
                    packer.add(Piece(row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], "<u4")))
                    out.take(packer)
                yield out.batch(doc_type)
            if out is not None:
                out.close(packer, last)
                yield out.batch(doc_type)

        near = left.repartition(F.floor(F.col("part") / fan)).sortWithinPartitions("part", "window_no", "offset")
        step = saved(near.mapInArrow(merge, schema))
        done = done.unionByName(step.where("sequence_id is not null"))
        left = step.where("sequence_id is null")
        if last:
            break
    return done.drop("part", "window_no")


class _Rows:
    """Rows of a group (a partition, later ``fan`` groups), numbered within it."""

    def __init__(self, part: int, level: int, bodies: bool, before: _Rows | None = None):
        self.part, self.bodies, self.n, self.rows = part, bodies, 0, before.rows if before else []
        self.base = level << 56 | part << 32

    def take(self, packer: Packer) -> None:
        for pieces in packer.emitted:
            self._row(pieces, self.base | self.n, None)
            self.n += 1
        packer.emitted = []

    def leave(self, windows: list[list[Piece]]) -> None:
        for number, pieces in enumerate(windows):
            self._row(pieces, None, number)

    def close(self, packer: Packer, last: bool) -> None:
        self.take(packer)
        if last:
            packer.emitted = list(finished(packer.leftovers(), packer.window))
            self.take(packer)
        else:
            self.leave(packer.leftovers())

    def _row(self, pieces: list[Piece], sequence: int | None, number: int | None) -> None:
        at = 0
        for x in pieces:
            raw = np.ascontiguousarray(x.ids, "<u4").tobytes()
            kept = raw if self.bodies or sequence is None else None
            self.rows.append((x.doc, x.start, len(x.ids), zlib.crc32(raw), x.total, sequence, at, kept, self.part, number))
            at += len(x.ids)

    def batch(self, doc_type: pa.DataType) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part", "window_no"]
        kinds = [doc_type, *[pa.int64()] * 6, pa.binary(), pa.int64(), pa.int64()]
        columns = zip(*self.rows) if self.rows else [()] * len(names)
        arrays = [pa.array(list(x), kind) for x, kind in zip(columns, kinds)]
        self.rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(sequence_id, n_ids, input_ids, documents)`` of pieces with bodies; ``input_ids`` are the little-endian ids of a
    sequence as bytes, padded with zeros to ``window`` unless its number of ids is a power of two; ``documents`` lists
    ``(offset, length, doc_id, start)`` of its pieces in order."""
    grouped = packed.groupBy("sequence_id").agg(  # a sequence has at most `window` pieces
        F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("found")
    )
    short = (F.col("n_ids").bitwiseAND(F.col("n_ids") - 1)) != 0
    padding = F.when(short, F.unhex(F.repeat(F.lit("00000000"), F.lit(window) - F.col("n_ids").cast("int")))).otherwise(F.unhex(F.lit("")))
    body = F.unhex(F.array_join(F.transform("found", lambda x: F.hex(x["ids"])), ""))
    return grouped.select(
        "sequence_id", "n_ids", F.concat(body, padding).alias("input_ids"),
        F.transform("found", lambda x: F.struct(x["offset"], x["length"], x["doc_id"], x["start"])).alias("documents"),
    )
