"""Near-duplicate documents by fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017).

A document is the set of its distinct five-word shingles (words lower-cased in A-Z, split at ASCII blanks; with fewer
words the whole sequence is one shingle).  Its sketch has ``COORDINATES`` bins.  In round i every shingle is thrown into
one bin by a hash of its own, with the value (i, hash); a bin keeps its smallest value, so values of earlier rounds
win.  The rounds end when every bin is filled; from round ``COORDINATES`` on, round i throws every shingle into bin
i - COORDINATES, so after two times ``COORDINATES`` rounds every bin is filled for certain.  Two sketches agree in a
bin with a probability of the Jaccard similarity, with Chernoff-type concentration over the bins.

Bands of the sketch propose pairs, full sets confirm them (``near``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberscope.llm.common import fresh, ByteHashes, mix, saved, text_slices, utf8, words
from emberscope.llm.near import near_classes

WORDS = 5
#: 20 bands of 5 coordinates: a pair of similarity 0.85 is missed with a probability of 8e-6, one of 0.8 of 4e-4.
BANDS, ROWS = 20, 5
COORDINATES = BANDS * ROWS
WIDTH = 2  # bytes kept of a coordinate

_SEED = np.random.Generator(np.random.PCG64(20170411))
_PLACE = _SEED.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_ROUND = _SEED.integers(1, 2**63, 2 * COORDINATES, dtype=np.uint64)


def word_shingles(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    raw, offsets = utf8(texts)
    if not len(raw):
        return [np.zeros(0, np.uint64)] * len(texts)
    starts, ends, edge = words((raw == 32) | ((raw >= 9) & (raw <= 13)), offsets)
    hashed = ByteHashes(raw).of(starts, ends)
    full = np.zeros(max(0, len(hashed) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        full += hashed[i : i + len(full)] * _PLACE[i]
    full = mix(full)
    out = []
    for first, last in zip(edge[:-1], edge[1:]):
        if last - first >= WORDS:
            out.append(np.unique(full[first : last - WORDS + 1]))
        elif last > first:
            short = hashed[first:last] * _PLACE[: last - first]
            out.append(mix(np.array([short.sum(dtype=np.uint64) ^ np.uint64(last - first)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fast_sketch(values: np.ndarray) -> np.ndarray:
    """The bins of a non-empty set of 64-bit hashes."""
    bins = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    open_ = COORDINATES
    for i in range(2 * COORDINATES):
        hashed = mix(values ^ _ROUND[i])
        value = (np.uint64(i) << np.uint64(54)) | (hashed >> np.uint64(10))
        if i < COORDINATES:
            place = ((hashed & np.uint64(0xFFFFFFFF)) * np.uint64(COORDINATES)) >> np.uint64(32)
            order = np.argsort(value)[::-1]  # of several writes the last stays: the smallest
            thrown = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
            thrown[place[order]] = value[order]
            np.minimum(bins, thrown, out=bins)
        else:
            bins[i - COORDINATES] = min(bins[i - COORDINATES], value.min())
        open_ = np.count_nonzero(bins == np.iinfo(np.uint64).max)
        if not open_:
            break
    return bins


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        sets = word_shingles(batch.column("text"))
        digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        known: dict[bytes, bytes] = {}
        for x, digest in zip(sets, digests):
            if digest is not None and digest not in known:
                known[digest] = mix(fast_sketch(x)).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("fp"),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([known.get(x) for x in digests], pa.binary()),
            ],
            names=["id", "fp", "n_shingles", "digest", "signature"],
        )


def _decided(documents: DataFrame, ident: str, text: str, percent: int) -> DataFrame:
    """``(id, fp, n_shingles, component_id, kept)`` per row; ``fp`` is a hash of the text."""
    source = documents.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signed = saved(source.select("id", F.xxhash64("text").alias("fp"), "text").mapInArrow(
        _signed, "id long, fp long, n_shingles long, digest binary, signature binary"
    ))
    classes = saved(
        signed.where("digest is not null and id is not null")
        .groupBy("digest").agg(F.min(F.struct("id", "signature")).alias("least"))
        .select("digest", "least.id", "least.signature")
    )

    def with_text(groups: DataFrame) -> DataFrame:
        return groups.join(source.where("id is not null"), "id")

    members = near_classes(
        classes.select("id", "signature"), with_text, word_shingles, percent, 100, BANDS, ROWS * WIDTH, WIDTH
    )
    placed = classes.join(members, "id", "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    rows = signed.select("id", "fp", "n_shingles", "digest")
    # texts without shingles have no class: they do not take part in the join, where they would all meet in one task
    out = rows.where("digest is not null").join(placed, "digest", "left").unionByName(
        rows.where("digest is null").withColumn("class_id", F.lit(None).cast("long"))
    )
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")))
    return out.select("id", "fp", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(documents: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Two documents are linked if ``100 * intersection >= percent * union`` of their shingle sets.  Documents with equal
    sets are one class and go through the search once, so thousands of copies cost one signature.

    A null or empty text, or one of blanks only, has no shingles and is linked with nothing.  Rows that share an id
    are one document: what any of them links to, the id links to.  A row without an id is a component of its own
    with a null ``component_id`` and stays.  An empty table gives an empty result.  Other columns are not read.
    """
    return _decided(documents, ident, text, percent).drop("fp").withColumnRenamed("id", "doc_id")


def without_near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest id, of repeated rows one.

    All columns come back as they are.  Rows without an id stay.
    """
    decided = _decided(documents, "doc_id", "text", percent)
    ident, name, number = fresh("id"), fresh("fp"), fresh("n")
    kept = decided.where("kept and id is not null").select(F.col("id").alias(ident), F.col("fp").alias(name)).distinct()
    once = documents.where("doc_id is not null").withColumn(name, F.xxhash64("text"))
    stays = once.join(kept, (F.col("doc_id").cast("long") == F.col(ident)) & (once[name] == kept[name]), "left_semi")
    # rows that share id and text are one document: any of them stands for it
    place = F.row_number().over(Window.partitionBy("doc_id", name).orderBy(F.lit(0)))
    one = stays.withColumn(number, place).where(F.col(number) == 1)
    return one.select(documents.columns).unionByName(documents.where("doc_id is null"))
