"""Near-duplicate embeddings by cross-polytope hashing (Andoni, Indyk, Laarhoven, Razenshteyn, Schmidt 2015).

One hash: three rounds of random signs and a fast Hadamard transform rotate the vector; its code is the signed axis
that is nearest.  Multiprobe: the ``PROBES`` nearest axes are all taken.  A bucket of a table is a tuple of ``HASHES``
codes, so a vector is in ``PROBES ** HASHES`` buckets of each of ``TABLES`` tables, and two vectors meet in a table if
they share a code in each of its hashes.  In 64 dimensions vectors of cosine 0.95 share one of two codes in 92 of 100
hashes, so a pair at the threshold is missed by all tables with a probability of 6e-6 and nearer ones far more rarely.

Equal vectors are one class and are hashed once.  The members of a bucket are dealt to pairs of blocks; cosines are
taken in double precision inside the task.  A linked pair is counted in the first bucket that both share, which a task
can tell from their codes, so links are counted without writing them out; of the links only a spanning forest
leaves the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import by_group, components, deal, group_bounds, mix, pairs_within, roots, saved, whole_groups

TABLES, HASHES, PROBES = 8, 3, 2
COSINE = 0.95


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the length is a power of two."""
    n, d = rows.shape
    h = 1
    while h < d:
        pair = rows.reshape(n, d // (2 * h), 2, h)
        rows = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return rows / np.sqrt(d)


def codes(vectors: np.ndarray) -> np.ndarray:
    """``(rows, TABLES, HASHES, PROBES)`` codes, sorted within a hash; length of the vectors is any."""
    n, dim = vectors.shape
    d = 1 << max(1, dim - 1).bit_length()
    wide = np.zeros((n, d))
    wide[:, :dim] = vectors
    out = np.empty((n, TABLES, HASHES, PROBES), np.int32)
    random = np.random.Generator(np.random.PCG64(20150909))
    for t in range(TABLES):
        for k in range(HASHES):
            turned = wide
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], d))
            near = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :PROBES]
            out[:, t, k] = np.sort(2 * near + (np.take_along_axis(turned, near, 1) > 0), axis=1)
    return out


_COMBOS = np.stack(np.meshgrid(*[np.arange(PROBES)] * HASHES, indexing="ij"), -1).reshape(-1, HASHES)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its class, its vector at length one and its codes; these are null if it cannot be used."""
    for batch in batches:
        n, column = batch.num_rows, batch.column("vector")
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        node, digest, unit, coded = ([None] * n for _ in range(4))
        for size in np.unique(sizes[sizes > 0]):
            some = np.flatnonzero(sizes == size)
            rows = flat[offsets[:-1][some][:, None] + np.arange(size)] + 0.0
            top = np.abs(rows).max(axis=1)
            usable = np.isfinite(rows).all(axis=1) & (top > 0)
            some, rows, top = some[usable], rows[usable], top[usable]
            units = rows / top[:, None]  # no overflow of squares
            units /= np.sqrt(np.einsum("ij,ij->i", units, units))[:, None]
            for i, row, one, found in zip(some, rows, units, codes(units)):
                digest[i] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
                node[i] = int.from_bytes(digest[i][:8], "little", signed=True)
                unit[i], coded[i] = one.tobytes(), found.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(node, pa.int64()), pa.array(digest, pa.binary()), pa.array(unit, pa.binary()), pa.array(coded, pa.binary())],
            names=["id", "node", "digest", "unit", "codes"],
        )


def _table_codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, TABLES, HASHES, PROBES)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, key, slot)`` for every bucket of every vector; the slot tells the table and the choice of codes."""
    for batch in batches:
        every = _table_codes(batch.column("codes"))
        sizes = np.array([len(x) for x in batch.column("unit").to_pylist()], np.uint64)
        key = mix((np.arange(TABLES, dtype=np.uint64) + np.uint64(1))[None, :, None] + (sizes << np.uint64(8))[:, None, None])
        for k in range(HASHES):
            key = mix(key + every[:, :, k, :][:, :, _COMBOS[:, k]].astype(np.uint64))
        each = TABLES * len(_COMBOS)
        slots = np.tile(np.arange(each, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("id").to_numpy(), each)), pa.array(key.ravel().view(np.int64)), pa.array(slots)],
            names=["id", "key", "slot"],
        )


def _link(cosine: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task and vector: how many rows it is linked with in the buckets here, and the edges of a forest."""
        for part in whole_groups(batches, ["key", "lo", "hi"]):
            ids = part.column("id").to_numpy()
            n = len(ids)
            units = part.column("unit").to_pylist()
            sizes = np.array([len(x) // 8 for x in units])
            wide = np.zeros((n, sizes.max()))
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                wide[some, :size] = np.frombuffer(b"".join(units[i] for i in some)).reshape(len(some), size)
            every, slot, copies = _table_codes(part.column("codes")), part.column("slot").to_numpy(), part.column("copies").to_numpy()
            of_table, choice = slot // len(_COMBOS), _COMBOS[slot % len(_COMBOS)]
            picked = np.take_along_axis(every[np.arange(n), of_table], choice[:, :, None], 2)[:, :, 0]
            links, label = np.zeros(n, np.int64), np.arange(n)
            for a, b in pairs_within(*group_bounds(part, ["key"]), most=1 << 14):
                same_bucket = (of_table[a] == of_table[b]) & (picked[a] == picked[b]).all(1)
                near = (np.einsum("ij,ij->i", wide[a], wide[b]) >= cosine) & (sizes[a] == sizes[b]) & same_bucket
                a, b = a[near], b[near]
                if not len(a):
                    continue
                label = roots(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, label]))
                shared = (every[a][..., :, None] == every[b][..., None, :]).any(-1)  # pair, table, hash, code
                owned = shared.any(-1).all(-1).argmax(1) == of_table[a]  # the first table in which they meet, and
                first = np.take_along_axis(every[a, of_table[a]], shared[np.arange(len(a)), of_table[a]].argmax(-1)[..., None], 2)
                owned &= (first[..., 0] == picked[a]).all(-1)  # of the buckets there the first
                np.add.at(links, a[owned], copies[b[owned]])
                np.add.at(links, b[owned], copies[a[owned]])
            some = np.flatnonzero((links > 0) | (label != np.arange(n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(links[some])], names=["id", "root", "links"]
            )

    return link


def near_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    ``n_links``: other rows whose cosine, in double precision, is at least ``cosine``; ``component_id``: the smallest
    id reachable by links.  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths.  Rows that share an id each count in ``n_links``.  A row without an
    id links with nothing and stays, with a null ``component_id``.  Other columns are not read.
    """
    source = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    coded = saved(source.mapInArrow(_coded, "id long, node long, digest binary, unit binary, codes binary"))
    nodes = saved(
        coded.where("node is not null and id is not null").groupBy("node", "digest")
        .agg(F.min(F.struct("id", "unit", "codes")).alias("least"), F.count("*").alias("copies"))
        .select(F.col("node").alias("id"), "digest", F.col("least.id").alias("vec_id"), "least.unit", "least.codes", "copies")
    )
    member = nodes.select("id", "unit", "codes").mapInArrow(_buckets, "id long, key long, slot int")
    counts = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = member.join(counts, "key").join(nodes.select("id", "unit", "codes", "copies"), "id")
    dealt = by_group(deal(members, "key", "id", "n").drop("n"), "key")
    found = saved(dealt.mapInArrow(_link(cosine), "id long, root long, links long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("digest", "id", "vec_id", "copies").join(links, "id", "left").join(grouped, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    first = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = placed.join(first, "component").select(
        "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    usable = F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")
    out = coded.select("id", usable).join(named, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
