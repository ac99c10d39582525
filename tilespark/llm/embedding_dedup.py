"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative per group.

Only vectors of the same label (and dimension) are compared. Equal vectors
collapse to one with a count; they are told by a 128-bit digest of label and
components. Each label has cells in proportion to the root of its vectors,
fitted by spherical k-means on a bounded sample. Vectors of one cell are
compared with each other. A linked pair may also lie on both sides of a border:
if x is nearest to centre c and y to centre d, then
x.c - x.d <= |x - y| |c - d|, likewise for y, and |x - y| <= 2 sin(angle / 2);
so the vectors of c that are so near to d meet those of d that are so near to c,
and no link is lost (a smaller `slack` than 2 sin(angle / 2) compares fewer and
gives that up). What meets is cut into square blocks of matrix products in
double precision; a block reports links by count and a spanning forest of them,
never as pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those of a null label, link with nothing and stay; rows that
share a vec_id are vectors of their own; component_id is the smallest vec_id
that is not null; a null vec_id is kept by no group but its own; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import connected_components, joined_by_size, least_reached, materialize, runs

#: A label of n vectors has 1 + root(n) / ROOTS_PER_CELL cells, rounded down.
ROOTS_PER_CELL = 6
#: Vectors of a label that its cells are fitted on at most, about, and for each cell; rounds of fitting.
SAMPLE, SAMPLE_PER_CELL, FIT_ROUNDS = 1 << 17, 256, 12
#: Vectors that one task assigns to cells at once, about.
PART = 1 << 13
#: Rows of a block at least; beyond it twice the root of the members.
BLOCK = 1024
#: Rows of a product with all centres at once.
CHUNK = 1024


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 2) -> np.ndarray:
    """k unit centres of unit vectors (fewer if there are fewer vectors)."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        for i in range(0, len(vectors), CHUNK):
            part = vectors[i : i + CHUNK]
            np.add.at(sums, (part @ centres.T).argmax(axis=1), part)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision. Scaled by the largest component first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _read(width: int):
    """(vec_id, label, dim, key, vector) with components of so many bytes: key and vector are null where the vector links with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vectors, dims = [], [], []
            for label, raw in zip(b["label"].to_pylist(), b["embedding"]):
                key = vector = None
                if label is not None and raw.is_valid and raw.values.null_count == 0:
                    # Adding nothing makes one zero of both.
                    values = raw.values.to_numpy(zero_copy_only=False) + 0
                    if len(values) and np.isfinite(values).all() and values.any():
                        vector = values.astype(f"<f{width}").tobytes()
                        key = hashlib.blake2b(vector, digest_size=16, salt=label.to_bytes(8, "little", signed=True)).digest()
                vectors.append(vector)
                keys.append(key)
                dims.append(len(vector) // width if vector else 0)
            arrays = [b["vec_id"], b["label"], pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "dim", "key", "vector"])

    return read


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors at length 1."""
    vectors = column.to_pylist()
    return _units(np.frombuffer(b"".join(vectors), f"<f{len(vectors[0]) // dim}").reshape(len(vectors), dim))


def _fit(table: pa.Table) -> pa.Table:
    centres = spherical_kmeans(_matrix(table["vector"], table["dim"][0].as_py()), table["cells"][0].as_py())
    return pa.table({"label": table["label"][:1], "dim": table["dim"][:1], "centres": pa.array([centres.astype("<f8").tobytes()])})


def _assign(slack: float):
    """Each vector in its own cell, (c, c), and on its side of each border (c, d) that is near."""

    def assign(table: pa.Table, fitted: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py() if table.num_rows else 1
        centres = np.frombuffer(fitted["centres"][0].as_py(), "<f8").reshape(-1, dim) if fitted.num_rows else np.zeros((1, dim))
        vectors = _matrix(table["vector"], dim) if table.num_rows else np.zeros((0, dim))
        at, cells = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for first in range(0, len(vectors), CHUNK):
            dots = vectors[first : first + CHUNK] @ centres.T
            own = dots.argmax(axis=1)
            away = np.sqrt(np.maximum(0, 2 - 2 * (centres[own] @ centres.T)))
            near = dots.max(axis=1, keepdims=True) - dots <= slack * away + 1e-9
            near[np.arange(len(near)), own] = True
            i, j = np.nonzero(near)
            at.append(i + first)
            cells.append(np.stack([own[i], j], axis=1))
        rows, pairs = np.concatenate(at), np.concatenate(cells)
        out = table.select(["rep", "copies", "label", "dim", "vector"]).take(pa.array(rows))
        for name, column in (("c", pairs.min(axis=1)), ("d", pairs.max(axis=1)), ("side", pairs[:, 0])):
            out = out.append_column(name, pa.array(column.astype(np.int32)))
        return out

    return assign


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in runs(batches, ["label", "dim", "c", "d", "lo", "hi"]):
            block, side, reps, copies = (found[c].to_numpy() for c in ("block", "side", "rep", "copies"))
            vectors = _matrix(found["vector"], found["dim"][0].as_py())
            a, z = np.flatnonzero(block == found["lo"][0].as_py()), np.flatnonzero(block == found["hi"][0].as_py())
            links = np.zeros((len(reps), len(reps)), bool)
            inside = found["c"][0] == found["d"][0]
            links[np.ix_(a, z)] = (vectors[a] @ vectors[z].T >= threshold) & (inside | (side[a][:, None] != side[z][None, :]))
            links |= links.T
            np.fill_diagonal(links, False)
            some = links.any(axis=1)
            reps, copies, links = reps[some], copies[some], links[np.ix_(some, some)]
            arrays = [pa.array(reps), pa.array((links @ copies.astype(np.float64)).astype(np.int64)), pa.array(least_reached(reps, links) if len(reps) else reps)]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "n", "to"])

    return verify


def _members(vectors: DataFrame, slack: float) -> DataFrame:
    """vectors (rep, copies, label, dim, vector) by the cells (c, c) and borders (c, d) where they are compared."""
    sizes = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("cells", (1 + F.floor(F.sqrt("n") / ROOTS_PER_CELL)).cast("int"))
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "embedding-labels")
    sized = vectors.join(sizes, ["label", "dim"])
    # By hash, so that a rerun takes the same vectors.
    share = F.least(F.lit(SAMPLE), F.col("cells") * SAMPLE_PER_CELL) / F.col("n")
    sample = sized.where((F.col("cells") > 1) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * (1 << 30)))
    centres = sample.select("label", "dim", "cells", "vector").groupBy("label", "dim").applyInArrow(_fit, "label long, dim int, centres binary")
    centres = materialize(centres, "embedding-centres")
    # A label's centres go to each part of its vectors.
    spread = centres.join(sizes, ["label", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parted = sized.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int"))
    keys = ["label", "dim", "part"]
    left, right = parted.select(*keys, "rep", "copies", "vector"), spread.select(*keys, "centres")
    fields = "rep long, copies long, label long, dim int, vector binary, c int, d int, side int"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_assign(slack), fields)


def embedding_dedup(table: DataFrame, threshold: float = 0.98, slack: float | None = None) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    if slack is None:
        slack = 2 * float(np.sin(np.arccos(threshold) / 2))
    # Single precision travels as it is, and is widened where it is used.
    single = isinstance(table.schema["embedding"].dataType.elementType, FloatType)
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"))
    rows = rows.mapInArrow(_read(4 if single else 8), "vec_id long, label long, dim int, key binary, vector binary")
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "embedding-rows")
    known = rows.where("key is not null")
    distinct = known.groupBy("label", "dim", "key").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(distinct, "embedding-distinct")
    vectors = distinct.join(known.select(F.col("row_id").alias("rep"), "vector"), "rep")
    members = materialize(_members(vectors, slack), "embedding-members")
    group = ["label", "dim", "c", "d"]
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / F.greatest(F.lit(float(BLOCK)), 2 * F.sqrt("m"))).cast("int")
    placed = members.join(sizes, group).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*group, "lo", "hi"]
    placed = placed.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).select(*keys, "block", "side", "rep", "copies", "vector")
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(max(tasks, members.count() // (4 * BLOCK)), *keys).sortWithinPartitions(*keys)
    verified = materialize(placed.mapInArrow(_verify(threshold), "rep long, n long, to long"), "embedding-links")
    links = verified.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = connected_components(verified.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), "embedding").withColumnRenamed("id", "rep")
    mine = distinct.select("key", "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left")
    mine = mine.select("key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    n_rows = rows.count()
    out = joined_by_size(rows.select("vec_id", "row_id", "key"), materialize(mine, "embedding-named"), "key", "copies", n_rows).withColumn("root", F.coalesce("root", "row_id"))
    out = materialize(out.select("vec_id", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "embedding-roots")
    least = materialize(out.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "embedding-least")
    out = joined_by_size(out, least, "root", "n", n_rows)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
