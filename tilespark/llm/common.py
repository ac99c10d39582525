"""Helpers that the corpus operators share: scratch tables, salts and two-level ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, scratch_path, stored

__all__ = ["SPACE_BYTES", "connected_components", "discard", "joined_by_size", "keep_rows", "least_reached", "materialize", "ranked", "runs", "salt", "scratch_path"]

#: The white space of the corpus contracts: space and the controls 9 to 13.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])

materialize = stored

#: Keys that hold more than this part of all rows are hot: there are fewer of them than this number.
HOT_PARTS = 1024


def salt(count: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(0x5A17)), F.lit(count)).cast("int")


def ranked(df: DataFrame, groups: list[str], order: list[Column], salts: int, salt_on: list[str], name: str = "rank") -> DataFrame:
    """Add a gapless rank from 0 within groups without bringing a group to one task.

    Rows are cut into `salts` slices by a hash of `salt_on`; slice sizes are
    pre-aggregated, their running sum (at most groups x salts rows) gives each
    slice its first rank, and a window ranks the rows within a slice. The group
    columns must not be null.
    """
    df = df.withColumn("_slice", salt(salts, *salt_on))
    sizes = df.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*groups, "_slice").orderBy(*order)
    rows = df.withColumn("_within", F.row_number().over(inner) - 1)
    keys = [*groups, "_slice"]
    return rows.join(first, keys).withColumn(name, (F.col("_within") + F.col("_first")).cast("long")).drop("_slice", "_within", "_first")


def keep_rows(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """The rows of docs that stay, by flags (doc_id, text_md5, kept) with one row per row of docs.

    A doc_id of one row decides by an anti-join. Rows that share a doc_id, or have
    none, are told apart by their text, and those equal in that too by a number.
    """
    flags = materialize(flags.select("doc_id", "text_md5", "kept"), "flags")
    ids = flags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept"))
    dropped = ids.where("n = 1 and doc_id is not null and not kept").select(F.col("doc_id").alias("__keep_id"))
    shared = materialize(ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__keep_id")), "shared")
    out = docs.join(dropped, docs["doc_id"] == F.col("__keep_id"), "left_anti")
    if shared.isEmpty():
        return out
    same = docs["doc_id"].eqNullSafe(F.col("__keep_id"))
    twins = docs.join(shared, same, "left_semi").withColumn("__keep_md5", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    twins = materialize(twins.withColumn("__keep_row", F.monotonically_increasing_id()), "twins")
    # Equal rows are numbered in slices, so that many of them are not one task's.
    rows = twins.select("__keep_row", F.col("doc_id").alias("__keep_id"), "__keep_md5")
    rows = rows.withColumn("__keep_key", F.concat(F.coalesce(F.col("__keep_id").cast("string"), F.lit("null")), F.lit(":"), "__keep_md5"))
    rows = ranked(rows, ["__keep_key"], [F.col("__keep_row")], 64, ["__keep_row"], "__keep_n")
    stay = flags.where("kept").groupBy(F.col("doc_id").alias("stay_id"), F.col("text_md5").alias("stay_md5")).agg(F.count(F.lit(1)).alias("most"))
    first = F.col("__keep_id").eqNullSafe(F.col("stay_id")) & (F.col("__keep_md5") == F.col("stay_md5")) & (F.col("__keep_n") < F.col("most"))
    twins = twins.join(rows.join(stay, first, "left_semi").select("__keep_row"), "__keep_row", "left_semi").select(*(f"`{c}`" for c in docs.columns))
    return out.join(shared, out["doc_id"].eqNullSafe(F.col("__keep_id")), "left_anti").unionByName(twins)


def joined_by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """rows left-joined with groups (one row per key; `size`: how many of the rows have it, `n_rows` in all).

    The groups of hot keys are fewer than HOT_PARTS and go to the rows; those of
    other keys meet them by a shuffle. Rows of a null key are not shuffled.
    """
    hot = F.col(size) * HOT_PARTS > n_rows
    common, rare = F.broadcast(groups.where(hot)), groups.where(~hot)
    known = rows.where(F.col(key).isNotNull())
    out = known.join(common, key).unionByName(known.join(common.select(key), key, "left_anti").join(rare, key, "left"))
    extra = [F.lit(None).cast(t).alias(c) for c, t in groups.dtypes if c != key]
    return out.unionByName(rows.where(F.col(key).isNull()).select("*", *extra))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every end of the edges (a, b); a component is its smallest id.

    First each end with several smaller neighbours hands all but the least of
    them on to the least, until every end has one: a forest. Then every end is
    moved up to its neighbour's neighbour, until that is a root. A root that many
    ends point to is no task's alone. Rounds are stored tables; those that are
    done with are removed.
    """
    larger = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialize(edges.select(*larger).where("a <> b").distinct(), f"{name}-edges")
    while True:
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")), f"{name}-least")
        several = least.where("n > 1").select("a", F.col("b").alias("least"))
        handed = edges.join(several, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        handed = materialize(handed.distinct(), f"{name}-handed")
        done = handed.isEmpty()
        if not done:
            following = materialize(least.select("a", "b").union(handed).distinct(), f"{name}-edges")
            discard(least)
        discard(edges, handed)
        if done:
            break
        edges = following
    parents = least.select(F.col("a").alias("id"), F.col("b").alias("component"))
    old, n_ids = least, least.count()
    while True:
        counts = parents.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        tops = counts.join(parents.select(F.col("id").alias("component"), F.col("component").alias("top")), "component")
        tops = materialize(tops, f"{name}-tops")
        if tops.isEmpty():
            discard(tops)
            return parents.union(parents.select("component", "component").distinct())
        parents = materialize(joined_by_size(parents, tops, "component", "n", n_ids).select("id", F.coalesce("top", "component").alias("component")), f"{name}-parents")
        discard(old, tops)
        old = parents


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, from batches in which equal keys stand together."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        rest = None
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            column = table[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, z in zip(starts, starts[1:]):
            yield table.slice(a, z - a)
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest


def least_reached(ids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least id that links reach from it."""
    least = ids.copy()
    while True:
        near = np.where(links, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        now = np.minimum(least, near)
        if (now == least).all():
            return now
        least = now
