"""Balanced label propagation: linked documents move to one shard, sizes stay even.

Law: `rows`. Every shard gets the same number of documents, one more or less.
Links join documents of equal text. A hash deals documents to shards first.
Linked documents are taken as units: a group of copies, or, where a group is
larger than a fraction of a shard, slices of it. Each round joins units to
where all documents of their group are by now, asks for the shard that holds
most of them among those with room (for what is unplaced of the group, if there
are such), and grants the moves that the shard's quota of linked documents still
takes, large groups first. Units that have a place ask again for a shard that
holds more of their group. Rounds end when none is granted or, all units being
placed, when the last one lowered no cut. At last the
shards are made equal: each ranks its documents, linked ones first, and those
beyond its size fill the shards that have room.

What the driver sees is counts by shard and priority bucket, bounded whatever
the corpus' size. Ranks are dealt in slices, so no shard is one task's.

Defined cases: a null text is empty, its size is 8, and all empty texts are
linked; rows that share a doc_id are rows of their own; with fewer documents
than shards some shards are empty; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked

SHARDS = 24
#: Slices that a group of copies is counted in, and the most units that it becomes: at least so many, and one more for each so many documents.
SLICES, ROWS_PER_SLICE = 256, 1 << 20
#: A unit holds at most about this part of a shard.
UNIT_PART = 1 / 32
#: Buckets by priority in which a shard's quota is granted to groups of no more than a unit; larger ones are granted one by one.
BUCKETS = 1024


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or b"" for x in b["text"].cast(pa.binary()).to_pylist()]
        size = pa.array([len(x) + 8 for x in texts], pa.int64())
        crc = pa.array([zlib.crc32(x) for x in texts], pa.int64())
        digest = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b["doc_id"], size, crc, digest], ["doc_id", "size", "text_crc32", "hub"])


def _spread(rows: Column, shards: int) -> Column:
    return F.pmod(rows, F.lit(shards)).cast("int")


def _grant(wishes: DataFrame, room: dict[int, int]) -> tuple[list[tuple[int, int, int]], set[int]]:
    """The (to, level, bucket) that are granted, from sums n of them, and the shards that only refused; room is brought up to date."""
    granted: list[tuple[int, int, int]] = []
    # At most shards x BUCKETS rows of small groups, and for each larger one some, bounded by shards / UNIT_PART.
    asked = sorted((r["to"], -r["level"], r["bucket"], r["n"]) for r in wishes.collect())
    for to, level, bucket, n in asked:
        if n <= room[to]:
            room[to] -= n
            granted.append((to, -level, bucket))
    return granted, {x[0] for x in asked} - {x[0] for x in granted}


def _ask(free: list[int]):
    """The shard that each unit asks for, and whether it would take all that is unplaced of its group."""
    shards = len(free)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to: list[int | None] = []
            whole = []
            for hub, n, target, held, loose in zip(*(b[c].to_pylist() for c in ("hub", "n", "target", "held", "loose"))):
                best = [(-p["least"], p["held"]) for p in held]
                if target is None:
                    known = {s for s, _ in best}
                    first = zlib.crc32(hub)
                    order = [s for s, _ in best] + [s for s in ((first + i) % shards for i in range(shards)) if s not in known]
                    takes_all = next((s for s in order if free[s] >= loose), None)
                else:
                    # A unit that has a place asks only for shards that hold more of its group.
                    own = dict(best)[target]
                    order, takes_all = [s for s, h in best if h > own], None
                whole.append(takes_all is not None)
                to.append(takes_all if takes_all is not None else next((s for s in order if free[s] >= n), None))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("hub", "unit", "n", "target", "size")), pa.array(to, pa.int32()), pa.array(whole, pa.bool_())], ["hub", "unit", "n", "target", "size", "to", "whole"])

    return ask


def _propagate(starts: DataFrame, n_docs: int, shards: int, rounds: int | None) -> DataFrame:
    """(unit, target) of the units that are granted a shard, from rows (hub, unit, shard, n): how many of its documents are where."""
    quota = n_docs // shards
    state = starts.groupBy("hub", "unit").agg(F.sum("n").alias("n")).withColumn("target", F.lit(None).cast("int"))
    state = materialize(state, "shard-units")
    closed: set[int] = set()
    cut, k = None, 0
    while rounds is None or k < rounds:
        k += 1
        room = dict.fromkeys(range(shards), quota)
        for row in state.where("target is not null").groupBy("target").agg(F.sum("n").alias("n")).collect():  # at most `shards` rows
            room[row["target"]] -= row["n"]
        # Where each group's documents are by now: at most `shards` places.
        still = starts.join(state.where("target is null").select("unit"), "unit", "left_semi").select("hub", "shard", "n", F.col("n").alias("loose"))
        settled = state.where("target is not null").select("hub", F.col("target").alias("shard"), "n", F.lit(0).cast("long").alias("loose"))
        held = still.unionByName(settled).groupBy("hub", "shard").agg(F.sum("n").alias("n"), F.sum("loose").alias("loose"))
        place = F.struct(F.col("n").alias("held"), (-F.col("shard")).alias("least"))
        held = held.groupBy("hub").agg(F.sort_array(F.collect_list(place), asc=False).alias("held"), F.sum("n").alias("size"), F.sum("loose").alias("loose"))
        held = materialize(held, "shard-held")
        now = held.agg(F.sum("loose").alias("loose"), F.sum(F.col("size") - F.col("held")[0]["held"]).alias("cut")).first()
        if now["cut"] is None or now["cut"] == 0 and not now["loose"]:
            break
        if not now["loose"] and cut is not None and now["cut"] >= cut:
            break
        cut = now["cut"]
        # The shards by how much of the group they hold, then all others, in one order for the whole group.
        asking = materialize(state.join(held, "hub").mapInArrow(_ask([0 if s in closed else room[s] for s in range(shards)]), "hub binary, unit long, n long, target int, size long, to int, whole boolean"), "shard-asks")
        large = F.col("size") > max(1.0, quota * UNIT_PART)
        level = F.when(large, F.floor(F.log2("size")).cast("int") + 1).otherwise(0)
        # All of a group or none, while one shard takes it.
        bucket = F.when(large & F.col("whole"), F.xxhash64("hub")).when(large, F.xxhash64("unit")).otherwise(F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(BUCKETS)).cast("long"))
        asking = asking.select("hub", "unit", "n", "target", "to", level.alias("level"), bucket.alias("bucket"))
        granted, refused = _grant(asking.where("to is not null").groupBy("to", "level", "bucket").agg(F.sum("n").alias("n")), {s: 0 if s in closed else room[s] for s in room})
        if not granted and not refused:
            break
        closed |= refused
        if not granted:
            continue
        yes = F.broadcast(asking.sparkSession.createDataFrame(granted, "to int, level int, bucket long").withColumn("yes", F.lit(True)))
        moved = asking.join(yes, ["to", "level", "bucket"], "left")
        state = materialize(moved.select("hub", "unit", "n", F.when(F.col("yes"), F.col("to")).otherwise(F.col("target")).alias("target")), "shard-units")
    return state.where("target is not null").select("unit", "target")


def _sizes_even(placed: DataFrame, n_docs: int, shards: int, n_slices: int) -> DataFrame:
    """Equal shards from rows with shard and linked: each document's last shard and slot."""
    quota = {s: n_docs // shards + (s < n_docs % shards) for s in range(shards)}
    counts = {s: 0 for s in range(shards)}
    linked = {s: 0 for s in range(shards)}
    for r in placed.groupBy("shard", "linked").count().collect():  # at most 2 x shards rows
        counts[r["shard"]] += r["count"]
        linked[r["shard"]] += r["count"] * r["linked"]
    numbered = ranked(placed, ["shard", "linked"], [F.col(c) for c in ("doc_id", "text_crc32", "size", "hub")], n_slices, ["doc_id", "text_crc32", "size"])
    as_map = lambda d: F.create_map(*(F.lit(x).cast("long" if i % 2 else "int") for p in d.items() for i, x in enumerate(p)))
    at = lambda d, key: F.element_at(as_map(d), key)
    shard = F.col("shard")
    rank = F.when(F.col("linked") == 1, F.col("rank")).otherwise(F.col("rank") + at(linked, shard))
    # Ranks beyond a shard's size are numbered through all shards and fill the free slots in turn.
    before, spare, holes, filled = {}, 0, [], 0
    for s in range(shards):
        before[s] = spare - quota[s]
        spare += max(0, counts[s] - quota[s])
        if counts[s] < quota[s]:
            holes.append((filled, s, counts[s]))
            filled += quota[s] - counts[s]
    over = rank >= at(quota, shard)
    nth = rank + at(before, shard)
    to, slot = shard, rank
    if holes:
        hole = None
        for first, s, used in reversed(holes):
            place = F.struct(F.lit(s).alias("shard"), (nth - first + used).alias("slot"))
            hole = F.when(nth >= first, place) if hole is None else hole.when(nth >= first, place)
        to, slot = F.when(over, hole["shard"]).otherwise(shard), F.when(over, hole["slot"]).otherwise(rank)
    return numbered.select("doc_id", "size", "text_crc32", "hub", to.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law has none)."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = table.mapInArrow(_digests, "doc_id long, size long, text_crc32 long, hub binary")
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "shard-rows")
    n_docs = rows.count()
    n_slices = max(SLICES, n_docs // ROWS_PER_SLICE)
    rows = rows.withColumn("slice", _spread(F.xxhash64("row_id"), n_slices)).withColumn("start", _spread(F.xxhash64("row_id", F.lit(1)), shards))
    slices = rows.groupBy("hub", "slice", "start").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.groupBy("hub", "slice").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.sum("n").alias("group_size")).where("group_size > 1")
    most = max(1.0, n_docs / shards * UNIT_PART)
    n_units = F.least(F.lit(n_slices), F.ceil(F.col("group_size") / F.lit(most))).cast("int")
    groups = materialize(groups.select("hub", n_units.alias("units")), "shard-groups")
    unit = F.xxhash64("hub", F.pmod(F.col("slice"), F.col("units"))).alias("unit")
    units = slices.join(groups, "hub").select("hub", unit, F.col("start").alias("shard"), "n").groupBy("hub", "unit", "shard").agg(F.sum("n").alias("n"))
    units = materialize(units, "shard-starts")
    targets = _propagate(units, n_docs, shards, rounds)
    # One row for each slice of a linked group: the keys by which documents find their target.
    keys = slices.join(groups, "hub").select("hub", "slice", unit).distinct()
    moves = keys.join(targets, "unit", "left").select("hub", "slice", F.lit(1).alias("linked"), "target")
    placed = rows.join(moves, ["hub", "slice"], "left")
    placed = placed.select("doc_id", "size", "text_crc32", "hub", F.coalesce("target", "start").alias("shard"), F.coalesce("linked", F.lit(0)).alias("linked"))
    out = _sizes_even(materialize(placed, "shard-placed"), n_docs, shards, n_slices)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.hex("hub").alias("text_sha256"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: linked groups, and how many of their documents are apart from the shard that holds most of the group."""
    per = sharded.groupBy("text_sha256", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("text_sha256").agg(F.sum("n").alias("all"), F.max("n").alias("most")).where("all > 1")
    return per.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("all") - F.col("most")).alias("apart"), F.sum("all").alias("linked"))
