"""N-gram Jaccard join: a MinHash LSH forest proposes, shingle sets decide.

The shingles of a text are its runs of `n` words (maximal runs of characters
other than `[\\x20\\x09-\\x0D]`), as 64-bit hashes; a text of fewer words is one
shingle. Texts with equal shingle sets are one class from the start.

The forest has `trees` tries over signatures of `depth` MinHash digits. Each trie
is the sorted order of its labels, dealt out by ranges: neighbours' common
prefixes tell which sets share a node at any depth, and a row per set and tree
names the first set of its node at each depth. Matched prefixes are shortened
from the full depth, for each set until the chance that one of its links is lost
is at most 1 - `recall`: first for all sets to where a link at the threshold is
found with that chance; then, after verification, further for each set whose
links, by their exact similarities, are more or nearer the threshold than that
depth serves.

The sets of a node meet in blocks, where whole signatures tell pairs that may
reach the threshold (within `slack`, five standard deviations) from chance. What
is so joined is verified: all sets of a group meet in square blocks, where matrix
products of their incidence give exact intersections. A block reports links by
count and a spanning forest of them, so no pair of documents is ever a row and a
group of any size is split over tasks of similar size.

Two shingles are taken for equal if their 64-bit hashes are, and two sets if
their 128-bit digests are.

Defined cases: texts without words (null, empty, white space) link to nothing
and stay; rows that share a doc_id are rows of their own; of a class the row
with the smallest doc_id stays (null last), one row if several share it; a
class has the smallest doc_id as its id; an empty table gives an empty result.
Other columns are ignored by `jaccard_join` and passed through by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, connected_components, discard, joined_by_size, keep_rows, least_reached, materialize, runs

#: Candidate rows (of two numbers, a flag and 16 bytes each) up to which they are sent to the scan; beyond it the texts are shuffled to them.
BROADCAST_CANDIDATES = 1 << 17
#: Rows of a trie that one task sorts, about.
ROWS_PER_TASK = 1 << 20
#: Sets of a node or group that one task compares with each other; beyond it blocks of about twice the root of their number.
NODE_BLOCK, GROUP_BLOCK = 1024, 64
#: Bytes of text that are hashed at once.
SEGMENT = 1 << 20
#: Shingles that are columns of an incidence matrix at once.
COLUMNS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], np.uint64)


@dataclass(frozen=True)
class Forest:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    trees: int = 32
    depth: int = 8
    seed: int = 5

    #: The shortest prefix: it loses one link of 10^10 at the threshold, so no set needs a shorter one.
    shortest: int = 3
    #: How far a signature may put a similarity below the threshold, in standard deviations.
    slack: float = 5.0

    def lost(self, similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
        """The chance that two sets share no node at a depth."""
        return (1 - similarity**depth) ** self.trees

    def matched_depth(self) -> int:
        """The longest prefix that loses a link at the threshold with a chance of at most 1 - recall."""
        depth = self.depth
        while depth > self.shortest and self.lost(self.threshold, depth) > 1 - self.recall:
            depth -= 1
        return depth

    def least_agreement(self) -> float:
        """The part of a signature's digits that a pair at the threshold shares almost surely."""
        digits = self.trees * self.depth
        return self.threshold - self.slack * (self.threshold * (1 - self.threshold) / digits) ** 0.5

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        size = (self.trees * self.depth, 1)
        return rng.integers(0, 1 << 31, size).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, size).astype(np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


_powers = np.full(1, 0xD6E8FEB86659FD93, np.uint64)
_letters = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX[2])


def _word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word; long texts are cut at white space."""
    global _powers
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + SEGMENT)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        chars = np.frombuffer(text, np.uint8, end - at, at)
        at = end
        edge = np.diff(np.concatenate([[True], _SPACE[chars], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            continue
        longest = int((ends - starts).max())
        if longest > len(_powers):
            _powers = np.cumprod(np.full(2 * longest, 0xD6E8FEB86659FD93, np.uint64))
        lengths = np.diff(starts, append=len(chars))
        place = np.arange(starts[0], len(chars)) - np.repeat(starts, lengths)
        values = np.where(_SPACE[chars[starts[0] :]], np.uint64(0), _letters[chars[starts[0] :]] * _powers[np.minimum(place, len(_powers) - 1)])
        found.append(_mixed(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64) * _MIX[2]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """The text's shingles as ascending distinct 64-bit hashes."""
    words = _word_hashes(text)
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * _MIX[0] + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(total))


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def _signatures(forest: Forest):
    a, b = forest.permutations()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, signatures, digests = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                text = text or b""
                shingles = shingle_set(text, forest.n)
                digests.append(hashlib.md5(text).hexdigest())
                keys.append(_set_key(shingles) if len(shingles) else None)
                low = np.full(len(a), 0xFFFFFFFF, np.uint32)
                x = (shingles >> np.uint64(32)).astype(np.uint32)
                for i in range(0, len(x), 512):
                    np.minimum(low, (x[i : i + 512] * a + b).min(axis=1), out=low)
                signatures.append(low.astype("<u2").tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests, pa.string()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "text_md5", "set_key", "signature"])

    return sign


def _tries(forest: Forest):
    """Walk sorted (tree, label, rep): for each set the first set of its node at each depth, of this task's rows.

    A task's first and last rows keep their labels, so that nodes can be joined
    across tasks. Sets that share no node of the shortest prefix are left out.
    """
    depths = range(forest.shortest, forest.depth + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.concat_tables(tables).combine_chunks()
        n = rows.num_rows
        tree, rep = rows["tree"].to_numpy(), rows["rep"].to_numpy()
        labels = rows["label"].to_numpy()
        digits = np.frombuffer(b"".join(labels), "<u2").reshape(n, forest.depth)
        common = np.zeros(n, np.int64)
        same = tree[1:] == tree[:-1]
        for k in range(forest.depth):
            same = same & (digits[1:, k] == digits[:-1, k])
            common[1:] += same
        place = np.arange(n)
        firsts = [rep[np.maximum.accumulate(np.where(common < x, place, 0))] for x in depths]
        edge = np.zeros(n, bool)
        edge[[0, -1]] = True
        keep = (common >= forest.shortest) | np.append(common[1:] >= forest.shortest, False) | edge
        arrays = [pa.array(tree[keep]), pa.array(rep[keep]), *(pa.array(f[keep]) for f in firsts)]
        arrays += [pa.array(np.where(edge, labels, None)[keep], pa.binary()), pa.array((place == n - 1)[keep])]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(int(keep.sum()), TaskContext.get().partitionId(), np.int32))], ["tree", "rep", *(f"d{x}" for x in depths), "label", "last", "part"])

    return walk


def _grow(sets: DataFrame, forest: Forest) -> DataFrame:
    """(tree, rep, d3 .. d8): sets that share nodes, and the first set of each node that they are in."""
    n_rows = sets.count() * forest.trees
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // ROWS_PER_TASK + 1)
    rows = sets.select("rep", "signature", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    label = F.substring(F.col("signature"), F.col("tree") * (2 * forest.depth) + 1, F.lit(2 * forest.depth)).alias("label")
    order = ["tree", "label", "rep"]
    rows = rows.select("tree", label, "rep").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    names = [f"d{x}" for x in range(forest.shortest, forest.depth + 1)]
    found = rows.mapInArrow(_tries(forest), f"tree int, rep long, {', '.join(f'{x} long' for x in names)}, label binary, last boolean, part int")
    found = materialize(found, "ngram-tries")
    return _across_tasks(found, forest)


def _renamed(names: list[str], first_tree: np.ndarray, own: np.ndarray, goes_on: np.ndarray):
    """Nodes that a task's first row is in, by the first set that `goes_on` gives them: a row for each depth, a column for each task, -1 for none.

    That row's set can be the first of another tree's node too, so the place is told by the tree as well.
    """

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b["part"].to_numpy()
            begun = b["tree"].to_numpy() == first_tree[part]
            arrays = [b["tree"], b["rep"]]
            for name, firsts in zip(names, goes_on):
                node, first = b[name].to_numpy(), firsts[part]
                arrays.append(pa.array(np.where(begun & (node == own[part]) & (first >= 0), first, node)))
            yield pa.RecordBatch.from_arrays(arrays, ["tree", "rep", *names])

    return rename


def _across_tasks(found: DataFrame, forest: Forest) -> DataFrame:
    """Give nodes that several tasks hold parts of the first set of their first part."""
    depths = range(forest.shortest, forest.depth + 1)
    names = [f"d{x}" for x in depths]
    # Two rows of each task, or its only one: the ends of its range.
    ends = found.where("label is not null").select("part", "last", "tree", "rep", "label", *names).orderBy("part", "last").collect()
    tasks = ends[-1]["part"] + 1 if ends else 0
    first_tree, own, goes_on = np.full(tasks, -1, np.int32), np.full(tasks, -1, np.int64), np.full((len(names), tasks), -1, np.int64)
    before: dict[int, int] = {}
    for a, z in zip(ends, ends[1:]):
        if a["part"] == z["part"]:
            # One node may fill a whole task: it goes on.
            before = {x: first for x, first in before.items() if a[f"d{x}"] == z[f"d{x}"] and a["tree"] == z["tree"]}
            continue
        last = {x: before.get(x, a[f"d{x}"]) for x in depths}
        before = {x: first for x, first in last.items() if a["tree"] == z["tree"] and a["label"][: 2 * x] == z["label"][: 2 * x]}
        first_tree[z["part"]], own[z["part"]] = z["tree"], z["rep"]
        for x, first in before.items():
            goes_on[x - forest.shortest, z["part"]] = first
    if (goes_on < 0).all():
        return found.select("tree", "rep", *names)
    # A few numbers for each task go along; no row meets another.
    out = found.select("tree", "rep", "part", *names).mapInArrow(_renamed(names, first_tree, own, goes_on), f"tree int, rep long, {', '.join(f'{x} long' for x in names)}")
    return materialize(out, "ngram-forest")


def _likely(least: float):
    """Pairs of a node's block whose signatures agree in enough digits, as a spanning forest (a, b).

    Two blocks that meet only report what joins the groups that each has in
    itself, since those are reported where it meets itself.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in runs(batches, ["node", "lo", "hi"]):
            reps, block = found["rep"].to_numpy(), found["block"].to_numpy()
            # The low byte of each digit: digits that differ agree in it once in 256 times, which only adds pairs.
            digits = np.frombuffer(b"".join(found["signature"].to_pylist()), np.uint8).reshape(len(reps), -1)
            digits = np.ascontiguousarray(digits[:, ::2])
            links = np.stack([np.count_nonzero(digits == d, axis=1) for d in digits]) >= least * digits.shape[1]
            own = block[:, None] == block[None, :]
            known = reps if found["lo"][0] == found["hi"][0] else least_reached(reps, links & own)
            to = least_reached(reps, links)
            edges = np.unique(np.stack([known, to], axis=1)[known != to], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return compare


def _in_blocks(members: DataFrame, group: str, least_block: int) -> DataFrame:
    """members (group, rep, m: the group's size, ...) once for each block that they meet: with lo, hi and their own block."""
    blocks = F.ceil(F.col("m") / F.greatest(F.lit(float(least_block)), 2 * F.sqrt("m"))).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))
    return rows.drop("blocks", "with", "m")


def _pairs(tries: DataFrame, sets: DataFrame, forest: Forest, depth: int, state: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between sets of a node at this depth that look alike.

    With a state (rep, component, active), only of nodes that hold sets of several
    components, an active one among them: within a component all are compared.
    """
    rows = tries.select(F.xxhash64("tree", f"d{depth}").alias("node"), "rep")
    if state is not None:
        rows = rows.join(state, "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("active", F.lit(False)).alias("active"))
        several = rows.groupBy("node").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.bool_or("active").alias("any"))
        several = several.where(F.col("any") & (F.col("first") < F.col("last"))).select("node")
        rows = materialize(rows.select("node", "rep").join(several, "node", "left_semi"), "ngram-several")
    # Near copies share the same nodes in many trees: equal nodes are looked at once.
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(38,0)")).alias("sum2"))
    nodes = nodes.where("m > 1").groupBy("m", "sum", "sum2").agg(F.min("node").alias("node")).select("node", "m")
    members = materialize(rows.join(nodes, "node").select("node", "m", "rep"), "ngram-nodes")
    signed = _in_blocks(members.join(sets.select("rep", "signature"), "rep"), "node", NODE_BLOCK)
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, members.count() // ROWS_PER_TASK * 16 + 1)
    keys = ["node", "lo", "hi"]
    signed = signed.select(*keys, "block", "rep", "signature").repartition(tasks, *keys).sortWithinPartitions(*keys)
    out = materialize(signed.mapInArrow(_likely(forest.least_agreement()), "a long, b long").distinct(), "ngram-edges")
    discard(members)
    return out


def _shingle_rows(n: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t or b"", n) for t in b["text"].cast(pa.binary()).to_pylist()]
            same = pa.array([_set_key(s) == k for s, k in zip(sets, b["set_key"].to_pylist())], pa.bool_())
            out = b.drop_columns(["text", "set_key"]).append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield out.filter(same)

    return read


def similarities(lo: list[np.ndarray], hi: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the intersection and the union of each set of lo with each of hi."""
    parts = [*lo, *hi]
    values, column = np.unique(np.concatenate(parts), return_inverse=True)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(lo), len(hi)), np.float64)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, z = np.searchsorted(column, [first, first + COLUMNS])
        incidence = np.zeros((len(parts), COLUMNS), np.float32)
        incidence[row[a:z], column[a:z] - first] = 1
        common += incidence[: len(lo)] @ incidence[len(lo) :].T
    sizes = np.array([len(p) for p in parts], np.float64)
    return common, sizes[: len(lo), None] + sizes[None, len(lo) :] - common


def _verify(forest: Forest):
    """(rep, n, to, lost): links of the sets of a group's block, a spanning forest, and the chances that they are lost at each depth."""
    depths = range(forest.shortest, forest.depth + 1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["component", "lo", "hi"]):
            own, reps, copies = (block[c].to_numpy() for c in ("block", "rep", "copies"))
            sets = [np.frombuffer(x, np.uint64) for x in block["shingles"].to_pylist()]
            low, high = block["lo"][0].as_py(), block["hi"][0].as_py()
            a, z = np.flatnonzero(own == low), np.flatnonzero(own == high)
            links = np.zeros((len(reps), len(reps)), bool)
            lost = np.zeros((len(reps), len(depths)))
            if len(a) and len(z):
                common, union = similarities([sets[i] for i in a], [sets[i] for i in z])
                found = common >= forest.threshold * union - 1e-9
                links[np.ix_(a, z)] = found
                at_a, at_z = np.nonzero(found)
                other = a[at_a] != z[at_z]
                at_a, at_z = at_a[other], at_z[other]
                similar = common[at_a, at_z] / union[at_a, at_z]
                for k, depth in enumerate(depths):
                    chance = forest.lost(similar, depth)
                    np.add.at(lost[:, k], a[at_a], chance)
                    if low != high:
                        np.add.at(lost[:, k], z[at_z], chance)
            links |= links.T
            np.fill_diagonal(links, False)
            counts = links @ copies.astype(np.float64)
            arrays = [pa.array(reps), pa.array(counts.astype(np.int64)), pa.array(least_reached(reps, links)), pa.array(list(lost), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "n", "to", "lost"])

    return verify


def _verified(table: DataFrame, sets: DataFrame, first: DataFrame, groups: DataFrame, forest: Forest) -> DataFrame:
    """What `_verify` reports of the groups (id, component), with the sets' shingles read again from one text each."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    grouped = groups.join(sizes, "component").select(F.col("id").alias("rep"), "component", "m")
    members = materialize(sets.select("rep", "copies").join(grouped, "rep").join(first, "rep"), "ngram-members")
    n_members = members.count()
    wanted = F.broadcast(members) if n_members <= BROADCAST_CANDIDATES else members
    # A null doc_id is 0 in the key and told apart by the flag; the set's key drops other rows of the same doc_id.
    keyed = table.withColumn("_null", F.col("doc_id").isNull()).withColumn("_id", F.coalesce("doc_id", F.lit(0))).drop("doc_id")
    wanted_key = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")]
    texts = keyed.join(wanted.select("rep", "set_key", *wanted_key), ["_id", "_null"]).select("text", "set_key", "rep")
    found = texts.mapInArrow(_shingle_rows(forest.n), "rep long, shingles binary").dropDuplicates(["rep"])
    found = found.join(members.select("rep", "copies", "component", "m"), "rep")
    keys = ["component", "lo", "hi"]
    placed = _in_blocks(found, "component", GROUP_BLOCK).select(*keys, "block", "rep", "copies", "shingles")
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(max(tasks, n_members // 4096), *keys).sortWithinPartitions(*keys)
    out = materialize(placed.mapInArrow(_verify(forest), "rep long, n long, to long, lost array<double>"), "ngram-links")
    discard(members)
    return out


def _needs(verified: DataFrame, forest: Forest) -> DataFrame:
    """(rep, depth): the longest prefix at which a set keeps all its links, and one at the threshold beside, with the chance of `recall`."""
    depths = range(forest.shortest, forest.depth + 1)
    lost = verified.groupBy("rep").agg(*(F.sum(F.col("lost")[k]).alias(f"l{x}") for k, x in enumerate(depths)))
    need = F.lit(forest.shortest)
    for x in depths:
        need = F.when(F.col(f"l{x}") + float(forest.lost(forest.threshold, x)) <= 1 - forest.recall, F.lit(x)).otherwise(need)
    return lost.select("rep", need.alias("depth"))


def _classes(docs: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """The rows (row_id, doc_id, text_md5, set_key), and per set key its copies, number of links and its class' root set."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = table.mapInArrow(_signatures(forest), "doc_id long, text_md5 string, set_key binary, signature binary")
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "ngram-rows")
    # Equal sets have equal signatures, so any one of them stands for all.
    sets = rows.where("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("signature").alias("signature"))
    sets = materialize(sets, "ngram-sets")
    first = rows.select(F.col("row_id").alias("rep"), "doc_id", "set_key")
    tries = _grow(sets, forest)
    depth = forest.matched_depth()
    groups = connected_components(_pairs(tries, sets, forest, depth), "ngram-groups")
    verified = _verified(table, sets, first, groups, forest)
    while depth > forest.shortest:
        depth -= 1
        active = _needs(verified, forest).select("rep", (F.col("depth") <= depth).alias("active"))
        state = materialize(groups.withColumnRenamed("id", "rep").join(active, "rep", "left"), "ngram-state")
        if state.where("active").isEmpty():
            break
        edges = _pairs(tries, sets, forest, depth, state)
        name = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"{c}_group"))
        across = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
        across = materialize(across.where("a <> b").distinct(), "ngram-across")
        if across.isEmpty():
            continue
        # Groups that shorter prefixes join are verified anew as a whole; what was found of their parts goes.
        joined = connected_components(across, "ngram-joined").select(F.col("id").alias("component"), F.col("component").alias("now"))
        moved = groups.join(joined, "component").select("id", F.col("now").alias("component"))
        new = joined.join(groups.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("now").alias("component"))
        changed = materialize(moved.unionByName(new), "ngram-changed")
        again = _verified(table, sets, first, changed, forest)
        verified = materialize(verified.join(changed.select(F.col("id").alias("rep")), "rep", "left_anti").unionByName(again), "ngram-links")
        groups = materialize(groups.join(changed.select("id"), "id", "left_anti").unionByName(changed), "ngram-groups")
    links = verified.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = connected_components(verified.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), "ngram-classes")
    named = sets.select("set_key", "rep", "copies").join(links, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    named = named.select("set_key", "copies", n_links.alias("n_links"), F.coalesce("component", "rep").alias("root"))
    return rows.drop("signature"), materialize(named, "ngram-named")


def _flags(docs: DataFrame, forest: Forest) -> DataFrame:
    rows, sets = _classes(docs, forest)
    n_rows = rows.count()
    rows = joined_by_size(rows, sets, "set_key", "copies", n_rows).withColumn("root", F.coalesce("root", "row_id"))
    rows = materialize(rows.select("row_id", "doc_id", "text_md5", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "ngram-flags")
    # Only classes of several rows need their first row looked up.
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first")
    firsts = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), best).where("n > 1").select("root", "n", F.col("first.doc_id").alias("class_doc"), F.col("first.row_id").alias("class_row"))
    out = joined_by_size(rows, materialize(firsts, "ngram-firsts"), "root", "n", n_rows)
    alone = F.col("class_row").isNull()
    return out.select("doc_id", "text_md5", F.when(alone, F.col("doc_id")).otherwise(F.col("class_doc")).alias("class_id"), "n_links", (alone | (F.col("class_row") == F.col("row_id"))).alias("kept"))


def jaccard_join(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """A row per document: doc_id, class_id, n_links (other documents at the threshold or above), kept."""
    return _flags(docs, forest or Forest()).drop("text_md5")


def keep_one(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """The documents with one row of each class, in docs' own columns."""
    return keep_rows(docs, _flags(docs, forest or Forest()))
