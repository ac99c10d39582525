"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Documents become pieces of at most `capacity` tokens. What must be packed is
then only how many pieces there are of each length, at most `capacity` numbers,
so the driver plans with counts whatever the corpus' size: first it fixes the
sets that dominate every other set with one of their pieces (a piece beside
which nothing fits; two pieces that fill a sequence; a piece and the largest
that fits, where no two fit, or no two that fit weigh more), again and again
until no such set is left; then it packs the rest by best fit, longest first,
many equal sequences at a time. The plan gives ranges of ranks among the pieces
of a length; ranks are dealt out in slices, so a length that a third of all
pieces have is no task's alone.

Defined cases: a null text is empty and has its end id alone; a text of any
length is cut, never dropped, its first piece the shorter one; rows that share
a doc_id are packed each for itself; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked
from .tokens import END_ID, encoder

CAPACITY = 2048
#: Slices of a length's pieces for ranking: at least so many, and one more for each so many pieces.
SLICES, ROWS_PER_SLICE = 256, 1 << 20


@dataclass(frozen=True)
class Pattern:
    """`times` sequences, each of the pieces in `parts`: (length, how many)."""

    times: int
    parts: tuple[tuple[int, int], ...]


class _Counts:
    """How many pieces are left of each length, and the lengths that are left in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.remove(length)

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest pieces, one of length `without` set aside."""
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(k - len(out), self.n[x] - (x == without))
            if len(out) == k:
                break
        return out

    def largest(self, most: int, without: int) -> int | None:
        """The largest piece of at most `most`, one of length `without` set aside."""
        at = bisect_left(self.lengths, most + 1) - 1
        while at >= 0 and self.n[self.lengths[at]] - (self.lengths[at] == without) == 0:
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def heaviest_pair(self, most: int, without: int) -> int:
        """The greatest sum of two pieces that is at most `most`, or 0."""
        best, low, high = 0, 0, bisect_left(self.lengths, most) - 1
        free = lambda x: self.n[x] - (x == without)
        while low <= high:
            a, z = self.lengths[low], self.lengths[high]
            if a + z > most or not free(z):
                high -= 1
            elif not free(a):
                low += 1
            else:
                if a != z or free(a) > 1:
                    best = max(best, a + z)
                low += 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some best packing has, and the counts that they leave."""
    left, fixed = _Counts(counts), []

    def fix(times: int, *lengths: int) -> None:
        parts = ((lengths[0], 2),) if len(lengths) == 2 and lengths[0] == lengths[1] else tuple((x, 1) for x in lengths)
        fixed.append(Pattern(times, parts))
        for length, many in parts:
            left.take(length, many * times)

    def pair(length: int, mate: int) -> None:
        fix(left.n[length] // 2 if length == mate else min(left.n[length], left.n[mate]), length, mate)

    changed = True
    while changed:
        changed = False
        for length in reversed(left.lengths[:]):
            while length in left.n:
                room = capacity - length
                mate = left.largest(room, length)
                if mate is None:
                    # Nothing fits beside one of them; the others of this length may still be met in later rounds.
                    fix(left.n[length] if 2 * length > capacity else 1, length)
                elif mate == room:
                    pair(length, mate)
                elif len(few := left.smallest(2, length)) < 2 or sum(few) > room:
                    # The next pair may find other pieces left, so each step checks anew.
                    pair(length, mate) if length != mate and 2 * length > capacity and 2 * mate + length > capacity else fix(1, length, mate)
                elif (len(three := left.smallest(3, length)) < 3 or sum(three) > room) and left.heaviest_pair(room, length) <= mate:
                    fix(1, length, mate)
                else:
                    break
                changed = True
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit by falling length. Equal sequences are filled together: in the tightest room that a piece fits, as many as go in."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def put(times: int, room: int, parts: tuple[tuple[int, int], ...]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((times, parts))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, parts = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, times, parts = capacity, n, ()
            each = min(room // length, n)
            filled = min(times, n // each)
            if parts and filled < times:
                put(times - filled, room, parts)
            put(filled, room - each * length, (*parts, (length, each)))
            n -= filled * each
    return [Pattern(times, parts) for groups in open_.values() for times, parts in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, first sequence, offset) by length and first rank."""
    fixed, left = reduce_by_dominance(counts, capacity)
    ranks, sequence, rows = dict.fromkeys(counts, 0), 0, []
    for pattern in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, many in pattern.parts:
            rows.append((length, ranks[length], many, sequence, offset))
            ranks[length] += many * pattern.times
            offset += many * length
        sequence += pattern.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of n tokens start and end."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


def _pieces(tokenizer_file: str, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_file)
        end = np.array([END_ID], tokens.dtype).tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(b["doc_id"].to_pylist(), tokens.encode(t.as_py() or "" for t in b["text"])):
                wide = np.frombuffer(ids + end, tokens.dtype).astype("<u4")
                bounds = cut(len(wide), capacity)
                for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
                    for to, x in zip(rows, (doc_id, k, a, z - a, zlib.crc32(wide[a:z]), wide[a:z].tobytes() if with_ids else None)):
                        to.append(x)
            arrays = [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return pieces


def _place(rows: np.ndarray):
    width = int(rows[:, 1].max(initial=0)) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = rows[:, 0] * width + rows[:, 1]
        for b in batches:
            length, rank = (b[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            own = rows[np.searchsorted(keys, length * width + np.minimum(rank, width - 1), "right") - 1]
            step = rank - own[:, 1]
            out = b.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(own[:, 3] + step // own[:, 2]))
            yield out.append_column("offset", pa.array(own[:, 4] + step % own[:, 2] * length))

    return place


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids (32-bit, little-endian) if asked for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = rows.mapInArrow(_pieces(tokenizer_file, capacity, with_ids), kind)
    pieces = materialize(pieces if with_ids else pieces.drop("ids"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    slices = max(SLICES, sum(counts.values()) // ROWS_PER_SLICE)
    numbered = ranked(pieces, ["length"], order, slices, ["doc_id", "piece"]).select(*pieces.columns, "rank")
    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return numbered.mapInArrow(_place(plan(counts, capacity)), f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_tokens, ids, parts (doc_id, piece, offset, length)."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("parts"))
