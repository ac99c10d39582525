"""A Spark data source for OpenStreetMap PBF extracts: `spark.read.format("osmpbf").option("entity", "ways").load(path)`.

A file is a chain of blobs. The driver reads only the blobs' heads to find where
each lies, and every OSMData blob is an input partition (small ones are grouped).
Entities that are not asked for are skipped inside a blob, and tags are decoded
only if `tags` is not false. A block's entities of one kind are one Arrow batch.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_for

SCHEMAS = {
    "nodes": "id bigint, lat double, lon double, tags map<string,string>, ordinal bigint",
    "ways": "id bigint, node_ids array<bigint>, tags map<string,string>, ordinal bigint",
    "relations": "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>, ordinal bigint",
}
MEMBER_TYPES = ("node", "way", "relation")
#: Bytes of blobs that one partition reads, about.
PARTITION_BYTES = 32 << 20


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << shift
        if byte < 0x80:
            return out, at
        shift += 7


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def message(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value) of a message; nested ones are views."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire} is not read here")
        yield key >> 3, value


def fields_of(data: memoryview) -> dict[int, list[int | memoryview]]:
    """All values of each field, in order."""
    out: dict[int, list[int | memoryview]] = defaultdict(list)
    for number, value in message(data):
        out[number].append(value)
    return out


def numbers(values: list[int | memoryview]) -> np.ndarray:
    """A repeated field's unsigned numbers; writers may pack them, in one run or several, or not."""
    parts = [np.zeros(0, np.uint64)]
    for value in values:
        if isinstance(value, int):
            parts.append(np.array([value], np.uint64))
            continue
        data = np.frombuffer(value, np.uint8)
        last = np.flatnonzero(data < 0x80)
        if len(data) and (not len(last) or last[-1] != len(data) - 1):
            raise ValueError("a run of numbers ends within a number")
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
        parts.append(np.add.reduceat((data & 0x7F).astype(np.uint64) << shift.astype(np.uint64), first) if len(last) else parts[0])
    return np.concatenate(parts)


def _summed(values: np.ndarray) -> np.ndarray:
    """Zig-zag deltas to values."""
    return np.cumsum((values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64))


def _int64(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, offset of the blob, its length) of each blob, reading heads only."""
    with open_for(path) as f:
        while head := f.read(4):
            if len(head) < 4:
                raise ValueError("the file ends within a blob's head")
            fields = fields_of(memoryview(f.read(struct.unpack(">I", head)[0])))
            yield bytes(fields[1][-1]).decode(), f.tell(), fields[3][-1]
            f.seek(fields[3][-1], 1)


def blob_content(path: str, offset: int, length: int) -> memoryview:
    with open_for(path) as f:
        f.seek(offset)
        fields = fields_of(memoryview(f.read(length)))
    if 1 in fields:
        return fields[1][-1]
    if 3 in fields:
        return memoryview(zlib.decompress(fields[3][-1]))
    raise ValueError("only raw and zlib blobs are read here")


def read_bounds(path: str) -> tuple[float, float, float, float] | None:
    """(min_lon, min_lat, max_lon, max_lat) of the file's header, if it has them."""
    for kind, offset, length in blobs(path):
        if kind == "OSMHeader":
            for number, value in message(blob_content(path, offset, length)):
                if number == 1:
                    box = {k: _signed(v) / 1e9 for k, v in message(value)}
                    return box[1], box[4], box[2], box[3]
        return None
    return None


_TAGS = pa.map_(pa.string(), pa.string())
_MEMBERS = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))
#: The Arrow types before the ordinal.
_TYPES = {"nodes": [pa.int64(), pa.float64(), pa.float64(), _TAGS], "ways": [pa.int64(), pa.list_(pa.int64()), _TAGS], "relations": [pa.int64(), _MEMBERS, _TAGS]}
_NAMES = {"nodes": ["id", "lat", "lon", "tags", "ordinal"], "ways": ["id", "node_ids", "tags", "ordinal"], "relations": ["id", "members", "tags", "ordinal"]}


class _Block:
    """A primitive block: its strings, groups and grid."""

    def __init__(self, data: memoryview, tags: bool):
        fields = fields_of(data)
        self.strings = [bytes(v).decode("utf-8", "replace") for table in fields[1] for k, v in message(table) if k == 1]
        self.groups, self.tags = fields[2], tags
        last = lambda number, default: fields[number][-1] if fields[number] else default
        self.granularity, self.lat_offset, self.lon_offset = last(17, 100), _int64(last(19, 0)), _int64(last(20, 0))

    def degrees(self, v: np.ndarray, offset: int) -> list[float]:
        return ((offset + self.granularity * v) / 1e9).tolist()

    def named(self, fields: dict) -> list[tuple[str, str]] | None:
        """Tags by the numbers of their keys and values; of a key that is repeated the last."""
        if not self.tags:
            return None
        return list({self.strings[k]: self.strings[v] for k, v in zip(numbers(fields[2]).tolist(), numbers(fields[3]).tolist())}.items())

    def dense_nodes(self, data: memoryview) -> tuple[list, list, list, list]:
        f = fields_of(data)
        ids, lats, lons = (_summed(numbers(f[k])) for k in (1, 8, 9))
        own: list = [[] if self.tags else None for _ in ids]
        pairs = numbers(f[10]) if self.tags else np.zeros(0, np.uint64)
        if pairs.any():
            rest = iter(pairs.tolist())
            for tags in own:
                found = {}
                while key := next(rest, 0):
                    found[self.strings[key]] = self.strings[next(rest)]
                tags += found.items()
        return ids.tolist(), self.degrees(lats, self.lat_offset), self.degrees(lons, self.lon_offset), own

    def node(self, data: memoryview) -> tuple:
        f = fields_of(data)
        lat, lon = (np.array([_signed(f[k][-1])]) for k in (8, 9))
        return _signed(f[1][-1]), self.degrees(lat, self.lat_offset)[0], self.degrees(lon, self.lon_offset)[0], self.named(f)

    def way(self, data: memoryview) -> tuple:
        f = fields_of(data)
        return _int64(f[1][-1]), _summed(numbers(f[8])).tolist(), self.named(f)

    def relation(self, data: memoryview) -> tuple:
        f = fields_of(data)
        members = zip(numbers(f[10]).tolist(), _summed(numbers(f[9])).tolist(), numbers(f[8]).tolist())
        return _int64(f[1][-1]), [{"type": MEMBER_TYPES[k], "ref": ref, "role": self.strings[role]} for k, ref, role in members], self.named(f)

    def columns(self, entity: str) -> list[list]:
        out: list[list] = [[] for _ in _TYPES[entity]]
        single = {"nodes": (1, self.node), "ways": (3, self.way), "relations": (4, self.relation)}[entity]
        for group in self.groups:
            for number, value in message(group):
                if number == single[0]:
                    found = [[x] for x in single[1](value)]
                elif number == 2 and entity == "nodes":
                    found = self.dense_nodes(value)
                else:
                    continue
                for column, more in zip(out, found):
                    column += more
        return out


def batch(block: memoryview, entity: str, tags: bool, first: int) -> pa.RecordBatch | None:
    """The entities of one kind in a primitive block, numbered from `first` on; None without any."""
    columns = _Block(block, tags).columns(entity)
    n = len(columns[0])
    if not n:
        return None
    arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES[entity])]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(first, first + n))], _NAMES[entity])


class _Blobs(InputPartition):
    def __init__(self, places: list[tuple[int, int, int]]):
        self.places = places


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.entity = options["path"], options.get("entity", "nodes")
        self.tags = options.get("tags", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        parts, size = [[]], 0
        for k, (kind, offset, length) in enumerate(blobs(self.path)):
            if kind != "OSMData":
                continue
            if size + length > PARTITION_BYTES and parts[-1]:
                parts.append([])
                size = 0
            parts[-1].append((k, offset, length))
            size += length
        return [_Blobs(p) for p in parts]

    def read(self, partition: _Blobs) -> Iterator[pa.RecordBatch]:
        for k, offset, length in partition.places:
            found = batch(blob_content(self.path, offset, length), self.entity, self.tags, k << 32)
            if found is not None:
                yield found


class OsmPbf(DataSource):
    """Options: path (a file that all executors see), entity (nodes, ways, relations), tags (true, false)."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        entity = self.options.get("entity", "nodes")
        if entity not in SCHEMAS:
            raise ValueError(f"no such entity: {entity}")
        return SCHEMAS[entity]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, entity: str, tags: bool = True):
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osmpbf").option("entity", entity).option("tags", str(tags).lower()).load(path)
