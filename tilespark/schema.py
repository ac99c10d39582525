"""Tile schemas: which features a tile holds, as Column expressions over tags.

A schema turns a row into a struct (layer, type, attributes, min_zoom, rank) or
null, which drops the row. Attributes keep their order and kind: an array of
(key, kind, s, i, d, b).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.scalar import parse_number

POINT, LINE, POLYGON = 1, 2, 3
ATTRIBUTE = "struct<key:string,kind:string,s:string,i:bigint,d:double,b:boolean>"

# ---- fixed values: road, signal and place classes of the two schemas ----
DELIVERY_ROADS = {
    "motorway": ("motorway", 6), "motorway_link": ("motorway", 12), "trunk": ("trunk", 6), "trunk_link": ("trunk", 12),
    "primary": ("primary", 8), "primary_link": ("primary", 12), "secondary": ("secondary", 10), "secondary_link": ("secondary", 12),
    "tertiary": ("tertiary", 11), "tertiary_link": ("tertiary", 13), "residential": ("minor", 13), "unclassified": ("minor", 13),
    "living_street": ("minor", 14), "service": ("service", 14), "pedestrian": ("path", 14), "footway": ("path", 15),
    "path": ("path", 15), "cycleway": ("path", 15), "track": ("path", 15), "steps": ("path", 15),
}
DELIVERY_RANKS = {"path": 0, "service": 1, "minor": 2, "tertiary": 3, "secondary": 4, "primary": 5, "trunk": 6, "motorway": 7}
DELIVERY_SIGNALS = ("traffic_signals", "stop", "give_way")
DELIVERY_WATER = ("water", "bay", "strait")
OMT_ROADS = {
    "motorway": ("motorway", 4), "trunk": ("trunk", 5), "primary": ("primary", 7), "secondary": ("secondary", 9), "tertiary": ("tertiary", 10),
    "unclassified": ("minor", 12), "residential": ("minor", 12), "living_street": ("minor", 13), "service": ("service", 13), "track": ("track", 13),
    "pedestrian": ("path", 13), "path": ("path", 14), "footway": ("path", 14), "cycleway": ("path", 14), "steps": ("path", 14),
}
OMT_WATER = ("water", "bay", "strait", "lagoon")
OMT_WATERWAYS = ("stream", "river", "canal", "drain", "ditch")
OMT_PLACES = {
    "continent": (1, 0), "country": (2, 2), "state": (3, 4), "city": (4, 5), "town": (5, 8),
    "village": (6, 11), "hamlet": (7, 13), "suburb": (8, 12), "neighbourhood": (9, 13), "island": (10, 10),
}
METRES_PER_LEVEL = 3.66
# ---- end of fixed values ----


def lookup(table: dict, key: Column, part: int | None = None) -> Column:
    """A dimension small enough to be a literal map; null for other keys."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v if part is None else v[part])) for k, v in table.items())
    return F.try_element_at(F.create_map(*pairs), key)


def attribute(key: str, value: Column, kind: str = "string") -> Column:
    """One attribute; a null value is dropped by `attributes`."""
    null = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
    own = {"string": "s", "int": "i", "double": "d", "bool": "b"}[kind]
    slots = [(value if c == own else F.lit(None)).cast(t).alias(c) for c, t in null.items()]
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), *slots))


def attributes(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda a: a.isNotNull())


def some(text: Column) -> Column:
    """The text if it is not empty."""
    return F.when(F.length(text) > 0, text)


def classified(layer: str, kind: int, attrs: Column, min_zoom: Column, rank: Column | None = None) -> Column:
    rank = F.lit(0) if rank is None else rank
    return F.struct(F.lit(layer).alias("layer"), F.lit(kind).alias("type"), attrs.alias("attributes"), min_zoom.cast("int").alias("min_zoom"), rank.cast("int").alias("rank"))


#: What `classified` gives. A schema's method that returns None classifies nothing.
CLASSIFIED = "struct<layer:string,type:int,attributes:array<struct<key:string,kind:string,s:string,i:bigint,d:double,b:boolean>>,min_zoom:int,rank:int>"


@dataclass(frozen=True)
class Layer:
    id: str
    fields: dict[str, str]
    min_zoom: int
    max_zoom: int
    description: str | None = None

    def metadata(self) -> dict:
        out = {"id": self.id, "fields": self.fields, "minzoom": self.min_zoom, "maxzoom": self.max_zoom}
        return out if self.description is None else out | {"description": self.description}


class TileSchema:
    """Subclass this: columns in, columns out. `way` reads node_ids and tags, `node` and `relation` read tags (and kind)."""

    name: str = "tiles"
    min_zoom: int = 0
    max_zoom: int = 14
    extent: int = 4096
    reads_nodes: bool = False

    @property
    def layers(self) -> list[Layer]:
        raise NotImplementedError

    def way(self, node_ids: Column, tags: Column) -> Column | None:
        return None

    def node(self, tags: Column) -> Column | None:
        return None

    def relation(self, multipolygon: Column, tags: Column) -> Column | None:
        return None

    def tolerance(self, zoom: Column) -> Column:
        return F.when(zoom >= self.max_zoom, 2).otherwise(4)


def closes(node_ids: Column) -> Column:
    return F.try_element_at(node_ids, F.lit(1)) == F.try_element_at(node_ids, F.lit(-1))


@dataclass(frozen=True)
class DeliverySchema(TileSchema):
    """Roads, water and traffic controls for routing by eye."""

    min_zoom: int = 6
    max_zoom: int = 15
    extent: int = 4096
    names: bool = True
    signals: bool = True
    name: str = field(default="delivery", init=False)

    WATER_ZOOM = 6
    SIGNAL_ZOOM = 14

    @property
    def reads_nodes(self) -> bool:
        return self.signals

    @property
    def layers(self) -> list[Layer]:
        road = {"class": "String"} | ({"name": "String"} if self.names else {})
        found = [
            Layer("road", road, self.min_zoom, self.max_zoom, "Roads, by how heavily they are drawn."),
            Layer("water", {"class": "String"}, self.min_zoom, self.max_zoom, "Water areas."),
        ]
        return [*found, Layer("signal", {"class": "String"}, self.SIGNAL_ZOOM, self.max_zoom, "Places where traffic is held up: lights, signs, level crossings.")] if self.signals else found

    def way(self, node_ids: Column, tags: Column) -> Column:
        highway = tags["highway"]
        kind = lookup(DELIVERY_ROADS, highway, 0)
        attrs = [attribute("class", kind)] + ([attribute("name", some(tags["name"]))] if self.names else [])
        road = classified("road", LINE, attributes(*attrs), F.greatest(lookup(DELIVERY_ROADS, highway, 1), F.lit(self.min_zoom)), lookup(DELIVERY_RANKS, kind))
        water = classified("water", POLYGON, attributes(attribute("class", F.lit("water"))), F.lit(self.WATER_ZOOM))
        # A highway that is not drawn is not looked at as water either.
        drawn = F.when(highway.isNotNull(), F.when(kind.isNotNull(), road)).when(tags["natural"].isin(*DELIVERY_WATER) & closes(node_ids), water)
        return F.when(F.size(node_ids) >= 2, drawn)

    def node(self, tags: Column) -> Column:
        if not self.signals:
            return F.lit(None)
        highway = tags["highway"]
        controlled = (tags["crossing"] == "traffic_signals") | (tags["crossing:signals"] == "yes")
        kind = (
            F.when(tags["railway"].isin("level_crossing", "crossing"), F.lit("level_crossing"))
            .when(highway == "crossing", F.when(controlled, F.lit("traffic_signals")))
            .when(highway.isin(*DELIVERY_SIGNALS), highway)
        )
        return F.when(kind.isNotNull(), classified("signal", POINT, attributes(attribute("class", kind)), F.greatest(F.lit(self.SIGNAL_ZOOM), F.lit(self.min_zoom))))

    def relation(self, multipolygon: Column, tags: Column) -> Column:
        water = classified("water", POLYGON, attributes(attribute("class", F.lit("water"))), F.lit(self.WATER_ZOOM))
        return F.when(multipolygon & tags["natural"].isin(*DELIVERY_WATER), water)


@dataclass(frozen=True)
class OpenMapTilesSchema(TileSchema):
    """A subset of the public OpenMapTiles layers."""

    min_zoom: int = 4
    max_zoom: int = 14
    extent: int = 4096
    buildings: bool = True
    name: str = field(default="openmaptiles", init=False)
    reads_nodes: bool = field(default=True, init=False)

    @property
    def layers(self) -> list[Layer]:
        z = self.max_zoom
        found = [
            Layer("transportation", {"class": "String", "subclass": "String", "brunnel": "String", "oneway": "Number"}, self.min_zoom, z, "Ways for traffic."),
            Layer("transportation_name", {"name": "String", "ref": "String", "class": "String"}, 8, z, "Names of ways; declared, and not filled."),
            Layer("water", {"class": "String", "intermittent": "Number"}, self.min_zoom, z, "Water areas."),
            Layer("waterway", {"class": "String", "name": "String"}, 9, z, "Rivers and smaller waters as lines."),
            Layer("place", {"class": "String", "name": "String", "rank": "Number"}, self.min_zoom, z, "Places with names."),
        ]
        return [*found, Layer("building", {"render_height": "Number"}, 13, z)] if self.buildings else found

    @staticmethod
    def is_water(tags: Column) -> Column:
        return F.coalesce(tags["natural"].isin(*OMT_WATER), F.lit(False)) | F.coalesce(tags["landuse"] == "reservoir", F.lit(False)) | tags["water"].isNotNull()

    def _water(self) -> Column:
        return classified("water", POLYGON, attributes(attribute("class", F.lit("lake"))), F.lit(0))

    @staticmethod
    def brunnel(tags: Column) -> Column:
        out = None
        for k in ("bridge", "tunnel", "ford"):
            out = (F.when if out is None else out.when)(tags[k] != "no", F.lit(k))
        return out

    @staticmethod
    def height(tags: Column) -> Column:
        return F.coalesce(parse_number(tags["height"]), parse_number(tags["building:levels"]) * METRES_PER_LEVEL)

    def way(self, node_ids: Column, tags: Column) -> Column:
        base = F.regexp_replace(tags["highway"], "_link$", "")
        kind = lookup(OMT_ROADS, base, 0)
        road = classified(
            "transportation",
            LINE,
            attributes(
                attribute("class", kind),
                attribute("subclass", F.when(base != kind, base)),
                attribute("brunnel", self.brunnel(tags)),
                attribute("oneway", F.when(tags["oneway"] == "yes", F.lit(1)), "int"),
            ),
            F.greatest(lookup(OMT_ROADS, base, 1), F.lit(self.min_zoom)),
        )
        area = (F.size(node_ids) > 3) & closes(node_ids)
        building = area & F.lit(self.buildings) & tags["building"].isNotNull()
        waterway = tags["waterway"]
        stream = classified(
            "waterway", LINE, attributes(attribute("class", waterway), attribute("name", some(tags["name"]))), F.when(waterway == "river", 9).otherwise(12)
        )
        drawn = (
            F.when(tags["highway"].isNotNull(), F.when(kind.isNotNull(), road))
            .when(area & self.is_water(tags), self._water())
            .when(building, classified("building", POLYGON, attributes(attribute("render_height", self.height(tags), "double")), F.lit(13)))
            .when(waterway.isin(*OMT_WATERWAYS), stream)
        )
        return F.when(F.size(node_ids) >= 2, drawn)

    def node(self, tags: Column) -> Column:
        place, name = tags["place"], some(tags["name"])
        rank = lookup(OMT_PLACES, place, 0)
        attrs = attributes(attribute("class", place), attribute("name", name), attribute("rank", rank, "int"))
        return F.when(rank.isNotNull() & name.isNotNull(), classified("place", POINT, attrs, lookup(OMT_PLACES, place, 1), rank))

    def relation(self, multipolygon: Column, tags: Column) -> Column:
        return F.when(multipolygon & self.is_water(tags), self._water())


@dataclass(frozen=True)
class KeepEverythingSchema(TileSchema):
    """Every highway with all its tags, not simplified: the open end of the extension point."""

    min_zoom: int = 8
    max_zoom: int = 15
    extent: int = 4096
    name: str = field(default="everything", init=False)
    reads_nodes: bool = field(default=False, init=False)

    @property
    def layers(self) -> list[Layer]:
        return [Layer("road", {}, self.min_zoom, self.max_zoom)]

    def way(self, node_ids: Column, tags: Column) -> Column:
        slots = [F.lit(None).cast(t).alias(c) for c, t in (("i", "bigint"), ("d", "double"), ("b", "boolean"))]
        attrs = F.transform(F.map_entries(tags), lambda e: F.struct(e["key"].alias("key"), F.lit("string").alias("kind"), e["value"].alias("s"), *slots))
        return F.when((F.size(node_ids) >= 2) & tags["highway"].isNotNull(), classified("road", LINE, attrs, F.lit(self.min_zoom)))

    def tolerance(self, zoom: Column) -> Column:
        return F.lit(0)
