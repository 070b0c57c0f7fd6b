"""Readers of the files a tile corpus comes in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import heights
from ..functions.scalars import parse_height, tile_city, tile_index
from ..operators.vector import tags_match

#: Fixed palette: red, green and blue of streets, greens and open ground; buildings are grey above black.
STREET, GREEN, OPEN = (255, 0, 0), (128, 255, 0), (0, 0, 0)
#: Fixed tag values of what counts as green and as street.
GREEN_TAGS = {
    "landuse": ["grass", "forest", "meadow", "recreation_ground", "village_green", "cemetery", "orchard", "allotments", "greenfield", "flowerbed"],
    "leisure": ["park", "garden", "pitch", "playground", "nature_reserve", "golf_course", "dog_park", "common"],
    "natural": ["wood", "grassland", "scrub", "heath"],
}
STREET_CLASSES = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "residential", "unclassified", "living_street", "pedestrian",
]
STREET_WIDTH = 8.0


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """PNG tiles named City_number.png: path, city, idx, status, height, width, data (blue, green, red bytes).
    Files that can't be read stay, with status unreadable."""
    t = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    name = F.regexp_extract("origin", "([^/]+)$", 1)
    status = F.when(F.col("height") > 0, "read").otherwise("unreadable")
    return t.select(F.col("origin").alias("path"), tile_city(name).alias("city"), tile_index(name).alias("idx"), status.alias("status"), "height", "width", "data")


def pixels(tiles: DataFrame) -> DataFrame:
    """The pixels of readable tiles: city, idx, r, c, red, green, blue; one tile is unpacked at a time."""
    import numpy as np
    import pandas as pd

    def unpack(batches):
        for batch in batches:
            for t in batch.itertuples():
                a = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, -1).astype(np.int32)
                r, c = np.indices(a.shape[:2])
                yield pd.DataFrame({"city": t.city, "idx": t.idx, "r": r.ravel(), "c": c.ravel(), "red": a[..., 2].ravel(), "green": a[..., 1].ravel(), "blue": a[..., 0].ravel()})

    good = tiles.where("status = 'read'").select("city", "idx", "height", "width", "data")
    return good.mapInPandas(unpack, "city string, idx int, r int, c int, red int, green int, blue int")


def pixel_class(red: Column, green: Column, blue: Column) -> Column:
    def is_(rgb: tuple) -> Column:
        return (red == rgb[0]) & (green == rgb[1]) & (blue == rgb[2])

    grey = (red == green) & (green == blue) & (red > 0)
    return F.when(is_(STREET), "street").when(is_(GREEN), "green").when(is_(OPEN), "open").when(grey, "building").otherwise("off_palette")


def cities(spark: SparkSession, path: str) -> DataFrame:
    """A list of cities in any of its shapes: rows, names, {names: [..]} or {City: [lat, lon]}."""
    text = spark.read.text(path, wholetext=True)
    row = "struct<city: string, lat: double, lon: double, continent: string, fabric: string>"
    v = F.btrim("value")

    def named(names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("city"), *[F.lit(None).cast(t).alias(c) for c, t in (("lat", "double"), ("lon", "double"), ("continent", "string"), ("fabric", "string"))]))

    pairs = F.transform(
        F.map_entries(F.from_json(v, "map<string, array<double>>")),
        lambda e: F.struct(e["key"].alias("city"), F.get(e["value"], F.lit(0)).alias("lat"), F.get(e["value"], F.lit(1)).alias("lon"), F.lit(None).cast("string").alias("continent"), F.lit(None).cast("string").alias("fabric")),
    )
    rows = (
        F.when(F.rlike(v, F.lit(r"^\[\s*\{")), F.from_json(v, f"array<{row}>"))
        .when(F.rlike(v, F.lit(r"^\[")), named(F.from_json(v, "array<string>")))
        .when(F.get_json_object(v, "$.names").isNotNull(), named(F.from_json(v, "struct<names: array<string>>")["names"]))
        .otherwise(pairs)
    )
    return text.select(F.inline(rows))


def height_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved height table: levels (grey, n, byte), and the inverse, which is computed anew from them."""
    t = spark.read.json(path, multiLine=True)
    both = t.select(F.posexplode(F.arrays_zip("forward", "counts")).alias("grey", "x")).select("grey", F.col("x.counts").alias("n"), F.col("x.forward").cast("int").alias("byte"))
    levels = both.where("n > 0")
    return levels, heights.inverse(levels)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metric table in CSV; empty cells are null, numbers are doubles."""
    t = spark.read.csv(path, header=True, nullValue="")
    text = {"city", "file"}
    return t.select(*[F.col(c) if c in text else F.col(c).try_cast("double").alias(c) for c in t.columns])


POINT = "struct<lat: double, lon: double>"
ELEMENT = f"type string, id bigint, tags map<string, string>, geometry array<{POINT}>, members array<struct<type: string, role: string, geometry: array<{POINT}>>>"


def elements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Map elements from saved answers ({elements: [..]}, gzip or not), of each type and id the first by file and place.
    lines: an answer a line, else a file."""
    t = spark.read.schema(f"elements array<struct<{ELEMENT.replace(' string', ': string', 1).replace('id bigint', 'id: bigint').replace('tags map', 'tags: map').replace('geometry array', 'geometry: array', 1).replace('members array', 'members: array')}>>").json(path, multiLine=not lines)
    rows = t.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"), F.posexplode("elements").alias("_at", "e"))
    rows = rows.select("e.type", "e.id", F.struct("_file", "_row", "_at").alias("_order"), F.struct("e.tags", "e.geometry", "e.members").alias("e"))
    first = rows.groupBy("type", "id").agg(F.min_by("e", "_order").alias("e"))
    return first.select("type", "id", "e.*")


def chained(ways: Column) -> Column:
    """Ways of a relation with open ones joined where one ends as another begins or ends: a fold that adds to the open
    chain what fits it, as often as there are ways, so their order doesn't matter. Chains that stay open stay as they are."""
    last = lambda w: F.get(w, F.size(w) - 1)
    first = lambda w: F.get(w, F.lit(0))
    closed = lambda w: (F.size(w) >= 4) & (first(w) == last(w))
    fits = lambda a, b: ~closed(a) & ~closed(b) & ((last(a) == first(b)) | (last(a) == last(b)))
    empty = F.array().cast(f"array<array<{POINT}>>")

    def grow(state: Column, _: Column) -> Column:
        head, rest = F.get(state["open"], F.lit(0)), F.slice(state["open"], 2, F.greatest(F.size(state["open"]), F.lit(1)))
        match = F.array_position(F.transform(rest, lambda w: fits(head, w)), True).cast("int")
        other = F.get(rest, match - 1)
        tail = F.when(last(head) == first(other), other).otherwise(F.reverse(other))
        joined = F.concat(head, F.slice(tail, 2, F.greatest(F.size(tail), F.lit(1))))
        left = F.filter(rest, lambda w, i: i != match - 1)
        more = F.struct(F.concat(F.array(joined), left).alias("open"), state["done"].alias("done"))
        stop = F.struct(rest.alias("open"), F.concat(state["done"], F.array(head)).alias("done"))
        none = F.struct(state["open"].alias("open"), state["done"].alias("done"))
        return F.when(F.size(state["open"]) == 0, none).when(match > 0, more).otherwise(stop)

    start = F.struct(F.coalesce(ways, empty).alias("open"), empty.alias("done"))
    turns = F.sequence(F.lit(0), 2 * F.size(F.coalesce(ways, empty)))
    return F.aggregate(turns, start, grow, lambda s: s["done"])


def features(elements: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Buildings, streets and greens of map elements, in metres east and north of a point: kind, type, id, ring,
    is_hole, points, height and width. Rings are closed ways and the members of relations, whose open ways are joined
    at their ends."""
    east, north = 111320.0 * F.cos(F.radians(F.lit(lat0))), F.lit(111320.0)

    def local(points: Column) -> Column:
        return F.transform(points, lambda p: F.struct(((p["lon"] - lon0) * east).alias("x"), ((p["lat"] - lat0) * north).alias("y")))

    ways = F.filter("members", lambda m: m["type"] == "way")

    def members(inner: bool) -> Column:
        some = F.filter(ways, lambda m: (F.coalesce(m["role"], F.lit("")) == "inner") == inner)
        joined = chained(F.transform(some, lambda m: m["geometry"]))
        return F.transform(joined, lambda g: F.struct(F.lit("inner" if inner else "outer").alias("role"), g.alias("geometry")))

    rings = F.when(F.col("type") == "way", F.array(F.struct(F.lit("outer").alias("role"), F.col("geometry").alias("geometry")))).otherwise(
        F.concat(members(False), members(True))
    )
    t = elements.select("type", "id", "tags", F.posexplode(rings).alias("ring", "g"))
    n = F.size("g.geometry")
    closed = (n >= 4) & (F.get("g.geometry", F.lit(0)) == F.get("g.geometry", n - 1))
    building = F.coalesce(F.col("tags")["building"] != "no", F.lit(False))
    street = F.coalesce(F.col("tags")["highway"].isin(*STREET_CLASSES), F.lit(False))
    kind = F.when(building & closed, "building").when(street & (n >= 2) & (F.col("type") == "way"), "street").when(tags_match(F.col("tags"), GREEN_TAGS) & closed, "green")
    height = parse_height(F.col("tags")["height"], F.col("tags")["building:levels"], F.col("tags")["building:height"])
    return t.withColumn("kind", kind).where("kind is not null").select(
        "kind", "type", "id", "ring", (F.col("g.role") == "inner").alias("is_hole"), local(F.col("g.geometry")).alias("points"),
        F.when(F.col("kind") == "building", height).alias("height"), F.when(F.col("kind") == "street", STREET_WIDTH).alias("width"),
    )


def query_text(south: Column, west: Column, north: Column, east: Column) -> Column:
    """The text that asks a map service for a box, and nothing else: no request is made here."""
    box = F.format_string("%.5f,%.5f,%.5f,%.5f", south, west, north, east)
    classes = "|".join(STREET_CLASSES)
    greens = "".join(f'nwr["{k}"~"^({"|".join(v)})$"]({{box}});' for k, v in GREEN_TAGS.items())
    text = '[out:json][timeout:180];(nwr["building"]({box});way["highway"~"^(' + classes + ')$"]({box});' + greens + ");out geom;"
    return F.replace(F.lit(text), F.lit("{box}"), box)


def chunks(places: DataFrame, size_m: float, chunk_m: float, margin_m: float = 150.0) -> DataFrame:
    """Boxes that tile a square window with a margin around each place (place, lat, lon): place, i, j, south, west, north,
    east, and a key for saved answers. Boxes are at most chunk_m wide, as wide as they can be to be alike."""
    from ..functions.scalars import metres_per_degree

    whole = size_m + 2 * margin_m
    n = max(1, math.ceil(whole / chunk_m))
    per_lat, per_lon = metres_per_degree(F.col("lat"))
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    t = places.select("place", "lat", "lon", F.explode(axis).alias("i")).select("place", "lat", "lon", "i", F.explode(axis).alias("j"))
    step = whole / n
    south, west = F.col("lat") + (F.col("i") * step - whole / 2) / per_lat, F.col("lon") + (F.col("j") * step - whole / 2) / per_lon
    t = t.select("place", "i", "j", south.alias("south"), west.alias("west"), (south + step / per_lat).alias("north"), (west + step / per_lon).alias("east"))
    return t.withColumn("key", F.format_string("%.5f_%.5f_%.5f_%.5f", "south", "west", "north", "east"))


def option_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, parameters map<string, double>, objectives map<string, string>, seconds map<string, double>").json(path)


def inventory(spark: SparkSession, folder: str, pattern: str = "*", least: int = 0) -> DataFrame:
    """Files of a folder by name: path, name, length; only the listing is read. Files of least bytes or fewer are left out."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return t.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length").where(F.col("length") > least)
