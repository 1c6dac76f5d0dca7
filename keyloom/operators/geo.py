"""Geo points: a member's 52-bit interleaved cell, and exact distances on a sphere. All of it is column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The earth's radius in metres, units in metres, limits of latitude, and the base 32 alphabet.
RADIUS = 6372797.560856
UNITS = {"M": 1.0, "KM": 1000.0, "FT": 0.3048, "MI": 1609.34}
LAT_LIMIT = 85.05112878
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Cells along each axis.
SCALE = float(1 << 26)
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _spread(x: Column) -> Column:
    """The bits of a number, each followed by a free one: its binary digits read in base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def steps(lon: Column, lat: Column, lat_limit: float = LAT_LIMIT) -> tuple[Column, Column]:
    """The position of a point's cell along both axes (26 bits each)."""
    return F.floor((lon + 180.0) / 360.0 * SCALE).cast("long"), F.floor((lat + lat_limit) / (2 * lat_limit) * SCALE).cast("long")


def middle(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a cell."""
    return (x + 0.5) / SCALE * 360.0 - 180.0, (y + 0.5) / SCALE * (2 * LAT_LIMIT) - LAT_LIMIT


def encode(lon: Column, lat: Column, lat_limit: float = LAT_LIMIT) -> Column:
    """26 bits of latitude and longitude, interleaved, longitude in the higher bit of each pair."""
    x, y = steps(lon, lat, lat_limit)
    return _spread(y) + 2 * _spread(x)


def decode(cell: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a cell: a base 4 digit holds a bit of each."""
    axis = lambda bits: F.conv(F.translate(F.conv(cell.cast("string"), 10, 4), "0123", bits), 2, 10).cast("long")
    return middle(axis("0011"), axis("0101"))


def geohash(lon: Column, lat: Column) -> Column:
    """The standard geohash of 11 characters; the last one, which 52 bits don't reach, is the alphabet's first."""
    signs = F.conv(F.shiftright(encode(lon, lat, 90.0), 2).cast("string"), 10, 32)
    return F.concat(F.translate(F.lpad(signs, 10, "0"), BASE32, ALPHABET), F.lit("0"))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the sphere (haversine)."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * RADIUS * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def stored(points: DataFrame) -> DataFrame:
    """GEOADD: (key, member, cell), with the position that the cell keeps.

    The position comes from the steps along the axes, not from the cell's bits, so a condition on it stays plain
    arithmetic wherever it is pushed to.
    """
    lon, lat = middle(*steps(F.col("lon"), F.col("lat")))
    return points.select("key", "member", encode(F.col("lon"), F.col("lat")).alias("cell"), lon.alias("lon"), lat.alias("lat"))


def within(places: DataFrame, lon: float, lat: float, radius: float, unit: str = "M") -> DataFrame:
    """Members within a radius, with dist in the unit. Latitudes too far away go before any trigonometry."""
    metres = radius * UNITS[unit]
    band = metres / RADIUS * 57.29577951308232 + 1e-9
    near = places.filter((F.col("lat") >= lat - band) & (F.col("lat") <= lat + band))
    d = near.withColumn("metres", distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")))
    return d.filter(F.col("metres") <= metres).withColumn("dist", F.col("metres") / UNITS[unit]).drop("metres")


def within_box(places: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "M") -> DataFrame:
    """Members in a box around a point: the latitude distance and the distance along the member's own latitude count."""
    u = UNITS[unit]
    up = distance(F.lit(lon), F.lit(lat), F.lit(lon), F.col("lat"))
    across = distance(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat"))
    hit = places.filter((up <= height * u / 2) & (across <= width * u / 2))
    return hit.withColumn("dist", distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) / u)


def around_members(places: DataFrame, centers: DataFrame, radius: float, unit: str = "M") -> DataFrame:
    """For every center (key, member) all members of its key within the radius.

    Both sides are cut into latitude bands as high as the radius, so the join is an equi-join on (key, band) of three
    neighbouring bands, not a comparison of all pairs.
    """
    metres = radius * UNITS[unit]
    high = metres / RADIUS * 57.29577951308232
    band = lambda c: F.floor((c + 90.0) / high).cast("long")
    c = places.join(centers, ["key", "member"], "left_semi").select("key", F.col("member").alias("center"), F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    c = c.withColumn("band", F.explode(F.array(*[band(F.col("clat")) + k for k in (-1, 0, 1)])))
    both = places.withColumn("band", band(F.col("lat"))).join(c, ["key", "band"])
    both = both.withColumn("metres", distance(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")))
    return both.filter(F.col("metres") <= metres).select("key", "center", "member", (F.col("metres") / UNITS[unit]).alias("dist"))
