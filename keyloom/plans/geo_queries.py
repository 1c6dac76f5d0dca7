"""Geo queries; distances are rounded to a metre, as stored positions are exact only to a cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import geo as G
from keyloom.plans.registry import query, search

R = G.RADIUS
CELLS = "c AS (SELECT key, member, floor((lat + 85.05112878) / 170.10225756 * 67108864)::BIGINT AS y, floor((lon + 180.0) / 360.0 * 67108864)::BIGINT AS x FROM kv_geo WHERE abs(lat) <= 85.05112878), p AS (SELECT key, member, x, y, (x + 0.5) / 67108864 * 360.0 - 180.0 AS lon, (y + 0.5) / 67108864 * 170.10225756 - 85.05112878 AS lat FROM c)"


def dist(lon1, lat1, lon2, lat2):
    return f"2 * {R} * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"


def places(t):
    return G.stored(t.kv_geo.filter(f"abs(lat) <= {G.LAT_LIMIT}").withColumn("lon", F.col("lon").cast("double")).withColumn("lat", F.col("lat").cast("double")))


BITS = " + ".join(f"(((x >> {k}) & 1) << {2 * k + 1}) + (((y >> {k}) & 1) << {2 * k})" for k in range(26))


@query("geoadd", f"WITH {CELLS} SELECT key, member, {BITS} AS cell FROM p")
def geoadd(t):
    return places(t).select("key", "member", "cell")


@query("geopos", f"WITH {CELLS} SELECT key, member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
def geopos(t):
    return places(t).select("key", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("geodist", f"WITH {CELLS} SELECT a.key, a.member AS a, b.member AS b, round({dist('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000.0, 3) AS km FROM p a JOIN p b ON a.key = b.key AND a.member = 'c1' AND b.member <> 'c1'")
def geodist(t):
    p = places(t)
    a = p.filter("member = 'c1'").select("key", F.col("member").alias("a"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    both = p.filter("member <> 'c1'").join(F.broadcast(a), "key")  # one member
    return both.select("key", "a", F.col("member").alias("b"), F.round(G.distance(F.col("alon"), F.col("alat"), F.col("lon"), F.col("lat")) / 1000.0, 3).alias("km"))


#: In SQL, the bits of a cell whose latitude runs from -90 to 90, five at a time.
_HASH = " || ".join(f"substr('{G.ALPHABET}', ((cell >> {52 - 5 * (k + 1)}) & 31)::INTEGER + 1, 1)" for k in range(10))


@query("geohash", f"WITH {CELLS}, h AS (SELECT key, member, floor((lat + 90.0) / 180.0 * 67108864)::BIGINT AS y, floor((lon + 180.0) / 360.0 * 67108864)::BIGINT AS x FROM p), i AS (SELECT key, member, {BITS} AS cell FROM h) SELECT key, member, {_HASH} || '0' AS hash FROM i")
def geohash(t):
    p = places(t)
    return p.select("key", "member", G.geohash(F.col("lon"), F.col("lat")).alias("hash"))


@query("geo_decode", f"WITH {CELLS} SELECT key, member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
def geo_decode(t):
    """The positions that the stored cells alone give back."""
    lon, lat = G.decode(F.col("cell"))
    return places(t).select("key", "member", "cell").select("key", "member", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_RADIUS = f"WITH {CELLS}, d AS (SELECT key, member, {dist('10.0', '40.0', 'lon', 'lat')} AS m FROM p)"
for _name in ("georadius", "georadius_ro"):

    @query(_name, _RADIUS + " SELECT key, member, round(m / 1000, 3) AS dist FROM d WHERE m <= 3000000.0")
    def _georadius(t):
        return G.within(places(t), 10.0, 40.0, 3000.0, "KM").select("key", "member", F.round("dist", 3).alias("dist"))


@query("geosearch", _RADIUS + " SELECT key, member, round(m / 1609.34, 3) AS dist FROM d WHERE m <= 2500 * 1609.34 ORDER BY m, member LIMIT 12")
def geosearch(t):
    return G.within(places(t), 10.0, 40.0, 2500.0, "MI").orderBy("dist", "member").limit(12).select("key", "member", F.round("dist", 3).alias("dist"))


@query("geosearch_box", f"WITH {CELLS} SELECT key, member, round({dist('10.0', '40.0', 'lon', 'lat')} / 1000, 3) AS dist FROM p WHERE {dist('10.0', '40.0', '10.0', 'lat')} <= 1500000 AND {dist('10.0', 'lat', 'lon', 'lat')} <= 2500000")
def geosearch_box(t):
    return G.within_box(places(t), 10.0, 40.0, 5000.0, 3000.0, "KM").select("key", "member", F.round("dist", 3).alias("dist"))


@query("geosearchstore", _RADIUS + " SELECT 'dst' AS key, member, round(m / 1000, 3) AS score FROM d WHERE m <= 2000000.0")
def geosearchstore(t):
    return G.within(places(t), 10.0, 40.0, 2000.0, "KM").select(F.lit("dst").alias("key"), "member", F.round("dist", 3).alias("score"))


@query("geosearchstore_cells", f"WITH {CELLS}, d AS (SELECT *, {BITS} AS cell, {dist('10.0', '40.0', 'lon', 'lat')} AS m FROM p) SELECT 'dst' AS key, member, cell AS score FROM d WHERE m <= 2000000.0")
def geosearchstore_cells(t):
    """Without STOREDIST the score is the cell."""
    return G.within(places(t), 10.0, 40.0, 2000.0, "KM").select(F.lit("dst").alias("key"), "member", F.col("cell").alias("score"))


@query("georadius_with", f"WITH {CELLS}, d AS (SELECT *, {BITS} AS cell, {dist('10.0', '40.0', 'lon', 'lat')} AS m FROM p) SELECT key, member, round(m / 1000, 3) AS dist, cell, round(lon, 6) AS lon, round(lat, 6) AS lat FROM d WHERE m <= 2000000.0")
def georadius_with(t):
    """WITHDIST WITHHASH WITHCOORD."""
    return G.within(places(t), 10.0, 40.0, 2000.0, "KM").select("key", "member", F.round("dist", 3).alias("dist"), "cell", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_MEMBERS = f"WITH {CELLS} SELECT a.key, a.member AS center, b.member, round({dist('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 3) AS dist FROM p a JOIN p b ON a.key = b.key WHERE a.member LIKE 'c2%' AND {dist('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1000000"
for _name in ("georadiusbymember", "georadiusbymember_ro"):

    @search(_name, _MEMBERS, "a.member LIKE 'c2%'", "CAST(substr(a.member, 2) AS BIGINT) % 20 = 0")
    def _bymember(t, which):
        p = places(t)
        found = G.around_members(p, p.alias("a").filter(which).select("key", "member"), 1000.0, "KM")
        return found.withColumn("dist", F.round("dist", 3))
