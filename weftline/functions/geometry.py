"""Geometries as columns, and the functions on them, all from built-in functions.

A geometry is a struct: kind, shapes (polygons or other parts, each an array of rings
or one array of points) and srid. An empty geometry has no shapes. Lengths and areas are
planar, in units of the srid. Every function binds its argument once, as the element of
a one-element array, so that chained calls don't repeat each other's expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<array<array<struct<x:double,y:double>>>>"
TYPE = f"struct<kind:string,shapes:{POINTS},srid:int>"
KINDS = ("POINT", "LINESTRING", "LINEARRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
RADIUS = 6378137.0
#: Fixed value: the first eccentricity of the ellipsoid of 1984.
ECCENTRICITY = 0.0818191908426215
NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:E[-+]?[0-9]+)?"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def from_text(wkt: Column, srid: int | None = None) -> Column:
    """A geometry from its text; an error for what isn't one, null for null.

    A third coordinate is left out. Collections of geometries aren't supported.
    """
    def points(part: Column) -> Column:
        def point(p: Column) -> Column:
            return F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"))

        pairs = F.split(F.regexp_replace(part, "[()]", ""), ",")
        return F.transform(pairs, lambda p: _bound(F.split(F.trim(p), " "), point))

    def rings(part: Column) -> Column:
        return F.transform(F.split(part, r"\) ?, ?\("), points)

    def made(t: Column) -> Column:
        kind, body = t["kind"], t["body"]
        polygons = F.split(body, r"\) ?\) ?, ?\( ?\(")
        shapes = (
            F.when(t["empty"], F.array().cast(POINTS))
            .when(kind == "MULTIPOLYGON", F.transform(polygons, rings))
            .when(kind == "POLYGON", F.array(rings(body)))
            .when(kind == "MULTILINESTRING", F.transform(rings(body), lambda r: F.array(r)))
            .when(kind == "MULTIPOINT", F.transform(points(body), lambda p: F.array(F.array(p))))
            .otherwise(F.array(F.array(points(body))))
        )
        # p is a point, r a run of them in parentheses, g a polygon
        shape = F.regexp_replace(F.regexp_replace(body, r" ?([(),]) ?", "$1"), "[^(),]+", "p")
        runs = F.regexp_replace(F.regexp_replace(shape, "p(?:,p)*", "r"), r"\(r\)", "R")
        nested = (
            F.when(kind == "POINT", shape == "p")
            .when(kind.isin("LINESTRING", "LINEARRING"), runs == "r")
            .when(kind == "MULTIPOINT", (runs == "r") | shape.rlike(r"^\(p\)(?:,\(p\))*$"))
            .when(kind.isin("POLYGON", "MULTILINESTRING"), runs.rlike("^R(?:,R)*$"))
            .otherwise(F.regexp_replace(F.regexp_replace(runs, "R(?:,R)*", "g"), r"\(g\)", "G").rlike("^G(?:,G)*$"))
        )
        numbers = F.forall(F.split(F.regexp_replace(body, "[()]", ""), ","), lambda p: F.trim(p).rlike(f"^{NUMBER} {NUMBER}(?: {NUMBER})?$"))
        legal = kind.isin(*KINDS) & (t["empty"] | (nested & numbers))
        wrong = F.raise_error(F.concat(F.lit("not a geometry: "), F.substring(t["text"], 1, 100))).cast(TYPE)
        done = F.struct(kind.alias("kind"), shapes.cast(POINTS).alias("shapes"), F.lit(srid).cast("int").alias("srid"))
        return F.when(t["text"].isNull(), None).when(legal, done).otherwise(wrong)

    def parts(text: Column) -> Column:
        return F.struct(
            text.alias("text"), F.regexp_extract(text, "^([A-Z]+)", 1).alias("kind"), text.rlike("^[A-Z]+(?: Z)? EMPTY$").alias("empty"),
            F.regexp_extract(text, r"^[A-Z]+(?: Z)? ?\((.*)\)$", 1).alias("body"),
        )

    text = F.regexp_replace(F.upper(F.trim(wkt)), r"\s+", " ")
    return _bound(_bound(text, parts), made)


def set_srid(g: Column, srid: int) -> Column:
    """A geometry under another label; its coordinates stay."""
    if srid not in LABELS:
        _known(srid)
    return g.withField("srid", F.lit(srid).cast("int"))


def srid(g: Column) -> Column:
    return g["srid"]


def _all_points(g: Column) -> Column:
    return F.flatten(F.flatten(g["shapes"]))


def x(g: Column) -> Column:
    """The least x of the bounds; null if empty."""
    return F.array_min(F.transform(_all_points(g), lambda p: p["x"]))


def y(g: Column) -> Column:
    """The least y of the bounds; null if empty."""
    return F.array_min(F.transform(_all_points(g), lambda p: p["y"]))


def _sum(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.transform(items, of), F.lit(0.0), lambda a, v: a + v)


def _over_edges(ring: Column, of: Callable[[Column, Column], Column]) -> Column:
    """The sum of ``of`` over neighbouring points."""
    def over(points: Column) -> Column:
        return _sum(F.zip_with(points, F.slice(points, 2, F.size(points)), lambda a, b: F.when(b.isNotNull(), of(a, b)).otherwise(0.0)), lambda v: v)

    return _bound(ring, over)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _ring_area(ring: Column) -> Column:
    return F.abs(_over_edges(ring, _cross)) / 2


def _with_holes(shape: Column, of: Callable[[Column], Column]) -> Column:
    return of(shape[0]) - _sum(F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0))), of)


def _area(g: Column) -> Column:
    return F.when(g["kind"].endswith("POLYGON"), _sum(g["shapes"], lambda s: _with_holes(s, _ring_area))).when(g.isNotNull(), 0.0)


def area(g: Column) -> Column:
    """Outer rings without their holes; 0 for points and lines."""
    return _bound(g, _area)


def centroid(g: Column) -> Column:
    """By area for polygons, by length for lines, the mean for points; the mean too where area or length is 0."""
    def moment(axis: str) -> Callable[[Column], Column]:
        def of(ring: Column) -> Column:
            return F.signum(_over_edges(ring, _cross)) * _over_edges(ring, lambda a, b: (a[axis] + b[axis]) * _cross(a, b)) / 6
        return of

    def line(a: Column, b: Column) -> Column:
        return F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)

    def middle(g: Column) -> Column:
        lines, points = F.flatten(g["shapes"]), _all_points(g)
        whole, total = _area(g), _sum(lines, lambda r: _over_edges(r, line))

        def at(axis: str) -> Column:
            by_area = _sum(g["shapes"], lambda s: _with_holes(s, moment(axis))) / whole
            by_length = _sum(lines, lambda r: _over_edges(r, lambda a, b: line(a, b) * (a[axis] + b[axis]) / 2)) / total
            mean = _sum(points, lambda p: p[axis]) / F.size(points)
            return F.when(g["kind"].endswith("POLYGON") & (whole > 0), by_area).when(g["kind"].rlike("^(MULTI)?LINE") & (total > 0), by_length).otherwise(mean)

        point = F.array(F.array(F.array(F.struct(at("x").alias("x"), at("y").alias("y")))))
        shapes = F.when(F.size(points) > 0, point.cast(POINTS)).otherwise(F.array().cast(POINTS))
        return F.when(g.isNotNull(), F.struct(F.lit("POINT").alias("kind"), shapes.alias("shapes"), g["srid"].alias("srid")))

    return _bound(g, middle)


def as_text(g: Column) -> Column:
    def number(v: Column) -> Column:
        return F.regexp_replace(v.cast("string"), r"\.0$", "")

    def points(ring: Column) -> Column:
        return F.array_join(F.transform(ring, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", ")

    def rings(shape: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(shape, points), "), ("), F.lit(")"))

    def text(g: Column) -> Column:
        parts = F.transform(g["shapes"], rings)
        body = (
            F.when(g["kind"].isin("POINT", "LINESTRING", "LINEARRING"), points(g["shapes"][0][0]))
            .when(g["kind"] == "MULTIPOINT", points(_all_points(g)))
            .when(g["kind"].isin("POLYGON", "MULTILINESTRING"), F.array_join(parts, ", "))
            .otherwise(F.concat(F.lit("("), F.array_join(parts, "), ("), F.lit(")")))
        )
        return F.when(F.size(g["shapes"]) == 0, F.concat(g["kind"], F.lit(" EMPTY"))).otherwise(F.concat(g["kind"], F.lit(" ("), body, F.lit(")")))

    return _bound(g, text)


def as_geojson(g: Column) -> Column:
    """A GeoJSON object as text; coordinates nest as deep as the kind needs."""
    names = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
    kinds = F.create_map(*(F.lit(x) for name in names for x in (name.upper(), name)), F.lit("LINEARRING"), F.lit("LineString"))

    def text(g: Column) -> Column:
        pairs = F.transform(g["shapes"], lambda s: F.transform(s, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
        coordinates = (
            F.when(F.size(g["shapes"]) == 0, F.lit("[]"))
            .when(g["kind"] == "POINT", F.to_json(pairs[0][0][0]))
            .when(g["kind"].isin("LINESTRING", "LINEARRING"), F.to_json(pairs[0][0]))
            .when(g["kind"] == "POLYGON", F.to_json(pairs[0]))
            .when(g["kind"] == "MULTIPOINT", F.to_json(F.flatten(F.flatten(pairs))))
            .when(g["kind"] == "MULTILINESTRING", F.to_json(F.flatten(pairs)))
            .otherwise(F.to_json(pairs))
        )
        return F.concat(F.lit('{"type":"'), kinds[g["kind"]], F.lit('","coordinates":'), coordinates, F.lit("}"))

    return _bound(g, text)


def _to_mercator(p: Column) -> tuple[Column, Column]:
    return F.radians(p["x"]) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2)) * RADIUS


def _from_mercator(p: Column) -> tuple[Column, Column]:
    return F.degrees(p["x"] / RADIUS), F.degrees(2 * F.atan(F.exp(p["y"] / RADIUS)) - math.pi / 2)


def _to_swiss(p: Column) -> tuple[Column, Column]:
    """Published approximation of the Swiss survey, to about a metre."""
    u, v = (p["x"] * 3600 - 26782.5) / 10000, (p["y"] * 3600 - 169028.66) / 10000
    east = 2600072.37 + 211455.93 * u - 10938.51 * u * v - 0.36 * u * v**2 - 44.54 * u**3
    north = 1200147.07 + 308807.95 * v + 3745.25 * u**2 + 76.63 * v**2 - 194.56 * u**2 * v + 119.79 * v**3
    return east, north


def _from_swiss(p: Column) -> tuple[Column, Column]:
    u, v = (p["x"] - 2600000) / 1000000, (p["y"] - 1200000) / 1000000
    lon = 2.6779094 + 4.728982 * u + 0.791484 * u * v + 0.1306 * u * v**2 - 0.0436 * u**3
    lat = 16.9023892 + 3.238272 * v - 0.270978 * u**2 - 0.002528 * v**2 - 0.0447 * u**2 * v - 0.0140 * v**3
    return lon * 100 / 36, lat * 100 / 36


def _old_swiss(p: Column) -> tuple[Column, Column]:
    east, north = _to_swiss(p)
    return east - 2000000, north - 1000000


def _from_old_swiss(p: Column) -> tuple[Column, Column]:
    return _from_swiss({"x": p["x"] + 2000000, "y": p["y"] + 1000000})


def _to_ellipsoid_mercator(p: Column) -> tuple[Column, Column]:
    sine = F.sin(F.radians(p["y"])) * ECCENTRICITY
    stretch = F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2) * F.pow((1 - sine) / (1 + sine), ECCENTRICITY / 2)
    return F.radians(p["x"]) * RADIUS, F.log(stretch) * RADIUS


def _from_ellipsoid_mercator(p: Column) -> tuple[Column, Column]:
    """The latitude by the usual series in the conformal latitude."""
    e2 = ECCENTRICITY**2
    chi = math.pi / 2 - 2 * F.atan(F.exp(-p["y"] / RADIUS))
    series = {
        2: e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 4: 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        6: 7 * e2**3 / 120 + 81 * e2**4 / 1120, 8: 4279 * e2**4 / 161280,
    }
    latitude = chi
    for k, c in series.items():
        latitude = latitude + c * F.sin(chi * k)
    return F.degrees(p["x"] / RADIUS), F.degrees(latitude)


#: srid -> (from longitude and latitude, to them); 4326 is what all pass through
PROJECTIONS = {
    4326: (None, None), 3857: (_to_mercator, _from_mercator), 3395: (_to_ellipsoid_mercator, _from_ellipsoid_mercator),
    2056: (_to_swiss, _from_swiss), 21781: (_old_swiss, _from_old_swiss),
}
#: (from, to) -> a way that doesn't lead through longitude and latitude
DIRECT = {
    (2056, 21781): lambda p: (p["x"] - 2000000, p["y"] - 1000000),
    (21781, 2056): lambda p: (p["x"] + 2000000, p["y"] + 1000000),
}
#: Reference systems that geometries may be labelled with, without a way to or from them.
LABELS = {2249}


def _known(number: int) -> None:
    if number not in PROJECTIONS:
        raise ValueError(f"unknown reference system {number}")


def transform(g: Column, target: int) -> Column:
    """The geometry in another reference system; an error where its own isn't known."""
    _known(target)

    def pair(by: Callable | None, p: Column) -> Column:
        a, b = by(p) if by else (p["x"], p["y"])
        return F.struct(a.alias("x"), b.alias("y"))

    def moved(g: Column) -> Column:
        def point(p: Column) -> Column:
            """Through longitude and latitude, by the way back from the geometry's own system."""
            geographic = F.lit(None).cast("struct<x:double,y:double>")
            for number, (_, back) in PROJECTIONS.items():
                geographic = F.when(g["srid"] == number, pair(back, p)).otherwise(geographic)
            out = _bound(geographic, lambda q: pair(PROJECTIONS[target][0], q)) if target != 4326 else geographic
            for (start, end), by in DIRECT.items():
                out = F.when(g["srid"] == start, pair(by, p)).otherwise(out) if end == target else out
            return out

        points = F.transform(g["shapes"], lambda s: F.transform(s, lambda r: F.transform(r, point)))
        unknown = F.raise_error(F.lit("the geometry has no known reference system")).cast(POINTS)
        shapes = F.when(g["srid"] == target, g["shapes"]).when(g["srid"].isin(*PROJECTIONS), points.cast(POINTS)).otherwise(unknown)
        return F.when(g.isNotNull(), F.struct(g["kind"].alias("kind"), shapes.alias("shapes"), F.lit(target).cast("int").alias("srid")))

    return _bound(g, moved)


def is_geometry(kind: str) -> bool:
    """Whether a type, as ``dtypes`` names it, is that of a geometry."""
    return kind == TYPE
