"""KML, GML and Shapefile as tables, and KML, GML and GeoJSON documents from tables.

Files are read whole on the executors, a file a task; a small parser turns each into
features: a folder, attributes as texts, and geometries as their texts with a reference
system. All else is done by built-in functions. Written documents hold a batch of rows
each, so that no document grows with the table; a folder of them is read as one table.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import geometry

#: Attributes that every placemark has.
KML_ATTRIBUTES = ("name", "description", "address", "author", "begin", "end")
FEATURE = "folder string, attributes map<string,string>, shapes array<struct<wkt:string,srid:int>>"
#: The shape types of a .shp file by their number modulo 10.
POINT, LINES, POLYGONS, POINTS = 1, 3, 5, 8

Feature = tuple[str | None, dict[str, str | None], list[tuple[str, int | None]]]


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _children(e: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (c for c in e if _local(c) in names)


def _below(e: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (c for c in e.iter() if _local(c) in names)


def _texts(e: ElementTree.Element, name: str) -> str | None:
    found = next(_below(e, name), None)
    return None if found is None else (found.text or "").strip()


def _points(e: ElementTree.Element) -> list[str]:
    """Pairs of numbers, from coordinates with commas or from positions."""
    pairs = []
    for c in _below(e, "coordinates", "posList", "pos"):
        values = (c.text or "").split()
        if _local(c) == "coordinates":
            pairs += [" ".join(v.split(",")[:2]) for v in values]
        else:
            size = int(c.get("srsDimension") or e.get("srsDimension") or (len(values) if _local(c) == "pos" else 2))
            pairs += [" ".join(values[i : i + 2]) for i in range(0, len(values), size)]
    return pairs


def _rings(polygon: ElementTree.Element) -> str:
    rings = [r for side in (("outerBoundaryIs", "exterior"), ("innerBoundaryIs", "interior")) for b in _children(polygon, *side) for r in _below(b, "LinearRing")]
    return "(" + ", ".join("(" + ", ".join(_points(r)) + ")" for r in rings) + ")"


def _shapes(e: ElementTree.Element) -> list[str]:
    """The texts of a geometry; a collection of one kind is one text, a mixed one several."""
    kind = _local(e)
    if kind in ("Point", "LineString", "LinearRing", "Curve"):
        points = _points(e)
        name = {"Curve": "LINESTRING"}.get(kind, kind.upper())
        return [f"{name} ({', '.join(points)})"] if points else []
    if kind in ("Polygon", "Surface"):
        return [f"POLYGON {_rings(e)}"]
    members = [m for c in e if not _children_of_value(c) for m in ([c] if _local(c) in GEOMETRIES else [x for x in c if _local(x) in GEOMETRIES])]
    parts = [s for m in members for s in _shapes(m)]
    kinds = {p.partition(" ")[0] for p in parts}
    if len(kinds) == 1 and (only := kinds.pop()) in ("POINT", "LINESTRING", "POLYGON"):
        bodies = [p.partition(" ")[2] for p in parts]
        return [f"MULTI{only} (" + ", ".join(b[1:-1] if only == "POINT" else b for b in bodies) + ")"]
    return parts


GEOMETRIES = (
    "Point", "LineString", "LinearRing", "Curve", "Polygon", "Surface", "MultiGeometry", "MultiPoint", "MultiLineString", "MultiCurve", "MultiPolygon",
    "MultiSurface", "GeometryCollection",
)


def _children_of_value(e: ElementTree.Element) -> bool:
    """Whether an element is a value and no part of a geometry."""
    return not len(e) and _local(e) not in GEOMETRIES


def parse_kml(data: bytes, file: str) -> Iterator[Feature]:
    """The placemarks of a document, under the name of the folder they stand in."""
    folders: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
        if _local(e) == "Folder":
            folders.append(e) if event == "start" else folders.pop()
        elif event == "end" and _local(e) == "Placemark":
            named = next((n.text for n in _children(folders[-1], "name")), None) if folders else None
            attributes: dict[str, str | None] = {k: _texts(e, k) if k in ("begin", "end", "author") else next((c.text for c in _children(e, k)), None) for k in KML_ATTRIBUTES}
            for d in _below(e, "SimpleData"):
                attributes[d.get("name")] = d.text
            for d in _below(e, "Data"):
                attributes[d.get("name")] = _texts(d, "value")
            shapes = [s for g in _children(e, *GEOMETRIES) for s in _shapes(g)]
            yield named or file, attributes, [(s, 4326) for s in shapes]
            e.clear()


def _srid(name: str | None) -> int | None:
    """The number at the end of a reference system's name."""
    found = re.search(r"(\d+)\D*$", name or "")
    return int(found[1]) if found else None


def parse_gml(data: bytes, file: str) -> Iterator[Feature]:
    """The features of a collection; a geometry without a system has that of the first envelope."""
    default = None
    for _, e in ElementTree.iterparse(io.BytesIO(data), ("end",)):
        if default is None and _local(e) in ("Envelope", "Box"):
            default = _srid(e.get("srsName"))
        if _local(e) not in ("featureMember", "featureMembers", "member"):
            continue
        for feature in e:
            attributes: dict[str, str | None] = {}
            shapes: list[tuple[str, int | None]] = []
            for c in feature:
                found = next((g for g in c if _local(g) in GEOMETRIES), None)
                if found is not None:
                    shapes += [(s, _srid(found.get("srsName")) or default) for s in _shapes(found)]
                elif _local(c) not in ("boundedBy", "location"):
                    attributes[_local(c)] = c.text
            yield _local(feature), attributes, shapes
        e.clear()


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    crossings = (
        (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)
    )
    return sum(crossings) % 2 == 1


def _shape(record: bytes) -> str | None:
    """The text of one record of a .shp file; outer rings run clockwise, holes the other way."""
    kind = struct.unpack_from("<i", record)[0] % 10
    if kind == POINT:
        return "POINT ({!r} {!r})".format(*struct.unpack_from("<2d", record, 4))
    if kind == POINTS:
        n = struct.unpack_from("<i", record, 36)[0]
        flat = struct.unpack_from(f"<{2 * n}d", record, 40)
        return "MULTIPOINT (" + ", ".join(f"{x!r} {y!r}" for x, y in zip(flat[::2], flat[1::2], strict=True)) + ")"
    if kind not in (LINES, POLYGONS):
        return None
    parts, n = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", record, 44 + 4 * parts)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    runs = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    text = lambda run: "(" + ", ".join(f"{x!r} {y!r}" for x, y in run) + ")"
    if kind == LINES:
        return f"LINESTRING {text(runs[0])}" if parts == 1 else "MULTILINESTRING (" + ", ".join(map(text, runs)) + ")"
    outer = [[r] for r in runs if _area(r) <= 0] or [[r] for r in runs[:1]]
    for hole in (r for r in runs if _area(r) > 0 and all(r is not o[0] for o in outer)):
        next((o for o in outer if _inside(hole[0], o[0])), outer[0]).append(hole)
    polygons = ["(" + ", ".join(map(text, o)) + ")" for o in outer]
    return f"POLYGON {polygons[0]}" if len(polygons) == 1 else "MULTIPOLYGON (" + ", ".join(polygons) + ")"


def _shp(data: bytes) -> Iterator[str | None]:
    at = 100
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        yield _shape(data[at + 8 : at + 8 + size])
        at += 8 + size


def _dbf(data: bytes) -> Iterator[dict[str, str | None]]:
    """The rows of a .dbf file as texts; blank values are null, deleted rows are left out."""
    rows, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at, place = [], 32, 1
    while data[at] != 0x0D:
        name, width = data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]
        fields.append((name, place, place + width))
        at, place = at + 32, place + width

    def text(raw: bytes) -> str | None:
        try:
            value = raw.decode("utf-8")
        except UnicodeDecodeError:
            value = raw.decode("latin-1")
        return value.strip(" \0") or None

    for i in range(rows):
        row = data[head + i * size : head + (i + 1) * size]
        yield {name: text(row[a:b]) for name, a, b in fields}


def prj_srid(text: str | None) -> int | None:
    """The reference system that a .prj text names, by its authority's number or by its name."""
    text = text or ""
    numbers = re.findall(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]', text)
    if numbers:
        return int(numbers[-1])
    for name, srid in (("CH1903+", 2056), ("CH1903", 21781), ("Web_Mercator", 3857), ("World_Mercator", 3395), ("WGS", 4326)):
        if name in text.replace(" ", "_"):
            return srid
    return None


def _features(files: DataFrame, parse: Callable[..., Iterator[Feature]]) -> DataFrame:
    """The features of files; ``parse`` takes the values of their columns."""
    schema = pa.schema([
        ("folder", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("shapes", pa.list_(pa.struct([("wkt", pa.string()), ("srid", pa.int32())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some: list[dict] = []
                for folder, attributes, shapes in parse(*row):
                    some.append({"folder": folder, "attributes": list(attributes.items()), "shapes": [{"wkt": w, "srid": s} for w, s in shapes]})
                    if len(some) == 1000:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some = []
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    return files.mapInArrow(run, FEATURE)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (content, stem): the files at a path, and each one's name without folder and ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"))


def kml_features(spark: SparkSession, path: str) -> DataFrame:
    return _features(_files(spark, path), parse_kml)


def gml_features(spark: SparkSession, path: str) -> DataFrame:
    return _features(_files(spark, path), parse_gml)


def shapefile_features(spark: SparkSession, path: str) -> DataFrame:
    """The shapes of .shp files with the rows of the .dbf files of the same names, in the systems of their .prj files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"^(.*)\.[^./]*$", 1)
    kinds = ("shp", "dbf", "prj")
    part = [F.max(F.when(F.lower("path").endswith("." + k), F.col("content"))).alias(k) for k in kinds]
    groups = files.where(F.lower("path").rlike(r"\.(shp|dbf|prj)$")).groupBy(name.alias("name")).agg(*part).where("shp IS NOT NULL")

    def parse(stem: str, shp: bytes, dbf: bytes | None, prj: bytes | None) -> Iterator[Feature]:
        srid = prj_srid(prj.decode("utf-8", "replace")) if prj else None
        rows = _dbf(dbf) if dbf else None
        for shape in _shp(shp):
            yield stem, next(rows, {}) if rows else {}, [(shape, srid)] if shape else []

    return _features(groups.select(F.regexp_extract("name", "([^/]*)$", 1), *kinds), parse)


def folders(features: DataFrame) -> list[str]:
    """The names of the tables that features make, in order."""
    return [r.folder for r in features.select("folder").distinct().orderBy("folder").collect()]


def as_table(features: DataFrame, folder: str | None = None, always: tuple[str, ...] = (), target: int | None = None) -> DataFrame:
    """The features of one folder, or of all, as a table.

    A column for each attribute, as a number where all its values are numbers; geometries
    in ``geometry``, ``geometry2`` and so on, brought to ``target`` if that is given.
    Names and kinds come from two aggregates; only they reach the driver.
    """
    rows = features if folder is None else features.where(F.col("folder") == folder)
    found = sorted(r.key for r in rows.select(F.explode(F.map_keys("attributes")).alias("key")).distinct().collect())
    names = [*always, *(n for n in found if n not in always)]
    value = {n: F.col("attributes")[n] for n in names}
    sums = [F.max(F.size("shapes")).alias("n")]
    for i, n in enumerate(names):
        sums += [F.count(value[n]).alias(f"a{i}"), F.count(value[n].try_cast("bigint")).alias(f"b{i}"), F.count(value[n].try_cast("double")).alias(f"c{i}")]
    seen = rows.agg(*sums).first()

    def typed(i: int, n: str) -> Column:
        whole, real = seen[f"a{i}"] and seen[f"a{i}"] == seen[f"b{i}"], seen[f"a{i}"] and seen[f"a{i}"] == seen[f"c{i}"]
        return (value[n].try_cast("bigint") if whole else value[n].try_cast("double") if real else value[n]).alias(n)

    def shape(i: int) -> Column:
        s = F.get("shapes", F.lit(i))
        g = geometry.from_text(s["wkt"]).withField("srid", s["srid"])
        return (g if target is None else geometry.transform(g, target)).alias("geometry" + (str(i + 1) if i else ""))

    return rows.select(*(typed(i, n) for i, n in enumerate(names)), *(shape(i) for i in range(max(seen["n"] or 0, 0))))


def read_kml(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A folder of a KML document, or all, with the attributes that placemarks always have."""
    return as_table(kml_features(spark, path), folder, KML_ATTRIBUTES)


def read_gml(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A kind of features of a GML collection, or all; geometries in longitude and latitude."""
    return as_table(gml_features(spark, path), folder, target=4326)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """The shapes below a path, in their own reference system."""
    return as_table(shapefile_features(spark, path))


def single_geometry(rows: DataFrame, kinds: tuple[str, ...] = geometry.KINDS) -> DataFrame:
    """``rows`` with one geometry column, ``geometry``, of one kind, as most formats need.

    The column of that name stays, else the first geometry column; others go. Geometries of
    kinds that aren't in ``kinds`` become null. If a kind and its multiple occur, all
    become multiples; of other mixtures only the most frequent kind stays, unless the
    format takes all kinds. One aggregate by kind comes to the driver.
    """
    shapes = [n for n, kind in rows.dtypes if geometry.is_geometry(kind)]
    if not shapes:
        return rows
    chosen = "geometry" if "geometry" in shapes else shapes[0]
    kept = rows.select(*(F.col(f"`{n}`").alias("geometry" if n == chosen else n) for n in rows.columns if n == chosen or n not in shapes))
    g = F.col("geometry")
    kept = kept.withColumn("geometry", F.when(g["kind"].isin(*kinds), g))
    found = [r.kind for r in kept.where(g.isNotNull()).groupBy(g["kind"].alias("kind")).count().orderBy(F.desc("count"), "kind").collect()]
    if len(found) < 2:
        return kept
    plain = {k.removeprefix("MULTI") for k in found}
    if len(plain) == 1 and f"MULTI{min(plain)}" in kinds:
        one, many = min(plain), f"MULTI{min(plain)}"
        # a line or point has one part of one ring, in its multiple too
        return kept.withColumn("geometry", F.when(g["kind"] == one, g.withField("kind", F.lit(many))).otherwise(g))
    return kept if set(kinds) == set(geometry.KINDS) else kept.withColumn("geometry", F.when(g["kind"] == found[0], g))


def _documents(parts: DataFrame, head: str, between: str, tail: str, path: str) -> None:
    """Write the texts of a one-column table as documents, one for each batch of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                yield pa.RecordBatch.from_arrays([pa.array([head + between.join(batch.column(0).to_pylist()) + tail], pa.large_string())], names=["value"])
        if not some:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.large_string())], names=["value"])

    parts.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def _safe(column: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def _xml_shape(g: Column, prefix: str, ring: Callable[[Column], Column], sides: tuple[str, str], multi: dict[str, tuple[str, str]], attribute: Column | None = None) -> Column:
    """A geometry as an XML element; ``ring`` writes the points of a run."""
    def tag(name: str, body: Column, more: Column | None = None) -> Column:
        start = F.concat(F.lit(f"<{prefix}{name}"), more, F.lit(">")) if more is not None else F.lit(f"<{prefix}{name}>")
        return F.concat(start, body, F.lit(f"</{prefix}{name}>"))

    def polygon(shape: Column, more: Column | None = None) -> Column:
        closed = F.transform(shape, lambda r, i: F.when(i == 0, tag(sides[0], tag("LinearRing", ring(r)))).otherwise(tag(sides[1], tag("LinearRing", ring(r)))))
        return tag("Polygon", F.array_join(closed, ""), more)

    def simple(name: str, run: Column, more: Column | None = None) -> Column:
        return tag(name, ring(run), more)

    def members(kind: str, name: str, each: Callable[[Column], Column]) -> Column:
        outer, member = multi[kind]
        wrapped = F.transform(g["shapes"], lambda s: tag(member, each(s)) if member else each(s))
        return tag(outer, F.array_join(wrapped, ""), attribute)

    first = g["shapes"][0][0]
    return (
        F.when(g["kind"] == "POINT", simple("Point", first, attribute))
        .when(g["kind"] == "LINESTRING", simple("LineString", first, attribute))
        .when(g["kind"] == "LINEARRING", simple("LinearRing", first, attribute))
        .when(g["kind"] == "POLYGON", polygon(g["shapes"][0], attribute))
        .when(g["kind"] == "MULTIPOINT", members("MULTIPOINT", "Point", lambda s: simple("Point", s[0])))
        .when(g["kind"] == "MULTILINESTRING", members("MULTILINESTRING", "LineString", lambda s: simple("LineString", s[0])))
        .otherwise(members("MULTIPOLYGON", "Polygon", polygon))
    )


def as_kml(g: Column) -> Column:
    """A geometry as a KML element; null for null and empty ones."""
    def ring(run: Column) -> Column:
        return F.concat(F.lit("<coordinates>"), F.array_join(F.transform(run, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " "), F.lit("</coordinates>"))

    whole = {k: ("MultiGeometry", "") for k in ("MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")}
    return F.transform(F.array(g), lambda g: F.when(F.size(g["shapes"]) > 0, _xml_shape(g, "", ring, ("outerBoundaryIs", "innerBoundaryIs"), whole)))[0]


def as_gml(g: Column) -> Column:
    """A geometry as a GML 3 element with its reference system; null for null and empty ones."""
    def ring(run: Column) -> Column:
        return F.concat(F.lit('<gml:posList srsDimension="2">'), F.array_join(F.flatten(F.transform(run, lambda p: F.array(p["x"].cast("string"), p["y"].cast("string")))), " "), F.lit("</gml:posList>"))

    whole = {"MULTIPOINT": ("MultiPoint", "pointMember"), "MULTILINESTRING": ("MultiCurve", "curveMember"), "MULTIPOLYGON": ("MultiSurface", "surfaceMember")}

    def text(g: Column) -> Column:
        system = F.when(g["srid"].isNotNull(), F.concat(F.lit(' srsName="EPSG:'), g["srid"].cast("string"), F.lit('"'))).otherwise("")
        return F.when(F.size(g["shapes"]) > 0, _xml_shape(g, "gml:", ring, ("exterior", "interior"), whole, system))

    return F.transform(F.array(g), text)[0]


#: Types of a KML schema's fields.
KML_TYPES = {"int": "int", "smallint": "short", "bigint": "int", "boolean": "bool", "double": "float", "float": "float"}


def write_kml(rows: DataFrame, path: str, name: str = "table") -> None:
    """Documents with one folder, attributes as extended data, geometries in longitude and latitude.

    A geometry without a known reference system is written as it is. Several geometries of
    a row make a collection.
    """
    plain = [(n, kind) for n, kind in rows.dtypes if not geometry.is_geometry(kind)]
    shapes = [F.col(f"`{n}`") for n, kind in rows.dtypes if geometry.is_geometry(kind)]
    data = [
        F.when(F.col(f"`{n}`").isNull(), "").otherwise(F.concat(F.lit(f'<SimpleData name="{_escaped(n)}"><![CDATA['), F.replace(F.col(f"`{n}`").cast("string"), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></SimpleData>")))
        for n, _ in plain
    ]
    texts = [as_kml(F.when(g["srid"].isin(*geometry.PROJECTIONS), geometry.transform(g, 4326)).otherwise(g)) for g in shapes]
    found = F.filter(F.array(*texts), lambda t: t.isNotNull()) if texts else F.array().cast("array<string>")
    shape = F.transform(F.array(found), lambda f: F.when(F.size(f) > 1, F.concat(F.lit("<MultiGeometry>"), F.array_join(f, ""), F.lit("</MultiGeometry>"))).otherwise(F.array_join(f, "")))[0]
    place = F.concat(F.lit(f'<Placemark><ExtendedData><SchemaData schemaUrl="#{_escaped(name)}">'), *data, F.lit("</SchemaData></ExtendedData>"), shape, F.lit("</Placemark>"))
    fields = "".join(f'<SimpleField type="{KML_TYPES.get(kind, "string")}" name="{_escaped(n)}"/>' for n, kind in plain)
    schema = f'<Schema name="{_escaped(name)}" id="{_escaped(name)}">{fields}</Schema>'
    head = f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{_escaped(name)}</name>{schema}<Folder><name>{_escaped(name)}</name>'
    _documents(rows.select(place.alias("value")), head, "\n", "</Folder></Document></kml>", path)


def _element(name: str) -> str:
    """A name that an XML element may have."""
    out = re.sub(r"[^\w.-]", "_", name)
    return out if re.match(r"[^\W\d]", out) else "_" + out


def write_gml(rows: DataFrame, path: str, name: str = "table") -> None:
    """Feature collections; geometries keep their reference system."""
    kind = _element(name)
    parts = []
    for n, of in rows.dtypes:
        column, tag = F.col(f"`{n}`"), _element(n)
        body = as_gml(column) if geometry.is_geometry(of) else _safe(column.cast("string"))
        parts.append(F.when(body.isNotNull(), F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))).otherwise(""))
    member = F.concat(F.lit(f"<gml:featureMember><{kind}>"), *parts, F.lit(f"</{kind}></gml:featureMember>"))
    head = '<?xml version="1.0" encoding="UTF-8"?><wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs" xmlns:gml="http://www.opengis.net/gml">'
    _documents(rows.select(member.alias("value")), head, "\n", "</wfs:FeatureCollection>", path)


def write_geojson(features: DataFrame, path: str) -> None:
    """Feature collections of a one-column table of features."""
    _documents(features, '{"type":"FeatureCollection","features":[', ",\n", "]}", path)
