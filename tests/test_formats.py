import json
import struct

import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry as geo
from weftline.operators import packages
from weftline.sources import features, files, formats

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>d</name>
<Folder><name>one</name>
<Placemark><name>a &amp; b</name><description><![CDATA[<b>x</b>]]></description><ExtendedData><SchemaData schemaUrl="#s"><SimpleData name="n">3</SimpleData></SchemaData></ExtendedData>
<MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,1 0,4,1 4,4,1 0,0,1</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,1 1,2 2,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon><Point><coordinates>7,8</coordinates></Point></MultiGeometry></Placemark>
<Placemark><ExtendedData><Data name="n"><value>4</value></Data></ExtendedData><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark>
</Folder><Folder><name>two</name><Placemark><name>p</name><LineString><coordinates>0,0 1,1</coordinates></LineString></Placemark><Placemark><name>q</name></Placemark></Folder></Document></kml>"""


def texts(rows, *columns):
    return rows.select(*(geo.as_text(F.col(c)).alias(c) if geo.is_geometry(dict(rows.dtypes)[c]) else c for c in columns)).collect()


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    path = str(tmp_path / "a.kml")
    assert features.folders(features.kml_features(spark, path)) == ["one", "two"]
    one = features.read_kml(spark, path, "one")
    assert one.columns == [*features.KML_ATTRIBUTES, "n", "geometry", "geometry2"] and dict(one.dtypes)["n"] == "bigint"
    got = sorted(texts(one, "n", "name", "description", "geometry", "geometry2"))
    assert tuple(got[0]) == (3, "a & b", "<b>x</b>", "POLYGON ((0 0, 0 4, 4 4, 0 0), (1 1, 1 2, 2 2, 1 1))", "POINT (7 8)")
    assert tuple(got[1]) == (4, None, None, "MULTIPOINT (1 2, 3 4)", None)
    assert sorted(texts(features.read_kml(spark, path, "two"), "name", "geometry")) == [("p", "LINESTRING (0 0, 1 1)"), ("q", None)]


def test_gml(spark, tmp_path):
    member = "<gml:featureMember><x:road><x:name>a&lt;b</x:name><x:km>1.5</x:km><x:shape>{}</x:shape></x:road></gml:featureMember>"
    shapes = [
        '<gml:Polygon srsName="urn:ogc:def:crs:EPSG::3857"><gml:exterior><gml:LinearRing><gml:posList srsDimension="3">0 0 9 0 4 9 4 4 9 0 0 9</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>',
        "<gml:MultiCurve><gml:curveMember><gml:LineString><gml:pos>0 0</gml:pos><gml:pos>2 2</gml:pos></gml:LineString></gml:curveMember></gml:MultiCurve>",
    ]
    text = '<c xmlns:gml="http://www.opengis.net/gml" xmlns:x="u"><gml:boundedBy><gml:Envelope srsName="EPSG:4326"/></gml:boundedBy>' + "".join(map(member.format, shapes)) + "</c>"
    (tmp_path / "a.gml").write_text(text)
    rows = features.as_table(features.gml_features(spark, str(tmp_path / "a.gml")))
    assert sorted(texts(rows, "geometry")) == [("MULTILINESTRING ((0 0, 2 2))",), ("POLYGON ((0 0, 0 4, 4 4, 0 0))",)]
    assert {(r.name, r.km, r.geometry.srid) for r in rows.collect()} == {("a<b", 1.5, 3857), ("a<b", 1.5, 4326)}
    assert {r.geometry.srid for r in features.read_gml(spark, str(tmp_path / "a.gml")).collect()} == {4326}


def shapefile(folder, shapes, names):
    """A shapefile of (kind, body) records with a text column and a number."""
    records = b"".join(struct.pack(">2i", i + 1, len(body) // 2 + 2) + struct.pack("<i", kind) + body for i, (kind, body) in enumerate(shapes))
    (folder / "s.shp").write_bytes(struct.pack(">i20xi", 9994, (100 + len(records)) // 2) + b"\0" * 72 + records)
    fields = [(b"NAME", b"C", 12), (b"KM", b"N", 8)]
    head = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, k, w in fields) + b"\r"
    rows = b"".join(b" " + n.encode("latin-1").ljust(12) + str(i / 2).rjust(8).encode() for i, n in enumerate(names))
    (folder / "s.dbf").write_bytes(b"\x03" + b"\0" * 3 + struct.pack("<IHH", len(names), 32 + len(head), 21) + b"\0" * 20 + head + rows)
    (folder / "s.prj").write_text('PROJCS["CH1903_LV03",GEOGCS["GCS_CH1903"]]')


def test_shapefile(spark, tmp_path):
    def parts(*runs):
        starts = [sum(map(len, runs[:i])) for i in range(len(runs))]
        points = [v for r in runs for p in r for v in p]
        return struct.pack(f"<4d2i{len(runs)}i{len(points)}d", 0, 0, 0, 0, len(runs), len(points) // 2, *starts, *points)

    outer, hole, other = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 0), (20, 1), (21, 1), (20, 0)]
    shapes = [(1, struct.pack("<2d", 1.5, 2)), (3, parts([(0, 0), (1, 1)])), (5, parts(outer, other, hole)), (0, b""), (8, struct.pack("<4di4d", 0, 0, 0, 0, 2, 1, 2, 3, 4)), (15, parts(outer))]
    shapefile(tmp_path, shapes, ["é", "b", "c", "d", "", "f"])
    rows = features.read_shapefile(spark, str(tmp_path))
    got = {r.KM: (r.NAME, r.geometry) for r in texts(rows, "KM", "NAME", "geometry")}
    assert got == {
        0.0: ("é", "POINT (1.5 2)"), 0.5: ("b", "LINESTRING (0 0, 1 1)"), 1.0: ("c", "MULTIPOLYGON (((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 2 1, 2 2, 1 1)), ((20 0, 20 1, 21 1, 20 0)))"),
        1.5: ("d", None), 2.0: (None, "MULTIPOINT (1 2, 3 4)"), 2.5: ("f", "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0))"),
    }
    assert {r.srid for r in rows.select("geometry.srid").collect()} == {21781, None}
    assert formats.read(spark, str(tmp_path / "s.shp")).count() == 6


@pytest.mark.parametrize("name", ["kml", "gml", "geojson"])
def test_written_documents(spark, tmp_path, name):
    """Every kind of geometry, odd texts and nulls, through a format; each document can be parsed by itself."""
    wkts = ["POINT (1 2)", "LINESTRING (0 0, 3 4)", "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5)))", None, "POINT EMPTY"]
    rows = spark.createDataFrame([(i, w, f"<{i}> & ]]> \"é\"" if i else None) for i, w in enumerate(wkts)], "i long, w string, t string").repartition(2)
    rows = rows.select("i", "t", geo.from_text(F.col("w"), 4326).alias("geometry"))
    if name == "geojson":
        rows = rows.where("i <> 7")
        features.write_geojson(files.geojson_features(rows), str(tmp_path / "o"))
        for f in (tmp_path / "o").glob("*.txt"):
            assert json.loads(f.read_text())["type"] == "FeatureCollection"
    else:
        formats.write(rows, str(tmp_path / "o"), name)
    back = formats.read(spark, str(tmp_path / "o"), name)
    got = {int(r.i): (r.t, r.geometry) for r in texts(back, "i", "t", "geometry")}
    assert got == {i: (f"<{i}> & ]]> \"é\"" if i else None, None if w == "POINT EMPTY" else w) for i, w in enumerate(wkts) if not (name == "geojson" and i == 7)}


def test_single_geometry(spark):
    rows = spark.createDataFrame([(1, "POINT (1 2)"), (2, "POINT (3 4)"), (3, "MULTIPOINT (5 6)")], "i int, w string")
    rows = rows.select("i", geo.from_text(F.col("w"), 4326).alias("a"), geo.from_text(F.lit("POINT (0 0)")).alias("b"))
    out = features.single_geometry(rows)
    assert out.columns == ["i", "geometry"] and {r.geometry for r in texts(out, "geometry")} == {"MULTIPOINT (1 2)", "MULTIPOINT (3 4)", "MULTIPOINT (5 6)"}
    only = features.single_geometry(rows, ("POINT", "LINESTRING"))
    assert [r.geometry for r in sorted(texts(only, "i", "geometry"))] == ["POINT (1 2)", "POINT (3 4)", None]
    mixed = rows.select(F.when(F.col("i") == 1, geo.from_text(F.lit("LINESTRING (0 0, 1 1)"))).otherwise(F.col("b")).alias("geometry"))
    assert sorted(map(str, texts(features.single_geometry(mixed, ("POINT", "LINESTRING")), "geometry"))) == ["Row(geometry='POINT (0 0)')"] * 2 + ["Row(geometry=None)"]
    assert features.single_geometry(rows.select("i")).columns == ["i"]


def test_csv_sidecars(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,x,y,n\n01,2.5,47,7\n")
    (tmp_path / "t.csvt").write_text('"String(5)","Point(X)","Point(Y)",Integer')
    (tmp_path / "t.prj").write_text('GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]')
    rows = formats.read(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in texts(rows, "a", "Point", "n")] == [("01", "POINT (2.5 47)", 7)] and rows.first().Point.srid == 4326
    files.write_csv(rows, str(tmp_path / "o.csv"))
    back = files.read_csv(spark, str(tmp_path / "o.csv"))
    assert back.dtypes == rows.dtypes and texts(back, *back.columns) == texts(rows, *rows.columns) and back.first().Point.srid == 4326


def test_identification(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": null, "properties": {"n": 1}}]}')
    (tmp_path / "b.json").write_text('[{"n": 1}, {"n": 2}]')
    (tmp_path / "c.json").write_text('{"n": 1}\n{"n": 2}\n')
    assert [formats.identify(spark, str(tmp_path / f)) for f in ("a.json", "b.json")] == ["geojson", "json"]
    assert [formats.identify(spark, f) for f in ("x.CSV", "x.kml", "x.gml", "x.shp", "x.xml", "x.doc")] == ["csv", "kml", "gml", "shapefile", "xml", "other"]
    assert [formats.read(spark, str(tmp_path / f)).count() for f in ("a.json", "b.json", "c.json")] == [1, 2, 2]
    assert formats.named("CSV") is formats.FORMATS["csv"]
    for wrong in (lambda: formats.read(spark, "x.doc"), lambda: formats.named("doc"), lambda: formats.write(spark.range(1), "x", "shapefile")):
        with pytest.raises(formats.FormatError):
            wrong()
    formats.register("upper", formats.Format(("up",), lambda s, p: s.range(3)))
    assert formats.read(spark, "x.up").count() == 3
    del formats.FORMATS["upper"]


def test_xml_rows_are_the_roots_children(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<!-- <no> -->\n<trucks>\n <truck p="1" x="2">one</truck>\n <truck p="3" x="4">two</truck>\n</trucks>')
    assert sorted(tuple(r) for r in formats.read(spark, str(tmp_path / "a.xml")).select("p", "x", "text").collect()) == [(1, 2, "one"), (3, 4, "two")]


def test_model(spark):
    rows = spark.createDataFrame([(5, "ab", -17, 1.5, True), (None, "abcd", 1234, 99.0, False)], "i long, t string, n int, f double, b boolean")
    rows = rows.withColumn("at", geo.from_text(F.lit("POINT (7 47.5)"), 4326)).withColumn("d", F.lit("2020-01-01").cast("date"))
    text = files.interlis_model("my model!", {"a table": rows})
    for line in ("TRANSFER MyModel;", "POINT = COORD2 7.000 47.500 7.000 47.500;", "BOOLEAN = (True, False);", "TABLE ATable =", "I: OPTIONAL [0 .. 9];", "T: TEXT*4;", "N: [-99 .. 9999];", "F: [0.000 .. 99.999];", "At: POINT;", "D: DATE;"):
        assert line in text, line
    assert "AREA WITH (STRAIGHTS)" in files.interlis_model("m", {"t": rows.select(geo.from_text(F.lit("POLYGON ((0 0, 0 1, 1 1, 0 0))")).alias("p"))})


def test_packages(spark):
    rows = spark.createDataFrame([(1, "Roads", "all", 1, True), (2, "rivers", "ROADS too", 2, False), (3, "b", None, 2, True), (4, None, "x", 2, False)], "id long, name string, description string, owner long, private boolean")
    ids = lambda **k: [r.id for r in packages.search(rows, 1, **k).collect()]
    assert ids() == [1, 2, 4] and ids(text="road") == [1, 2] and ids(name="road") == [1] and ids(description="road") == [2] and ids(mine_only=True) == [1]
    assert ids(sort=("name", False)) == [2, 1, 4] and ids(page=2) == []
    uses = spark.createDataFrame([(10, 1), (11, 10), (12, 11), (11, 12), (13, 2)], "user long, used long")
    assert sorted(r.id for r in packages.dependants(uses, spark.createDataFrame([(1,)], "id long")).collect()) == [10, 11, 12]
    assert sorted(r.id for r in packages.sources_of(uses, 12).collect()) == [1, 10, 11, 12]
    seconds = spark.createDataFrame([(1, 600), (2, 60)], "id long, seconds int")
    assert packages.least_refresh(uses, seconds, 12) == 600 and packages.least_refresh(uses, seconds, 1000) is None
