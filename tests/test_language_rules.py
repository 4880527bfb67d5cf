import json
import time

import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry as geo
from weftline.functions import misc, text
from weftline.operators import relational as rel
from weftline.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_predicates_are_two_valued(spark):
    null = F.lit(None).cast("int")
    kept = lambda x: spark.range(1).where(x).count() == 1
    assert [kept(x) for x in (rel.equal(null, null), rel.not_equal(null, F.lit(1)), rel.compare(null, "<", F.lit(1)), rel.in_list(null, F.lit(1)), rel.not_in_list(null, F.lit(1)), rel.holds(null == 1), rel.holds(null == 1, True))] == [False, True, False, False, True, False, True]
    assert not kept(rel.like(F.lit(None).cast("string"), "a", True))


def test_errors_come_before_jobs(spark):
    rows = spark.range(2).selectExpr("id", "'x' AS s")
    for broken in (lambda: rel.union_all(rows.select("id"), rows.select("s")), lambda: rel.order_by(rows, (3, True)), lambda: rel.order_by(rows, ("nope", True)), lambda: rel.join(rows, rows, [], "inner"), lambda: rel.case(rows, [(F.lit(True), F.lit(1)), (F.lit(True), F.lit("x"))]), lambda: text.extract(F.lit("a"), "a"), lambda: text.substring(F.lit("a"), 0), lambda: misc.cast(F.lit("a"), rows.schema["s"].dataType, "DATETIME"), lambda: geo.set_srid(F.lit(1), 99)):
        with pytest.raises(ValueError):
            broken()


def test_nulls_sort_last(spark):
    rows = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert [r.a for r in rel.order_by(rows, (1, True)).collect()] == [1, 3, None]
    assert [r.a for r in rel.order_by(rows, ("A", False)).collect()] == [3, 1, None]


def test_text(spark):
    assert [one(spark, text.pad(F.lit(s), w, "both")) for s, w in (("ab", 5), ("abc", 6), ("abc", 2))] == ["ab".center(5), "abc".center(6), "abc"]
    assert one(spark, text.trim(F.lit("  a b\t\n"))) == "a b"
    assert one(spark, text.extract(F.lit("abc"), "(x)")) is None and one(spark, text.get(F.lit("abc"), 5)) is None
    assert one(spark, text.replace(F.lit("a-b"), r"(\w)-(\w)", r"\2$\1")) == "b$a"
    assert one(spark, misc.cast(F.lit("3.141"), spark.range(1).selectExpr("'a' s").schema["s"].dataType, "INTEGER")) == 3
    assert one(spark, text.to_char(F.lit("2015-02-01").cast("timestamp"), "am %d.%m.%y")) == "am 01.02.15"


@pytest.mark.parametrize("wkt", ["POINT (1 2)", "LINESTRING (0 0, 3 4)", "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5), (5.2 5.5, 5.2 5.6, 5.3 5.6, 5.2 5.5)))"])
def test_geometry_texts(spark, wkt):
    assert one(spark, geo.as_text(geo.from_text(F.lit(wkt.lower())))) == wkt


def test_geometry_measures(spark):
    poly = geo.from_text(F.lit("MULTIPOLYGON (((0 0, 0 2, 2 2, 2 0, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))"), 2056)
    assert one(spark, geo.area(poly)) == 8 and one(spark, geo.as_text(geo.centroid(poly))) == "POINT (6 1)"
    assert one(spark, geo.as_text(geo.centroid(geo.from_text(F.lit("LINESTRING (0 0, 4 0)"))))) == "POINT (2 0)"
    bern = geo.transform(geo.from_text(F.lit("POINT (7.438632 46.951083)"), 4326), 2056)
    assert abs(one(spark, geo.x(bern)) - 2600000) < 5 and abs(one(spark, geo.y(bern)) - 1200000) < 5
    back = geo.transform(geo.transform(bern, 21781), 4326)
    assert abs(one(spark, geo.x(back)) - 7.438632) < 1e-4
    with pytest.raises(Exception, match="reference system"):
        one(spark, geo.x(geo.transform(geo.from_text(F.lit("POINT (1 1)")), 4326)))
    with pytest.raises(Exception, match="not a geometry"):
        one(spark, geo.from_text(F.lit("POINT 1 1")))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\nid;x;y;d\n1;2.5;3;2015-02-01\n2;4;5;no\n")
    path = str(tmp_path / "a.csv")
    assert files.sniffed_separator(spark, path) == ";"
    rows = files.read_csv(spark, path, '"Integer","Point(x)","Point(y)","Date"', 4326)
    assert rows.columns == ["id", "Point", "d"]
    got = rows.select("id", geo.as_text(F.col("Point")).alias("p"), "d").collect()
    assert [(r.id, r.p, r.d is None) for r in got] == [(1, "POINT (2.5 3)", False), (2, "POINT (4 5)", True)]
    assert files.write_csv(rows, str(tmp_path / "out")) == '"Integer","WKT","DateTime"'
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 2
    files.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().Point.startswith("POINT")
    files.write_xml(spark.range(2).selectExpr("id AS `a b`"), str(tmp_path / "xml"))
    assert sorted(r.ab for r in files.read_xml(spark, str(tmp_path / "xml"), "row").collect()) == [0, 1]
    features = [{"type": "Feature", "properties": {"n": i}, "geometry": g} for i, g in enumerate([{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}, None])]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = files.read_geojson(spark, str(tmp_path / "f.geojson")).select("n", geo.as_text(F.col("geometry")).alias("w")).collect()
    assert [r.w for r in sorted(got)] == ["POINT (1 2)", "POLYGON ((0 0, 0 1, 1 1, 0 0))", None]
    again = files.geojson_features(files.read_geojson(spark, str(tmp_path / "f.geojson"))).collect()
    again = [json.loads(r.value) for r in again]
    assert [f["geometry"] for f in sorted(again, key=lambda f: f["properties"]["n"])] == [f["geometry"] for f in features]


@pytest.mark.parametrize(("wkt", "coordinates"), [("MULTIPOINT (1 2, 3 4)", [[1, 2], [3, 4]]), ("MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]), ("MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)))", [[[[0, 0], [0, 1], [1, 1], [0, 0]]]])])
def test_geojson(spark, wkt, coordinates):
    got = json.loads(one(spark, geo.as_geojson(geo.from_text(F.lit(wkt)))))
    assert got["coordinates"] == coordinates and got["type"].upper() == wkt.split()[0]


def test_numbers_follow_the_order(spark):
    """Skewed, repeated and null keys, over several partitions, and columns of the names that numbering uses."""
    rows = spark.range(0, 5000, 1, 7).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id % 1000 END AS k", "id AS place", "1 AS part", "2 AS before")
    got = misc.with_range(rows, "n", [F.col("k").asc_nulls_last(), F.col("place").desc()], 10, 5).collect()
    want = sorted((r.k is None, r.k or 0, -r.place) for r in rows.collect())
    assert [(r.k is None, r.k or 0, -r.place) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == [10 + 5 * i for i in range(5000)]
    assert misc.with_range(rows.where("false"), "n", ["k"]).count() == 0


def test_chained_transforms_are_short(spark):
    """Four reference systems in a row, in a second or two once Spark is warm."""
    g = geo.from_text(F.lit("POINT (7.5 47)"), 4326)
    one(spark, geo.x(geo.transform(g, 3857)))
    began = time.time()
    for srid in (2056, 3857, 21781, 3395, 4326):
        g = geo.transform(g, srid)
    assert abs(one(spark, geo.x(g)) - 7.5) < 1e-3 and time.time() - began < 15


@pytest.mark.parametrize("wkt", ["POINT 1 1", "POINT (1)", "POINT (1 1, 2 2)", "POINT (1.2.3 1)", "POLYGON (0 0, 1 1)", "LINESTRING ((0 0, 1 1))", "MULTIPOLYGON ((0 0, 0 1, 1 1, 0 0))", "POLYGON ((0 0, 0 1), 1 1)", "CIRCLE (1 1)", ""])
def test_wrong_geometry_texts(spark, wkt):
    with pytest.raises(Exception, match="not a geometry"):
        one(spark, geo.as_text(geo.from_text(F.lit(wkt))))


@pytest.mark.parametrize(("wkt", "text"), [("POINT Z (1 2 3)", "POINT (1 2)"), ("polygon empty", "POLYGON EMPTY"), ("MULTIPOINT ((1 2), (3 4))", "MULTIPOINT (1 2, 3 4)"), ("LINEARRING (0 0, 1 0, 1 1, 0 0)", "LINEARRING (0 0, 1 0, 1 1, 0 0)"), ("POINT(1e3 -.5)", "POINT (1000 -0.5)")])
def test_odd_geometry_texts(spark, wkt, text):
    assert one(spark, geo.as_text(geo.from_text(F.lit(wkt)))) == text


def test_union_of_geometries(spark):
    a = spark.createDataFrame([("POINT (1 2)",)], "w string").select(geo.from_text(F.col("w"), 4326).alias("g"))
    b = spark.createDataFrame([("POINT (222638.98 111325.14)",), (None,)], "w string").select(geo.from_text(F.col("w"), 3857).alias("h"))
    got = [r.t for r in rel.union_all(a, b, a).select(geo.as_text(geo.transform(F.col("g"), 4326)).alias("t")).collect()]
    assert got[0] == got[3] == "POINT (1 2)" and got[1].startswith("POINT (1.99999") and got[2] is None
    for wrong in (a.select(geo.from_text(F.lit("POINT (1 1)")).alias("g")), a.union(b.limit(1))):
        with pytest.raises(rel.QueryError):
            rel.union_all(wrong, b)


@pytest.mark.parametrize("task_rows", [50, 10_000, 1 << 23])
def test_join_of_repeated_keys(spark, monkeypatch, task_rows):
    """Against loops: keys of many rows, null keys, copies of whole rows, keys of one side; columns keep their order."""
    monkeypatch.setattr(rel, "TASK_ROWS", task_rows)
    a = [(i % 3 if i % 7 else None, "xy"[i % 2], i // 2) for i in range(300)] + [(9, "x", 1), (5, None, 2)]
    b = [(i % 4 if i % 5 else None, "xyz"[i % 3], i // 3) for i in range(80)] + [(5, None, 3), (5, None, 3)]
    left, right = spark.createDataFrame(a, "k int, s string, v int"), spark.createDataFrame(b, "l int, t string, w int")
    got = rel.join_repeated(left, right, [(F.col("k"), F.col("l")), (F.upper("s"), F.upper("t"))])
    assert got.columns == ["k", "s", "v", "l", "t", "w"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(x + y) for x in a for y in b if x[:2] == y[:2])
    assert rel.join_repeated(left, right.where("false"), [(F.col("k"), F.col("l"))]).count() == 0


def test_tasks_follow_the_rows_of_a_join(spark, monkeypatch):
    """The registered join of many rows a key is shared by many tasks, also if there is one key."""
    from weftline.plans import catalogue

    monkeypatch.setattr(rel, "TASK_ROWS", 1000, raising=False)
    data = "/root/testdata/sf0.01"
    got = catalogue.QUERIES["join_multi_cond"](spark, data)
    assert got.groupBy(F.spark_partition_id()).count().count() == 1 and got.count() > 0  # of under TASK_ROWS rows
    monkeypatch.setattr(text, "get", lambda column, at: F.lit("x"))
    got = catalogue.QUERIES["join_multi_cond"](spark, data)
    made = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) > 5000 and max(made) < 2500
    one = spark.range(400).selectExpr("id AS a", "1 AS k"), spark.range(300).selectExpr("id AS b", "1 AS l")
    made = [r["count"] for r in rel.join_repeated(*one, [(F.col("k"), F.col("l"))]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 120_000 and max(made) < 8000
