"""Reading and writing tabular and geographic text files, through Spark's own readers and writers."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import geometry
from weftline.sources import features

#: Separators that a header line is searched for, the most frequent one wins.
SEPARATORS = (";", ",", "\t", "|")


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """The separator of the first line that isn't empty; one line comes to the driver."""
    first = spark.read.text(path).where(F.trim("value") != "").head()
    line = first.value if first else ""
    return max(SEPARATORS, key=line.count)


#: type in a types file -> how a text column becomes it
TYPE_FILE: dict[str, Callable] = {
    "integer": lambda c: c.cast("double").cast("bigint"),
    "real": lambda c: c.cast("double"),
    "string": lambda c: c,
    "date": lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"),
    "time": lambda c: F.try_to_timestamp(c, F.lit("HH:mm:ss")).cast("timestamp_ntz"),
    "datetime": lambda c: F.try_to_timestamp(c).cast("timestamp_ntz"),
}
X_TYPES, Y_TYPES = ("point(x)", "coordx"), ("point(y)", "coordy")


def _beside(spark: SparkSession, path: str, ending: str) -> str | None:
    """The text of the file with another ending beside a file; null if there is none."""
    name = re.sub(r"\.csv$", "", path.rstrip("/"), flags=re.I) + ending
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return "\n".join(r.value for r in spark.read.text(name).collect())


def read_csv(spark: SparkSession, path: str, types: str | None = None, srid: int | None = None) -> DataFrame:
    """A CSV table with a header; ``types``, a line such as ``"Integer","String(20)"``, overrides inference.

    Where they aren't given, types and reference system come from the ``.csvt`` and ``.prj``
    files beside the table, if there are any. A pair of an X and a Y column becomes one
    geometry column, ``Point``.
    """
    types = _beside(spark, path, ".csvt") if types is None else types
    srid = features.prj_srid(_beside(spark, path, ".prj")) if srid is None else srid
    reader = spark.read.option("header", True).option("sep", sniffed_separator(spark, path)).option("encoding", "UTF-8")
    if types is None or not re.fullmatch(r'(\s*"?\w+\s*(\(.*?\))?"?\s*,?)+', types.split("\n")[0]):
        return reader.option("inferSchema", True).csv(path)
    types = types.split("\n")[0]
    rows = reader.csv(path)
    kinds = [t.strip().strip('"').lower() for t in types.split(",")]
    if len(kinds) != len(rows.columns):
        raise ValueError(f"{len(kinds)} types for {len(rows.columns)} columns")
    out, x = [], None
    for name, kind in zip(rows.columns, kinds, strict=True):
        column = F.col(f"`{name}`")
        plain = kind if kind in X_TYPES + Y_TYPES else kind.split("(")[0]
        if plain in X_TYPES:
            x = column
        elif plain in Y_TYPES and x is not None:
            out.append(geometry.from_text(F.concat(F.lit("POINT ("), x, F.lit(" "), column, F.lit(")")), srid).alias("Point"))
        elif plain == "wkt":
            out.append(geometry.from_text(column, srid).alias(name))
        elif plain in TYPE_FILE:
            out.append(TYPE_FILE[plain](column).alias(name))
        else:
            raise ValueError(f"unknown type {kind}")
    return rows.select(*out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A table of a JSON array or of JSON lines, whichever the file has; its first line tells."""
    first = spark.read.text(path).where(F.trim("value") != "").head()
    line = first.value.strip() if first else ""
    return spark.read.option("multiLine", not (line.startswith("{") and line.endswith("}"))).json(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature: its properties, and its geometry in longitude and latitude."""
    shape = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
    found = spark.read.option("multiLine", True).schema(shape).json(path).select(F.explode("features").alias("f"))
    sample = found.select("f.properties").where("properties IS NOT NULL")
    schema = spark.read.json(sample.rdd.map(lambda r: r.properties)).schema
    rows = found.select(F.from_json("f.properties", schema).alias("p"), F.col("f.geometry").alias("g"))
    # coordinate arrays have the nesting of WKT's parentheses
    pair = F.regexp_replace(F.regexp_replace("g.coordinates", r"\s+", ""), r"\[(-?[0-9.eE+-]+),(-?[0-9.eE+-]+)(?:,[^\]]*)?\]", "$1 $2")
    body = F.translate(pair, "[]", "()")
    text = F.concat(F.upper("g.type"), F.when(body.startswith("("), body).otherwise(F.concat(F.lit("("), body, F.lit(")"))))
    return rows.select("p.*", F.when(F.col("g").isNotNull(), geometry.from_text(text, 4326)).alias("geometry"))


def _row_tag(spark: SparkSession, path: str) -> str:
    """The name of the root's first child; the begin of the text is all that is looked at."""
    begin = "\n".join(r.value for r in spark.read.text(path).head(500))
    begin = re.sub(r"<!--.*?-->|<\?.*?\?>|<!.*?>", "", begin, flags=re.S)
    names = re.findall(r"<([^\s/>!?]+)", begin)
    if len(names) < 2:
        raise ValueError(f"{path} has no elements below its root")
    return names[1]


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """A row for each ``row_tag``, or child of the root: attributes as columns, the element's own text as ``text``."""
    row_tag = row_tag or _row_tag(spark, path)
    rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    return rows.select(*(F.col(f"`{c}`").alias("text" if c == "_VALUE" else c.removeprefix("_")) for c in rows.columns))


def as_texts(rows: DataFrame) -> DataFrame:
    """Every column as text, geometries as WKT, for exports."""
    def text(field):
        column = F.col(f"`{field.name}`")
        is_geometry = geometry.is_geometry(field.dataType.simpleString())
        return (geometry.as_text(column) if is_geometry else column.cast("string")).alias(field.name)

    return rows.select(*map(text, rows.schema))


#: The names of types in a types file.
TYPE_NAMES = {"int": "Integer", "bigint": "Integer", "smallint": "Integer", "double": "Real", "float": "Real", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "Date"}


def write_csv(rows: DataFrame, path: str) -> str:
    """CSV with ``;`` and a header, and beside it the files of its types and its reference system; returns the line of types.

    The system is that of the first geometry column, if its geometries have one.
    """
    spark = rows.sparkSession
    as_texts(rows).write.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)
    kinds = ["WKT" if geometry.is_geometry(t) else TYPE_NAMES.get(t, "String") for _, t in rows.dtypes]
    line = ",".join(f'"{k}"' for k in kinds)
    stem = re.sub(r"\.csv$", "", path.rstrip("/"), flags=re.I)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(stem + ".csvt")
    shapes = [n for n, t in rows.dtypes if geometry.is_geometry(t)]
    srid = rows.agg(F.max(f"`{shapes[0]}`.srid")).first()[0] if shapes else None
    if srid is not None:
        spark.createDataFrame([(f'LOCAL_CS["EPSG {srid}",AUTHORITY["EPSG","{srid}"]]',)], "value string").coalesce(1).write.text(stem + ".prj")
    return line


def write_json(rows: DataFrame, path: str) -> None:
    as_texts(rows).write.json(path)


def geojson_features(rows: DataFrame, column: str = "geometry") -> DataFrame:
    """A text column, ``value``, with a GeoJSON feature for each row; other columns are its properties, as text."""
    others = [c for c in rows.columns if c != column]
    as_text = (F.col(f"`{c}`").cast("string").alias(c) for c in others)
    properties = F.to_json(F.struct(*as_text), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    shape = F.coalesce(geometry.as_geojson(F.col(f"`{column}`")), F.lit("null"))
    return rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write_geojson(rows: DataFrame, path: str) -> None:
    """Feature collections of the one geometry column that the format takes; records where there is none."""
    if not any(geometry.is_geometry(t) for _, t in rows.dtypes):
        return write_json(rows, path)
    return features.write_geojson(geojson_features(features.single_geometry(rows)), path)


def write_xml(rows: DataFrame, path: str) -> None:
    """``<root><row a="..."/></root>``; attribute names without characters that aren't word characters."""
    text = as_texts(rows)
    names = [F.col(f"`{c}`").alias("_" + "".join(x for x in c if x.isalnum() or x == "_")) for c in text.columns]
    text.select(*names).write.format("xml").option("rootTag", "root").option("rowTag", "row").save(path)


def column_profile(rows: DataFrame) -> DataFrame:
    """Rows (column, type, max_length, low, high, has_nulls): the bounds that a derived schema states, in one pass."""
    sums = []
    for i, (name, kind) in enumerate(rows.dtypes):
        column = F.col(f"`{name}`")
        numeric = kind in ("int", "bigint", "smallint", "double", "float")
        sums += [
            (F.max(F.length(column)) if kind == "string" else F.lit(None)).cast("bigint").alias(f"l{i}"),
            (F.min(column) if numeric else F.lit(None)).cast("double").alias(f"a{i}"),
            (F.max(column) if numeric else F.lit(None)).cast("double").alias(f"b{i}"),
            F.coalesce(F.bool_or(column.isNull()), F.lit(False)).alias(f"n{i}"),
        ]
    wide = rows.agg(*sums)
    each = [
        F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(f"l{i}").alias("max_length"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"), F.col(f"n{i}").alias("has_nulls"))
        for i, (n, t) in enumerate(rows.dtypes)
    ]
    return wide.select(F.inline(F.array(*each)))


def geometry_profile(rows: DataFrame) -> DataFrame:
    """Rows (column, kind, west, south, east, north): the most frequent kind and the bounds of each geometry column, in one pass."""
    names = [n for n, t in rows.dtypes if geometry.is_geometry(t)]
    sums = []
    for i, name in enumerate(names):
        points = F.flatten(F.flatten(F.col(f"`{name}`.shapes")))
        for axis in ("x", "y"):
            along = F.transform(points, itemgetter(axis))
            sums += [F.min(F.array_min(along)).alias(f"a{axis}{i}"), F.max(F.array_max(along)).alias(f"b{axis}{i}")]
        sums.append(F.mode(F.col(f"`{name}`.kind"), True).alias(f"k{i}"))
    each = [
        F.struct(F.lit(n).alias("column"), F.col(f"k{i}").alias("kind"), *(F.col(f"{c}{i}").alias(of) for c, of in (("ax", "west"), ("ay", "south"), ("bx", "east"), ("by", "north"))))
        for i, n in enumerate(names)
    ]
    return rows.agg(*sums).select(F.inline(F.array(*each)))


def _nines(x: float) -> int:
    """The next number of nines only."""
    return 10 ** (int(math.floor(math.log10(x))) + 1) - 1


def model_name(name: str) -> str:
    """A name of letters, digits and underscores, words with capitals."""
    return "".join(w.capitalize() for w in re.sub(r"[^A-Za-z0-9_\s]", "", name).split())


def interlis_model(name: str, tables: dict[str, DataFrame]) -> str:
    """The text of an INTERLIS 1 model that the tables' bounds call for; one or two aggregates a table reach the driver."""
    domain: dict[str, str] = {}
    blocks = []
    for table, rows in tables.items():
        shapes = {r["column"]: r for r in geometry_profile(rows).collect()} if any(geometry.is_geometry(t) for _, t in rows.dtypes) else {}
        fields = []
        for r in column_profile(rows).collect():
            low, high = r.low if r.low and r.low < 0 else None, r.high if r.high and r.high > 0 else None
            kind = "!! Unbekannter Typ"
            if r.type == "string":
                kind = f"TEXT*{r.max_length or 10}"
            elif r.type in ("int", "bigint", "smallint"):
                kind = f"[{-_nines(-low) if low else 0} .. {_nines(high) if high else 0}]"
            elif r.type in ("double", "float"):
                kind = f"[0.000 .. {_nines(high) if high else 0}.999]"
            elif r.type == "boolean":
                kind, domain["BOOLEAN"] = "BOOLEAN", "(True, False)"
            elif r.type in ("timestamp", "timestamp_ntz", "date"):
                kind = "DATE"
            elif (g := shapes.get(r["column"])) and g.kind:
                bounds = " ".join(f"{v:.3f}" for v in (g.west, g.south, g.east, g.north))
                vertex = f"WITH (STRAIGHTS) VERTEX COORD2 {bounds} WITHOUT OVERLAPS > 0.001"
                if g.kind == "POINT":
                    kind, domain["POINT"] = "POINT", f"COORD2 {bounds}"
                else:
                    kind = {"LINESTRING": f"POLYLINE {vertex}", "LINEARRING": f"POLYLINE {vertex}", "POLYGON": f"AREA {vertex}"}.get(g.kind, "!! Geometrie-Feld")
            fields.append(f"\t\t{model_name(r['column'])}: {'OPTIONAL ' if r.has_nulls else ''}{kind};\n")
        blocks.append(f"\tTABLE {model_name(table)} = \n{''.join(fields)}\tNO IDENT\n\tEND {model_name(table)};\n")
    own = model_name(name)
    domains = "DOMAIN\n\n" + "".join(f"\t{k} = {v};\n" for k, v in domain.items()) if domain else ""
    return (
        f"TRANSFER {own}; \n\n!! Derived from the data; to be corrected by hand.\n\n{domains}\nMODEL {own}\n\nTOPIC {own} = \n\n{''.join(blocks)}\nEND {own}.\n\nEND {own}.\n\n"
        "FORMAT FREE;\n\n\nCODE\n\tBLANK = DEFAULT, UNDEFINED = DEFAULT, CONTINUE = DEFAULT;\n\t TID = ANY;\n\nEND."
    )
