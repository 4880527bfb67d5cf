"""Formats by name: which one a file has, reading it, writing a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import features, files


class FormatError(ValueError):
    """A file that no reader takes, or a table that no writer takes."""


@dataclass(frozen=True)
class Format:
    """A format's endings, and its reader and writer, if it has one."""

    endings: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame] | None = None
    write: Callable[[DataFrame, str], object] | None = None


#: In the order in which they are tried.
FORMATS: dict[str, Format] = {
    "csv": Format(("csv",), files.read_csv, files.write_csv),
    "geojson": Format(("geojson",), files.read_geojson, files.write_geojson),
    "json": Format(("json",), files.read_json, files.write_json),
    "kml": Format(("kml",), features.read_kml, features.write_kml),
    "gml": Format(("gml",), features.read_gml, features.write_gml),
    "xml": Format(("xml",), files.read_xml, files.write_xml),
    "shapefile": Format(("shp",), lambda spark, path: features.read_shapefile(spark, path[:-4] + ".{shp,dbf,prj}")),
}
OTHER = "other"


def register(name: str, made: Format) -> None:
    """Add a format, or replace one."""
    FORMATS[name.lower()] = made


def identify(spark: SparkSession, path: str) -> str:
    """The name of a file's format, by its ending; a JSON file with a geometry is GeoJSON. Other files are ``other``."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending == "json" and spark.read.text(path).where(F.col("value").contains('"geometry"')).head(1):
        return "geojson"
    return next((name for name, made in FORMATS.items() if ending in made.endings), OTHER)


def named(name: str) -> Format:
    """A format by its name, in any case."""
    if name.lower() not in FORMATS:
        raise FormatError(f"unknown format {name}")
    return FORMATS[name.lower()]


def read(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A file as a table, by its own format or the one that is named."""
    made = FORMATS.get((name or identify(spark, path)).lower())
    if made is None or made.read is None:
        raise FormatError(f"no reader for {path}")
    return made.read(spark, path)


def write(rows: DataFrame, path: str, name: str) -> None:
    """A table as files of a format."""
    made = named(name)
    if made.write is None:
        raise FormatError(f"no writer for {name}")
    made.write(rows, path)
