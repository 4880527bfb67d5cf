"""The registered queries over the operators of this package, with equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import geometry as geo
from weftline.functions import misc, text
from weftline.operators import packages
from weftline.operators import relational as rel
from weftline.sources import features, files, formats
from weftline.stored import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def _query(sql: str | None = None):
    def register(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[build.__name__] = run
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


def _simple(name: str, source: str, columns: Callable[[], list], sql_columns: str, where: Callable | None = None, sql_where: str = "") -> None:
    """A projection, and perhaps a filter, of one table."""
    def build(t) -> DataFrame:
        rows = t(source)
        rows = rows.where(where()) if where else rows
        return rel.project(rows, *columns())

    build.__name__ = name
    _query(f"SELECT {sql_columns} FROM {source}{' WHERE ' + sql_where if sql_where else ''}")(build)


LABELLED = "documents LEFT JOIN labels l ON documents.doc_id IS NOT DISTINCT FROM l.doc_id"


def _labelled(t) -> DataFrame:
    d, l = rel.prefixed(t("documents").select("doc_id", "lang", "source"), "d"), rel.prefixed(t("labels"), "l")
    return rel.join(d, l, [(c("d__doc_id"), c("l__doc_id"))], "left")


def _over_labelled(name: str, condition: Callable, sql: str) -> None:
    def build(t) -> DataFrame:
        return _labelled(t).where(condition()).select(c("d__doc_id").alias("doc_id"))

    build.__name__ = name
    _query(f"SELECT documents.doc_id FROM {LABELLED} WHERE {sql}")(build)


@_query("""SELECT o_orderkey AS id, c_name AS customer, n_name AS nation, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('O', 'F') AND regexp_matches(n_name, '^[A-N].*[02468]$')""")
def flagship_order_report(t):
    rows = rel.join(t("orders"), t("customer"), [(c("o_custkey"), c("c_custkey"))])
    rows = rel.join(rows, t("nation"), [(c("c_nationkey"), c("n_nationkey"))])
    rows = rows.where(rel.in_list(c("o_orderstatus"), F.lit("O"), F.lit("F")) & rel.like(c("n_name"), "^[A-N].*[02468]$"))
    size = rel.case(rows, [(rel.compare(c("o_totalprice"), ">", F.lit(200000)), F.lit("large")), (rel.compare(c("o_totalprice"), ">", F.lit(100000)), F.lit("medium"))], F.lit("small"))
    return rel.order_by(rel.project(rows, ("id", c("o_orderkey")), ("customer", c("c_name")), ("nation", c("n_name")), ("size", size)), ("nation", True), (1, False))


_simple("project_alias", "customer", lambda: [("key", c("c_custkey")), ("name", c("c_name"))], "c_custkey AS key, c_name AS name")
_simple("project_literals", "region", lambda: [("key", c("r_regionkey")), ("i", F.lit(42).cast("bigint")), ("f", F.lit(-1.5)), ("b", F.lit(True)), ("t", F.lit("x")), ("n", F.lit(None).cast("string"))], "r_regionkey AS key, 42::BIGINT AS i, -1.5::DOUBLE AS f, true AS b, 'x' AS t, NULL::VARCHAR AS n")
_simple("dup_names", "customer", lambda: [("a", c("c_custkey")), ("a", c("c_name")), ("A", c("c_nationkey"))], 'c_custkey AS a, c_name AS a2, c_nationkey AS "A3"')
_simple("where_cmp", "lineitem", lambda: [("k", c("l_orderkey")), ("q", c("l_quantity"))], "l_orderkey AS k, l_quantity AS q", lambda: rel.compare(c("l_quantity"), "<=", F.lit(10)) & rel.compare(c("l_discount"), ">", F.lit(0.05)), "l_quantity <= 10 AND l_discount > 0.05")
_simple("where_and_or", "lineitem", lambda: [("k", c("l_orderkey"))], "l_orderkey AS k", lambda: rel.equal(c("l_returnflag"), F.lit("R")) | (rel.equal(c("l_linestatus"), F.lit("O")) & rel.compare(c("l_quantity"), "<", F.lit(5))), "l_returnflag = 'R' OR (l_linestatus = 'O' AND l_quantity < 5)")
_over_labelled("where_not_equal_null", lambda: rel.not_equal(c("l__quality"), F.lit(1)), "NOT coalesce(quality = 1, false)")
_simple("like_regex", "part", lambda: [("k", c("p_partkey"))], "p_partkey AS k", lambda: rel.like(c("p_name"), "^[a-h].+ .*[en]g?e?[tr]$"), "regexp_matches(p_name, '^[a-h].+ .*[en]g?e?[tr]$')")
_simple("not_like_regex", "part", lambda: [("k", c("p_partkey"))], "p_partkey AS k", lambda: rel.like(c("p_type"), "[AE]$", True), "NOT regexp_matches(p_type, '[AE]$')")
_simple("in_list", "orders", lambda: [("k", c("o_orderkey"))], "o_orderkey AS k", lambda: rel.in_list(c("o_orderstatus"), F.lit("O"), F.lit("P")), "o_orderstatus IN ('O', 'P')")
_over_labelled("not_in_null", lambda: rel.not_in_list(c("l__quality"), F.lit(1), F.lit(None).cast("int")), "NOT coalesce(quality = 1, false)")
_over_labelled("is_null", lambda: c("l__doc_id").isNull(), "l.doc_id IS NULL")
_over_labelled("is_not_null", lambda: c("l__doc_id").isNotNull(), "l.doc_id IS NOT NULL")
_over_labelled("predicate_fn", lambda: rel.holds(c("l__toxic") == 1), "coalesce(toxic = 1, false)")
_over_labelled("not_predicate_fn", lambda: rel.holds(c("l__toxic") == 1, negated=True), "NOT coalesce(toxic = 1, false)")


def _joined(name: str, how: str) -> None:
    """Documents with their labels; some have none."""
    def build(t) -> DataFrame:
        rows = rel.join(t("documents").select(c("doc_id").alias("d")), t("labels"), [(c("d"), c("doc_id"))], how)
        return rel.project(rows, ("d", c("d")), ("q", c("quality")))

    build.__name__ = name
    _query(f"SELECT documents.doc_id AS d, quality AS q FROM documents {how.upper()} JOIN labels l ON documents.doc_id IS NOT DISTINCT FROM l.doc_id")(build)


for _how in ("inner", "left", "right", "full"):
    _joined(f"join_{_how}", _how)


@_query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND substr(c_name, length(c_name), 1) = substr(s_name, length(s_name), 1)")
def join_multi_cond(t):
    rows = rel.join_repeated(t("customer"), t("supplier"), [(c("c_nationkey"), c("s_nationkey")), (text.get(c("c_name"), -1), text.get(c("s_name"), -1))])
    return rows.select("c_custkey", "s_suppkey")


@_query("SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain(t):
    rows = rel.join(t("supplier"), t("nation"), [(c("s_nationkey"), c("n_nationkey"))])
    return rel.join(rows, t("region"), [(c("n_regionkey"), c("r_regionkey"))]).select("s_name", "n_name", "r_name")


@_query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(t):
    a, b = rel.prefixed(t("nation"), "a"), rel.prefixed(t("nation"), "b")
    return rel.project(rel.join(a, b, [(c("a__n_regionkey"), c("b__n_regionkey"))]), ("a", c("a__n_name")), ("b", c("b__n_name")))


@_query("SELECT p_partkey AS a, r_name AS b FROM part JOIN region ON lower(substr(p_name, 1, 1)) = lower(substr(r_name, 1, 1))")
def join_expr_key(t):
    rows = rel.join(t("part"), t("region"), [(F.lower(text.get(c("p_name"), 0)), F.lower(text.get(c("r_name"), 0)))])
    return rel.project(rows, ("a", c("p_partkey")), ("b", c("r_name")))


@_query("""WITH k AS (SELECT n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS k FROM nation), m AS (SELECT r_name, CASE WHEN r_regionkey > 1 THEN r_regionkey END AS m FROM region)
SELECT n_name, r_name FROM k JOIN m ON k IS NOT DISTINCT FROM m""")
def join_null_keys(t):
    a = t("nation").select("n_name", F.when(c("n_regionkey") > 1, c("n_regionkey")).alias("k"))
    b = t("region").select("r_name", F.when(c("r_regionkey") > 1, c("r_regionkey")).alias("m"))
    return rel.join(a, b, [(c("k"), c("m"))]).select("n_name", "r_name")


@_query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all(t):
    return rel.union_all(rel.project(t("customer"), ("name", c("c_name")), ("nation", c("c_nationkey"))), t("supplier").select("s_name", "s_nationkey"))


@_query("""SELECT name, row_number() OVER (ORDER BY name DESC) AS place FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier)""")
def union_order(t):
    both = rel.union_all(rel.project(t("customer"), ("name", c("c_name"))), t("supplier").select("s_name"))
    return misc.numbered(rel.order_by(both, ("name", False)), "place")


@_query("SELECT o_orderkey AS k, o_totalprice AS p, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def order_position(t):
    return misc.numbered(rel.order_by(rel.project(t("orders"), ("k", c("o_orderkey")), ("p", c("o_totalprice"))), (2, False), (1, True)), "place")


@_query("SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def order_hidden(t):
    return misc.numbered(rel.project(rel.order_by(t("orders"), (c("o_orderdate"), False), (c("o_orderkey"), True)), ("k", c("o_orderkey"))), "place")


@_query(f"""SELECT documents.doc_id AS k, row_number() OVER (ORDER BY quality DESC NULLS LAST, documents.doc_id) AS down, row_number() OVER (ORDER BY quality NULLS LAST, documents.doc_id) AS up FROM {LABELLED}""")
def order_nulls(t):
    rows = _labelled(t)
    down = misc.numbered(rel.order_by(rows, ("l__quality", False), ("d__doc_id", True)), "down")
    return misc.numbered(rel.order_by(down, ("l__quality", True), ("d__doc_id", True)), "up").select(c("d__doc_id").alias("k"), "down", "up")


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size, CASE WHEN l_returnflag = 'R' THEN 'back' END AS back FROM lineitem")
def case_searched(t):
    rows = t("lineitem")
    size = rel.case(rows, [(rel.compare(c("l_quantity"), "<", F.lit(10)), F.lit("few")), (rel.compare(c("l_quantity"), "<", F.lit(30)), F.lit("some"))], F.lit("many"))
    return rel.project(rows, ("l_orderkey", c("l_orderkey")), ("l_linenumber", c("l_linenumber")), ("size", size), ("back", rel.case(rows, [(rel.equal(c("l_returnflag"), F.lit("R")), F.lit("back"))])))


def _part(name: str, column: Callable, sql: str, source: str = "part", key: str = "p_partkey") -> None:
    _simple(name, source, lambda: [("k", c(key)), ("v", column())], f"{key} AS k, {sql} AS v")


_padded = "('  ' || p_name || chr(160))"
_blank = lambda: F.concat(F.lit("  "), c("p_name"), F.lit("\xa0"))
_part("fn_concat", lambda: text.concat(c("p_name"), F.lit("-"), c("p_type")), "p_name || '-' || p_type")
_part("fn_trim", lambda: text.trim(_blank()), "p_name")
_part("fn_ltrim", lambda: text.ltrim(_blank()), "p_name || chr(160)")
_part("fn_rtrim", lambda: text.rtrim(_blank()), "'  ' || p_name")
_part("fn_upper", lambda: text.upper(c("p_name")), "upper(p_name)")
_part("fn_lower", lambda: text.lower(c("p_type")), "lower(p_type)")
_part("fn_len", lambda: text.length(c("p_name")), "length(p_name)")
_part("fn_extract", lambda: text.extract(c("p_type"), r"([A-Z])[A-Z]*(E)"), "CASE WHEN regexp_matches(p_type, '([A-Z])[A-Z]*(E)') THEN regexp_extract(p_type, '([A-Z])[A-Z]*(E)', 1) END")
_part("fn_startswith", lambda: text.starts_with(c("p_type"), "S"), "starts_with(p_type, 'S')")
_part("fn_endswith", lambda: text.ends_with(c("p_type"), "L"), "ends_with(p_type, 'L')")
_part("fn_get", lambda: text.get(c("p_name"), 4), "CASE WHEN length(p_name) > 4 THEN substr(p_name, 5, 1) END")
_part("fn_get_end", lambda: text.get(c("p_name"), -2), "CASE WHEN length(p_name) >= 2 THEN substr(p_name, -2, 1) END")
_part("fn_contains", lambda: text.contains(c("p_type"), "A.*E"), "regexp_matches(p_type, 'A.*E')")
_part("fn_contains_ci", lambda: text.contains(c("p_type"), "a.*e", match_case=False), "regexp_matches(p_type, 'a.*e', 'i')")
_part("fn_replace", lambda: text.replace(c("p_name"), "([aeiou])", r"<\1$>"), "regexp_replace(p_name, '([aeiou])', '<\\1$>', 'g')")
_part("fn_repeat", lambda: text.repeat(c("p_type"), 2), "repeat(p_type, 2)")
_part("fn_pad_left", lambda: text.pad(c("p_type"), 12, "left"), "CASE WHEN length(p_type) >= 12 THEN p_type ELSE lpad(p_type, 12, ' ') END")
_part("fn_pad_right", lambda: text.pad(c("p_type"), 12, "right"), "CASE WHEN length(p_type) >= 12 THEN p_type ELSE rpad(p_type, 12, ' ') END")
_part("fn_pad_both", lambda: text.pad(c("p_type"), 13, "both"), "CASE WHEN length(p_type) >= 13 THEN p_type ELSE repeat(' ', (14 - length(p_type)) // 2) || p_type || repeat(' ', 13 - length(p_type) - (14 - length(p_type)) // 2) END")
_part("fn_count", lambda: text.count(c("p_name"), "[aeiou]"), "len(regexp_extract_all(p_name, '[aeiou]'))")
_part("fn_substring", lambda: text.substring(c("p_name"), 2, 3), "substr(p_name, 2, 3)")
_part("fn_xpath", lambda: text.xpath(F.concat(F.lit("<a><b c='"), c("p_partkey").cast("string"), F.lit("'/></a>")), "/a/b/@c"), "p_partkey::VARCHAR")
_part("fn_to_char", lambda: text.to_char(c("o_orderdate"), "%d.%m.%Y"), "strftime(o_orderdate, '%d.%m.%Y')", "orders", "o_orderkey")
_part("fn_to_date", lambda: misc.to_date(F.concat(F.lit("31."), (c("o_orderkey") % 14 + 1).cast("string"), F.lit(".2015")), "%d.%m.%Y"), "try_strptime('31.' || (o_orderkey % 14 + 1) || '.2015', '%d.%m.%Y')", "orders", "o_orderkey")
_part("fn_round", lambda: misc.round_(c("o_totalprice").cast("double"), 0), "round_even(o_totalprice::DOUBLE, 0)", "orders", "o_orderkey")


@_query("SELECT documents.doc_id AS k, coalesce(quality::VARCHAR, 'none') AS v FROM " + LABELLED)
def fn_nvl(t):
    rows = _labelled(t)
    value = misc.nvl(c("l__quality"), F.lit("none"), rows.schema["l__quality"].dataType, rows.select(F.lit("none").alias("x")).schema["x"].dataType)
    return rel.project(rows, ("k", c("d__doc_id")), ("v", value))


@_query("SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS INTEGER) AS i, o_orderkey::VARCHAR AS t, o_orderkey::DOUBLE AS f, epoch_ms(o_orderkey * 1000) AS d, o_orderkey % 2 <> 0 AS b FROM orders")
def fn_cast(t):
    rows = t("orders")
    price, key = rows.schema["o_totalprice"].dataType, rows.schema["o_orderkey"].dataType
    return rel.project(rows, ("k", c("o_orderkey")), ("i", misc.cast(c("o_totalprice"), price, "INTEGER")), ("t", misc.cast(c("o_orderkey"), key, "TEXT")), ("f", misc.cast(c("o_orderkey"), key, "FLOAT")), ("d", misc.cast(c("o_orderkey"), key, "DATETIME")), ("b", misc.cast(c("o_orderkey") % 2, key, "BOOLEAN")))


@_query("SELECT o_orderkey AS k, 10 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS n FROM orders WHERE o_orderstatus = 'O'")
def fn_range(t):
    return misc.with_range(t("orders").where("o_orderstatus = 'O'").select(c("o_orderkey").alias("k")), "n", ["k"], 10, 5)


def _geometry(t) -> DataFrame:
    """A square with a hole beside each part's key."""
    k = c("p_partkey").cast("string")
    wkt = F.format_string("POLYGON ((%1$s 0, %1$s 8, %2$s 8, %2$s 0, %1$s 0), (%3$s 1, %3$s 2, %4$s 2, %4$s 1, %3$s 1))", k, (c("p_partkey") + 8).cast("string"), (c("p_partkey") + 1).cast("string"), (c("p_partkey") + 2).cast("string"))
    return t("part").select(c("p_partkey").alias("k"), geo.from_text(wkt, 3857).alias("g"))


@_query("SELECT p_partkey AS k, p_partkey::DOUBLE AS x, 0::DOUBLE AS y, 63::DOUBLE AS area, 3857::INTEGER AS srid FROM part")
def geom_bounds_area(t):
    return _geometry(t).select("k", geo.x(c("g")).alias("x"), geo.y(c("g")).alias("y"), geo.area(c("g")).alias("area"), geo.srid(c("g")).alias("srid"))


@_query("SELECT p_partkey AS k, round(p_partkey + (64 * 4 - 1.5) / 63, 6) AS x, round((64 * 4 - 1.5) / 63, 6) AS y FROM part")
def geom_centroid(t):
    return _geometry(t).select("k", geo.centroid(c("g")).alias("m")).select("k", F.round(geo.x(c("m")), 6).alias("x"), F.round(geo.y(c("m")), 6).alias("y"))


_number = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::DOUBLE::VARCHAR END"


@_query(f"SELECT p_partkey AS k, 'POINT (' || p_partkey || ' ' || {_number.format('(p_partkey / 2.0)')} || ')' AS w FROM part")
def geom_astext(t):
    wkt = F.format_string("point(%s   %s)", c("p_partkey").cast("string"), (c("p_partkey") / 2.0).cast("string"))
    return t("part").select(c("p_partkey").alias("k"), geo.as_text(geo.from_text(wkt)).alias("w"))


def _kinds(t) -> DataFrame:
    """A line of 3-4-5 steps, two points, two lines, or two squares of which one has a hole, beside each part's key."""
    k = c("p_partkey").cast("string")
    k2 = (c("p_partkey") + 2).cast("string")
    k4 = (c("p_partkey") + 4).cast("string")
    wkt = (
        F.when(c("p_partkey") % 4 == 0, F.format_string("LINESTRING (%1$s 0, %1$s 5, %2$s 5)", k, k4))
        .when(c("p_partkey") % 4 == 1, F.format_string("MULTIPOINT ((%1$s 1), (%2$s 2))", k, k4))
        .when(c("p_partkey") % 4 == 2, F.format_string("MULTILINESTRING ((%1$s 0, %2$s 0), (%1$s 3, %2$s 3))", k, k4))
        .otherwise(F.format_string("MULTIPOLYGON (((%1$s 0, %1$s 4, %3$s 4, %3$s 0, %1$s 0), (%1$s 0, %1$s 2, %2$s 2, %2$s 0, %1$s 0)), ((%1$s 10, %1$s 14, %3$s 14, %3$s 10, %1$s 10)))", k, k2, k4))
    )
    return t("part").select(c("p_partkey").alias("k"), geo.from_text(wkt, 2056).alias("g"))


@_query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 3 THEN 28 ELSE 0 END::DOUBLE AS area, CASE p_partkey % 4 WHEN 1 THEN 1 ELSE 0 END::DOUBLE AS low,
round(p_partkey + CASE p_partkey % 4 WHEN 0 THEN 8.0 / 9 WHEN 3 THEN (16 * 2.0 - 4 * 1 + 16 * 2.0) / 28 ELSE 2 END, 6) AS x,
round(CASE p_partkey % 4 WHEN 0 THEN (5 * 2.5 + 4 * 5.0) / 9 WHEN 3 THEN (16 * 2.0 - 4 * 1 + 16 * 12.0) / 28 ELSE 1.5 END, 6) AS y,
CASE p_partkey % 4 WHEN 0 THEN 'LINESTRING (' || p_partkey || ' 0, ' || p_partkey || ' 5, ' || (p_partkey + 4) || ' 5)' WHEN 1 THEN 'MULTIPOINT (' || p_partkey || ' 1, ' || (p_partkey + 4) || ' 2)'
WHEN 2 THEN 'MULTILINESTRING ((' || p_partkey || ' 0, ' || (p_partkey + 4) || ' 0), (' || p_partkey || ' 3, ' || (p_partkey + 4) || ' 3))'
ELSE replace(replace(replace('MULTIPOLYGON (((a 0, a 4, c 4, c 0, a 0), (a 0, a 2, b 2, b 0, a 0)), ((a 10, a 14, c 14, c 10, a 10)))', 'a', p_partkey::VARCHAR), 'b', (p_partkey + 2)::VARCHAR), 'c', (p_partkey + 4)::VARCHAR) END AS w FROM part""")
def geom_kinds(t):
    g, m = c("g"), c("m")
    rows = _kinds(t).select("k", "g", geo.centroid(g).alias("m"))
    return rows.select("k", geo.area(g).alias("area"), geo.y(g).alias("low"), F.round(geo.x(m), 6).alias("x"), F.round(geo.y(m), 6).alias("y"), geo.as_text(g).alias("w"))


@_query("SELECT p_partkey AS k, round(radians(p_partkey % 170) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(p_partkey % 80 + 1) / 2)) * 6378137.0, 3) AS y FROM part")
def geom_transform(t):
    wkt = F.format_string("POINT (%s %s)", (c("p_partkey") % 170).cast("string"), (c("p_partkey") % 80 + 1).cast("string"))
    moved = geo.transform(geo.set_srid(geo.from_text(wkt), 4326), 3857)
    return t("part").select(c("p_partkey").alias("k"), moved.alias("g")).select("k", F.round(geo.x(c("g")), 3).alias("x"), F.round(geo.y(c("g")), 3).alias("y"))


_swiss = """u AS (SELECT p_partkey AS k, 6 + (p_partkey % 400) / 100.0 AS lon, 46 + (p_partkey % 170) / 100.0 AS lat FROM part),
v AS (SELECT *, (lon * 3600 - 26782.5) / 10000 AS u, (lat * 3600 - 169028.66) / 10000 AS v FROM u),
w AS (SELECT *, 2600072.37 + 211455.93 * u - 10938.51 * u * v - 0.36 * u * v * v - 44.54 * u * u * u AS e, 1200147.07 + 308807.95 * v + 3745.25 * u * u + 76.63 * v * v - 194.56 * u * u * v + 119.79 * v * v * v AS n FROM v)"""


@_query(f"""WITH {_swiss} SELECT k, round(e, 2) AS e, round(n, 2) AS n, round(e - 2000000, 2) AS e_old, round(n - 1000000, 2) AS n_old, round(lon, 3) AS lon, round(lat, 3) AS lat,
round(radians(lon) * 6378137.0, 2) AS x, round((ln(tan(pi() / 4 + radians(lat) / 2)) + 0.0818191908426215 / 2 * ln((1 - 0.0818191908426215 * sin(radians(lat))) / (1 + 0.0818191908426215 * sin(radians(lat))))) * 6378137.0, 2) AS y FROM w""")
def geom_transform_systems(t):
    """From longitude and latitude to the Swiss systems, back through both, and to the mercator projection of the ellipsoid and back."""
    wkt = F.format_string("POINT (%s %s)", (6 + (c("p_partkey") % 400) / 100.0).cast("string"), (46 + (c("p_partkey") % 170) / 100.0).cast("string"))
    start = geo.from_text(wkt, 4326)
    new, world = geo.transform(start, 2056), geo.transform(start, 3395)
    old = geo.transform(new, 21781)
    back = geo.transform(geo.transform(geo.transform(old, 2056), 3395), 4326)
    rows = t("part").select(c("p_partkey").alias("k"), new.alias("new"), old.alias("old"), back.alias("back"), world.alias("world"))
    rounded = [F.round(f(c(g)), digits).alias(name) for g, digits, names in (("new", 2, "e n"), ("old", 2, "e_old n_old"), ("back", 3, "lon lat"), ("world", 2, "x y")) for f, name in zip((geo.x, geo.y), names.split(), strict=True)]
    return rows.select("k", *rounded)


@_query("""SELECT 'c' || c_custkey AS k, 4326::INTEGER AS srid, round((c_custkey % 170)::DOUBLE, 6) AS x, 10.0::DOUBLE AS y FROM customer
UNION ALL SELECT 's' || s_suppkey, 4326, round(degrees((s_suppkey % 100) * 1000 / 6378137.0), 6), round(degrees(2 * atan(exp(500000 / 6378137.0)) - pi() / 2), 6) FROM supplier""")
def union_geometries(t):
    """Points in longitude and latitude, and others in metres, under the first one's reference system."""
    a = t("customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("k"), geo.from_text(F.format_string("POINT (%s 10)", (c("c_custkey") % 170).cast("string")), 4326).alias("g"))
    b = t("supplier").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("k"), geo.from_text(F.format_string("POINT (%s 500000)", (c("s_suppkey") % 100 * 1000).cast("string")), 3857).alias("h"))
    return rel.union_all(a, b).select("k", geo.srid(c("g")).alias("srid"), F.round(geo.x(c("g")), 6).alias("x"), F.round(geo.y(c("g")), 6).alias("y"))


@_query("SELECT c_name, sum_open FROM (SELECT c_custkey, c_name FROM customer) JOIN (SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS sum_open FROM orders) ON o_custkey = c_custkey")
def view_nested(t):
    orders = t("orders")
    inner = orders.select("o_custkey", rel.case(orders, [(rel.equal(c("o_orderstatus"), F.lit("O")), c("o_totalprice"))]).alias("sum_open"))
    return rel.join(t("customer").select("c_custkey", "c_name"), inner, [(c("c_custkey"), c("o_custkey"))]).select("c_name", "sum_open")


@_query("SELECT o_orderkey::VARCHAR AS k, coalesce(CASE WHEN o_orderstatus = 'O' THEN 'open' END, 'NULL') AS s FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def preview_page(t):
    rows = t("orders")
    status = rel.case(rows, [(rel.equal(c("o_orderstatus"), F.lit("O")), F.lit("open"))])
    return rel.preview(rel.order_by(rel.project(rows, ("k", c("o_orderkey")), ("s", status)), ("k", True)), 20, 2)


@_query("""SELECT 'n_nationkey' AS "column", 'bigint' AS type, NULL::BIGINT AS max_length, min(n_nationkey)::DOUBLE AS low, max(n_nationkey)::DOUBLE AS high, false AS has_nulls FROM nation
UNION ALL SELECT 'n_name', 'string', max(length(n_name)), NULL, NULL, false FROM nation""")
def schema_profile(t):
    return files.column_profile(t("nation").select(c("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name"))


def _shaped(t) -> DataFrame:
    """Suppliers with a point each, or with two."""
    k = c("s_suppkey")
    point = F.when(k % 3 == 0, F.format_string("MULTIPOINT (%1$s 47, %1$s 48)", (k % 170).cast("string"))).otherwise(F.format_string("POINT (%s 47.5)", (k % 170).cast("string")))
    return t("supplier").select(c("s_suppkey").alias("k"), F.concat(c("s_name"), F.lit(" <&> \"é\"")).alias("n"), c("s_acctbal").alias("b"), geo.from_text(point, 4326).alias("geometry"))


def _through(rows: DataFrame, name: str) -> DataFrame:
    """Rows as files of a format, and what reading these gives."""
    path = scratch(rows.sparkSession, name)
    formats.write(rows, path, name)
    return formats.read(rows.sparkSession, path, name)


_points = "CASE WHEN s_suppkey % 3 = 0 THEN 'MULTIPOINT (' || (s_suppkey % 170) || ' 47, ' || (s_suppkey % 170) || ' 48)' ELSE 'POINT (' || (s_suppkey % 170) || ' 47.5)' END"


def _round_trip(name: str, sql: str, number: str = "double") -> None:
    def build(t) -> DataFrame:
        back = _through(_shaped(t), name)
        shape = geo.as_text(c("geometry")) if geo.is_geometry(dict(back.dtypes)["geometry"]) else c("geometry")
        return back.select(c("k").cast("bigint").alias("k"), "n", F.round(c("b").cast(number), 2).alias("b"), shape.alias("w"))

    build.__name__ = f"{name}_round_trip"
    _query(f"SELECT s_suppkey AS k, s_name || ' <&> \"é\"' AS n, round(s_acctbal, 2) AS b, {sql} AS w FROM supplier")(build)


for _name in ("csv", "json", "xml", "kml", "gml"):
    _round_trip(_name, _points)
# one kind of geometries: points become multiples
_round_trip("geojson", "'MULTIPOINT (' || (s_suppkey % 170) || CASE WHEN s_suppkey % 3 = 0 THEN ' 47, ' || (s_suppkey % 170) || ' 48)' ELSE ' 47.5)' END")


@_query("SELECT 'geometry' AS \"column\", 'POINT' AS kind, min(s_suppkey % 170)::DOUBLE AS west, 47::DOUBLE AS south, max(s_suppkey % 170)::DOUBLE AS east, 48::DOUBLE AS north FROM supplier")
def geometry_bounds(t):
    return files.geometry_profile(_shaped(t).select("k", "geometry"))


@_query("""WITH p AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS owner, s_suppkey % 2 = 0 AS private FROM supplier)
SELECT id, name FROM p WHERE (owner = 3 OR NOT private) AND contains(lower(name), '1') ORDER BY name DESC NULLS LAST, id LIMIT 20""")
def package_search(t):
    rows = t("supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), F.lit("a supplier").alias("description"), c("s_nationkey").alias("owner"), (c("s_suppkey") % 2 == 0).alias("private"))
    return packages.search(rows, 3, text="1", sort=("name", False)).select("id", "name")


@_query("""WITH RECURSIVE r(id) AS (SELECT 1 UNION SELECT p_partkey FROM r JOIN part ON p_partkey // 3 = r.id AND p_partkey > 0) SELECT id::BIGINT AS id FROM r WHERE id <> 1""")
def package_dependants(t):
    uses = t("part").where("p_partkey > 0").select(c("p_partkey").alias("user"), F.expr("p_partkey DIV 3").alias("used"))
    return packages.dependants(uses, uses.sparkSession.createDataFrame([(1,)], "id long"))
