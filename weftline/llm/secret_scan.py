"""Secrets in texts: fixed forms, and sliding-window Shannon entropy. DataFrame functions only.

Fixed forms are assignments to a secret's name, access keys and long hexadecimal
runs. They are blanked out, hexadecimal runs first, then access keys, then assignments;
in what is left, runs of 20 and more base64 and URL characters are candidate strings. So
a key that is joined to a fixed form by a slash or a dash is a candidate of its own. A
candidate is of the hexadecimal class if all its characters are, else of the base64
class. A window of 20 characters slides over it. Its counts by character stand in the
bits of a few longs, five bits a character of the class; a step adds one to the count of
the character that comes in and takes one from that of the character that goes out. With
them changes the sum of c * log2(c), from which the entropy log2(20) - sum / 20 follows;
the greatest entropy of any window is held against the class's threshold. Candidates on
the allow list (plain words, digits only, UUIDs, addresses of files, and, in runs short
enough to be a key, example keys and placeholders) are left out.

Every regular expression works within a row, so nothing is shuffled. Positions come
from the lengths of the pieces between matches, in code points. A step of a window costs
the same wherever it stands, and lists are made block by block, so that the time is linear in
a text's length, also where one run is the whole text.

Defined results: a null text counts as empty and has no spans; a text of any length
is scanned whole; each row is scanned by itself, so repeated rows and ids repeat; an
empty table gives an empty result; other columns pass through untouched, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bound, free_name

#: kind -> (pattern, group that has the value, least length of that group)
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What a text must have for a kind's pattern to be tried, as a plain search.
NEEDS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "entropy": r"[A-Za-z0-9+/_=-]{20}",
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: class -> (its characters, least entropy in bits of a window)
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 3.02),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.83),
}
ALLOW_LIST = [
    r"^[A-Za-z_-]+$",
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([a-z0-9_-]{1,19}/){2,}[a-z0-9_-]{0,19}$",
]
#: Also on the allow list where the candidate is at most so long; in a longer run such letters stand by chance.
PLACEHOLDER, PLACEHOLDER_MOST = r"(?i)(example|placeholder|changeme|xxxx|0000|1234567)", 64
BLANKED = ("hex", "access", "assign")
KINDS = [*BASE, *CLASSES]
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string,first:bigint,last:bigint>>"
BLOCK = 64
COUNT_BITS, COUNTS_A_LONG = 5, 12


def _gathered(rows: Column, begin: Column, step: Callable[[Column, Column], Column], made: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The spans that ``made`` gives while a small state goes over ``rows``.

    ``made`` gives, from the state before a row and the row, whether there is a span, and
    the span. An aggregate copies its state at every step, so no list may grow in it: the
    state at the begin of each block of rows comes first, then each block's spans.
    """
    def block(part: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(SPAN).alias("found"))

        def add(s: Column, x: Column) -> Column:
            keep, span = made(s["state"], x)
            return F.struct(step(s["state"], x).alias("state"), F.when(keep, F.concat(s["found"], F.array(span))).otherwise(s["found"]).alias("found"))

        return F.aggregate(part, start, add)["found"]

    def over(blocks: Column) -> Column:
        states = F.aggregate(blocks, F.array(begin), lambda known, part: F.concat(known, F.array(F.aggregate(part, F.element_at(known, -1), step))))
        return bound(states, lambda known: F.flatten(F.transform(blocks, lambda part, i: block(part, F.get(known, i)))))

    def cut(items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(items) > 0, bound(blocks, over)).otherwise(_none())

    return bound(rows, cut)


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """What stands before each match of a pattern, the match, and its ``group``; after the last match, only what stands there."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"), value.alias("value"))


def _matches(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """The spans of a pattern's matches whose ``group`` has ``least`` characters, leftmost first."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("byte"))

    def bounds(state: Column, x: Column) -> tuple[Column, Column, Column, Column]:
        start, first = state["at"] + F.length(x["before"]), state["byte"] + F.octet_length(x["before"])
        return start, start + F.length(x["whole"]), first, first + F.octet_length(x["whole"])

    def step(state: Column, x: Column) -> Column:
        _, end, _, last = bounds(state, x)
        return F.struct(end.alias("at"), last.alias("byte"))

    def made(state: Column, x: Column) -> tuple[Column, Column]:
        start, end, first, last = bounds(state, x)
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["whole"].alias("value"),
            first.alias("first"), last.alias("last"),
        )
        return F.length(x["value"]) >= least, span

    return _gathered(_pieces(text, pattern, group), begin, step, made)


def _none() -> Column:
    return F.array().cast(SPAN)


def _blanked(kind: str, text: Column) -> Column:
    """``text`` with blanks in place of a fixed form's matches, as many as these have characters."""
    pattern, group, least = BASE[kind]

    def left(x: Column) -> Column:
        return F.concat(x["before"], F.when(F.length(x["value"]) >= least, F.repeat(F.lit(" "), F.length(x["whole"]))).otherwise(F.coalesce(x["whole"], F.lit(""))))

    return F.when(text.rlike(NEEDS[kind]), F.array_join(F.transform(_pieces(text, pattern, group), left), "")).otherwise(text)


def max_entropy(value: Column, alphabet: str) -> Column:
    """The greatest entropy of a window, by counts that change by one character in and one out."""
    codes = "".join(chr(48 + k) for k in range(len(alphabet)))
    numbers = F.transform(F.split(F.translate(value, alphabet, codes), ""), lambda c: F.ascii(c) - 48)
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    longs = -(-len(alphabet) // COUNTS_A_LONG)
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), longs).alias("counts"), F.lit(0.0).alias("total"), F.lit(float(WINDOW**2)).alias("least"))

    def place(c: Column) -> tuple[Column, Column]:
        """The long that has a character's count, and its lowest bit there."""
        return F.floor(c / COUNTS_A_LONG).cast("int"), (c % COUNTS_A_LONG) * COUNT_BITS

    def count(counts: Column, c: Column) -> Column:
        at, bit = place(c)
        return F.call_function("shiftright", F.get(counts, at), bit).bitwiseAND(F.lit(2**COUNT_BITS - 1)).cast("int")

    def one(c: Column, k: Column) -> Column:
        at, bit = place(c)
        return F.when(at == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))

    def slid(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            comes, goes = F.get(chars, i), F.get(chars, F.greatest(i - WINDOW, F.lit(0)))
            full = i >= WINDOW
            more, less = count(state["counts"], comes), count(state["counts"], goes)
            gained = F.get(terms, more + 1) - F.get(terms, more)
            lost = F.get(terms, less) - F.get(terms, less - 1)
            changed = F.when(full & (comes == goes), 0.0).when(full, gained - lost).otherwise(gained)
            counts = F.transform(state["counts"], lambda w, k: F.when(full, w + one(comes, k) - one(goes, k)).otherwise(w + one(comes, k)))
            total = state["total"] + changed
            least = F.when(i >= WINDOW - 1, F.least(total, state["least"])).otherwise(state["least"])
            return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step)["least"]

    return F.lit(math.log2(WINDOW)) - bound(numbers, slid) / WINDOW


def _entropy_spans(text: Column) -> Column:
    """Candidates of a text without fixed forms that aren't on the allow list and have a window of enough entropy."""
    names = list(CLASSES)
    is_hex = "^[0-9a-fA-F]+$"

    def wanted(x: Column) -> Column:
        value = x["value"]
        allowed = value.rlike(PLACEHOLDER) & (F.length(value) <= PLACEHOLDER_MOST)
        for pattern in ALLOW_LIST:
            allowed = allowed | value.rlike(pattern)
        passes = [max_entropy(value, CLASSES[c][0]) >= CLASSES[c][1] for c in names]
        return F.when(~allowed, F.when(value.rlike(is_hex), passes[0]).otherwise(passes[1])).otherwise(False)

    def named(x: Column) -> Column:
        k = F.when(x["value"].rlike(is_hex), 0).otherwise(1)
        return x.withField("rank", (k + KINDS.index(names[0])).cast("int")).withField("kind", F.element_at(F.array(*map(F.lit, names)), k + 1))

    return F.transform(F.filter(_matches(text, CANDIDATE, 0, WINDOW, names[0]), wanted), named)


def with_spans(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``docs`` with two columns more: the fixed forms' spans, and all spans, by start and kind.

    A span has start, end (exclusive), kind and value, and its first and last byte
    (exclusive) in UTF-8. ``base`` and ``spans`` must be new names.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.concat(*(F.when(body.rlike(NEEDS[kind]), _matches(body, pattern, group, least, kind)).otherwise(_none()) for kind, (pattern, group, least) in BASE.items()))
    out = docs.withColumn(base, F.array_sort(found))
    rest = body
    for kind in BLANKED:
        rest = bound(rest, partial(_blanked, kind))
    left = free_name(f"{spans}_left", out)
    out = out.withColumn(left, F.when(F.size(base) > 0, rest).otherwise(body))
    more = F.when(F.col(left).rlike(NEEDS["entropy"]), _entropy_spans(F.col(left))).otherwise(_none())
    return out.withColumn(spans, F.array_sort(F.concat(base, more))).drop(left)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """The digest of a scan: one row for each document."""
    found = with_spans(docs.select("doc_id", "text"))

    def n_of(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = map(n_of, BASE)
    n_entropy = (F.size("spans") - F.size("base_spans")).cast("bigint").alias("n_entropy")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), n_entropy)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span of their texts replaced by ``mark``, and ``n_chars``, if there is one, to match.

    Spans that overlap become one mark. A null text stays null.
    """
    base, spans, cuts = free_name("base_spans", docs), free_name("spans", docs), free_name("cuts", docs)
    found = with_spans(docs, "text", base, spans)

    def step(state: Column, s: Column) -> Column:
        return F.struct(F.greatest(s["last"], state["byte"]).alias("byte"))

    def part(state: Column, s: Column) -> tuple[Column, Column]:
        """What no earlier span covers."""
        return s["last"] > state["byte"], s.withField("first", F.greatest(s["first"], state["byte"]))

    found = found.withColumn(cuts, _gathered(F.col(spans), F.struct(F.lit(0).cast("bigint").alias("byte")), step, part))

    # pieces are cut out of the bytes, so that none is looked for from the text's begin
    def written(data: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(F.col(cuts), i - 1)["last"]).otherwise(0)
            joined = (i > 0) & (s["first"] == before) & (s["start"] < F.get(F.col(cuts), i - 1)["end"])
            return F.concat(F.decode(F.substring(data, (before + 1).cast("int"), (s["first"] - before).cast("int")), "UTF-8"), F.when(joined, "").otherwise(mark))

        last = F.element_at(F.col(cuts), -1)["last"]
        rest = F.decode(F.substring(data, (last + 1).cast("int"), F.octet_length(data)), "UTF-8")
        return F.concat(F.array_join(F.transform(F.col(cuts), piece), ""), rest)

    text = F.col("text")
    hit = F.size(cuts) > 0
    out = found.withColumn("text", F.when(hit, bound(F.encode(text, "UTF-8"), written)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def _sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def found(pattern: str, group: int, least: int, kind: str, rank: int, body: str = "body", source: str = "t") -> str:
        """Spans of one kind: a match starts after all pieces before it and all earlier matches."""
        p = quoted(pattern)
        start = "CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
        return (
            f"SELECT r, {rank} AS rank, '{kind}' AS kind, {start} AS a, {start} + length(ms[i]) AS z, ms[i] AS value FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM "
            f"(SELECT r, regexp_extract_all({body}, {p}, 0) AS ms, regexp_extract_all({body}, {p}, {group}) AS vs, string_split_regex({body}, {p}) AS ps FROM {source})) WHERE length(vs[i]) >= {least}"
        )

    def blanked(kind: str, body: str) -> str:
        """The text with blanks in place of a fixed form's matches."""
        pattern, group, least = BASE[kind]
        p = quoted(pattern)
        pieces = f"list_zip(string_split_regex({body}, {p}), regexp_extract_all({body}, {p}, 0), regexp_extract_all({body}, {p}, {group}))"
        return f"array_to_string(list_transform({pieces}, lambda x: x[1] || CASE WHEN length(x[3]) >= {least} THEN repeat(' ', length(x[2])) ELSE coalesce(x[2], '') END), '')"

    base = " UNION ALL ".join(found(p, g, least, kind, KINDS.index(kind)) for kind, (p, g, least) in BASE.items())
    allowed = " OR ".join([f"regexp_matches(value, {quoted(PLACEHOLDER)}) AND length(value) <= {PLACEHOLDER_MOST}", *(f"regexp_matches(value, {quoted(p)})" for p in ALLOW_LIST)])
    blanks = ", ".join(f"left{i + 1} AS (SELECT r, {blanked(kind, 'body')} AS body FROM {f'left{i}' if i else 't'})" for i, kind in enumerate(BLANKED))
    is_hex = "regexp_matches(value, '^[0-9a-fA-F]+$')"
    bits = f"list_max(list_transform(range(1, length(value) - {WINDOW - 2}), lambda i: list_entropy(string_split(substr(value, i, {WINDOW}), ''))))"
    names = list(CLASSES)
    text = "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS body FROM documents),
base AS ({base}),
{blanks},
candidates AS ({found(CANDIDATE, 0, WINDOW, "", 0, source=f"left{len(BLANKED)}")}),
apart AS (SELECT * FROM candidates c WHERE NOT ({allowed})),
method AS (SELECT r, CASE WHEN {is_hex} THEN {KINDS.index(names[0])} ELSE {KINDS.index(names[1])} END AS rank, CASE WHEN {is_hex} THEN '{names[0]}' ELSE '{names[1]}' END AS kind, a, z, value
  FROM apart WHERE {bits} >= CASE WHEN {is_hex} THEN {CLASSES[names[0]][1]} ELSE {CLASSES[names[1]][1]} END),
b AS (SELECT r, {counts}, {text} AS base_spans FROM base GROUP BY r),
s AS (SELECT r, {text} AS spans, count(*) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM method) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  (coalesce(n, 0) - {" - ".join(f"coalesce(n_{k}, 0)" for k in BASE)})::BIGINT AS n_entropy FROM t LEFT JOIN b USING (r) LEFT JOIN s USING (r)"""


SQL = _sql()
