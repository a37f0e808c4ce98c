"""Reading service answers: JSON in text, translations, citation metadata."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import strip

_STRICT = {"allowSingleQuotes": "false"}

# Marks around a JSON block in an answer.
JSON_FENCE = "```json"
FENCE = "```"

# Names of the metadata sources, in the order they are tried.
SOURCES = ("semantic_scholar", "crossref", "openalex")
NOT_FOUND = "not_found"


def json_slice(answer: Column) -> Column:
    """The JSON part of an answer.

    A fenced block wins; without its closing fence the block runs to the
    character before the last one, which as a rule leaves broken JSON. Next
    comes the stretch from the first ``{`` to the last ``}``, then the whole.
    """
    start = F.instr(answer, JSON_FENCE) + len(JSON_FENCE)
    after = F.substr(answer, start)
    closed = F.instr(after, FENCE)
    fenced = F.when(closed > 0, F.substr(after, F.lit(1), closed - 1)).otherwise(
        F.substr(after, F.lit(1), F.greatest(F.length(after) - 1, F.lit(0)))
    )
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return (
        F.when(answer.contains(JSON_FENCE), strip(fenced))
        .when(answer.contains("{") & answer.contains("}"), braces)
        .otherwise(answer)
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _json_object(text: Column) -> Column:
    """Top-level object as map of raw value text; NULL unless ``text`` is
    exactly one JSON object. The array around it makes trailing text and
    empty input show up."""
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _STRICT)
    return _let(wrapped, lambda objects: F.when(F.size(objects) == 1, F.get(objects, F.lit(0))))


def _last_wins(mapping: Column) -> Column:
    """Drop earlier entries of repeated keys."""

    def keep_last(entries: Column) -> Column:
        def is_last(entry: Column, index: Column) -> Column:
            later = F.slice(entries, index + 2, F.size(entries))
            return ~F.exists(later, lambda other: other["key"] == entry["key"])

        return F.map_from_entries(F.filter(entries, is_last))

    return _let(F.map_entries(mapping), keep_last)


def _string_map(raw: Column) -> Column:
    """Object text as a map, empty for NULL; NULL if it is no object."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(raw.isNull(), empty).otherwise(_last_wins(F.from_json(raw, "map<string,string>", _STRICT)))


def parse_classification(text: Column) -> Column:
    """``struct<ok, categories, classifications>`` from the JSON part.

    ``ok`` is false for broken JSON and for anything but an object in place of
    either map. An absent or null map counts as empty.
    """

    def maps(top: Column) -> Column:
        return F.struct(
            F.when(top.isNotNull(), _string_map(F.try_element_at(top, F.lit("categories")))).alias("categories"),
            F.when(top.isNotNull(), _string_map(F.try_element_at(top, F.lit("classifications")))).alias("classes"),
        )

    def checked(found: Column) -> Column:
        ok = found["categories"].isNotNull() & found["classes"].isNotNull()
        return F.struct(
            ok.alias("ok"),
            F.when(ok, found["categories"]).alias("categories"),
            F.when(ok, found["classes"]).alias("classifications"),
        )

    return _let(_let(_json_object(text), maps), checked)


def parse_translation(answer: Column, original: Column) -> Column:
    """Joined segments of a translation answer.

    No segments, or an answer that holds nothing, gives the original back. Broken
    JSON gives NULL.
    """
    nothing = answer.rlike(r"^\s*(null|false|0|\"\"|\[\s*\]|\{\s*\})\s*$")

    def joined(segments: Column) -> Column:
        first = F.transform(segments, lambda segment: F.get(segment, F.lit(0)))
        pieces = F.filter(first, lambda piece: piece.isNotNull() & (piece != ""))
        return F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, original).otherwise(F.array_join(pieces, ""))

    def read(top: Column) -> Column:
        segments = F.from_json(F.get(top, F.lit(0)), "array<array<string>>", _STRICT)
        return F.when(top.isNotNull(), _let(segments, joined))

    return F.when(nothing, original).otherwise(_let(F.from_json(answer, "array<string>", _STRICT), read))


def _metadata(year: Column, count: Column, source: str) -> Column:
    return F.struct(
        year.cast("int").alias("year"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("citation_count"),
        F.lit(source).alias("source"),
    )


def _first_hit(answer: Column, schema: str, path: Sequence[str], use: Callable[[Column], Column]) -> Column:
    """``use`` of the first hit in the list at ``path``; NULL without a hit."""
    found = F.from_json(answer, schema, _STRICT)
    for name in path:
        found = found[name]
    return _let(F.get(found, F.lit(0)), lambda hit: F.when(hit.isNotNull(), use(hit)))


def parse_semantic_scholar(answer: Column) -> Column:
    """Year and citation count of the first hit."""
    schema = "data array<struct<year:int,citationCount:bigint>>"
    return _first_hit(
        answer, schema, ["data"], lambda hit: _metadata(hit["year"], hit["citationCount"], SOURCES[0])
    )


def parse_crossref(answer: Column) -> Column:
    """First usable year among print, online and issue dates; no counts."""
    kinds = ("published-print", "published-online", "issued")
    dates = ",".join(f"`{kind}`:struct<`date-parts`:array<array<int>>>" for kind in kinds)

    def year(hit: Column, kind: str) -> Column:
        first_date = F.get(hit[kind]["date-parts"], F.lit(0))
        return F.nullif(F.get(first_date, F.lit(0)), F.lit(0))

    def read(hit: Column) -> Column:
        return _metadata(F.coalesce(*[year(hit, kind) for kind in kinds]), F.lit(0), SOURCES[1])

    return _first_hit(answer, f"message struct<items:array<struct<{dates}>>>", ["message", "items"], read)


def parse_openalex(answer: Column) -> Column:
    schema = "results array<struct<publication_year:int,cited_by_count:bigint>>"
    return _first_hit(
        answer, schema, ["results"], lambda hit: _metadata(hit["publication_year"], hit["cited_by_count"], SOURCES[2])
    )


METADATA_PARSERS = {
    "semantic_scholar": parse_semantic_scholar,
    "crossref": parse_crossref,
    "openalex": parse_openalex,
}
