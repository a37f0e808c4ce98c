"""Resolution of "not modified" revisit records of web archives.

A revisit says that a page had not changed since it was last fetched in full. It
is joined, as of its date, to the latest earlier full response of the same
canonical URL; its validators must agree with that response (entity tags by weak
comparison, else the modification date), and then the headers a 304 answer may
renew replace those stored.

The join is a window over records in date order, no self-join. A URL can be very
common, so windows run within a URL and a span of time; what was latest in the
spans before comes from one row per span. Only record headers are shuffled; a
payload is known by its record and its digest.

Defined results: a null URL or date resolves to nothing (``no_response``), and a
response without a date answers nothing. Responses of one date: the larger record
id counts as later; a response at the revisit's own date is not earlier. Repeated
rows each get a row. Null headers are none. Only the named columns are read. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields a 304 answer renews.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Seconds of a span.
SPAN = 6 * 3600

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port and no fragment, ``/`` for an
    empty path, query parameters sorted. What is no such URL stays as it is."""
    scheme, host = F.lower(F.regexp_extract(url, _URL, 1)), F.lower(F.regexp_extract(url, _URL, 2))
    path, query = F.regexp_extract(url, _URL, 3), F.regexp_extract(url, _URL, 4)
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")
    )
    asked = F.array_sort(F.array_remove(F.split(F.substring(query, 2, 1 << 30), "&"), ""))
    whole = F.concat(
        scheme,
        F.lit("://"),
        F.coalesce(port, host),
        F.when(path == "", "/").otherwise(path),
        F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(""),
    )
    return F.when(scheme == "", url).otherwise(whole)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def merge_headers(stored: Column, renewed: Column) -> Column:
    """``stored`` with the permitted fields of ``renewed`` in place of its own; names are in lower case."""
    fresh = F.map_filter(renewed, lambda name, _: name.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda name, _: ~F.array_contains(F.map_keys(fresh), name))
    return F.map_concat(kept, fresh)


def resolve(records: DataFrame, *, span: int = SPAN) -> DataFrame:
    """One row per revisit of ``records (record_id, kind, url, date, headers, digest)``.

    ``kind`` is ``response`` or ``revisit``, ``date`` a timestamp, ``headers`` a map
    with lower-case names, ``digest`` that of the payload. Adds ``status``
    (``resolved``, ``mismatch``, ``no_validator`` or ``no_response``),
    ``refers_to``, and for resolved ones the merged headers and the payload's digest.
    """
    none = F.create_map().cast("map<string,string>")
    read = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        "kind",
        canonical_url(F.col("url")).alias("url"),
        F.col("date").cast("timestamp").alias("date"),
        F.coalesce("headers", none).alias("headers"),
        "digest",
    )
    usable = (F.col("kind") == "response") & F.col("url").isNotNull() & F.col("date").isNotNull()
    full = F.when(usable, F.struct("date", "record_id", "headers", "digest"))
    read = read.where((F.col("kind") == "revisit") | usable)
    cut = F.floor(F.unix_timestamp("date") / F.lit(span))
    placed = read.withColumn("span", cut).withColumn("full", full)

    order = F.struct("date", "record_id")
    latest = placed.groupBy("url", "span").agg(F.max_by("full", F.when(F.col("full").isNotNull(), order)).alias("latest"))
    earlier = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("url", "span", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))

    # Revisits stand before responses of their date.
    within = Window.partitionBy("url", "span").orderBy("date", F.col("kind").desc(), "record_id")
    seen = placed.withColumn("seen", F.last("full", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    asked = seen.where("kind = 'revisit'").drop("full", "kind", "digest").alias("r")
    same = F.col("r.url").eqNullSafe(F.col("c.url")) & F.col("r.span").eqNullSafe(F.col("c.span"))
    joined = asked.join(carried.alias("c"), same, "left").select("r.*", "carried")
    can = F.col("url").isNotNull() & F.col("date").isNotNull()
    found = joined.select(
        "record_id", "url", "date", "headers", F.when(can, F.coalesce("seen", "carried")).alias("found")
    )
    has_tag, has_time = F.col("headers")["etag"].isNotNull(), F.col("headers")["last-modified"].isNotNull()
    tags = _tag(F.col("headers")) == _tag(F.col("found.headers"))
    times = F.col("headers")["last-modified"] == F.col("found.headers")["last-modified"]
    agree = F.coalesce(F.when(has_tag, tags).otherwise(times), F.lit(False))
    status = (
        F.when(F.col("found").isNull(), "no_response")
        .when(~has_tag & ~has_time, "no_validator")
        .when(agree, "resolved")
        .otherwise("mismatch")
    )
    judged = found.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return judged.select(
        "record_id",
        "url",
        "date",
        "status",
        F.col("found.record_id").alias("refers_to"),
        F.when(resolved, merge_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
        F.when(resolved, F.col("found.digest")).alias("digest"),
    )


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in order of names."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


# --- the registered query: the pages as an archive ---------------------------------


def archive(pages: DataFrame) -> DataFrame:
    """Every page as a full response, and two later revisits of its URL.

    The given pages have no dates or headers: these are made from their ids and
    contents, with other spellings of the URL, stale and weak entity tags, and
    revisits without validators among them.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    made = pages.select("page_id", "url", tag.alias("tag"), F.md5(F.col("html").cast("binary")).alias("digest"))
    n = F.col("page_id")

    def at(hours: Column) -> Column:
        return F.timestamp_seconds(F.lit(1_700_000_000) + hours * 3600)

    first = n * 7 % 500
    since = F.concat(F.lit("day "), (first % 30).cast("string"))
    response = F.struct(
        (n * 3).alias("record_id"),
        F.lit("response").alias("kind"),
        F.col("url").alias("url"),
        at(first).alias("date"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.col("tag"), F.lit("last-modified"), since,
            F.lit("cache-control"), F.lit("max-age=60"), F.lit("set-cookie"), F.concat(F.lit("s="), n.cast("string")),
        ).alias("headers"),
        F.col("digest").alias("digest"),
    )
    spelled = F.when(n % 3 == 0, F.concat(F.col("url"), F.lit("#part"))).otherwise(
        F.regexp_replace("url", "^http://([^/]+)/", "HTTP://$1:80/")
    )

    def revisit(number: int, hours: Column, url: Column, headers: Column) -> Column:
        return F.struct(
            (n * 3 + number).alias("record_id"),
            F.lit("revisit").alias("kind"),
            url.alias("url"),
            at(hours).alias("date"),
            headers.alias("headers"),
            F.lit(None).cast("string").alias("digest"),
        )

    sent = F.when(n % 5 == 0, F.concat(F.lit("W/"), F.col("tag"))).when(n % 7 == 0, '"old"').otherwise(F.col("tag"))
    one = F.create_map(
        F.lit("etag"), sent, F.lit("cache-control"), F.lit("max-age=90"), F.lit("content-length"), F.lit("0"),
        F.lit("set-cookie"), F.lit("s=304"),
    )
    two = F.when(n % 4 == 0, F.create_map(F.lit("date"), F.lit("today"))).otherwise(
        F.create_map(F.lit("date"), F.lit("today"), F.lit("last-modified"), since)
    )
    records = F.array(
        response, revisit(1, first + n % 11, spelled, one), revisit(2, first + 13 + n % 200, F.col("url"), two)
    )
    return made.select(F.explode(records).alias("r")).select("r.*")


def revisits_query(pages: DataFrame) -> DataFrame:
    out = resolve(archive(pages))
    return out.select(
        "record_id", "url", F.unix_timestamp("date").alias("date"), "status", "refers_to",
        header_lines(F.col("headers")).alias("headers"), "digest",
    )


_CANONICAL = r"""
  case when not regexp_matches(url, '{u}') then url else
  lower(regexp_extract(url, '{u}', 1)) || '://' ||
  case lower(regexp_extract(url, '{u}', 1))
    when 'http' then regexp_replace(lower(regexp_extract(url, '{u}', 2)), ':80$', '')
    when 'https' then regexp_replace(lower(regexp_extract(url, '{u}', 2)), ':443$', '')
    else lower(regexp_extract(url, '{u}', 2)) end ||
  case when regexp_extract(url, '{u}', 3) = '' then '/' else regexp_extract(url, '{u}', 3) end ||
  case when len(list_filter(string_split(substr(regexp_extract(url, '{u}', 4), 2), '&'), lambda q: q <> '')) > 0 then '?' ||
    array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(url, '{u}', 4), 2), '&'), lambda q: q <> '')), '&')
    else '' end end""".replace("{u}", _URL)

REVISITS_SQL = rf"""
with made as (
  select page_id as n, url, '"' || substr(md5(html), 1, 16) || '"' as tag, md5(html) as digest,
    page_id * 7 % 500 as first from pages),
responses as (
  select n * 3 as id, url, 1700000000 + first * 3600 as seen, digest, tag, 'day ' || (first % 30) as since,
    ['cache-control: max-age=60', 'content-type: text/html', 'etag: ' || tag, 'last-modified: day ' || (first % 30),
     'set-cookie: s=' || n] as lines from made),
revisits as (
  select n * 3 + 1 as id, case when n % 3 = 0 then url || '#part'
      else regexp_replace(url, '^http://([^/]+)/', 'HTTP://\1:80/') end as url,
    1700000000 + (first + n % 11) * 3600 as seen,
    case when n % 5 = 0 then 'W/' || tag when n % 7 = 0 then '"old"' else tag end as tag, null as since,
    ['cache-control', 'etag'] as names,
    ['cache-control: max-age=90', 'etag: ' || case when n % 5 = 0 then 'W/' || tag when n % 7 = 0 then '"old"' else tag end]
      as lines from made
  union all
  select n * 3 + 2, url, 1700000000 + (first + 13 + n % 200) * 3600, null,
    case when n % 4 <> 0 then 'day ' || (first % 30) end,
    case when n % 4 = 0 then ['date'] else ['date', 'last-modified'] end,
    case when n % 4 = 0 then ['date: today'] else ['date: today', 'last-modified: day ' || (first % 30)] end from made),
known as (select * exclude (url), {_CANONICAL} as url from responses),
asking as (select * exclude (url), {_CANONICAL} as url from revisits),
met as (
  select a.id, a.url, a.seen, a.tag, a.since, a.names, a.lines, k.id as found, k.tag as ktag, k.since as ksince,
    k.lines as klines, k.digest, row_number() over (partition by a.id order by k.seen desc, k.id desc) as r
  from asking a left join known k on a.url = k.url and k.seen < a.seen),
judged as (
  select *, case when found is null then 'no_response' when tag is null and since is null then 'no_validator'
    when tag is not null and regexp_replace(tag, '^W/', '') = ktag then 'resolved'
    when tag is null and since = ksince then 'resolved' else 'mismatch' end as status
  from met where r = 1)
select id as record_id, url, seen as date, status, found as refers_to,
  case when status = 'resolved' then array_to_string(list_sort(list_concat(
    list_filter(klines, lambda l: not list_contains(names, split_part(l, ': ', 1))), lines)), chr(10)) end as headers,
  case when status = 'resolved' then digest end as digest
from judged
"""
