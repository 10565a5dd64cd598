"""Not-modified revisits: each is resolved to the latest earlier full response of its canonical URL.

Records are rows (record_id, kind, url, at, status, headers, payload); kind is ``response`` or ``revisit``.
A revisit takes the newest response of the same canonical URL with an earlier time (of equal times the
lower record_id counts as earlier). If both name an entity tag, the tags must agree by weak comparison; else, if both name
a modification date, the dates must be equal; else nothing confirms it. A confirmed revisit gets the response's
payload and its headers, in which the revisit's own values replace those that a not-modified answer may
update; headers that describe the stored body are never replaced.

The as-of join is a scan in two levels over narrow rows: each time slice of a URL finds its last response,
these are carried over the slices, and within a slice each revisit looks back. So a URL that holds a third
of all rows is spread over its slices. Header and payload columns join the result afterwards by record_id.

outcome: ``resolved``, ``mismatch`` (validators differ), ``unconfirmed`` (no common validator), ``orphan`` (no earlier response).
A null or empty URL is its own canonical form "" and is never joined; a null time is an orphan. Null headers count as
none; names compare without case. Repeated record_ids are resolved each by its own row. Extra columns, whatever their names, are ignored.
An empty table gives no rows. Payloads may be very long; they pass the last join only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The headers that a not-modified answer may update.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

#: Query arguments that only track where a reader came from.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"

#: Slices of the time line, by quantiles.
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, ``www.`` and default port; no fragment, tracking arguments or last slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, rf"([?&]){TRACKING}=[^&]*", "$1")
    u = F.regexp_replace(u, r"&&+", "&")
    u = F.regexp_replace(u, r"\?&+", "?")
    u = F.regexp_replace(u, r"[?&]+$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    return F.coalesce(F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1")), F.lit(""))


def lower_headers(headers: Column) -> Column:
    """Header names in lower case; of names that then clash the last holds."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda f: f["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, own: Column) -> Column:
    """``stored`` with the values of ``own`` for the names in UPDATED."""
    permitted = F.map_filter(own, lambda k, v: k.isin(*UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)


def as_of(rows: DataFrame, slices: int = SLICES) -> DataFrame:
    """Add ``found``: the record_id of the latest earlier response for each revisit of (record_id, kind, site, at).

    The driver holds the slices' ends. Each (site, slice) is reduced to its last response before the carry.
    """
    seconds = F.unix_micros(F.col("at").cast("timestamp"))
    rows = rows.withColumn("__us", seconds)
    ends = rows.agg(F.percentile_approx("__us", [k / slices for k in range(1, slices)], 10_000)).first()[0] or [0]
    slice_of = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in sorted(set(ends))]), lambda e: e < F.col("__us")))
    rows = rows.withColumn("__slice", slice_of)
    response = F.when(F.col("kind") == "response", F.struct("__us", "record_id"))
    last = rows.groupBy("site", "__slice").agg(F.max(response).alias("last"))
    before = Window.partitionBy("site").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("site", "__slice", F.max("last").over(before).alias("carried"))
    near = Window.partitionBy("site", "__slice").orderBy("__us", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__near", F.max(response).over(near)).join(carried, ["site", "__slice"])
    return rows.withColumn("found", F.coalesce("__near", "carried")["record_id"]).drop("__us", "__slice", "__near", "carried")


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row a revisit: record_id, site, outcome, response_id, status, headers, payload."""
    records = records.select("record_id", "kind", canonical_url(F.col("url")).alias("site"), "at", "status", lower_headers(F.col("headers")).alias("headers"), "payload")
    narrow = records.select("record_id", "kind", "site", "at").where("at is not null and site != ''")
    found = as_of(narrow, slices).where("kind = 'revisit' and found is not null").select("record_id", "site", "at", "found")
    asked = records.where("kind = 'revisit'").select("record_id", "site", "at", F.col("headers").alias("own"))
    stored = records.where("kind = 'response'").select(F.col("record_id").alias("found"), F.col("site").alias("__site"), F.col("headers").alias("stored"), "status", "payload").dropDuplicates(["found", "__site"])
    df = asked.join(found.dropDuplicates(["record_id", "site", "at"]), ["record_id", "site", "at"], "left")
    df = df.join(stored, (df.found == stored.found) & (df.site == F.col("__site")), "left").drop(stored.found)
    tag = lambda h: F.regexp_replace(F.get(F.array(F.col(h)["etag"]), F.lit(0)), "^W/", "")
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    dates = F.col("own")["last-modified"], F.col("stored")["last-modified"]
    outcome = (
        F.when(F.col("found").isNull(), "orphan")
        .when(both(tag("own"), tag("stored")), F.when(tag("own") == tag("stored"), "resolved").otherwise("mismatch"))
        .when(both(*dates), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unconfirmed")
    )
    df = df.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return df.select(
        "record_id",
        "site",
        "outcome",
        F.col("found").alias("response_id"),
        F.when(done, F.col("status")).alias("status"),
        F.when(done, merged_headers(F.col("stored"), F.col("own"))).otherwise(F.col("own")).alias("headers"),
        F.when(done, F.col("payload")).alias("payload"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """The crawl that ``pages`` stands for: a full response of every page and a later revisit of it.

    Times follow page_id. A page's tag is the digest of its html. Every fifth revisit carries another tag, every
    seventh no tag but a date, every eleventh neither, and every thirteenth was made before the response.
    """
    id_, start = F.col("page_id"), F.lit("2024-01-01").cast("timestamp")
    at = lambda s: F.timestamp_micros(F.unix_micros(start) + s * 1_000_000)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), (id_ % 28).cast("string"))
    full = F.map_from_arrays(F.array(*map(F.lit, ("Content-Type", "ETag", "Last-Modified", "Cache-Control"))), F.array(F.lit("text/html"), tag, day, F.lit("max-age=60")))
    own = (
        F.when(id_ % 11 == 0, F.map_from_arrays(F.array(F.lit("Cache-Control")), F.array(F.lit("max-age=600"))))
        .when(id_ % 7 == 0, F.map_from_arrays(F.array(F.lit("Last-Modified"), F.lit("Cache-Control")), F.array(day, F.lit("max-age=600"))))
        .when(id_ % 5 == 0, F.map_from_arrays(F.array(F.lit("etag"), F.lit("Content-Type")), F.array(F.lit('"other"'), F.lit("text/plain"))))
        .otherwise(F.map_from_arrays(F.array(F.lit("etag"), F.lit("Content-Type"), F.lit("Expires")), F.array(F.concat(F.lit("W/"), tag), F.lit("text/plain"), day)))
    )
    when = F.when(id_ % 13 == 0, id_ * 10 - 1).otherwise(id_ * 10 + 100_000)
    responses = pages.select((id_ * 2).alias("record_id"), F.lit("response").alias("kind"), "url", at(id_ * 10).alias("at"), F.lit(200).alias("status"), full.alias("headers"), F.col("html").alias("payload"))
    revisits = pages.select((id_ * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", at(when).alias("at"), F.lit(304).alias("status"), own.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return responses.union(revisits)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return df.select("record_id", "site", "outcome", "response_id", "status", listed.alias("headers"), F.md5("payload").alias("payload_md5"))


ORACLE = r"""
with cleaned as (
  select page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url),
    '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'),
    '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') as u from pages),
pages2 as (
  select page_id, html, coalesce(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '/+(\?|$)', '\1', 'g'), '') as site from cleaned),
responses as (select page_id * 2 as id, site, page_id * 10 as moment, page_id, '"' || md5(coalesce(html, '')) || '"' as tag, 'day ' || (page_id % 28) as day, html from pages2),
revisits as (
  select page_id * 2 + 1 as id, page_id, site, case when page_id % 13 = 0 then page_id * 10 - 1 else page_id * 10 + 100000 end as moment,
    case when page_id % 11 = 0 or page_id % 7 = 0 then null when page_id % 5 = 0 then '"other"' else '"' || md5(coalesce(html, '')) || '"' end as tag,
    case when page_id % 11 = 0 or page_id % 7 != 0 then null else 'day ' || (page_id % 28) end as day from pages2),
joined as (
  select v.id, v.page_id, v.site, v.tag, v.day, r.id as response_id, r.tag as r_tag, r.day as r_day, r.html,
    row_number() over (partition by v.id order by r.moment desc, r.id desc) as k
  from revisits v left join responses r on v.site = r.site and v.site != '' and (r.moment < v.moment or r.moment = v.moment and r.id < v.id)),
judged as (
  select *, case when response_id is null then 'orphan' when tag is not null then case when tag = r_tag then 'resolved' else 'mismatch' end
    when day is not null then case when day = r_day then 'resolved' else 'mismatch' end else 'unconfirmed' end as outcome
  from joined where k = 1)
select id as record_id, site, outcome, response_id, case when outcome = 'resolved' then 200 end as status,
  case when outcome = 'resolved' and tag is null then 'cache-control=max-age=600;content-type=text/html;etag=' || r_tag || ';last-modified=' || day
    when outcome = 'resolved' then 'cache-control=max-age=60;content-type=text/html;etag=W/' || tag || ';expires=day ' || (page_id % 28) || ';last-modified=' || r_day
    when page_id % 11 = 0 then 'cache-control=max-age=600'
    when page_id % 7 = 0 then 'cache-control=max-age=600;last-modified=' || day
    when page_id % 5 = 0 then 'content-type=text/plain;etag="other"'
    else 'content-type=text/plain;etag=W/' || tag || ';expires=day ' || (page_id % 28) end as headers,
  case when outcome = 'resolved' then md5(html) end as payload_md5
from judged
"""
