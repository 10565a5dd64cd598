"""Removal of repeated passages by overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines of a text, unless all are blank, are a window. Windows are compared by 128
bits of hash over the whole table; the first occurrence of a window is that of the least (doc_id, line),
and every line that a later occurrence covers is removed. The line of the first occurrence at the same place
of the window comes strictly earlier, so some copy of every removed line stays.

Null text has no line and stays null; a text of one or two lines is never changed. A null doc_id comes
before all others. Rows of equal doc_id and text are one occurrence: they keep or lose the same lines.
Extra columns are kept, whatever their names; the added ones are ``counted`` and ``removed``, and a column of the input with one of those
names is an error. An empty table gives no rows. A text of very many lines is one row: its windows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPAN = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, body, at, h1, h2): one row a window; ``body`` tells texts of equal doc_id apart."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("body"), F.split("text", "\n").alias("lines"))
    lines = lines.where(F.size("lines") >= SPAN).select("doc_id", "body", "lines", F.posexplode(F.slice("lines", 1, F.size("lines") - (SPAN - 1))).alias("at", "a"))
    rows = lines.select("doc_id", "body", "at", "a", F.expr("lines[at + 1]").alias("b"), F.expr("lines[at + 2]").alias("c"))
    rows = rows.where("trim(a) != '' or trim(b) != '' or trim(c) != ''")
    return rows.select("doc_id", "body", "at", F.xxhash64("a", "b", "c").alias("h1"), F.xxhash64("c", F.lit(1), "a", F.lit(2), "b").alias("h2"))


def later_windows(found: DataFrame) -> DataFrame:
    """(doc_id, body, at) of the windows that occurred before.

    Firsts are reduced in each task before the exchange; only repeated hashes come back to the join,
    each of them once, and the engine splits a hash with many windows over several tasks.
    """
    place = F.struct(F.col("doc_id"), F.col("at"), F.col("body"))
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h1", "h2", "first")
    return found.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "body", "at")


def dedup_lines(docs: DataFrame, counted: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """All columns of ``docs``, with the repeated lines gone from ``text``, and the numbers of lines there were and of those removed."""
    if taken := {counted, removed} & set(docs.columns):
        raise ValueError(f"{', '.join(sorted(taken))} would be given twice; choose other names")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda p: F.sequence(p, p + (SPAN - 1)))))
    gone = later_windows(windows(docs)).groupBy("doc_id", "body").agg(covered.alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").alias("text"), F.xxhash64("text").alias("own"))
    rows = rows.join(gone, F.col("row.doc_id").eqNullSafe(gone["doc_id"]) & (F.col("own") == gone["body"]), "left").select("row", "text", "gone")
    lines = F.split("text", "\n")
    rows = rows.withColumn("n", F.coalesce(F.greatest(F.size(lines), F.lit(0)), F.lit(0)).cast("long")).withColumn("k", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    rows = rows.withColumn("lines", F.when(F.col("k") > 0, lines))
    stays = F.array_except(F.expr("sequence(0, cast(n as int) - 1)"), F.col("gone"))
    left = F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("k") > 0, left).otherwise(F.col("text"))
    return rows.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], F.col("n").alias(counted), F.col("k").alias(removed))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = """
with split as (select doc_id, text, string_split(text, chr(10)) as l from documents),
windows as (
  select doc_id, pos, l[pos] as a, l[pos + 1] as b, l[pos + 2] as c
  from (select doc_id, l, unnest(range(1, len(l) - 1)) as pos from split)
  where trim(l[pos], ' ') != '' or trim(l[pos + 1], ' ') != '' or trim(l[pos + 2], ' ') != ''),
later as (
  select doc_id, pos from (
    select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as k from windows)
  where k > 1),
gone as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as i from later),
lines as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from split),
kept as (
  select doc_id, string_agg(line, chr(10) order by i) as text, count(*) as n
  from lines anti join gone using (doc_id, i) group by doc_id)
select s.doc_id, case when s.text is null then null else coalesce(k.text, '') end as text,
  coalesce(len(s.l), 0) as n_lines, coalesce(len(s.l), 0) - coalesce(k.n, 0) as n_removed
from split s left join kept k using (doc_id)
"""
