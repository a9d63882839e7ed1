"""Operator 10 [native] - licence scans by canonical digest lookup.

A text is made canonical - lower case, punctuation and white space as single spaces, list
numbers, copyright lines and spelling variants out of the way - and the digest of the
whole is hash-joined to the digests of known licences. The same digests of its single
lines tell which one-line notices it carries. The known licences are a fixed list, so
their table is broadcast; everything is DataFrame expressions within one scan, without a
shuffle or any Python on the executors.

Defined results: a null text counts as the empty text, whose digest matches no licence;
known texts that share a digest give the least name;
a title line is part of a text, and each text is known with and without its usual titles; repeated rows are looked up alike;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelake.llm.common import table
from latticelake.llm.licence_texts import LICENCES, SPELLINGS

_GAPS = r"[^\p{L}\p{N}\n]+"
_NUMBERS = r"(?m)^ *[0-9]{1,2} "
_COPYRIGHT = r"^(portions )?copyright( |$)|^c [0-9]{4}( |$)|^all rights reserved$"
_NO_COPYRIGHT = r"^(portions )?copyright (holder|notice|owner|law|license)"


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that are neither blank nor copyright lines."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAPS, " ")
    for spelling, same in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(same))
    lines = F.transform(F.split(F.regexp_replace(out, _NUMBERS, ""), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~(x.rlike(_COPYRIGHT) & ~x.rlike(_NO_COPYRIGHT)))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known(spark: SparkSession) -> DataFrame:
    """(digest, licence) of the fixed list."""
    rows = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in LICENCES))
    listed = spark.range(1).select(F.inline(rows))
    found = listed.groupBy(digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest")).agg(F.min("licence").alias("licence")).collect()
    # digests as literals, so that the plans of scans are without the texts
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r["digest"]).alias("digest"), F.lit(r["licence"]).alias("licence")) for r in found))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, licence, n_notices, notices): the licence that a whole text is, and the notices among its lines."""
    listed = known(docs.sparkSession)
    # the fixed list's digests as a literal, for the look-up of lines
    pairs = F.create_map(*(F.lit(x) for r in listed.collect() for x in (r["digest"], r["licence"])))
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    found = lines.select(
        "doc_id", digest(F.array_join("lines", " ")).alias("digest"), F.filter(F.transform("lines", lambda x: F.try_element_at(pairs, digest(x))), lambda x: x.isNotNull()).alias("own")
    )
    return found.join(F.broadcast(listed), "digest", "left").select(
        "doc_id", "digest", "licence", F.size("own").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("notices"),
    )


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{_GAPS}', ' ', 'g')"
    for spelling, same in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{same}')"
    lines = f"list_transform(string_split(regexp_replace({out}, '{_NUMBERS}', '', 'g'), chr(10)), lambda x: trim(x))"
    return f"list_filter({lines}, lambda x: x <> '' and not (regexp_matches(x, '{_COPYRIGHT}') and not regexp_matches(x, '{_NO_COPYRIGHT}')))"


ORACLE = f"""
with listed(licence, body) as (values {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in LICENCES)}),
known as (select sha256(array_to_string({_lines_sql("body")}, ' ')) digest, min(licence) licence from listed group by 1),
d as (select doc_id, {_lines_sql("text")} lines, row_number() over () as r from documents),
own as (select r, k.licence from (select r, unnest(lines) line from d) x join known k on k.digest = sha256(line)),
notes as (select o.r, count(*) n, (select string_agg(l, ',' order by l) from (select distinct unnest(list(o.licence)) l)) names from own o group by o.r),
w as (select doc_id, r, sha256(array_to_string(lines, ' ')) digest from d)
select w.doc_id, w.digest, k.licence, coalesce(n, 0)::bigint n_notices, coalesce(names, '') notices
from w left join known k on k.digest = w.digest left join notes on notes.r = w.r
"""
