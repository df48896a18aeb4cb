"""Licence scans by canonical digest.

A text is brought to a canonical form, in which case, punctuation, white space, copyright lines and equivalent
spellings no longer count, and its digest is looked up: whole texts by a hash join with the digests of known
licences, and each line that may be a notice in the table of known notices. Both tables are fixed by the code
and so of bounded size. Only built-in functions run over the texts.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES, TEXTS

#: Lines about copyright alone: they differ from copy to copy.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(?:copyright\b|\(c\) |©)[^\n]*$"
#: Not a letter or digit; letters beyond ASCII stay, so that texts in any language keep their difference.
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Spellings that count as the same, applied in this order to lower case.
SPELLINGS = [
    ("https://", "http://"),
    ("licenc", "licens"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("non-infring", "noninfring"),
    ("non-commercial", "noncommercial"),
    ("sub-licens", "sublicens"),
]
#: Every notice has one of these in its canonical form, and so in lower case.
TRIGGER = r"licens|licenc|released under|distributed under|available under|rights reserved|public domain"


def canonical(text: Column) -> Column:
    """The canonical form; without the copyright lines."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, BETWEEN, " "))


def canonical_text(text: str) -> str:
    """:func:`canonical` of one string."""
    out = re.sub(COPYRIGHT, "", text.lower())
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", out).strip(" ")


def _digests(known: list[tuple[str, str]]) -> dict[str, str]:
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, t in known}


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: list[tuple[str, str]] = TEXTS,
    notices: list[tuple[str, str]] = NOTICES,
    digests: dict[str, str] = DIGESTS,
) -> DataFrame:
    """(doc_id, digest, license, notices): for each row of docs the SHA-256 of its canonical text, the licence
    that its whole text is by texts or digests (null: none), and the licences that a line of it is a notice of, sorted.

    Null texts count as empty; an empty canonical form is no licence. Rows repeated are kept, any id goes, an
    empty table gives an empty result. A text that equals a licence and also holds a notice has both.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    by_notice = _digests(notices)
    names = F.create_map(*(F.lit(x) for pair in by_notice.items() for x in pair))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.lower(x).rlike(TRIGGER))
    said = F.transform(lines, lambda x: F.try_element_at(names, F.sha2(canonical(x), 256)))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.sha2(canonical(text), 256).alias("digest"),
        F.array_sort(F.array_distinct(F.array_compact(said))).alias("notices"),
    )
    known = spark.createDataFrame(sorted((digests | _digests(texts)).items()), "digest string, license string")
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license", "notices")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), {_sql_text(COPYRIGHT)}, '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, {_sql_text(BETWEEN)}, ' ', 'g'))"


def _values(known: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{d}', '{n}')" for d, n in sorted(_digests(known).items()))


OP5_SQL = f"""
with texts(digest, license) as (values {_values(TEXTS)}),
notices(nd, name) as (values {_values(NOTICES)}),
d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
lines as (select r, unnest(string_split(text, chr(10))) line from d),
said as (
  select r, string_agg(distinct name, ',' order by name) names
  from (select r, sha256({_sql_canonical("line")}) nd from lines where regexp_matches(lower(line), '{TRIGGER}')) join notices using (nd)
  group by r),
c as (select r, doc_id, sha256({_sql_canonical("text")}) digest from d)
select doc_id, digest, license, coalesce(names, '') notices
from c left join texts using (digest) left join said using (r)
"""
