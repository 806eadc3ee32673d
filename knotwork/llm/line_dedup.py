"""Lines that many documents repeat, dropped everywhere but in one document. DataFrame operations only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points that at least ``min_docs`` documents hold lose their lines in all
documents but the one with the largest id; there every such line stays.

Plan. The lines are exploded with their positions and hashed to 128 bits. Grouping first by (hash,
document) and then by hash counts distinct documents with partial sums on both levels, so that a line
of every document costs a task one row per upstream task. Repeated keys are written to the shared folder and
join back to the lines; both sides of that equi-join are shuffled for it alone, so adaptive execution can
split the partition of a frequent key. Only positions are gathered per
document; the text is shuffled once, to meet them.

Cases. Null or empty text: one empty line. Rows that share an id count as one document but keep their
own lines; a null id counts as one further document, smaller than all others. Fully repeated rows each
get the same result. Extra columns pass through; ``n_lines`` and ``n_dropped`` of the input give way. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .common import own_name, replace_columns

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that where a string has only ASCII."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, th, pos, h1, h2) of each line whose key is long enough."""
    key = ascii_lower(F.col("s"))
    return (
        docs.select("id", "th", F.posexplode("lines").alias("pos", "line"))
        .select("id", "th", "pos", F.btrim("line", F.lit(SPACE)).alias("s"))
        .where(F.char_length("s") >= min_chars)
        .select("id", "th", "pos", key.alias("k"))
        .select("id", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text_col``, and ``n_lines`` (before) and ``n_dropped``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines"))
    lines = _lines(slim, min_chars)
    repeated = materialise(
        lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "keeper"),
        "repeated-lines",
    )
    id_, th_, gone, whole, key, parts = (own_name(docs, x) for x in ("id", "hash", "gone", "text", "key", "lines"))
    losing = (
        lines.join(repeated, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "th").agg(F.collect_set("pos").alias(gone))
        .select(F.col("id").alias(id_), F.col("th").alias(th_), gone)
    )
    own = docs.withColumn(whole, text).withColumn(key, F.xxhash64(whole))
    met = own.join(losing, own[f"`{id_col}`"].eqNullSafe(losing[id_]) & (own[key] == losing[th_]), "left")
    met = met.withColumn(parts, F.split(whole, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(whole)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    out = replace_columns(met, n_lines=F.size(parts).cast("long"), n_dropped=F.coalesce(F.size(gone), F.lit(0)).cast("long"), **{text_col: kept})
    return out.drop(whole, key, id_, th_, gone, parts)
