"""Operator 1, exact dedup by content-defined chunk recipes (native).

Every text is cut into chunks at places that its own characters choose, so
equal texts are cut alike wherever they stand. Distinct chunks are
deduplicated to identifiers; an identifier is verified by comparing the
chunk texts that share its hash. A document is then represented by its
recipe, the ordered list of its chunk identifiers, and documents are equal
exactly when their recipes are. Chunk texts move through one shuffle, each
distinct chunk once per map task; whole documents never move.

Cases: a null text counts as empty; an empty text has the empty recipe;
texts longer than any chunk are cut at ``max_chars``; rows that repeat a
doc_id count in ``group_size`` and share its verdict; a null doc_id is never
the one that stays unless all ids of its group are null; an empty table
gives an empty result. Other columns of the input are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, first_row, keyed, own_name, same_row, stored, table, text_or_empty

MIN_CHARS, MAX_CHARS = 256, 2048
# A chunk ends at a place that the characters around it choose, about one in a
# hundred. Latin letters: after one of a few pairs. Other scripts with spaces:
# after a word of two letters between others. Scripts without spaces: after a
# character whose last byte is in a small range (a rule over the blocks of
# Han, kana and Hangul; one letter each of Thai, Lao, Burmese and Khmer). A
# text without such places (a run of one character) is cut at ``max_chars``.
LATIN = "[es] [a-d]|[nt] [lm]|r [oq]|[.!?][ ]"
SPACED = r"[^\x00-\x7F] [^\x00-\x7F]{2} (?=[^\x00-\x7F])"
UNSPACED = "[" + "\u0e18\u0e98\u1018\u1798" + "".join(
    f"{chr(block << 8 | 0x60)}-{chr(block << 8 | 0x62)}" for block in range(0x30, 0xD7)) + "]"
DIVISOR = rf"(?:{LATIN}|(?=[^\x00-\x7F])(?:{SPACED}|{UNSPACED}))"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def chunks_of(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS,
              divisor: str = DIVISOR) -> Column:
    """The text cut into chunks, in order; joined they are the text again."""
    def cut(ends: str) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{{min_chars},{max_chars}}}?{ends}|.{{1,{max_chars}}}"), F.lit(0))

    if divisor != DIVISOR:
        return cut(divisor)
    # a text of ASCII alone has no other places than Latin ones; the search for those is cheaper
    return F.when(F.octet_length(text) == F.char_length(text), cut(f"(?:{LATIN})")).otherwise(cut(divisor))


def distinct_chunks(chunked: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """(h, chunk): each distinct chunk once, with its hash. The plain ``explode``
    would have the planner put a filter for empty lists below the cut, where
    the text is normalised and cut a second time."""
    return (chunked.select(F.explode_outer("_chunks").alias("_chunk")).where(F.col("_chunk").isNotNull())
            .select(chunk_hash(F.col("_chunk")).alias("_h"), "_chunk").distinct())


def chunk_recipes(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64,
                  min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """doc_id (or other ``keys``), text_sha256, recipe and ties of every row. ``recipe`` lists the
    chunk hashes; ``ties`` lists the numbers that tell apart chunks of equal
    hash (empty where the hash alone is the verified identifier)."""
    text = docs.select(*keys, normalised(text_or_empty()).alias("_text"))
    chunked = text.select(*keys, "_text", chunks_of(F.col("_text"), min_chars, max_chars).alias("_chunks"))
    recipes = stored(chunked.select(
        *keys, F.sha2(F.col("_text"), 256).alias("text_sha256"),
        F.transform("_chunks", lambda c: chunk_hash(c)).alias("recipe")), "recipes")
    distinct = distinct_chunks(chunked, chunk_hash)
    shared = stored(distinct.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"), "shared")
    if shared.isEmpty():  # every hash stands for one chunk text
        return recipes.withColumn("ties", F.array().cast("array<long>"))
    # number the chunks of a shared hash; per text, list its numbered chunks as position and number in turn
    rank = F.row_number().over(W.partitionBy("_h").orderBy("_chunk")).cast("long")
    ranks = stored(distinct.join(shared, "_h", "left_semi").withColumn("_rank", rank), "ranks")
    pieces = (chunked.select(F.sha2(F.col("_text"), 256).alias("text_sha256"), "_chunks").distinct()
              .select("text_sha256", F.posexplode_outer("_chunks").alias("_pos", "_chunk")).where(F.col("_chunk").isNotNull())
              .withColumn("_h", chunk_hash(F.col("_chunk"))))
    ties = (pieces.join(ranks, ["_h", "_chunk"]).groupBy("text_sha256")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").cast("long").alias("_at"), "_rank"))).alias("_t"))
            .select("text_sha256", F.flatten(F.transform("_t", lambda t: F.array(t["_at"], t["_rank"]))).alias("ties")))
    return (recipes.join(ties, "text_sha256", "left")
            .withColumn("ties", F.coalesce("ties", F.array().cast("array<long>"))))


def exact_groups(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = chunk_recipes(docs, **how)
    groups = rows.groupBy("recipe", "ties").agg(F.min("doc_id").alias("keep_id"),
                                                F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["recipe", "ties"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each
    group, also where its ids are null or repeated."""
    own = own_name()
    docs = keyed(docs, own)
    rows = chunk_recipes(docs, keys=("doc_id", own), **how)
    groups = rows.groupBy("recipe", "ties").agg(first_row(own).alias("_first"))
    gone = (rows.join(groups, ["recipe", "ties"])
            .where(~(F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & F.col(own).eqNullSafe(F.col("_first.own"))))
            .select(F.col("doc_id").alias("_gone_id"), F.col(own).alias("_gone_own")))
    return docs.join(gone, same_row(docs, gone, own, "_gone_id", "_gone_own"), "left_anti").drop(own)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE_SQL = {"op1_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""}
