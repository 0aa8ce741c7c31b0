"""Corpus ETL: exploding nested passages, filters, both kinds of deduplication, splits, samples, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import ranks
from quillstone.sources import tables

MIN_CHARS = {"v1": 20, "v2": 40}


def expand_passages(rows: DataFrame, lang: str, min_chars: int = 40) -> DataFrame:
    """One document for each English passage and its translation, by position in the English list; short ones are dropped."""
    item = F.posexplode(F.arrays_zip("passages.English_passages", "passages.Translated_passages", "passages.is_selected")).alias("i", "p")
    each = rows.withColumn("n_english", F.size("passages.English_passages")).select("*", item).where("i < n_english")
    sides = F.explode(F.array(F.struct(F.lit("en").alias("variant"), F.col("p.English_passages").alias("raw")), F.struct(F.lit("native").alias("variant"), F.col("p.Translated_passages").alias("raw"))))
    out = each.select("*", sides.alias("side")).withColumn("text", T.normalize(F.col("side.raw")))
    return out.where(F.length("text") >= min_chars).select(
        F.concat_ws(":", "query_id", F.lit(lang), "i", "side.variant").alias("doc_id"), "text", F.lit(lang).alias("lang"), F.col("side.variant").alias("variant"), "query_id",
        F.lower(F.trim(F.coalesce("query_type", F.lit("")))).alias("query_type"), F.coalesce(F.expr("nullif(query, '')"), F.expr("nullif(Eng_Query, '')"), F.lit("")).alias("source_query"),
        F.coalesce("Eng_Query", F.lit("")).alias("eng_query"), F.coalesce("p.is_selected", F.lit(0)).cast("int").alias("is_selected"),
        F.expr("nullif(Answer, '')").alias("answer"), F.expr("nullif(Eng_Answer, '')").alias("eng_answer"), F.length("text").alias("n_chars"),
    )


def expand_both(rows: DataFrame, language: str, flores: str, min_chars: int = 20) -> DataFrame:
    """v1: each list by its own length, translated first; rows without a query or passages are dropped."""
    kept = rows.where((F.coalesce("query", F.lit("")) != "") | (F.coalesce("Eng_Query", F.lit("")) != ""))
    sides = [
        kept.select("query_id", "query_type", "passages.is_selected", F.posexplode(f"passages.{name}").alias("i", "raw"), F.lit(code).alias("language"), F.lit(fl).alias("flores_code"), F.lit(english).alias("is_english"))
        for name, code, fl, english in (("Translated_passages", language, flores, False), ("English_passages", "en", "eng_Latn", True))
    ]
    every = sides[0].unionByName(sides[1]).withColumn("text", T.normalize(F.col("raw"), "v1")).where(F.length("text") >= min_chars)
    return every.select(T.doc_hash(F.col("text")).alias("doc_hash"), "text", "language", "flores_code", "is_english", query_type("query_type").alias("query_type"), (F.coalesce(F.get("is_selected", F.col("i")), F.lit(0)) == 1).alias("is_selected"), F.array("query_id").alias("source_query_ids"))


def query_type(name: str) -> Column:
    """The known types; any other is UNKNOWN."""
    upper = F.upper(F.trim(F.col(name)))
    return F.when(upper.isin("DESCRIPTION", "ENTITY", "LOCATION", "NUMERIC", "PERSON"), upper).otherwise("UNKNOWN")


def gold_ids(rows: DataFrame, lang: str) -> DataFrame:
    marked = F.filter(F.transform("passages.is_selected", lambda s, i: F.when(s == 1, i)), lambda i: i.isNotNull())
    named = F.flatten(F.transform(marked, lambda i: F.array(*[F.concat_ws(":", F.col("query_id"), F.lit(lang), i, F.lit(v)) for v in ("en", "native")])))
    return rows.select("query_id", named.alias("gold_doc_ids"))


def first_wins(docs: DataFrame, key: Column, order: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """dedup_key, the first row's ``order`` and ``columns``, n_copies. Combined before the shuffle, so a key may hold any share of the rows, and nothing but these columns moves."""
    keyed = docs.withColumn("dedup_key", key)
    return keyed.groupBy("dedup_key").agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in columns], F.count(F.lit(1)).alias("n_copies"))


#: Fixed value: ids of copies that a document lists at most.
LISTED = 50


def merged(docs: DataFrame, key: Column, order: str, ids: str, flag: str, listed: int = LISTED) -> DataFrame:
    """One row a key: the first ``listed`` ids in the order of their rows, repeats included, the number of all, flag true if any is; the rest from the first row.

    ``members`` has all ids of all keys, a row each.
    """
    # texts are read, and keys made of them, once
    keyed = tables.written(docs.withColumn("dedup_key", key).select("dedup_key", "lang", flag, *{order: 1, ids: 1}))
    one = keyed.groupBy("dedup_key").agg(F.min(order).alias(order), F.min_by("lang", order).alias("lang"), F.bool_or(flag).alias(flag), F.count(F.lit(1)).alias("n_copies"))
    # in the order of the rows, as they were concatenated; each task keeps its own first ones before the shuffle
    nth = F.row_number().over(Window.partitionBy("dedup_key").orderBy(order, ids))
    first = keyed.select("dedup_key", F.col(order).alias("at"), F.col(ids).alias("id"), nth.alias("nth")).where(F.col("nth") <= listed)
    some = first.groupBy("dedup_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    return one.join(some, "dedup_key")


def members(docs: DataFrame, key: Column, ids: str) -> DataFrame:
    """A row for each document: its key and the first id that has it."""
    keyed = docs.select(F.col(ids), key.alias("dedup_key"))
    return keyed.join(keyed.groupBy("dedup_key").agg(F.min(ids).alias("first_id")), "dedup_key").select(ids, "dedup_key", "first_id")


def holdout(docs: DataFrame, group: str, order: str, share: float = 0.85) -> DataFrame:
    """is_heldout: rows from position int(n * share) of their group on; n is the group's rows. Ids are different within a group."""
    placed = ranks.counted(docs, group, order)
    first = placed.groupBy(group).agg(ranks.at_rank(order, F.floor(F.col("n") * share) + 1).alias("first_heldout")).withColumnRenamed(group, "group_of_first")
    return docs.join(first, F.col(group).eqNullSafe(F.col("group_of_first"))).withColumn("is_heldout", F.coalesce(F.col(order) >= F.col("first_heldout"), F.lit(False))).drop("group_of_first", "first_heldout")


def holdout_asked(rows: DataFrame, asked: int, place: str = "place", share: float = 0.85) -> DataFrame:
    """Of the first ``asked`` rows of a source, by their place: is_heldout from position int(asked * share) on. A file with fewer rows holds out fewer, or none."""
    return rows.where(F.col(place) < asked).withColumn("is_heldout", F.col(place) >= int(asked * share))


def stratified_sample(docs: DataFrame, group: str, key: str, per_group: int, seed: int = 7) -> DataFrame:
    """per_group rows of each group, those with the smallest hash."""
    draw = F.sha2(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)), 256)
    return docs.withColumn("draw", draw).withColumn("draw_rank", F.row_number().over(Window.partitionBy(group).orderBy("draw"))).where(F.col("draw_rank") <= per_group)


def statistics(docs: DataFrame) -> DataFrame:
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("sum_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.round(F.avg("n_chars"), 2).alias("avg_chars"))


def build_statistics(rows: DataFrame, docs: DataFrame, key: str = "doc_hash") -> DataFrame:
    """What a build read and made, one row: source rows read, skipped (no query or no passages), labelled and their gold passages; documents, different ones, repeats."""
    text = (F.coalesce("query", F.lit("")) != "") | (F.coalesce("Eng_Query", F.lit("")) != "")
    n_passages = F.coalesce(F.size("passages.English_passages"), F.lit(0)) + F.coalesce(F.size("passages.Translated_passages"), F.lit(0))
    kept = text & (n_passages > 0)
    gold = F.coalesce(F.size(F.filter("passages.is_selected", lambda s: s == 1)), F.lit(0))
    read = rows.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(~kept).alias("rows_skipped"), F.count_if(kept & (gold > 0)).alias("rows_labelled"), F.sum(F.when(kept, gold).otherwise(0)).alias("gold"))
    made = docs.groupBy(key).count().agg(F.sum("count").alias("documents"), F.count(F.lit(1)).alias("unique")).withColumn("repeats", F.col("documents") - F.col("unique"))
    return read.crossJoin(made)
