"""Sources and sinks: corpus files, JSON lines, index tables, idempotent upsert, pagination, manifests, languages."""

from __future__ import annotations

import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")

#: The columns of a source row that anything reads; its meta struct is never scanned.
SOURCE_COLUMNS = ["source_lang", "target_lang", "query", "Eng_Query", "Answer", "Eng_Answer", "query_id", "query_type", "passages"]

#: Code, name, own name, FLORES code, file stem, speech locale, script, whether there is a train split.
LANGUAGES = (
    ("as", "Assamese", "অসমীয়া", "asm_Beng", "asm", None, "Bengali", True),
    ("bn", "Bengali", "বাংলা", "ben_Beng", "ben", "bn-IN", "Bengali", True),
    ("gu", "Gujarati", "ગુજરાતી", "guj_Gujr", "guj", "gu-IN", "Gujarati", True),
    ("hi", "Hindi", "हिन्दी", "hin_Deva", "hin", "hi-IN", "Devanagari", True),
    ("kn", "Kannada", "ಕನ್ನಡ", "kan_Knda", "kan", "kn-IN", "Kannada", True),
    ("ml", "Malayalam", "മലയാളം", "mal_Mlym", "mal", "ml-IN", "Malayalam", True),
    ("mr", "Marathi", "मराठी", "mar_Deva", "mar", "mr-IN", "Devanagari", True),
    ("ne", "Nepali", "नेपाली", "npi_Deva", "npi", None, "Devanagari", True),
    ("or", "Odia", "ଓଡ଼ିଆ", "ory_Orya", "ory", "od-IN", "Odia", True),
    ("pa", "Punjabi", "ਪੰਜਾਬੀ", "pan_Guru", "pan", "pa-IN", "Gurmukhi", True),
    ("sa", "Sanskrit", "संस्कृतम्", "san_Deva", "san", None, "Devanagari", True),
    ("ta", "Tamil", "தமிழ்", "tam_Taml", "tam", "ta-IN", "Tamil", True),
    ("te", "Telugu", "తెలుగు", "tel_Telu", "tel", "te-IN", "Telugu", False),
    ("ur", "Urdu", "اردو", "urd_Arab", "urd", None, "Perso-Arabic", True),
    ("en", "English", "English", "eng_Latn", "eng", "en-IN", "Latin", True),
)
LANGUAGE_DDL = "code string, name string, native_name string, flores string, file_stem string, locale string, script string, has_train boolean"


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES), LANGUAGE_DDL)


def resolve_language(name: str) -> tuple:
    """By code, then FLORES code, then file stem; od is or."""
    wanted = {"od": "or"}.get(name, name)
    for k in (0, 3, 4):
        for row in LANGUAGES:
            if row[k] == wanted:
                return row
    raise KeyError(f"unknown language {name}")


def locale_of(code: str) -> str:
    return next((row[5] for row in LANGUAGES if row[0] == {"od": "or"}.get(code, code) and row[5]), "hi-IN")


def source_path(root: str, language: str, split: str) -> str:
    row = resolve_language(language)
    if split == "train" and not row[7]:
        raise ValueError(f"{row[1]} has no train split")
    return f"{root}/{split}/{row[4]}{'val' if split == 'validation' else split}.parquet"


def with_retries(call: Callable[[], T], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> T:
    """What the call gives, asked again after 2, 4, ... seconds where it fails."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except (OSError, PySparkException):
            if n == attempts:
                raise
            wait(2.0**n)
    raise AssertionError


def read_source(spark: SparkSession, path: str, limit: int | None = None, columns: list[str] | None = SOURCE_COLUMNS) -> DataFrame:
    """Projected scan, or of all columns; a limit takes the first rows as they stand in the files."""
    if limit:
        return with_place(spark, path, "place_of_row", columns).where(F.col("place_of_row") < limit).drop("place_of_row")
    rows = with_retries(lambda: spark.read.parquet(path))
    return rows.select(*columns) if columns else rows


def with_place(spark: SparkSession, path: str, name: str = "place", columns: list[str] | None = None) -> DataFrame:
    """The rows of Parquet files with their place, from 0: files by name, rows as they stand in their file. Nothing is sorted."""
    rows = with_retries(lambda: spark.read.parquet(path))
    at = rows.select(*(columns or rows.columns), F.col("_metadata.file_path").alias("file_of_row"), F.col("_metadata.row_index").alias("row_in_file"))
    sizes = at.groupBy("file_of_row").agg((F.max("row_in_file") + 1).alias("n"))
    before = Window.orderBy("file_of_row").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sizes.select("file_of_row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_of_file"))
    return at.join(starts, "file_of_row").withColumn(name, F.col("start_of_file") + F.col("row_in_file")).drop("file_of_row", "row_in_file", "start_of_file")


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """With a schema; optional texts that are missing become empty."""
    rows = spark.read.schema(ddl).json(path)
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in optional}) if optional else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only where none is set and all tasks run in this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: what is used more than once is computed once, and outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/quillstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, when nothing that is still to be computed reads it."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if "/quillstone-" in path:
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def version_of(spark: SparkSession, paths: list[str]) -> str:
    """Changes when a file below the paths is added, removed or written again."""
    hadoop, seen = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for path in paths:
        where = hadoop.Path(path)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop.Path(path)) or []
        below = [x for f in found for x in (where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(f.getPath()) if f.isDirectory() else [f])]
        seen += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in below)
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: Rows of a saved corpus and of its queries.
CORPUS_DDL = "text string, language string, flores_code string, is_english boolean, doc_hash string, query_type string, is_selected boolean, source_query_ids array<long>"
QUERIES_DDL = "query_id long, text string, language string, flores_code string, query_type string, relevant_hashes array<string>, candidate_hashes array<string>, english_text string, reference_answer string"


def save_corpus(folder: str, language: str, corpus: DataFrame, queries: DataFrame | None = None, stats: DataFrame | None = None) -> None:
    for name, df in (("corpus", corpus), ("queries", queries), ("stats", stats)):
        if df is not None:
            write_jsonl(df, f"{folder}/{name}_{language}.jsonl")


def load_corpus(spark: SparkSession, folder: str, language: str) -> tuple[DataFrame, DataFrame, dict]:
    """The corpus, which must be there; queries and statistics, which are empty where they aren't."""
    path = lambda name: f"{folder}/{name}_{language}.jsonl"
    if not exists(spark, path("corpus")):
        raise FileNotFoundError(f"no saved corpus at {path('corpus')}")
    queries = read_jsonl(spark, path("queries"), QUERIES_DDL, ("english_text", "reference_answer")) if exists(spark, path("queries")) else spark.createDataFrame([], QUERIES_DDL)
    stats = spark.read.json(path("stats")).first().asDict() if exists(spark, path("stats")) else {}
    return read_jsonl(spark, path("corpus"), CORPUS_DDL), queries, stats


def create_collection(spark: SparkSession, path: str, ddl: str, partitions: tuple[str, ...] = ("strategy", "language"), recreate: bool = False) -> DataFrame:
    """An empty table, partitioned by what searches filter on; one that is there stays as it is unless it is to be made anew."""
    if recreate or not exists(spark, path):
        spark.createDataFrame([], ddl).write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return spark.read.schema(ddl).parquet(path)


def export_latency(summary: DataFrame, records: DataFrame, folder: str) -> None:
    """A summary beside the records that it sums up."""
    write_jsonl(summary.coalesce(1), f"{folder}/summary.json")
    write_jsonl(records, f"{folder}/records.json")


def cached(spark: SparkSession, path: str, build, refresh: bool = False) -> DataFrame:
    """The table at the path; built and written first if it isn't there, or to refresh it."""
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        write_table(build(), path)
    return spark.read.parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, version: str) -> DataFrame:
    """New rows replace those with their keys. Written as another version beside the old one, which stays readable."""
    old = spark.read.parquet(path)
    merged = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
    write_table(merged, f"{path}-{version}")
    return spark.read.parquet(f"{path}-{version}")


def filtered(chunks: DataFrame, languages: list[str] | None = None, english_only: bool = False, strategy: str | None = None) -> DataFrame:
    """english_only overrides languages; predicates reach the scan and its partitions."""
    if english_only:
        chunks = chunks.where("language = 'en'")
    elif languages:
        chunks = chunks.where(F.col("language").isin(languages))
    return chunks.where(F.col("strategy") == strategy) if strategy else chunks


def scroll(table: DataFrame, order: str, limit: int = 20, offset: int = 0) -> tuple[DataFrame, int | None]:
    """A page of 1 to 100 rows, and the offset of the next if there is one."""
    limit = min(100, max(1, limit))
    page = table.orderBy(order).offset(offset).limit(limit)
    more = table.orderBy(order).offset(offset + limit).limit(1).count()
    return page, offset + limit if more else None


def manifest(chunks: DataFrame) -> DataFrame:
    """For each strategy: chunks, documents, upper median and largest number of tokens; no strategy is gathered."""
    from quillstone.operators import ranks

    placed = ranks.counted(chunks, "strategy", "n_tokens")
    sizes = placed.groupBy("strategy").agg(F.max("n").alias("n_chunks"), ranks.at_rank("n_tokens", F.expr("n DIV 2 + 1")).alias("tokens_p50"), F.max("n_tokens").alias("tokens_max"))
    return sizes.join(chunks.groupBy("strategy").agg(F.count_distinct("doc_id").alias("n_docs")), "strategy")


def ingest_manifest(passages: DataFrame, queries: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """What an ingest made, one row: unique passages, queries, chunks, expansion, mean characters of a chunk, vectors and their
    dimension, and passages by language; each input is counted where it lies."""
    of = lambda df, *sums: df.agg(*sums)
    per_language = passages.groupBy(F.coalesce("language", F.lit("")).alias("language")).agg(F.count(F.lit(1)).alias("n"))  # a row a language
    parts = (
        of(passages, F.count(F.lit(1)).alias("unique_passages")),
        of(queries, F.count(F.lit(1)).alias("queries")),
        of(chunks, F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.length("text")), 1).alias("avg_chunk_chars")),
        of(vectors, F.count(F.lit(1)).alias("vectors_indexed"), F.max(F.size("embedding")).alias("dimension")),
        of(per_language, F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("per_language")),
    )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.crossJoin(part)  # one row each
    return whole.withColumn("expansion_ratio", F.round(F.when(F.col("unique_passages") > 0, F.col("chunks") / F.col("unique_passages")).otherwise(0.0), 3))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def migrate(spark: SparkSession, source: str, target: str, vector: str = "embedding") -> tuple[int, int]:
    """Copies a vector table without rows that have no vector; rows read and written."""
    rows = spark.read.parquet(source)
    write_table(rows.where(F.col(vector).isNotNull()), target)
    return rows.count(), spark.read.parquet(target).count()


def self_retrieval(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """Whether each probe (qid, embedding) finds itself first."""
    from quillstone.operators.retrieval import dense_top_k

    return dense_top_k(vectors, probes, 1).select("qid", (F.col("qid") == F.col("chunk_id")).alias("found"))
