"""A corpus pipeline of the numbered operators: documents in, token ids out.

Each stage reads what the stage before kept, as Parquet in the shared folder,
and its decisions take effect. Null texts count as empty, rows that repeat go
through one by one up to the near-duplicate stage, which keeps one of each
group; empty tables and further columns are fine in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common, decontaminate, language_id, mixing, near_dup, queries, token_output

#: A text that needs more phrases per symbol than this is in none of the languages.
MAX_PHRASE_RATE = 0.6


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language; null, empty and letterless texts go, and random strings."""
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    said = language_id.identify(packed, language_id.train(docs), keep=("row",))
    return said.filter((F.col("lang_pred") != "und") & (F.col("phrase_rate") <= MAX_PHRASE_RATE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each near-duplicate group, once; rows without id stay.

    Five-word shingles, similarity 0.8 or more. Of rows that share the kept id the first by text stays.
    """
    kept = near_dup.near_duplicates(docs, near_dup.Likeness(shingle=5, percent=80)).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = named.withColumn("__place", place).filter("__place = 1").select(*docs.columns)
    return named.unionByName(docs.filter("doc_id IS NULL"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; all others stay as they are."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return decontaminate.find_overlap(packed, bench, keep=("row",)).filter(F.size("spans") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row for each time that it takes all or part of one.

    A row of a part holds that part of the text, from the start of its first
    to the end of its last word.
    """
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    mixed = mixing.mix(packed, keep=("row",))
    most = F.coalesce(F.array_max(F.transform("passes", lambda p: p["times"])), F.lit(0))
    rows = mixed.withColumn("turn", F.explode(F.when(most > 0, F.sequence(F.lit(1).cast("long"), most)).otherwise(F.array().cast("array<long>"))))
    rows = rows.withColumn("parts", F.filter("passes", lambda p: p["times"] >= F.col("turn")))
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["last"] - p["first"]) == F.col("size")
    # Words of the text, to cut parts from; blocks next to each other stay together with the white space between.
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.regexp_replace(F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("words"), (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int")))), ""), r"[\x20\x09-\x0D]+$", "")
    rows = rows.withColumn("whole", whole).withColumn("words", F.when(~F.col("whole"), words))
    rows = rows.withColumn("cut", F.when(F.col("whole"), F.col("row.text")).otherwise(cut))
    return rows.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as ORC, and what reads back from them per document."""
    path = common.new_path(spark, "tokens")
    token_output.write_tokens(docs, path, queries.default_tokenizer(), end_id=2)
    return token_output.read_tokens(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_ids),
]

#: Suffix automata, MinHash, seeded blocks and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``.

    What a stage writes on the way is deleted when its result is written, and
    that when the next one's is, so that the folder holds two stages at most.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, function in STAGES:
        path = common.new_path(spark, "stage")
        with common.scratch(spark):
            done = function(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before:
            common.discard(spark, before)
        before = path
    return docs
