"""The thin queries of the corpus operators, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversation_repair, decontaminate, language_id, license_scan, mixing, near_dup, ngram_join, periodic_runs, quotation, repetition, secrets, token_output, url_filter
from .oracles import ORACLES  # noqa: F401  read by the entry module beside QUERIES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    """Where the 50k byte-level BPE vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=2)
    return token_output.read_tokens(spark, path)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``by_shard`` has the words that each shard takes, shard 0 first."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), shards=mixing.SHARDS)
    return mixed.withColumn("by_shard", mixing.by_shard("passes", mixing.SHARDS)).drop("passes")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    said = language_id.identify(docs, language_id.train(docs))
    return said.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/hundred/doc_id``; those whose whole text is a licence are licence files."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", path.alias("path"), "text")
    found = license_scan.scan_licences(files, keep=("doc_id",))
    return found.select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "how", "licence_path")


def quoting(turns: DataFrame) -> DataFrame:
    """The turns as mail: of every three, the second quotes the turn before it, the third the turn before it with what that quotes."""
    said = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = turns
    for back in (1, 2):
        # Only turns that quote so far back meet a text.
        quoted = said.filter(F.pmod("turn", F.lit(3)) <= 2 - back)
        rows = rows.join(quoted.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(f"back{back}")), ["conv_id", "turn"], "left")
    below = lambda text: F.regexp_replace(text, "(?m)^", "> ")
    head = lambda back: F.format_string("On turn %d the other wrote:\n", F.col("turn") - back)
    once = F.concat(head(1), below(F.col("back1")), F.lit("\n"), F.col("text"))
    twice = F.concat(head(1), below(F.concat(head(2), below(F.col("back2")), F.lit("\n"), F.col("back1"))), F.lit("\n"), F.col("text"))
    place = F.pmod("turn", F.lit(3))
    return rows.select("conv_id", "turn", "role", F.coalesce(F.when(place == 1, once).when(place == 2, twice), F.col("text")).alias("text"))


def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns quote nothing, so the query links them as mail that does."""
    mail = common.materialize(quoting(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "mail")
    return quotation.link_quotes(mail)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), model)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), near_dup.Likeness(shingle=3, percent=85))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_repetition(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(_table(spark, sf_dir, "conversations"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents get a periodic end first."""
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(_table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_license_scan": op2_license_scan,
    "op3_chat_quotes": op3_chat_quotes,
    "op4_url_filter": op4_url_filter,
    "op5_mix_sources": op5_mix_sources,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_near_dup": op8_near_dup,
    "op9_repetition": op9_repetition,
    "op10_secrets": op10_secrets,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_ngram_join": op12_ngram_join,
    "op13_periodic_runs": op13_periodic_runs,
}
