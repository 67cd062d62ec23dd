"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, byte_bpe, decontaminate, imatch, importance, lexical_search, packing, secret_scan, simhash, substrings, toxicity, training_order, url_filter, warc
from tidebar.session import ensure_semantics
from tidebar.sources.tables import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the text that they decode to."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url")).drop("ratio")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; the lexicon is learned from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as it was written to an archive and read back, in the order of the capture history."""
    found = warc.archive_and_index(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of every whole text's token ids (those of op11, of two bytes each) as it was read back from its shard."""
    shards = training_order.materialise(table(spark, sf_dir, "documents", "doc_id", "text"), key=20240607, width=2, ids="text", encoder=byte_bpe.bytes_of(2))
    return shards.read().select("slot", "shard", "doc_id", "place", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that whole texts hold, with the same or other values; a row for each pair."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text when windows of 50 words that an earlier document has are removed."""
    return substrings.Repeats(table(spark, sf_dir, "documents"), width=50).digest()


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole text."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text."""
    return secret_scan.find(table(spark, sf_dir, "documents"), outputs=("n_assign", "n_access", "n_hex", "base_sha256", "spans"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every whole text and of its edited text, and their likeness."""
    found = imatch.compare_with_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), imatch.as_text(F.col("fp")).alias("fingerprint"), imatch.as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every whole text's ids in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text")).places.drop("piece_key")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's distribution, and the ranks of those drawn."""
    found = importance.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    found = lexical_search.rank(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("item_id", "rank", "doc_id", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {"op1_bpe": op1_bpe, "op2_url_filter": op2_url_filter, "op3_toxicity": op3_toxicity, "op4_warc": op4_warc, "op5_training_order": op5_training_order, "op6_decontaminate": op6_decontaminate, "op7_substrings": op7_substrings, "op8_simhash": op8_simhash, "op9_secrets": op9_secrets, "op10_imatch": op10_imatch, "op11_packing": op11_packing, "op12_importance": op12_importance, "op13_search": op13_search}
    return {name: _settled(f) for name, f in found.items()}


def _settled(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_semantics(spark)
        return f(spark, sf_dir)

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    return run


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.oracle(), "op4_warc": warc.oracle(), "op7_substrings": substrings.oracle(), "op12_importance": importance.oracle(), "op13_search": lexical_search.oracle()}
