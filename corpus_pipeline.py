"""The corpus pipeline: documents go through STAGES in order, each stage written as Parquet and read again as the next one's input. What a stage has
written besides is removed when its output is there.

Every stage works on all that its predecessor kept. Rows that share a doc_id are one document and stay or go together; rows without a doc_id can't be
named as copies or leaks and stay. Null texts stay null up to the last stage, where they have no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from tidebar.session import ensure_semantics, made, release, scratch
from tidebar.sources.tables import table

#: Near-duplicates: texts whose sets of five-word shingles have an exact Jaccard similarity of 0.8. Candidates come from 256-bit fingerprints of the
#: distinct shingles: at 0.8 their expected distance is 39 bits (deviation 6), at most 48 (for 4 and 5 shingles); the radius is 4 deviations beyond that.
SHINGLE, LANES, RADIUS, SIMILARITY = 5, 4, 73, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least the cut go."""
    stems = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, stems, keep=tuple(docs.columns), out="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least doc_id stays."""
    found = simhash.near_duplicates(docs, shingle=SHINGLE, radius=RADIUS, lanes=LANES, ratio=SIMILARITY, exact=True)
    return docs.join(found.filter("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its own or other values, go."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars is counted anew."""
    kept = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    found = secret_scan.find(docs, keep=kept, outputs=("redacted",))
    made = {"text": F.col("redacted").alias("text"), "n_chars": F.char_length("redacted").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.select(*(made.get(c, F.col(c)) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), their number, and the digests of ids and decoded text."""
    return bpe.encode_decode(docs, keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("bpe encoding", encode),
]

#: The stages learn, compare fingerprints and tokenise in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_semantics(spark)
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        folder = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        release(spark, since=before, keep=(folder,))  # a stage's own tables and its predecessor's output aren't read any more
    return docs
