"""A corpus pipeline of five stages over ``documents``: language, near-duplicates, benchmark
leaks, secrets, packing.

Every stage takes what its predecessor kept, whole; all but the last return the columns of
``documents``. :func:`run` writes each stage's result as Parquet into the shared folder and
reads it back as the next one's input, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breezeframe.llm.common import materialise, table
from breezeframe.llm.decontaminate import find_overlaps
from breezeframe.llm.langid import fit, identify
from breezeframe.llm.minhash import near_duplicates
from breezeframe.llm.packing import pack
from breezeframe.llm.secrets import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no text, no letter, or (nearly) equal
    evidence for two languages. The classifier learns from the labels at hand."""
    model = fit(docs, F.lit(True))
    return identify(docs, model, keep=COLUMNS).where(
        "text IS NOT NULL AND lang_pred != 'und' AND NOT ambiguous"
    ).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; of rows
    that repeat a document (id and text) one stays. Rows without id stay unless they do."""
    found = near_duplicates(docs, SHINGLE, PERCENT)
    gone = found.where("NOT kept").select("doc_id").distinct()
    rest = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").withColumn("__h", F.xxhash64("text"))
    same = Window.partitionBy("doc_id", "__h").orderBy("n_chars", "source", "lang")
    return rest.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    found = find_overlaps(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where("NOT contaminated").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay."""
    clean = redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: trained and tokenised results have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
