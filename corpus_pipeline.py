"""The corpus pipeline: language ID, quality, near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage takes the whole result of the one before it, written as Parquet and read again. All stages but the last return
the columns of documents. SQL can't express the stages (learned models, similarity, a tokenizer), so ORACLE_SQL is None
and tests compare with brute force.

Every stage takes null keys, texts and other columns, repeated rows, texts of any length and empty tables. Columns beyond
those of documents pass through unchanged, also where an operator has a column of the same name; only the last stage
replaces token_ids and n_tokens. Scratch of a stage is deleted once its result is written. The stages bound how many rows
go to Python at once in the session that they run in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, language_id, pieces, quality, simhash
from tidewire.llm.common import bound_batches, cut, free, scope, scratch, set_aside

#: A document stays if its main language has at least this share of it.
LEAST_SHARE = 0.4
#: A document stays if its posterior of being good is at least this.
LEAST_QUALITY = 0.5

ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those without a main language."""
    bound_batches(spark)
    plain, own = set_aside(docs, "lang_pred", "score", "langs")
    found = language_id.identify(plain, language_id.train(plain))
    return own(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose posterior, with the rates of their source and language, is below LEAST_QUALITY.

    Null sources and languages are groups of their own; a null text is judged as an empty one.
    """
    bound_batches(spark)
    plain, own = set_aside(docs, "section_rate", "site_rate", "p_good", "keep", "__p")
    model = quality.train(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.evidence(plain, model, out="__p")
    narrow = cut(scored.select("source", "lang", "__p"), "evidence")
    table = quality.rates(narrow, model.prior, site="source", section="lang", p="__p")
    judged = quality.judge(scored, table, model, LEAST_QUALITY, site="source", section="lang", p="__p")
    return own(judged.where("keep"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.8 or more of their five-word shingles, the one of the least key stays.

    Rows with a null key and rows without words stay; a key that repeats with another text is no copy.
    """
    bound_batches(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents of nothing else go. n_chars follows the text; null texts stay."""
    bound_batches(spark)
    plain, own = set_aside(docs, "n_words", "n_hit", "items", "spans")
    found = decontaminate.find_contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rest = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    cleaned = decontaminate.remove_spans(rest)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return own(cleaned)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids and n_tokens; a null text has no ids."""
    bound_batches(spark)
    return pieces.encode(docs, pieces.Vocabulary.load()).withColumn("n_tokens", F.size("token_ids"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", judge_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: DataFrame | None = None
    for name, stage in STAGES:
        out = cut_outside(spark, stage, docs, sf_dir, name.replace(" ", "-"))
        if before is not None:
            free(before)
        docs = before = out
    return docs


def cut_outside(spark: SparkSession, stage, docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """The stage's result, written to scratch that outlives the stage's own."""
    path = scratch(spark, name)
    with scope(spark):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        schema = out.schema
    written = spark.read.schema(schema).parquet(path)
    written.scratch_path = path
    return written
