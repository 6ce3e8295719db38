"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that the stage before kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, neardup, pieces, quality
from tessera.runtime import Scratch, table

#: A document goes if no language is found, or if the prevailing one has less than this share of its letters.
LEAST_SHARE = 0.3


def _fresh(names: list[str], want: str) -> str:
    while want in names:
        want += "_"
    return want


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language or without a prevailing one; fills in lang where it is null."""
    model = langid.fit(langid.sample(docs))
    columns = docs.columns
    pred, score = _fresh(columns, "pred"), _fresh(columns, "share")
    out = langid.identify(docs, model, spans=False, names=(pred, score, ""))
    kept = out.where((F.col(pred) != langid.UND) & (F.col(score) >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*columns)


def clean_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is above their language's threshold."""
    scratch = Scratch(spark, "pipeline-quality")
    model, good = quality.fit(docs, table(spark, sf_dir, "labels"), scratch)
    if model is None:
        return docs
    good = good.select("doc_id").distinct()
    trusted = scratch.write(quality.perplexities(docs.select("doc_id", "lang", "text"), model, keep=["doc_id", "lang"]), "scored")
    mean = quality.mean_log_prob(trusted, good)
    by_lang, overall = quality.thresholds(trusted, good, mean)
    by_lang = scratch.write(by_lang, "thresholds")
    columns = docs.columns
    log, n, lang, limit = (_fresh(columns, c) for c in ("log_prob", "n_symbols", "tlang", "threshold"))
    out = quality.perplexities(docs, model, names=(log, n)).join(by_lang.toDF(lang, limit), F.col("lang").eqNullSafe(F.col(lang)), "left")
    rejected = quality.drawn_perplexity(log, n, mean) > F.coalesce(F.col(limit), F.lit(overall))
    return out.where(~F.coalesce(rejected, F.lit(False))).select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8), once.

    Rows are told apart by a key of their own where doc_id does not name them:
    rows that share a doc_id, or have none, are duplicates by their texts only,
    and null ids come after all others. Texts without words are duplicates of
    nothing but texts without words under the same doc_id that is not null.
    """
    scratch, columns = Scratch(spark, "pipeline-dedup"), docs.columns
    if _named(docs):
        found = neardup.near_duplicates(docs, scratch, width=5)
        return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*columns)
    row = _fresh(columns, "row")
    # Written once, so that the keys stay the same in all that reads them.
    docs = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(docs.select(F.col(row).alias("doc_id"), "text"), scratch, width=5)
    ids = docs.select(F.col(row).alias("key"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    blank = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    group = found.join(ids, found.doc_id == ids.key).select(
        F.when(~blank, F.col("component_id")).alias("component"),
        F.when(blank, F.col("id")).alias("blank"),
        F.struct(F.col("id").isNull().alias("none"), "id", "hash", "key").alias("first"),
    )
    keep = group.groupBy("component", "blank").agg(F.min("first").alias("first")).select(F.col("first.key").alias(row))
    return docs.join(keep, row, "left_semi").select(*columns)


def _named(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and the digests of the round trip."""
    import public_tokenizers

    return pieces.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, keep=["doc_id"])


STAGES = [
    ("language", language),
    ("quality", clean_text),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("tokens", tokenised),
]

#: Trained models, hashes and alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
