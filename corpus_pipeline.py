"""The corpus pipeline: five stages, each an operator of ``burnline.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and reads it as the next one's docs.
All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnline.llm import exact_dedup, langid, line_dedup, packing, simhash, tokens
from burnline.llm.common import fresh, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay. Those without a letter go, and those whose score lies below the
    bound that ``langid.learned_bounds`` learned for texts of their length (none for lengths of which few were learned,
    so very short texts stay). If no language was learned, only those without a letter go."""
    pred, score, letters = (fresh(docs.columns, c) for c in ("lang_pred", "score", "n_letters"))
    prototypes = langid.learn(docs)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = stored(langid.identify(docs, prototypes, pred=pred, score=score, n_letters=letters), "named")
    bounds = langid.learned_bounds(named, pred, score, letters)
    return named.where(langid.known(bounds, pred, score, letters)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.first_of_equals(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document of smallest id stays, and any row without an id. A row goes by
    its id and text, so another text of the same id is judged for itself."""
    key = fresh(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    goes = simhash.near_duplicates(keyed, carried=(key,)).where("doc_id <> component_id").select("doc_id", key).distinct()
    return keyed.join(goes, ["doc_id", key], "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and passages go from all documents but the first; ``n_chars`` follows the text."""
    cut = line_dedup.remove_repeats(docs, fresh(docs.columns, "removed"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences. The workers' memory is that of all stages, so the cache is small."""
    return packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"), cache_entries=200_000)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near_duplicates),
          ("line_dedup", substrings), ("packing", packed)]
#: SQL has no counterpart of the fingerprints, the language model or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
