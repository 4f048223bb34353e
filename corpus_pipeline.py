"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``docs``, whatever others it has besides ``doc_id`` and ``text``. No stage fails
on null or empty texts, null or repeated ids, texts of any length or an empty table; what each does with them
is said where it is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm.decontaminate import drop_contaminated
from jobloom.llm.minhash_dedup import drop_near_duplicates
from jobloom.llm.packing import pack
from jobloom.llm.queries import surrogate_key, table
from jobloom.llm.scratch import materialize
from jobloom.llm.surrogates import replace_personal_data
from jobloom.llm.toxicity import drop_toxic, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the lexicon is learned from the labelled rows of the corpus.

    Null and empty texts match no term and stay; rows with equal texts go or stay together.
    """
    lexicon = learn_lexicon(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drop_toxic(docs, lexicon, threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id.

    Texts without words and rows with a null doc_id stay; of rows that repeat a doc_id each counts by its text.
    """
    return drop_near_duplicates(docs, shingle_size=5, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay, rows with equal texts go or stay together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by surrogates; ``n_chars`` follows the new text and keeps its type.

    Null texts stay null, empty ones empty; rows with equal texts get equal ones.
    """
    from pyspark.sql import functions as F

    replaced = replace_personal_data(docs, surrogate_key(spark))
    changed = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return replaced.withColumn("n_chars", changed) if "n_chars" in docs.columns else replaced


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its place in a sequence of 2048 tokens; a null or empty text is one separator."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, separator=0)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
