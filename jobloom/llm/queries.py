"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.minhash_dedup import minhash_components

    return minhash_components(table(spark, sf_dir, "documents"), shingle_size=5, percent=75)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from jobloom.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), path, capacity=2048, separator=0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.warc import archive_digest

    return archive_digest(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_drawn_keys: dict[str, str] = {}


def surrogate_key(spark: SparkSession) -> str:
    """The key that the session names in ``spark.jobloom.surrogateKey``, or one drawn for this application."""
    application = spark.sparkContext.applicationId
    return spark.conf.get("spark.jobloom.surrogateKey", None) or _drawn_keys.setdefault(application, secrets.token_hex(16))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.surrogates import replace_personal_data

    return replace_personal_data(table(spark, sf_dir, "documents"), surrogate_key(spark), found_column="n_replaced")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.embedding_dedup import embedding_components

    return embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.spelling_variants import count_words, spelling_variants

    return spelling_variants(count_words(table(spark, sf_dir, "documents"), least_length=5, least_count=3, drop_one_in=97), ratio=2)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.lexical_search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobloom.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_surrogates": op8_surrogates,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_html_text": op10_html_text,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lexical_search": op12_lexical_search,
    "op13_language_id": op13_language_id,
}

#: DuckDB SQL with the same result, where SQL over whole tables can express it.
ORACLE_SQL: dict[str, str] = {
    "op9_embedding_dedup": """
        WITH RECURSIVE e AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        degree AS (SELECT x, count(*) AS n FROM links GROUP BY 1),
        lowest AS (SELECT x, min(y) AS low FROM reach GROUP BY 1),
        found AS (
            SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id
            FROM embeddings LEFT JOIN degree ON degree.x = vec_id LEFT JOIN lowest ON lowest.x = vec_id
        )
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS place, doc_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ),
        held AS (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM d WHERE len(terms) > 0),
        sizes AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
        counted AS (SELECT place, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counted, sizes GROUP BY term, docs
        ),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ),
        scored AS (
            SELECT item_id, doc_id, place,
                CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counted USING (term), sizes
            GROUP BY item_id, doc_id, place
        ),
        ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
