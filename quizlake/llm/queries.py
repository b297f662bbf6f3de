"""One query per operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import bag_search, ball_tree, bpe, hnsw, langid, licenses, ngram_join, packing, prefix_trie, secret_scan, substring_dedup, toxicity, warc
from quizlake.llm.tables import table
from quizlake.plans.registry import Plan, Query

QUERIES: dict[str, Query] = {}


def _register(name: str, sql: str | None = None):
    def enter(plan: Plan) -> Plan:
        QUERIES[name] = Query(plan, sql)
        return plan

    return enter


@_register("op10_bpe_pair_index")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode_decode(table(spark, folder, "documents")).select(
        "doc_id",
        "n_tokens",
        F.sha2("id_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_register("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids dealt to windows of 2048."""
    return packing.pack(table(spark, folder, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_register("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; two thirds of the labelled documents may be learned from."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs, usable=~held_out)
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held, "text"), model)


@_register("op1_ngram_jaccard_join", ngram_join.ORACLE)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose word five-gram sets are similar by 0.75 or more."""
    return ngram_join.jaccard_components(table(spark, folder, "documents"), words=5, percent=75)


@_register("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Severity grade of every document."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.grade(docs.select("doc_id", "text"), model)


@_register("op8_substring_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too, word by word or nearly so."""
    found = substring_dedup.repeated_passages(table(spark, folder, "documents"))
    return found.withColumnsRenamed({"doc": "doc_id", "src": "source_doc_id"})


_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@_register(
    "op6_ball_tree_top_k",
    f"""
    WITH v AS (
        SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
        FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
    )
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all integer vectors for every twentieth vector."""
    return ball_tree.top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


@_register("op9_hnsw")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found among all vectors for every twentieth vector."""
    return hnsw.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


@_register("op5_license_scan", licenses.oracle())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Known licence sentences and licences of every document, joined by commas."""
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licenses")])


@_register("op4_warc_derivatives", warc.oracle())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of every page, with their headers."""
    return warc.derivatives(warc.responses_of_pages(table(spark, folder, "pages")), keep=["page_id"])


@_register("op11_prefix_trie", prefix_trie.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of shared conversation prefixes."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@_register("op13_bag_search", bag_search.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return bag_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_register("op12_secret_scan", secret_scan.oracle())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.digest_columns(secret_scan.scan(table(spark, folder, "documents")))
