"""The operators as queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_tokens, curriculum, e8_neardup, exact_dedup, hilbert_shards, knn_quality, periodic_runs, piece_lattice, secret_scan, simhash_ball, token_count, topk_search, unit_dedup
from .common import LOWER, UPPER, read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e8_neardup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert_shards.shards(read(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curriculum.schedule(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "first_position")


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_lattice.encoded_corpus(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_pieces", "ids", "round_trip")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"), repository=F.struct("source", "lang"), owner=F.col("source"))
    kinds = {k: i for i, k in enumerate(secret_scan.ORDER)}
    n = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kinds[kind])).cast("long")
    return found.select(
        "doc_id",
        *[n("base", k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.array_sort(F.concat("base", "verdicts"))).alias("spans"),
        *[n("verdicts", k).alias(f"n_{k}") for k in secret_scan.VERDICTS],
    )


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unit_dedup.repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("unit_start"), F.col("end").alias("unit_end"), "words", F.lower(F.hex("digest")).alias("unit_digest"), "keep_id", "keep_start", "copies")


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.planted(read(spark, sf_dir, "documents")))
    order = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"]))
    found = found.withColumn("longest", F.array_max(order))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), F.col("longest.length").alias("length"), F.col("longest.period").alias("period"),
        F.expr("1000 * longest.length DIV longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_exact_dedup, op2_embedding_neardup, op3_hilbert_shards, op4_token_counts, op5_curriculum_mix, op6_quality_votes, op7_simhash_neardup, op8_sentencepiece, op9_secret_scan, op10_unit_dedup, op11_cross_tokens, op12_topk_search, op13_periodic_runs)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
            FROM t""",
        "op2_embedding_neardup": f"""
            WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.vec_id <> y.vec_id
                      WHERE list_cosine_similarity(x.e, y.e) >= {e8_neardup.LEAST}),
            reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
            least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
            degree AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
            SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
            FROM least LEFT JOIN degree USING (vec_id)""",
        "op12_topk_search": """
            WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    }
