"""Packing documents into a budget, finding similar examples, joining both to tasks."""

from pyspark.sql import functions as F

from ..operators import packing as P
from ..operators.cell_index import CellIndex
from ..operators.retrieval import nearest
from ..session import fresh_path
from ..streaming.index import follow_examples
from .registry import query, table
from .replies import SQL_REPLY
from .texts import SQL_CLEAN

BUDGET = 8000
K = 5

SQL_WITHIN = f"""
SELECT source, doc_id, lang, body, length(body) AS body_chars,
       sum(length(body)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total_chars
FROM (SELECT *, {SQL_CLEAN} || CASE WHEN lang = 'en' THEN chr(10) || '| ' || lang || ' | chars |' || chr(10) || '| --- | --- |'
             || chr(10) || '| ' || source || ' | ' || n_chars || ' |' || chr(10) ELSE '' END AS body FROM documents)
QUALIFY total_chars <= {BUDGET}"""
SQL_PACKED = f"""
SELECT source, string_agg('<doc index="' || 'http://' || lang || '/' || doc_id || '">' || chr(10) || body || chr(10) || '</doc>' || chr(10),
                          '' ORDER BY doc_id) AS doc_list
FROM ({SQL_WITHIN}) GROUP BY source"""


def search_documents(spark, sf):
    """Documents as search results of their source; the English ones carry a table."""
    rows = F.array(
        F.array(F.col("lang"), F.lit("chars")), F.array(F.col("source"), F.col("n_chars").cast("string")))
    return table(spark, sf, "documents", spread_out=True).select(
        "source", "doc_id", "lang", F.concat(F.lit("http://"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"), F.when(F.col("lang") == "en", F.array(rows)).alias("tables"), F.lit(BUDGET).alias("budget"))


@query(f"SELECT source, doc_id, body_chars, total_chars FROM ({SQL_WITHIN})")
def within_budget(spark, sf):
    kept = P.within_budget(search_documents(spark, sf), ["source"], "doc_id", "budget", tables="tables")
    return kept.select("source", "doc_id", "body_chars", "total_chars")


@query(SQL_PACKED)
def doc_packing(spark, sf):
    return packs(spark, sf)


def packs(spark, sf):
    return P.pack_documents(search_documents(spark, sf), ["source"], "doc_id", "budget", tables="tables")


def sql_nearest(k: int) -> str:
    return f"""
SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS rank
FROM embeddings q, embeddings v QUALIFY rank <= {k}"""


def similar(spark, sf, k):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(queries, vectors.select("vec_id", "embedding"), k)


@query(sql_nearest(K))
def topk_similar(spark, sf):
    return similar(spark, sf, K).select("query_id", "vec_id", "rank")


@query(f"""
WITH found AS (
  SELECT vec_id, embedding, 'seed ' || event_type AS content FROM embeddings JOIN events ON vec_id = event_id WHERE event_type = 'error'
  UNION ALL SELECT vec_id, embedding, props FROM embeddings JOIN events ON vec_id = event_id WHERE event_type IN ('click', 'view'))
SELECT q.vec_id AS query_id, v.vec_id AS vec_id, content,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS rank
FROM embeddings q, found v QUALIFY rank <= {K}""")
def feedback_examples(spark, sf):
    """Vectors of error events are the seeds of an index. The replies to all other events arrive in files and become
    examples where they are usable, in several batches; the stream is then run again over nothing new. All vectors ask."""
    base = fresh_path(spark, "feedback")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "event_type", F.expr(SQL_REPLY).alias("completion")).join(vectors, "id")
    index = CellIndex(spark, f"{base}/index", fanout=2)
    seeds = events.filter("event_type = 'error'").withColumn("content", F.concat(F.lit("seed "), "event_type"))
    index.add("seeds", seeds.select("id", "content", "embedding"))
    replies = events.filter("event_type <> 'error'").select("id", "completion", "embedding")
    replies.repartition(6, "id").write.parquet(f"{base}/results")
    for _ in range(2):
        follow_examples(
            spark, f"{base}/results", "id long, completion string, embedding array<float>", index, f"{base}/checkpoint",
            files_per_batch=2).awaitTermination()
    found = index.examples(vectors.withColumnRenamed("id", "query_id"), K)
    return found.select("query_id", F.col("id").alias("vec_id"), "content", "rank")


@query(f"""
SELECT query_id, string_agg('<example = ' || doc_id || '.json>' || chr(10) || text || chr(10) || '</example>' || chr(10), '' ORDER BY rank) AS examples
FROM ({sql_nearest(2)}) JOIN documents ON vec_id = doc_id GROUP BY query_id""")
def example_packing(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), F.concat(F.lit("examples/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("source"),
        F.col("text").alias("content"))
    ranked = similar(spark, sf, 2).join(docs, "vec_id")
    return P.pack_examples(ranked, ["query_id"], "rank")


@query(f"""
SELECT s_suppkey, 'src' || s_nationkey AS source, coalesce(doc_list, '') AS doc_list
FROM supplier LEFT JOIN ({SQL_PACKED}) p ON 'src' || s_nationkey = p.source""")
def enrich_tasks(spark, sf):
    tasks = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("source"))
    return P.enrich_tasks(tasks, packs(spark, sf), None, ["source"])
