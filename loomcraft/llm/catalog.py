"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path
from . import bestfit, decontaminate, divergence, exact_dedup, line_dedup, lm_scores, repair, rollups, simhash, suffixes, token_files, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Shuffled joins planned inside leave out rows whose key a Bloom filter of the other, filtered side doesn't hold,
    before they are shuffled. Spark bounds the filter by its number of bits, 8 MB here; with more keys than it is
    meant for it lets more rows through and loses none."""
    settings = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t",
                "expectedNumItems": "4000000", "numBits": str(8 << 23)}
    settings = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 10


@query(f"""
    WITH lines AS (
        SELECT doc_id, line, place,
               translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                     generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)),
    common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
    marked AS (SELECT doc_id, line, place, key IN (SELECT key FROM common) AS gone FROM lines)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), MIN_DOCS)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("""
    SELECT doc_id, max(doc_id) OVER equal_texts AS keep_id, count(*) OVER equal_texts AS group_size,
           doc_id = max(doc_id) OVER equal_texts AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW equal_texts AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), TOKENIZER, END_ID, 4096)


@query()
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), width=4, radius=4)


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"


@query(f"""
    WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    own AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(greatest(1, len(w) - 12)),
                lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS win FROM items WHERE len(w) > 0),
    places AS (SELECT doc_id, p AS start, n, array_to_string(w[p + 1:p + n], ' ') AS win
               FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p
                     FROM docs, (SELECT DISTINCT n FROM own) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, start, places.n, item_id FROM places JOIN own USING (win)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS p FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents were inserted, toxic ones deleted, and those of low quality revised to
    their distinct lines. Each batch is sent twice. Few but the texts to be revised are shuffled to meet their labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.filter("toxic = 1").select("doc_id")
    low = labels.filter("toxic = 0 AND quality = 0").select("doc_id")
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    rollup = rollups.TokenRollup(spark, fresh_path(spark, "token-rollup"), {
        "word_bpe_49k": rollups.tokenizer_count(TOKENIZER), "words": rollups.word_count})
    with filtered_joins(spark):
        for name, changes in (
            ("insert", docs.withColumn("op", F.lit("insert"))),
            ("delete", docs.join(toxic, "doc_id").withColumn("op", F.lit("delete"))),
            ("revise", docs.join(low, "doc_id").withColumn("text", lines).withColumn("op", F.lit("revise"))),
        ):
            rollup.commit(name, changes)
            rollup.commit(name, changes)
    return rollup.totals()


@query()
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"), TOKENIZER)


@query(f"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
                  FROM documents),
    said AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term FROM said GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCS}),
    counts AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
    sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
    vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
    own AS (SELECT DISTINCT lang, source FROM docs),
    shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) AS p
               FROM own JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN sizes USING (lang, source)
               LEFT JOIN counts USING (lang, source, term)),
    usual AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) AS q
              FROM counts JOIN (SELECT lang, sum(total) AS total FROM sizes GROUP BY lang) USING (lang) JOIN vocabulary USING (lang)
              GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
              FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM own a JOIN own b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value,
           (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
    FROM found QUALIFY part = 'pair' OR rank <= 10""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), MIN_DOCS, 10)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, without end marks, repeated or given the role user, by a hash of id and turn."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    hit = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    said = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), hit.alias("hit")).filter("hit <> 0")
    return said.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    report, _ = repair.repair(damaged(given))
    found = given.select(F.col("conv_id").alias("_own")).distinct().join(report, F.col("_own").eqNullSafe(F.col("conv_id")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        F.col("_own").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query()
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeats(table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
