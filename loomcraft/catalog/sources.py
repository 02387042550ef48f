"""Scans and sinks as round trips, and the streamed example index."""

from pyspark.sql import Window, functions as F

from ..session import fresh_path
from ..sources import scans, sinks
from ..streaming import index as I
from .registry import query, table
from .replies import SQL_REPLY


def task_rows(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("category"), F.col("lang").alias("subcategory"), F.col("text").alias("task"))


@query("SELECT source AS category, lang AS subcategory, text AS task, count(*) AS n FROM documents GROUP BY ALL")
def curriculum_csv(spark, sf):
    """Tasks written as CSV and read back: line breaks and quotes survive, every row gets its own ordinal."""
    path = fresh_path(spark, "curriculum")
    sinks.save_tasks_csv(task_rows(spark, sf), path)
    read = scans.scan_curriculum(spark, path)
    return read.groupBy("category", "subcategory", "task").agg(F.countDistinct("ordinal").alias("n"))


@query("SELECT event_id, 'c' || event_type AS category, user_id AS subcategory FROM events WHERE event_type <> 'error'")
def curriculum_json_lines(spark, sf):
    """Good lines become tasks."""
    tasks, _ = scans.scan_json_lines(spark, json_lines(spark, sf))
    return tasks.select(
        F.get_json_object("Task", "$.id").cast("long").alias("event_id"), F.col("Category").alias("category"),
        F.col("SubCategory").cast("long").alias("subcategory"))


@query("SELECT event_id FROM events WHERE event_type = 'error'")
def curriculum_bad_lines(spark, sf):
    """Bad lines are reported, each with its own number."""
    _, bad = scans.scan_json_lines(spark, json_lines(spark, sf))
    return bad.groupBy("line").agg(F.countDistinct("line_number").alias("n")).filter("n = 1").select(
        F.regexp_extract("line", "[0-9]+", 0).cast("long").alias("event_id"))


def json_lines(spark, sf):
    path = fresh_path(spark, "lines")
    number = F.col("event_id").cast("string")
    good = F.concat(F.lit('{"Category": "c'), "event_type", F.lit('", "SubCategory": '), F.col("user_id").cast("string"),
                    F.lit(', "Task": {"id": '), number, F.lit("}}"))
    broken = F.concat(F.lit('{"Category": '), number, F.lit(", oops"))
    line = F.when(F.col("event_type") == "error", broken).otherwise(good)
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return path


@query("SELECT source AS category, lang AS subcategory, doc_id AS task, text AS reply FROM documents")
def result_store(spark, sf):
    """Results saved in two runs that overlap: what is there stays, what is new is added, nothing twice."""
    path = fresh_path(spark, "results")
    rows = task_rows(spark, sf).select("category", "subcategory", F.col("doc_id").alias("task"), F.col("task").alias("reply"))
    sinks.save_results(rows.filter(F.length("reply") < 1500), path)
    sinks.save_results(rows, path)
    return spark.read.parquet(path).select("category", "subcategory", "task", "reply")


@query("SELECT doc_id, lang, text FROM documents")
def array_round_trip(spark, sf):
    """Documents saved as JSON arrays, one a file, and read back."""
    path = fresh_path(spark, "arrays")
    sinks.save_dataset(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "json_array")
    return scans.scan_dataset(spark, path, "json_array").select("doc_id", "lang", "text")


@query("SELECT conv_id, turn AS rank, text AS content FROM conversations WHERE turn < 3 AND role <> 'system'")
def search_cache(spark, sf):
    """Search results saved twice per task without the unusable ones, the first three ranks read back."""
    path = fresh_path(spark, "search")
    found = table(spark, sf, "conversations").select(
        F.col("role").alias("category"), F.lit("all").alias("subcategory"), "conv_id", F.col("turn").alias("rank"),
        F.when(F.col("role") != "system", F.lit("http://x")).alias("url"), F.col("text").alias("content"))
    keys = ["category", "subcategory", "conv_id", "rank"]
    sinks.save_search_results(found, path, keys)
    sinks.save_search_results(found, path, keys)
    return scans.scan_search_results(spark, path, 3).select("conv_id", "rank", "content")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def dataset_round_trip(spark, sf):
    """A data set written as JSON and as a columnar table, then read."""
    path = fresh_path(spark, "dataset")
    docs = table(spark, sf, "documents")
    sinks.save_dataset(docs, path + "-json", "json")
    lines = scans.scan_dataset(spark, path + "-json", "json").select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])
    sinks.save_dataset(lines, path + "-parquet")
    return scans.scan_dataset(spark, path + "-parquet")


@query("SELECT event_id, event_type AS category, user_id AS subcategory FROM events UNION ALL SELECT event_id, event_type, user_id FROM events")
def appended_tasks(spark, sf):
    """Task lines appended twice."""
    path = fresh_path(spark, "appended")
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("category"), F.col("user_id").alias("subcategory"))
    sinks.append_tasks(rows, path)
    sinks.append_tasks(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(f"""
SELECT c_custkey, min(c_custkey) OVER (PARTITION BY g) AS first, sector, grp
FROM (SELECT c_custkey, c_mktsegment AS sector, n_name AS grp, c_custkey // 1000 AS g FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def industry_sheet_scan(spark, sf):
    """Customers as the sheet's nine columns below its title rows: the four used columns, renamed."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sheet = rows.select(
        (F.col("c_custkey") + scans.SHEET_HEADER_ROWS + 1).alias("ordinal"), F.lit("10").alias("c0"),
        F.col("c_mktsegment").alias("c1"), F.lit("1010").alias("c2"), F.col("n_name").alias("c3"), F.lit("x").alias("c4"),
        F.col("c_name").alias("c5"), F.lit("y").alias("c6"), F.floor(F.col("c_custkey") / 1000).cast("string").alias("c7"))
    read = scans.industry_rows(sheet)
    return read.select(
        F.col("ordinal").alias("c_custkey"), (F.col("Sub-Industry").cast("long") * 1000).alias("first"),
        F.col("Sector").alias("sector"), F.col("`Industry Group`").alias("grp"))


@query("""
SELECT 'category=bench set' AS category, 'subcategory=' || CASE WHEN length(text) < 200 THEN 'short one' ELSE 'long one' END AS subcategory, item_id, text
FROM benchmark""")
def result_tree(spark, sf):
    """A tree of one-record files below category and subcategory folders, labelled by its paths."""
    path = fresh_path(spark, "tree")
    kind = F.when(F.length("text") < 200, F.lit("short_one")).otherwise(F.lit("long_one"))
    rows = table(spark, sf, "benchmark").select("item_id", "text", F.lit("bench_set").alias("category"), kind.alias("subcategory"))
    rows.write.option("maxRecordsPerFile", 1).partitionBy("category", "subcategory").json(path)
    record = lambda c: F.get_json_object("record", f"$.{c}")
    return scans.scan_result_tree(spark, path).select(
        "category", "subcategory", record("item_id").cast("long").alias("item_id"), record("text").alias("text"))


@query("SELECT item_id, text, 1 AS seq_num FROM benchmark")
def example_folder(spark, sf):
    """A folder of one-document files as example documents, each under its own source."""
    path = fresh_path(spark, "examples")
    table(spark, sf, "benchmark").write.option("maxRecordsPerFile", 1).json(path)
    found = scans.scan_examples(spark, path).dropDuplicates(["source"])
    field = lambda c: F.get_json_object("content", f"$.{c}")
    return found.select(field("item_id").cast("long").alias("item_id"), field("text").alias("text"), "seq_num")


def streamed(spark, sf):
    """Event replies written as result files, the stream run over them, and run again over nothing new."""
    base = fresh_path(spark, "stream")
    replies = table(spark, sf, "events").select(
        F.concat(F.lit("results/"), F.col("event_id").cast("string"), F.lit(".json")).alias("source"),
        F.expr(SQL_REPLY).alias("completion"))
    replies.write.option("maxRecordsPerFile", 5000).parquet(f"{base}/results")
    for _ in range(2):
        I.follow_results(spark, f"{base}/results", "source string, completion string", f"{base}/index", f"{base}/checkpoint").awaitTermination()
    return f"{base}/index"


@query("""
SELECT 'results/' || event_id || '.json' AS source, 1 AS seq_num, props AS content FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT 'seeds/' || item_id || '.json', 1, text FROM benchmark""")
def incremental_index(spark, sf):
    seeds = table(spark, sf, "benchmark").select(
        F.concat(F.lit("seeds/"), F.col("item_id").cast("string"), F.lit(".json")).alias("source"), F.lit(1).alias("seq_num"),
        F.col("text").alias("content"))
    return I.example_index(spark, streamed(spark, sf), seeds)


@query(f"""
SELECT 'results/' || event_id || '.json' AS source, {SQL_REPLY} AS completion FROM events WHERE event_type NOT IN ('click', 'view')""")
def index_rejects(spark, sf):
    return I.rejects(spark, streamed(spark, sf)).select("source", "completion")


@query("SELECT doc_id, text FROM documents")
def ordinal_order(spark, sf):
    """Documents numbered in file order: the numbers are dense and sorting by them restores the file."""
    path = fresh_path(spark, "ordered")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    numbered = scans.with_ordinal(spark.read.parquet(path), scans.place())
    near = Window.partitionBy(F.floor(F.col("ordinal") / 1000)).orderBy("ordinal")
    in_order = numbered.withColumn("_up", F.coalesce(F.col("doc_id") > F.lag("doc_id").over(near), F.lit(True)))
    return in_order.filter("_up").dropDuplicates(["ordinal"]).select("doc_id", "text")


