"""Documents gathered for tasks: searched once, read from the cache after."""

from pyspark.sql import functions as F

from loomcraft.plans import context

PAGES = [("u1", "<p>one</p>"), ("u2", "<p>two</p><table><tr><td>x</td></tr></table>"), ("u3", "<p> </p>"), ("u4", None), ("u5", "<p>five</p>")]


def listed(spark, rows):
    return spark.createDataFrame(rows, "task_key string, position int, url string")


def gathered(spark, path, keys, first, second, asked):
    tasks = spark.createDataFrame([(k,) for k in keys], "task_key string")

    def search(missing):
        asked.append(sorted(r.task_key for r in missing.collect()))
        return listed(spark, first), None if second is None else listed(spark, second)

    def fetch(urls):
        return urls.join(spark.createDataFrame(PAGES, "url string, html string"), "url", "left")

    rows = context.gather_documents(tasks, search, fetch, path, num_results=3).collect()
    return sorted((r.task_key, r.rank, r.url, r.content, r.tables) for r in rows)


def test_tasks_are_searched_once(spark, tmp_path):
    path, asked = f"{tmp_path}/cache", []
    first = [("a", 0, "u1"), ("a", 1, "u3"), ("a", 2, "u2"), ("a", 3, "u5"), ("b", 0, "missing")]
    second = [("a", 0, "u2"), ("a", 1, "u5"), ("a", 2, "u5")]
    of_a = [("a", 0, "u1", "one", []), ("a", 2, "u2", "two", [[["x"]]]), ("a", 3, "u5", "five", [])]
    assert gathered(spark, path, ["a", "b"], first, second, asked) == of_a
    # b has no documents, but is known; only c is asked for.
    assert gathered(spark, path, ["a", "b", "c", "c"], [("c", 0, "u5")], None, asked) == [*of_a, ("c", 0, "u5", "five", [])]
    assert gathered(spark, path, ["c", "a"], [], None, asked) == [*of_a, ("c", 0, "u5", "five", [])]
    assert asked == [["a", "b"], ["c"]]


def test_what_a_broken_run_left_counts_for_nothing(spark, tmp_path):
    path, asked = f"{tmp_path}/cache", []
    left = listed(spark, [("a", 0, "old")]).select(
        "task_key", F.lit(0).cast("long").alias("rank"), "url", F.lit("old").alias("content"), F.lit(None).cast("array<array<array<string>>>").alias("tables"),
        F.lit("broken").alias("run"))
    left.write.parquet(f"{path}/documents")
    assert gathered(spark, path, ["a"], [("a", 0, "u1")], None, asked) == [("a", 0, "u1", "one", [])]
    # A run over the same tasks at the same time: one of the two counts, whole.
    cache = context.DocumentCache(spark.createDataFrame([("a",)], "task_key string"), path)
    tasks = spark.createDataFrame([("a",)], "task_key string")
    cache.add(left.drop("run"), tasks)
    assert len(cache.documents(tasks).collect()) == 1
    assert asked == [["a"]]
