"""Finding benchmark items in documents by a prefix-filtered set join.

An item's window is ``window`` consecutive words, or all words of a shorter item. A document that contains a window
contains each of its shingles at the same distance, so it is enough to look for one: the shingles of
a window are put in order of rarity in the documents, and the rarest, the prefix that containment needs, is joined.
Where it stands in the window says where the window would begin (positional bound), that must be in
the document (length bound), and the words there are compared one by one. Windows any of whose
shingles no document has are never joined.

Only shingles that the benchmark has are listed of the documents; their places give both
rarity and candidates. Whether the benchmark's shingles are sent to all tasks is left to Spark, which goes by
the size of the written table; otherwise both sides are shuffled and hot shingles split.

Words are runs of characters outside the ASCII marks, A-Z lower-cased. Null text has no words. Items without
words have no windows; repeated items and windows count once. Rows with the same id and text are copies with
the same result; null ids are ids like any other. An empty benchmark hits nothing; an empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .columns import join_same, lower_ascii, rows_of, text_of

WINDOW = 13
SHINGLE = 5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ["_doc", "_print"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), _BREAK), "")


def _shingles(words: str, width: int) -> Column:
    """Hashes of ``width`` consecutive words at each place, none if there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item, window, n``: each item's distinct windows as words joined by spaces, and their length."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words_of(text_of()).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))
    return rows.select("item", F.least(F.lit(window), F.size("words")).alias("n"), F.explode(F.array_distinct(cut)).alias("window")).distinct()


def _postings(docs: DataFrame, wanted: DataFrame, widths: list[int]) -> DataFrame:
    """``_doc, _print, n_words, width, shingle, at`` of every place at which a document has a wanted shingle."""
    rows = rows_of(docs).select(*_DOC, words_of(F.col("_text")).alias("words"))

    def places(width: int) -> DataFrame:
        own = rows.select(*_DOC, F.size("words").alias("n_words"), F.lit(width).alias("width"),
                          F.posexplode(_shingles("words", width)).alias("at", "shingle"))
        return own.join(wanted, ["width", "shingle"], "left_semi")

    return reduce(DataFrame.unionByName, [places(w) for w in widths])


def _verdicts(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``_doc, _print, n_words, n_hit, windows`` of each document."""
    rows = rows_of(docs).select(*_DOC, words_of(F.col("_text")).alias("words"))
    windows = items.select("window", "n").distinct().withColumn("words", F.split("window", " "))
    # At most as many widths as a shingle has words.
    widths = sorted(r[0] for r in items.select(F.least("n", F.lit(shingle))).distinct().collect())
    if not widths:
        return rows.select(*_DOC, F.size("words").alias("n_words"), F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("windows"))
    own = reduce(DataFrame.unionByName, [
        windows.filter(F.least("n", F.lit(shingle)) == w).select(
            "window", "n", F.lit(w).alias("width"), F.posexplode(_shingles("words", w)).alias("off", "shingle"))
        for w in widths])
    own = written(own, "benchmark-shingles")
    wanted = written(own.select("width", "shingle").distinct(), "wanted-shingles")
    postings = written(_postings(docs, wanted, widths), "shingle-places")
    rarity = postings.groupBy("width", "shingle").agg(F.count("*").alias("places"))
    ordered = own.join(rarity, ["width", "shingle"])
    prefix = ordered.groupBy("window", "n", "width").agg(
        F.min_by(F.struct("shingle", "off"), F.struct("places", "off")).alias("rarest"), F.count("*").alias("found"))
    prefix = prefix.filter(F.col("found") == F.col("n") - F.col("width") + 1).select(
        "window", "n", "width", F.col("rarest.shingle").alias("shingle"), F.col("rarest.off").alias("off"))
    start = F.col("at") - F.col("off")
    candidates = postings.join(prefix, ["width", "shingle"]).filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    listed = candidates.groupBy(*_DOC).agg(F.collect_set(F.struct(start.alias("start"), F.col("n"), F.col("window"))).alias("found"))
    joined = join_same(rows, listed, _DOC, "left")
    true = F.filter("found", lambda x: F.array_join(F.slice("words", x["start"] + 1, x["n"]), " ") == x["window"])
    checked = joined.select(*_DOC, F.size("words").alias("n_words"), F.array_sort(true).alias("hits"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(x["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["start"] + x["n"]).alias("end")),
        lambda acc: acc["n"])
    return checked.select(
        *_DOC, "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce(F.array_distinct(F.transform("hits", lambda x: x["window"])), F.array().cast("array<string>")).alias("windows"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """``_doc, _print, n_words, n_hit, items, contaminated`` of each distinct document: the words inside windows, the items
    (sorted, as strings) and whether at least one word in ``share`` is hit."""
    known = written(item_windows(items, window), "benchmark-windows")
    verdicts = written(_verdicts(docs, known, window, shingle).dropDuplicates(_DOC), "verdicts")
    hits = verdicts.filter("n_hit > 0").select(*_DOC, F.explode("windows").alias("window"))
    lists = hits.join(known, "window").groupBy(*_DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = join_same(verdicts, lists, _DOC, "left")
    return joined.select(
        *_DOC, F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit").cast("long") >= F.col("n_words"))).alias("contaminated"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, items, contaminated``."""
    found = contamination(docs, items, window, shingle, share)
    rows = rows_of(docs).select(*_DOC)
    return join_same(rows, found, _DOC).select(F.col("_doc").alias("doc_id"), "n_words", "n_hit", "items", "contaminated")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    bad = contamination(docs, items, window, shingle, share).filter("contaminated").select(*_DOC)
    rows = rows_of(docs)
    return join_same(rows, bad, _DOC, "left_anti").select("_row.*")
