"""Scans of curricula, result trees, sheets, source files and cached search results."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.jsons import is_json
from ..functions.text import is_blank, path_labels, to_last_full_stop
from ..operators.binding import spread
from ..operators.selection import first_per_name
from ..session import written

# The source files tasks are mined from.
CODE_SUFFIX = r"\.(py|ipynb|txt|js)\z"
CODE_GLOB = "*.{py,ipynb,txt,js}"
PACKAGE_FILE = "__init__.py"
# Layout of the industry sheet, rows above the header and the columns used.
SHEET_HEADER_ROWS = 3
SHEET_COLUMNS = {1: "Sector", 3: "Industry Group", 5: "Industry", 7: "Sub-Industry"}

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+"


def with_ordinal(df: DataFrame, file_order: Column, name: str = "ordinal") -> DataFrame:
    """Number rows from 0 in file order: files by name, rows as they stand in their file.

    The rows are written once with their place (file, split, row in split); then the rows of earlier
    splits, one count per split, are added. No task sees more than its own split."""
    placed = df.withColumn("_file", file_order).withColumn("_row", F.monotonically_increasing_id())
    placed = written(placed, "ordinal")
    splits = placed.groupBy("_file").agg(F.count("*").alias("_n"), F.min("_row").alias("_start"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return placed.join(offsets, "_file").withColumn(
        name, F.col("_row") - F.col("_start") + F.col("_before")
    ).drop("_file", "_row", "_start", "_before")


def _file_path() -> Column:
    """Path of a row's file, as written rather than URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def place() -> Column:
    """Where a row's split lies: file, and offset within it."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _file_key() -> Column:
    """A row's file, told apart from others and ordered like them. Spark writes the slashes behind a scheme in two ways."""
    return F.regexp_replace("_metadata.file_path", _SCHEME, "$1:")


def _files_of_first(rows: DataFrame, n: int) -> tuple[str, int] | None:
    """The last file (by name) that the first ``n`` rows of a plain scan reach, and how many of them it holds.

    Files are counted a few at a time, twice as many each time, without reading a column, until there are enough rows; null
    if there never are. The driver holds the names of files, as the scan itself does, and of up to 1,024 their counts."""
    path = _file_key()
    files, at, step, before = sorted(re.sub(_SCHEME, r"\1:", f) for f in rows.inputFiles()), 0, 1, 0
    while at < len(files):
        some = files[at:at + step]
        counts = dict(rows.filter(path.between(some[0], some[-1])).groupBy(path.alias("file")).count().collect())
        for file in some:
            if before + counts.get(file, 0) >= n:
                return file, n - before
            before += counts.get(file, 0)
        at, step = at + step, min(2 * step, 1024)
    return None


def first_of_scan(rows: DataFrame, n: int, fmt: str) -> DataFrame:
    """The first ``n`` rows of a plain scan in file order. Files behind them aren't read, whatever the size of the input.

    Parquet tells each row's place, so nothing is numbered or written; of other formats the last file reached is numbered,
    and that file alone is written."""
    found = _files_of_first(rows, n) if n > 0 else ("", 0)
    if found is None:
        return rows
    last, rest = found
    path = _file_key()
    if fmt == "parquet":
        return rows.filter((path <= last) & ((path < last) | (F.col("_metadata.row_index") < rest)))
    cut = with_ordinal(rows.filter(path == last), place()).filter(F.col("ordinal") < rest).drop("ordinal")
    return rows.filter(path < last).unionByName(cut)


def scan_curriculum(spark: SparkSession, path: str, num_tasks: int | None = None) -> DataFrame:
    """Curriculum CSV (``Category,SubCategory,Task[,Schema]``), quoted fields may hold line breaks.

    With ``num_tasks`` the first that many rows in file order."""
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("emptyValue", "").csv(path)
    )
    if num_tasks is None:
        return with_ordinal(rows, place())
    found = _files_of_first(rows, num_tasks)
    needed = rows if found is None else rows.filter(_file_key() <= found[0])
    return with_ordinal(needed, place()).filter(F.col("ordinal") < num_tasks)


def scan_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Curriculum JSON lines: the good tasks, and the bad lines with their number."""
    lines = with_ordinal(spark.read.text(path), place())
    good = F.coalesce(is_json("value"), F.lit(False))
    field = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    tasks = lines.filter(good).select("ordinal", *[field(k) for k in ("Category", "SubCategory", "Task", "Schema")])
    bad = lines.filter(~good).select((F.col("ordinal") + 1).alias("line_number"), F.col("value").alias("line"))
    return tasks, bad


def scan_result_tree(spark: SparkSession, root: str, to_full_stop: bool = False) -> DataFrame:
    """Every file below ``root`` whose name ends with ``json``, one record a file, labelled by its path."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*json").text(root, wholetext=True)
        .select(F.col("value").alias("record"), _file_path().alias("source"))
    )
    folder = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?", "", root)
    folder = (os.path.abspath(folder) if folder == root and not root.startswith("/") else folder).rstrip("/") + "/"
    start = F.instr("source", folder)
    below = F.substring(F.col("source"), start + len(folder), F.length("source"))
    labels = path_labels(F.concat(F.lit("root/"), below), F.lit("root"))
    task = to_last_full_stop(labels["task"]) if to_full_stop else labels["task"]
    return files.select(
        F.sha2("source", 256).alias("id"), "source", labels["category"].alias("category"),
        labels["subcategory"].alias("subcategory"), task.alias("task"), "record",
    )


def scan_saved_results(spark: SparkSession, path: str, record: str = "reply", task: str = "task") -> DataFrame:
    """What ``save_results`` wrote, in the columns of ``scan_result_tree``, for the exports and preference jobs.

    ``id`` is a digest of category, subcategory and task, ``source`` their texts joined by slashes. Folder names are read
    as the texts they are; a filter on category or subcategory prunes folders. Results are dealt out by size, since they
    were written by folder: few large files beside many small ones."""
    names = ["category", "subcategory", task]
    rows = spread(spark.read.schema(f"`{task}` string, `{record}` string, category string, subcategory string").parquet(path))
    return rows.select(
        F.sha2(F.to_json(F.array(*names)), 256).alias("id"), F.concat_ws("/", *names).alias("source"),
        "category", "subcategory", F.col(task).alias("task"), F.col(record).alias("record"))


def scan_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Each JSON file of a folder as one example document."""
    return spark.read.text(folder, wholetext=True).select(
        _file_path().alias("source"), F.lit(1).alias("seq_num"), F.col("value").alias("content")
    )


def industry_rows(sheet: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The four used columns of an industry sheet, below its title rows and header, renamed."""
    body = sheet.filter(F.col(ordinal) > SHEET_HEADER_ROWS)
    data = [c for c in sheet.columns if c != ordinal]
    return body.select(
        (F.col(ordinal) - SHEET_HEADER_ROWS - 1).alias(ordinal),
        *[F.col(f"`{data[i]}`").alias(n) for i, n in SHEET_COLUMNS.items()],
    )


def scan_industry_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An industry sheet saved as CSV."""
    return industry_rows(with_ordinal(spark.read.option("multiLine", True).option("escape", '"').csv(path), place()))


def usable_code(files: DataFrame, path: str = "path", code: str = "code", max_chars: int | None = None) -> DataFrame:
    """Source files to mine: known suffix, not a package file, not blank, first of a name; whole, unless ``max_chars`` is given."""
    named = files.withColumn("name", F.substring_index(F.col(path), "/", -1)).filter(
        F.col("name").rlike(CODE_SUFFIX) & (F.col("name") != PACKAGE_FILE) & ~is_blank(code)
    )
    first = first_per_name(named, "name", path)
    return first if max_chars is None else first.withColumn(code, F.substring(F.col(code), 1, max_chars))


def scan_code(spark: SparkSession, root: str, max_chars: int | None = None) -> DataFrame:
    """The usable source files below ``root``; files of other suffixes are not read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", CODE_GLOB).text(root, wholetext=True).select(
        _file_path().alias("path"), F.col("value").alias("code")
    )
    return usable_code(files, max_chars=max_chars)


def scan_search_results(spark: SparkSession, path: str, num_results: int) -> DataFrame:
    """Cached search results with rank below ``num_results``; a filter on the folder columns prunes partitions."""
    return spark.read.parquet(path).filter(F.col("rank") < num_results)


def scan_dataset(spark: SparkSession, path: str, fmt: str = "parquet", num_samples: int | None = None) -> DataFrame:
    """A published data set; with ``num_samples`` its first rows.

    ``json`` is JSON lines, as ``save_dataset`` writes them; ``json_array`` is one array a file."""
    rows = spark.read.json(path, multiLine=True) if fmt == "json_array" else spark.read.format(fmt).load(path)
    return rows if num_samples is None else first_of_scan(rows, num_samples, fmt)

