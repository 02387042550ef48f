"""Text expressions: names, paths, search queries, cleaning, Markdown tables, budgets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# The character classes Python's Unicode-aware \w and \s stand for, spelled out so
# that the Java and RE2 regex engines agree on them.
WORD = r"\p{L}\p{N}_"
SPACE = r"\p{Z}\t-\r\x{1c}-\x{1f}\x{85}"
# The same white space as single characters, for trimming.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Limits of task and file names, and of a source file put in a prompt.
TASK_NAME_LIMIT = 65
TASK_NAME_KEPT = 55
FILE_NAME_LIMIT = 255
FILE_NAME_KEPT = 254
SOURCE_FILE_CHARS = 250_000
# Context tokens set aside for the rest of the prompt, and characters per token.
RESERVED_TOKENS = 4000
RESERVED_TOKENS_STEPWISE = 8000
CHARS_PER_TOKEN = 2


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def is_blank(c) -> Column:
    return strip(c) == ""


def search_query(category, subcategory, task) -> Column:
    """The web query of a task."""
    return F.concat(
        F.lit('"'), _col(category), F.lit('" "'), _col(subcategory), F.lit('" '), _col(task),
        F.lit(" AND (documentation OR functions OR examples OR code)"),
    )


def safe_name(c) -> Column:
    """Letters, digits, ``_``, ``-`` and white space only; blanks become ``_``; over-long names are cut."""
    kept = F.regexp_replace(_col(c), f"[^{WORD}{SPACE}-]", "")
    name = F.replace(kept, F.lit(" "), F.lit("_"))
    return F.when(F.length(name) > FILE_NAME_LIMIT, F.substring(name, 1, FILE_NAME_KEPT)).otherwise(name)


def task_slug(task) -> Column:
    """File-system name of a task."""
    task = _col(task)
    short = F.when(F.length(task) > TASK_NAME_LIMIT, F.substring(task, 1, TASK_NAME_KEPT)).otherwise(task)
    return safe_name(short)


def underscored(c) -> Column:
    return F.replace(_col(c), F.lit(" "), F.lit("_"))


def task_label(category, subcategory, slug) -> Column:
    """``category_subcategory_slug`` without blanks."""
    return underscored(F.concat_ws("_", _col(category), _col(subcategory), _col(slug)))


def result_path(vendor, run_date, category, subcategory, slug) -> Column:
    """Where the result of one task lives, relative to the job's root. ``run_date`` is always given,
    never today's date, so that a re-run finds the earlier results."""
    folder = F.concat(F.lit("results/"), _col(vendor), F.lit("_"), _col(run_date).cast("string"))
    path = F.concat_ws("/", folder, _col(category), _col(subcategory), F.concat(_col(slug), F.lit(".json")))
    return underscored(path)


def search_folder(run_date, category, subcategory, slug) -> Column:
    """Where the search results of one task are cached."""
    path = F.concat_ws(
        "/", F.lit("search_results"), _col(run_date).cast("string"), _col(category), _col(subcategory), _col(slug)
    )
    return underscored(path)


def readable(c) -> Column:
    """A path segment as a label."""
    return F.replace(_col(c), F.lit("_"), F.lit(" "))


def file_stem(c) -> Column:
    """File name without folder and last extension (a leading dot is not an extension)."""
    name = F.substring_index(_col(c), "/", -1)
    return F.when(name.rlike(r"^\.*[^.]+\."), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)


def path_labels(path, root) -> Column:
    """Struct of category, subcategory and task read off a result path below ``root``."""
    below = F.substring(_col(path), F.length(_col(root)) + 2, F.length(_col(path)))
    parts = F.split(below, "/")
    return F.struct(
        readable(F.get(parts, F.lit(0))).alias("category"),
        readable(F.get(parts, F.lit(1))).alias("subcategory"),
        readable(file_stem(path)).alias("task"),
    )


def clean_text(c) -> Column:
    """Drop all but ASCII letters, digits and white space."""
    return F.regexp_replace(_col(c), f"[^a-zA-Z0-9{SPACE}]", "")


def collapse_spaces(c) -> Column:
    return F.regexp_replace(_col(c), f"[{SPACE}]+", " ")


def to_last_full_stop(c) -> Column:
    """Cut an unfinished last sentence; text without a full stop is left alone."""
    text = _col(c)
    tail = F.length(F.substring_index(text, ".", -1))
    return F.when(F.contains(text, F.lit(".")), F.substring(text, F.lit(1), F.length(text) - tail)).otherwise(text)


def task_file_name(c) -> Column:
    """Name of the task file mined from a source file."""
    name = F.substring_index(_col(c), "/", -1)
    return F.concat(F.regexp_replace(name, r"\.(py|ipynb|txt|js)\z", ""), F.lit(".json"))


def _markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""))


def markdown_table(rows: Column) -> Column:
    """One table (array of rows of cells): first row header, then the separator, then the body."""
    header = F.get(rows, F.lit(0))
    rule = _markdown_row(F.transform(header, lambda _: F.lit("---")))
    body = F.slice(rows, F.lit(2), F.size(rows))
    lines = F.concat(F.array(_markdown_row(header), rule), F.transform(body, _markdown_row))
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(F.size(rows) > 0, text).otherwise(F.lit(""))


def markdown_tables(tables) -> Column:
    """All tables of a document, one after the other; a table without rows adds nothing."""
    return F.array_join(F.transform(_col(tables), markdown_table), "")


def context_tokens(vendor, lengths: Mapping[str, int]) -> Column:
    """Context length of a vendor's model; null for an unknown vendor."""
    known = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])
    return F.try_element_at(known, _col(vendor))


def character_budget(context_tokens, stepwise: bool = False) -> Column:
    """Characters of documents that fit a vendor's context."""
    reserved = RESERVED_TOKENS_STEPWISE if stepwise else RESERVED_TOKENS
    return (_col(context_tokens).cast("long") - F.lit(reserved)) * F.lit(CHARS_PER_TOKEN)
