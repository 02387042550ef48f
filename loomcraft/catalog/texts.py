"""Names, paths, search queries, cleaning, Markdown, budgets, file selection."""

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import selection as S
from ..operators.pages import extract_pages
from ..operators.prefix import forward_fill, with_position
from ..plans.context import gather_documents
from ..plans.curricula import SKIPPED_ROWS, industry_tasks
from ..session import fresh_path
from ..sources.scans import usable_code
from .registry import SQL, query, table

KEEP = rf"'[^{X.WORD}{X.SPACE}-]'"
RUN_DATE = "2024-02-13"


def sql_safe_name(c: str) -> str:
    name = f"replace(regexp_replace({c}, {KEEP}, '', 'g'), ' ', '_')"
    return f"left({name}, CASE WHEN length({name}) > 255 THEN 254 ELSE 255 END)"


def sql_slug(c: str) -> str:
    return sql_safe_name(f"left({c}, CASE WHEN length({c}) > 65 THEN 55 ELSE 65 END)")


SQL_CLEAN = rf"regexp_replace(text, '[^a-zA-Z0-9{X.SPACE}]', '', 'g')"


@query("""
SELECT doc_id, '"' || source || '" "' || lang || '" ' || text
       || ' AND (documentation OR functions OR examples OR code)' AS search_query
FROM documents""")
def search_queries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.search_query("source", "lang", "text").alias("search_query"))


@query(f"SELECT doc_id, {sql_slug('text')} AS slug, {sql_safe_name('text')} AS name FROM documents")
def task_slugs(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.task_slug("text").alias("slug"), X.safe_name("text").alias("name"))


@query(f"""
SELECT doc_id, replace(source || '_' || lang || '_' || slug, ' ', '_') AS label,
       replace('results/acme_{RUN_DATE}/' || source || '/' || lang || '/' || slug || '.json', ' ', '_') AS path,
       replace('search_results/{RUN_DATE}/' || source || '/' || lang || '/' || slug, ' ', '_') AS folder
FROM (SELECT *, {sql_slug('text')} AS slug FROM documents)""")
def result_paths(spark, sf):
    docs = table(spark, sf, "documents").withColumn("slug", X.task_slug("text"))
    return docs.select(
        "doc_id", X.task_label("source", "lang", "slug").alias("label"),
        X.result_path(F.lit("acme"), F.lit(RUN_DATE), "source", "lang", "slug").alias("path"),
        X.search_folder(F.lit(RUN_DATE), "source", "lang", "slug").alias("folder"),
    )


@query("""
SELECT c_custkey, replace(c_mktsegment, '_', ' ') AS category, replace(n_name, '_', ' ') AS subcategory,
       replace(c_name, '_', ' ') AS task
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def path_labels(spark, sf):
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat_ws("/", F.lit("results/run_1"), "c_mktsegment", "n_name", F.concat("c_name", F.lit(".json")))
    return named.select("c_custkey", X.path_labels(path, F.lit("results/run_1")).alias("l")).select("c_custkey", "l.*")


@query(f"SELECT doc_id, {SQL_CLEAN} AS cleaned FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_text("text").alias("cleaned"))


@query("""
SELECT doc_id, CASE WHEN contains(text, '.') THEN left(text, length(text) - instr(reverse(text), '.') + 1)
                    ELSE text END AS kept
FROM documents""")
def strip_incomplete(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.to_last_full_stop("text").alias("kept"))


@query("""
SELECT s_suppkey, (4096 * (2 + s_nationkey) - 4000) * 2 AS budget, (4096 * (2 + s_nationkey) - 8000) * 2 AS budget_stepwise
FROM supplier""")
def budgets(spark, sf):
    vendors = table(spark, sf, "supplier").withColumn("context_tokens", (F.col("s_nationkey") + 2) * 4096)
    return vendors.select(
        "s_suppkey", X.character_budget("context_tokens").alias("budget"),
        X.character_budget("context_tokens", stepwise=True).alias("budget_stepwise"))


CONTEXTS = {"1-URGENT": 128000, "2-HIGH": 32768, "5-LOW": 8192}


@query("""
SELECT o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 128000 WHEN '2-HIGH' THEN 32768 WHEN '5-LOW' THEN 8192 END - 4000) * 2 AS budget
FROM orders""")
def vendor_budgets(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", X.character_budget(X.context_tokens("o_orderpriority", CONTEXTS)).alias("budget"))


SQL_ORDER_TABLES = """
'| order | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || o_orderkey || ' | '
|| o_orderstatus || ' | ' || o_orderpriority || ' |' || chr(10)
|| '| customer |' || chr(10) || '| --- |' || chr(10) || '| ' || o_custkey || ' |' || chr(10) || '| ' || o_orderkey || ' |' || chr(10)"""


@query(f"SELECT o_orderkey, {SQL_ORDER_TABLES} AS markdown FROM orders")
def tables_markdown(spark, sf):
    text = lambda c: F.col(c).cast("string")
    tables = F.array(
        F.array(F.array(F.lit("order"), F.lit("status"), F.lit("priority")),
                F.array(text("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))),
        F.array(F.array(F.lit("customer")), F.array(text("o_custkey")), F.array(text("o_orderkey"))),
        F.array().cast("array<array<string>>"),
    )
    return table(spark, sf, "orders").select("o_orderkey", X.markdown_tables(tables).alias("markdown"))


@query(r"""
WITH shown AS (SELECT page_id, url, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS body FROM pages),
paragraphs AS (
  SELECT page_id, place, regexp_replace(regexp_replace(piece, '(?s)</(p|article|body|html)>.*', ''), '<[^>]*>', '', 'g') AS words
  FROM (SELECT page_id, unnest(string_split(body, '<p>')[2:]) AS piece, generate_subscripts(string_split(body, '<p>')[2:], 1) AS place
        FROM shown)),
texts AS (
  SELECT page_id, place, trim(replace(replace(replace(replace(words, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
                              ' ' || chr(9) || chr(10) || chr(13)) AS text FROM paragraphs)
SELECT page_id, url, coalesce(regexp_replace(content, '[ \t\n\r]+', ' ', 'g'), '') AS content, []::VARCHAR[][][] AS tables
FROM shown LEFT JOIN (SELECT page_id, string_agg(text, ' ' ORDER BY place) AS content FROM texts WHERE text <> '' GROUP BY page_id)
USING (page_id)""")
def page_extract(spark, sf):
    return extract_pages(table(spark, sf, "pages", spread_out=True))


@query(f"""
SELECT o_orderkey, 'Order ' || o_orderkey || ' is <' || o_orderstatus || '> & due' AS content,
       {SQL_ORDER_TABLES} AS markdown
FROM orders""")
def page_tables(spark, sf):
    cells = lambda *c: F.concat(F.lit("<tr>"), *[x for i in c for x in (F.lit("<td> <b>"), i, F.lit("</b>\n</td>"))], F.lit("</tr>"))
    text = lambda c: F.col(c).cast("string")
    page = F.concat(
        F.lit('<!DOCTYPE html><html><head><script>var t="</p><table>";</script></head><body><p> Order\n<i>'),
        text("o_orderkey"), F.lit("</i> is &lt;"), F.col("o_orderstatus"), F.lit("&gt;<!-- x --> &amp; due</p><p> </p><table>"),
        cells(F.lit("order"), F.lit("status"), F.lit("priority")),
        cells(text("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")),
        F.lit("</table><table>"), cells(F.lit("customer")), cells(text("o_custkey")), cells(text("o_orderkey")),
        F.lit("</table></body></html>"),
    )
    pages = extract_pages(table(spark, sf, "orders", spread_out=True).select("o_orderkey", page.alias("html")))
    return pages.select("o_orderkey", "content", X.markdown_tables("tables").alias("markdown"))


SQL_CODE_PATH = """'repo/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '/' || CASE
    WHEN n_chars < 60 THEN '__init__.py'
    ELSE source || '_' || lang || CASE WHEN n_chars < 400 THEN '.py' WHEN n_chars < 900 THEN '.ipynb'
         WHEN n_chars < 1500 THEN '.js' WHEN n_chars < 6000 THEN '.txt' ELSE '.md' END END"""


@query(f"""
WITH files AS (SELECT {SQL_CODE_PATH} AS path, text AS code FROM documents),
named AS (SELECT *, split_part(path, '/', 3) AS name FROM files)
SELECT path, name, left(code, 250000) AS code, regexp_replace(name, '\\.(py|ipynb|txt|js)$', '') || '.json' AS task_file
FROM named
WHERE regexp_matches(name, '\\.(py|ipynb|txt|js)$') AND name <> '__init__.py' AND regexp_matches(code, '[^{X.SPACE}]')
QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) = 1""")
def code_files(spark, sf):
    files = code_corpus(spark, sf)
    return usable_code(files, max_chars=X.SOURCE_FILE_CHARS).select("path", "name", "code", X.task_file_name("path").alias("task_file"))


def code_corpus(spark, sf):
    """Documents laid out as a source tree: many files of one name, package files, other suffixes."""
    path = F.expr(SQL_CODE_PATH.replace("VARCHAR", "STRING"))
    return table(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("code"))


@query("SELECT source, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY source")
def first_per_name(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    return S.first_per_name(docs, "source", "doc_id")


@query("SELECT doc_id, source, lang, text FROM documents ORDER BY doc_id LIMIT 10")
def first_tasks(spark, sf):
    return S.first_rows(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), 10, ["doc_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 5")
def skip_head(spark, sf):
    return S.skip_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), 5, "c_custkey")


@query("""
SELECT doc_id, source, lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def skip_done(spark, sf):
    tasks = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return S.not_done(tasks, table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, text, source, NULL AS item_id FROM documents UNION ALL SELECT NULL, text, NULL, item_id FROM benchmark")
def append_side(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return S.with_side_sets(docs, table(spark, sf, "benchmark"), None)


# Pages as two engines' result lists: what mentions one word, what mentions another.
FIRST_WORD, SECOND_WORD = "the", "un"


@query(f"""
WITH hits AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS site,
                     split_part(split_part(url, '?', 1), '#', 1) AS url, html FROM pages),
first AS (SELECT site, page_id AS position, url FROM hits WHERE contains(html, '{FIRST_WORD}')),
second AS (SELECT site, min(page_id) AS position, url FROM hits WHERE contains(html, '{SECOND_WORD}') GROUP BY site, url)
SELECT site, 1 AS engine, position, url FROM first
UNION ALL
SELECT site, 2, position, url FROM second s
WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.site = s.site AND f.url = s.url)""")
def url_union(spark, sf):
    site = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    plain = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    hits = table(spark, sf, "pages").select(site.alias("site"), F.col("page_id").alias("position"), plain.alias("url"), "html")
    found = lambda word: hits.filter(F.contains("html", F.lit(word))).drop("html")
    return S.merged_results(found(FIRST_WORD), found(SECOND_WORD), ["site"], "position", "url")


SQL_HITS = """SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS site, split_part(split_part(url, '?', 1), '#', 1) AS url, html FROM pages"""


@query(f"""
WITH hits AS ({SQL_HITS}),
first AS (SELECT site, 1 AS engine, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS position, url FROM hits
          WHERE contains(html, '{FIRST_WORD}') QUALIFY position < 10),
other AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS position, url FROM hits
          WHERE contains(html, '{SECOND_WORD}') QUALIFY position < 10),
second AS (SELECT site, 2 AS engine, min(position) AS position, url FROM other
           WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.site = other.site AND f.url = other.url) GROUP BY site, url),
ranked AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY engine, position, url) - 1 AS rank, url
           FROM (SELECT * FROM first UNION ALL SELECT * FROM second)),
pages_read AS ({SQL["page_extract"]}),
fetched AS (SELECT hits.url, arg_min(content, page_id) AS content FROM hits JOIN pages_read USING (page_id) GROUP BY hits.url)
SELECT site AS task_key, rank, url, content FROM ranked JOIN fetched USING (url) WHERE content <> ''""")
def gathered_documents(spark, sf):
    """Sites as tasks. Some are searched in a first run, the others in a second; a third would find nothing and is never asked."""
    pages = table(spark, sf, "pages")
    plain = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    hits = pages.select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("task_key"), "page_id", plain.alias("url"), "html")
    tasks = hits.select("task_key").distinct()

    def engine(missing, word):
        listed = with_position(hits.filter(F.contains("html", F.lit(word))).drop("html"), ["task_key"], "page_id", "position")
        return listed.join(missing.select("task_key"), "task_key", "left_semi").select("task_key", "position", "url")

    def search(missing):
        return engine(missing, FIRST_WORD), engine(missing, SECOND_WORD)

    def fetch(urls):
        first = hits.groupBy("url").agg(F.min("page_id").alias("page_id"))
        return hits.join(first, ["url", "page_id"], "left_semi").join(urls, "url", "left_semi")

    path = fresh_path(spark, "gathered")
    gather_documents(tasks.filter(F.crc32(F.col("task_key").cast("binary")) % 2 == 0), search, fetch, path)
    gather_documents(tasks, search, fetch, path)
    nothing = lambda missing: (missing.select("task_key", F.lit(0).alias("position"), F.lit("x").alias("url")).limit(0), None)
    return gather_documents(tasks, nothing, fetch, path).drop("tables")


@query("""
SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER w AS value, last_value(t IGNORE NULLS) OVER w AS event_type
FROM (SELECT *, CASE WHEN event_type <> 'purchase' THEN value END AS v,
             CASE WHEN event_type <> 'error' THEN event_type END AS t FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def forward_fill_by_user(spark, sf):
    return forward_fill(blanked_events(spark, sf), ["value", "event_type"], "event_id", ["user_id"], block_rows=1000)


@query("""
SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER w AS value, last_value(t IGNORE NULLS) OVER w AS event_type
FROM (SELECT *, CASE WHEN event_type <> 'purchase' THEN value END AS v,
             CASE WHEN event_type <> 'error' THEN event_type END AS t FROM events)
WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def forward_fill_all(spark, sf):
    return forward_fill(blanked_events(spark, sf), ["value", "event_type"], "event_id", block_rows=1000)


def blanked_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "purchase", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))


# Customers as an industry sheet with merged cells: a cell is blank where it repeats the one above.
SQL_SHEET = """
SELECT c_custkey AS ordinal, c_mktsegment AS sector, n_name AS grp, 'Industry ' || (c_custkey // 4) AS industry, c_name AS sub
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query(f"""
SELECT ordinal, grp AS category, industry AS subcategory, sub AS task,
       '{{"Category":"' || grp || '","SubCategory":"' || industry || '","Task":"' || sub || '"}}' AS task_json
FROM ({SQL_SHEET}) WHERE ordinal >= 5""")
def industry_curriculum(spark, sf):
    return industry_tasks(industry_sheet(spark, sf), skip=SKIPPED_ROWS)


def industry_sheet(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sheet = rows.select(
        F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("Sector"), F.col("n_name").alias("Industry Group"),
        F.concat(F.lit("Industry "), F.floor(F.col("c_custkey") / 4).cast("string")).alias("Industry"),
        F.col("c_name").alias("Sub-Industry"))
    # Neighbours stay within blocks of 1000 rows, as merged cells do not cross a page.
    above = Window.partitionBy(F.floor(F.col("ordinal") / 1000)).orderBy("ordinal")
    blank = lambda c: F.when(~F.coalesce(F.lag(c).over(above) == F.col(c), F.lit(False)), F.col(c)).alias(c)
    return sheet.select("ordinal", *[blank(c) for c in ("Sector", "Industry Group", "Industry")], "Sub-Industry")


