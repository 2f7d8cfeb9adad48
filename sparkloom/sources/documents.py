"""Sources and sinks of documents: files by content digest, plain text, HTML to Markdown, catalog and reconciliation."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.session import table

MOST_BYTES = 64 << 20
MOST_CHARS = 8_000_000


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files as (path, digest, size, content, error): whatever Spark's file systems reach. A file of more than most_bytes has no digest and no content but an
    error that says so; the others are read all the same."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    refused = F.when(F.col("length") > most_bytes, F.concat(F.col("length").cast("string"), F.lit(f" bytes, more than {most_bytes}")))
    # by length first, so that the content of large files isn't read
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("string").alias("digest"), F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"), refused.alias("error"))
    sound = files.where(F.col("length") <= most_bytes).select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("size"), "content", F.lit(None).cast("string").alias("error"))
    return sound.unionByName(large)


def plain_texts(files: DataFrame) -> DataFrame:
    """(path, digest, text) of the files that are valid UTF-8 and not blank."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", "digest", T.normalize_text(text).alias("text")).where("text IS NOT NULL")


def text_faults(files: DataFrame) -> DataFrame:
    """(path, error) of the files that plain_texts() leaves out: too large, not UTF-8, or without a text (blank or with a NUL)."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.coalesce("error", F.when(text.isNull(), F.lit("not UTF-8")).when(T.normalize_text(text).isNull(), F.lit("no text")))
    return files.select("path", error.alias("error")).where("error IS NOT NULL")


def first_locations(files: DataFrame) -> DataFrame:
    """One row per digest: the first path, the copies, and whether all agree in size (if not, the catalog is corrupt)."""
    return files.groupBy("digest").agg(F.min("path").alias("path"), F.count("*").alias("copies"), (F.count_distinct("size") == 1).alias("sound"))


def reconcile(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, state) of a catalog (path, digest) against a listing (path, digest): added, duplicate (of a known digest), changed, missing or kept."""
    known = catalog.select("digest").distinct().withColumn("known", F.lit(True))
    both = catalog.select("path", F.col("digest").alias("old")).join(listing.select("path", F.col("digest").alias("new")), "path", "full_outer")
    marked = both.join(known.withColumnRenamed("digest", "new"), "new", "left")
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), F.when(F.col("known"), "duplicate").otherwise("added")).when(F.col("old") != F.col("new"), "changed").otherwise("kept")
    return marked.select("path", state.alias("state"))


def catalog_page(documents: DataFrame, selected: DataFrame, offset: int, most: int = 50) -> DataFrame:
    """A page of all documents with a flag for those that a zone has selected."""
    if not 0 < most <= 200:
        raise ValueError("a page has 1 to 200 rows")
    flagged = documents.join(selected.select("doc_id").distinct().withColumn("_chosen", F.lit(True)), "doc_id", "left")
    return flagged.withColumn("selected", F.col("_chosen").isNotNull()).drop("_chosen").orderBy("doc_id").offset(offset).limit(most)


def prepare_missing(documents: DataFrame, prepared: DataFrame) -> DataFrame:
    """Documents that still need a text under their profiles (doc_id, extraction, normalisation)."""
    return documents.join(prepared, ["doc_id", "extraction", "normalisation"], "left_anti")


class _Markdown(HTMLParser):
    """Collects headings, paragraphs, lists, links' texts and tables of a page as Markdown; scripts and styles are dropped."""

    BLOCKS = frozenset(["p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "blockquote", "pre", "ul", "ol", "table", "form", "figure", "body"])
    SKIPPED = frozenset(["script", "style", "noscript", "template", "svg"])

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.now: list[str] = []
        self.title: list[str] = []
        self.mark, self.skipped, self.in_title = "", 0, False
        self.cells: list[str] | None = None
        self.rows: list[list[str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.lines.append(self.mark + text)
        self.mark = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skipped += 1
        elif tag == "title":
            self.in_title = True
        elif tag in ("td", "th"):
            self.now = []
        elif tag == "tr":
            self.cells = []
        elif tag in self.BLOCKS or tag == "li" or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            if self.cells is None:
                self.flush()
            if tag == "li":
                self.mark = "- "
            elif tag[0] == "h" and tag[1:].isdigit():
                self.mark = "#" * int(tag[1]) + " "
            elif tag == "table":
                self.rows = []
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join("".join(self.now).split()))
            self.now = []
        elif tag == "tr" and self.cells is not None:
            self.rows.append(self.cells)
            self.cells = None
        elif tag == "table":
            for number, cells in enumerate(x for x in self.rows if x):
                self.lines.append("| " + " | ".join(x.replace("|", "\\|") for x in cells) + " |")
                if number == 0:
                    self.lines.append("|" + " --- |" * len(cells))
            self.rows = []
        elif tag in self.BLOCKS or tag == "li" or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()):
            if self.cells is None:
                self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self.now.append(data)


def html_to_markdown(page: str, most: int = MOST_CHARS) -> tuple[str | None, str]:
    """(title, Markdown) of an HTML page; more than `most` characters of Markdown are refused, not cut."""
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    parser.flush()
    text = "\n\n".join(parser.lines)
    if len(text) > most:
        raise ValueError(f"a page gives {len(text)} characters, more than {most}")
    return " ".join("".join(parser.title).split()) or None, text


def html_texts(pages: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(page_id, title, markdown, error) of pages (page_id, html); null pages give an empty text, a page that is refused no text but an error."""

    def read(page: str | None) -> tuple[str | None, str | None, str | None]:
        try:
            return *html_to_markdown(page or "", most), None
        except Exception as e:  # whatever a page does to the parser, the others go on
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], **{name: [x[i] for x in found] for i, name in enumerate(("title", "markdown", "error"))}})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, markdown string, error string")


def with_cache(texts: DataFrame, cache: DataFrame, capability: str, version: str) -> DataFrame:
    """Texts with their cached payload by key over capability, version and text; null where it has to be computed."""
    key = T.deterministic_id(F.lit(capability), F.lit(version), F.col("text"))
    return texts.withColumn("key", key).join(cache.select("key", "payload"), "key", "left")


def html_to_text(spark, sf_dir):
    return html_texts(table(spark, sf_dir, "pages")).select("page_id", "title", F.char_length("markdown").alias("chars"), F.sha2("markdown", 256).alias("digest"))


def page_titles(spark, sf_dir):
    raw = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_title(raw).alias("title"))


def document_reconcile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), "doc_id")
    listing = rows.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"))
    return reconcile(rows.where("doc_id % 5 <> 0").select("path", "digest"), listing).groupBy("state").agg(F.count("*").alias("n"))


def document_catalog(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return catalog_page(documents, documents.where("source = 'src3'"), 20, 100)


def document_prepare_missing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", F.lit("plain").alias("extraction"), F.coalesce("lang", F.lit("")).alias("normalisation"))
    return prepare_missing(documents, documents.where("doc_id % 4 <> 1"))


def analysis_cache(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    cache = texts.where("doc_id % 2 = 0").select(T.deterministic_id(F.lit("sentences"), F.lit("1"), F.col("text")).alias("key"), F.char_length("text").alias("payload")).dropDuplicates(["key"])
    return with_cache(texts, cache, "sentences", "1").groupBy(F.col("payload").isNotNull().alias("cached")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (html_to_text, page_titles, document_reconcile, document_catalog, document_prepare_missing, analysis_cache)}

ORACLE_SQL = {
    "page_titles": r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages",
    "document_reconcile": """WITH r AS (SELECT 'd' || doc_id AS path, sha256(text) AS digest, doc_id FROM documents WHERE text IS NOT NULL), c AS (SELECT path, digest FROM r WHERE doc_id % 5 <> 0),
l AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256(digest) ELSE digest END AS digest FROM r WHERE doc_id % 7 <> 0)
SELECT CASE WHEN l.path IS NULL THEN 'missing' WHEN c.path IS NULL THEN CASE WHEN l.digest IN (SELECT digest FROM c) THEN 'duplicate' ELSE 'added' END WHEN c.digest <> l.digest THEN 'changed' ELSE 'kept' END AS state, count(*) AS n FROM c FULL OUTER JOIN l ON c.path = l.path GROUP BY 1""",
    "document_catalog": "SELECT doc_id, lang, source, coalesce(source = 'src3', false) AS selected FROM documents ORDER BY doc_id LIMIT 100 OFFSET 20",
    "document_prepare_missing": "SELECT doc_id, 'plain' AS extraction, coalesce(lang, '') AS normalisation FROM documents WHERE doc_id % 4 = 1",
    "analysis_cache": "WITH t AS (SELECT text IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) AS cached FROM documents WHERE text IS NOT NULL) SELECT cached, count(*) AS n FROM t GROUP BY cached",
}
