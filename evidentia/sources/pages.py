"""Web pages and publications as documents. Pages are parsed by the standard library in Arrow batches; the rest are column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidentia.functions import text as T
from evidentia.partitions import small_batches
from evidentia.sources.adapters import PAGE
from evidentia.sources.parsers import effective_date

#: Where a page's text stands, the first that is there, and what is cut from it.
MANUAL_BODY = ["div.WordSection1", "body"]
MANUAL_JUNK = ["p.HeaderFooterClassificationIndicator", ".MsoHeader", ".MsoFooter"]
POLICY_BODY = ["article", "#content", "body"]
POLICY_JUNK = ["nav", "header", "footer", "script", "style", ".breadcrumb", ".usa-sidenav", ".book-navigation", ".toc", ".visually-hidden", ".uscis-alert"]
#: File stem, citation, title, landing page.
PUBLICATIONS = [
    ("irs_pub17", "IRS Publication 17", "Your Federal Income Tax (For Individuals)", "https://www.irs.gov/forms-pubs/about-publication-17", "p17"),
    ("irs_pub501", "IRS Publication 501", "Dependents, Standard Deduction, and Filing Information", "https://www.irs.gov/forms-pubs/about-publication-501", "p501"),
    ("irs_pub519", "IRS Publication 519", "U.S. Tax Guide for Aliens", "https://www.irs.gov/forms-pubs/about-publication-519", "p519"),
    ("irs_pub970", "IRS Publication 970", "Tax Benefits for Education", "https://www.irs.gov/forms-pubs/about-publication-970", "p970"),
    ("irs_form1040_instructions", "IRS Form 1040 Instructions", "Instructions for Form 1040 and 1040-SR", "https://www.irs.gov/forms-pubs/about-form-1040", "i1040gi"),
]
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


def _hit(selector: str, tag: str, ids: str, classes: set[str]) -> bool:
    """Whether an element is meant by tag, tag.class, .class or #id."""
    if selector.startswith("#"):
        return ids == selector[1:]
    name, _, kind = selector.partition(".")
    return name in ("", tag) and (not kind or kind in classes)


class Selected(HTMLParser):
    """Text pieces of the first element that each selector names, without junk elements, in one pass over the page."""

    def __init__(self, within: list[str], junk: list[str]):
        super().__init__(convert_charrefs=True)
        self.within, self.junk = within, junk
        self.open: list[str] = []
        self.cut: int | None = None
        self.at: dict[str, int] = {}
        self.pieces: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append(tag)
        given = dict(attrs)
        ids, classes = given.get("id") or "", set((given.get("class") or "").split())
        for s in self.within:
            if s not in self.pieces and _hit(s, tag, ids, classes):
                self.at[s], self.pieces[s] = len(self.open), []
        if self.cut is None and (tag in ("script", "style") or any(_hit(s, tag, ids, classes) for s in self.junk)):
            self.cut = len(self.open)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open.pop() != tag:
            pass
        depth = len(self.open)
        self.at = {s: d for s, d in self.at.items() if d <= depth}
        if self.cut is not None and self.cut > depth:
            self.cut = None

    def handle_data(self, data):
        data = data.strip()
        if data and self.cut is None:
            for s in self.at:
                self.pieces[s].append(data)

    def text(self) -> str | None:
        return next(("\n".join(self.pieces[s]) for s in self.within if s in self.pieces), None)


def selected(html: str | None, within: list[str], junk: list[str]) -> str | None:
    page = Selected(within, junk)
    page.feed(html or "")
    page.close()
    return page.text()


def page_text(html: Column, within: list[str], junk: list[str]) -> Column:
    """The text of a page's main element, a line a piece; null if the page has none of them."""
    small_batches()

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: selected(p, within, junk), na_action=None)

    return run(html)


@F.pandas_udf(StringType())
def capitals_to_title(headings: pd.Series) -> pd.Series:
    """Headings in capitals get a capital a word; the letter behind any other sign counts as a word's first."""
    return headings.map(lambda h: h.title() if isinstance(h, str) and h.isupper() else h)


def manual_sections(pages: DataFrame, volume: str = "09FAM", base: str = "", least: int = 200) -> DataFrame:
    """Documents of a consular manual's pages: id, text (its title in the tree), url, breadcrumb, html."""
    body = page_text(F.col("html"), MANUAL_BODY, MANUAL_JUNK)
    rows = pages.withColumn("body", F.regexp_replace(F.regexp_replace(body, r"^UNCLASSIFIED \(U\)\s*", ""), r"\bUNCLASSIFIED \(U\)", ""))
    rows = rows.filter(F.length("body") >= least)
    title, number = F.trim(F.regexp_replace("text", r"\s+", " ")), r"^([\d.\-()A-Z]+)\s+(.*)$"
    named = title.rlike(number)
    ident = F.coalesce("id", F.lit(""))
    return rows.select(
        F.lit("fam").alias("source"),
        F.concat(F.lit(f"fam:{volume}-"), ident).alias("doc_id"),
        F.concat(F.lit("9 FAM "), F.when(named, F.regexp_extract(title, number, 1)).otherwise(ident)).alias("citation"),
        capitals_to_title(F.when(named, F.regexp_extract(title, number, 2)).otherwise(title)).alias("title"),
        F.col("body").alias("text"),
        F.concat(F.lit(base), "url").alias("url"),
        F.coalesce("breadcrumb", F.array().cast("array<string>")).alias("breadcrumb"),
        effective_date(F.col("body")).cast("string").alias("effective_date"),
    )


def policy_documents(pages: DataFrame, least: int = 400) -> DataFrame:
    """Documents of a policy manual's pages: url, html. Pages of other addresses are left out."""
    rows = pages.filter(F.col("url").rlike(PAGE))
    rows = rows.withColumn("body", F.regexp_replace(page_text(F.col("html"), POLICY_BODY, POLICY_JUNK), r"\n{3,}", "\n\n")).filter(F.length("body") >= least)
    volume = F.regexp_extract("url", PAGE, 1)
    part = F.nullif(F.upper(F.regexp_extract("url", PAGE, 2)), F.lit(""))
    chapter = F.nullif(F.regexp_extract("url", PAGE, 3), F.lit(""))
    head = F.coalesce(F.regexp_replace(page_text(F.col("html"), ["h1"], []), "\n", " "), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(head, r"\s*\|\s*USCIS\s*$", ""), r"^(?:Chapter|Part)\s+\w+\s*[-–]\s*", ""))
    stamp = F.nullif(F.regexp_extract("html", r"Last Reviewed/Updated:\s*(\d{2}/\d{2}/\d{4})", 1), F.lit(""))
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit("uscis_pm").alias("source"),
        F.concat(F.lit("uscis_pm:"), F.substring_index("url", "/", -1)).alias("doc_id"),
        F.concat(F.lit("USCIS Policy Manual Vol. "), volume, F.coalesce(F.concat(F.lit(", Part "), part), F.lit("")), F.coalesce(F.concat(F.lit(", Ch. "), chapter), F.lit(""))).alias("citation"),
        F.when(bare != "", bare).otherwise(head).alias("title"),
        F.col("body").alias("text"),
        "url",
        F.concat(F.array(F.lit("USCIS Policy Manual"), F.concat(F.lit("Volume "), volume)), F.when(part.isNotNull(), F.array(F.concat(F.lit("Part "), part))).otherwise(none)).alias("breadcrumb"),
        F.try_to_date(stamp, "MM/dd/yyyy").cast("string").alias("effective_date"),
    )


def publications(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """``publication_documents`` of the PDF files at ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return publication_documents(files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("stem"), "content"), extract)


def publication_documents(files: DataFrame, extract: Callable[[bytes], str]) -> DataFrame:
    """A document a known publication among ``files`` (stem, content). ``extract`` gives the raw text of a file's bytes; empty texts are left out."""

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(extract)

    run = run.asNondeterministic()  # so that no filter takes it below the join, to files of other kinds
    known = files.sparkSession.createDataFrame(PUBLICATIONS, "stem string, citation string, title string, url string, file string")
    rows = files.join(F.broadcast(known), "stem").withColumn("text", T.normalize_ws(T.clean_pdf_text(run("content")))).filter("text <> ''")  # five fixed rows
    return rows.select(
        F.lit("irs_pub").alias("source"), F.concat(F.lit("irs_pub:"), "stem").alias("doc_id"), "citation", "title", "text", "url",
        F.array(F.lit("Internal Revenue Service"), F.col("citation")).alias("breadcrumb"),
        F.create_map(F.lit("pdf"), F.concat(F.lit("https://www.irs.gov/pub/irs-pdf/"), "file", F.lit(".pdf"))).alias("extra"),
    )
