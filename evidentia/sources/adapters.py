"""Source adapters that end in documents: titles of the statute code, notices of the official journal, pages of a policy manual."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.sources.parsers import crosswalk

#: Elements of the statute XML that are passed over, that are a line each, and whose children are not read again.
ASIDE = {"note", "notes", "sourceCredit", "editorialNotes", "toc"}
LINES = {"num", "heading", "chapeau", "content", "p", "continuation"}
CLOSED = {"num", "heading"}
#: Section states that are left out.
GONE = ("repealed", "omitted", "transferred")
PAGE = r"^https://www\.uscis\.gov/policy-manual/volume-(\d+)(?:-part-([a-z]+))?(?:-chapter-(\d+))?$"


def _name(el) -> str:
    return str(el.tag).rpartition("}")[2]


def _squeezed(el) -> str:
    return re.sub(r"\s+", " ", " ".join(el.itertext())).strip()


def statute_text(section) -> str:
    """The section's lines, two spaces a level from the third on; a bare marker such as (a) takes the next line's text behind it."""
    lines: list[str] = []
    stack = [(el, 0) for el in reversed(section)]
    while stack:
        el, depth = stack.pop()
        name = _name(el)
        if name in ASIDE:
            continue
        text = _squeezed(el) if name in LINES else ""
        if text and lines and re.fullmatch(r"\(\w{1,4}\)", lines[-1].strip()):
            lines[-1] += " " + text
        elif text:
            lines.append("  " * max(0, depth - 2) + text)
        if name not in CLOSED:
            stack += [(child, depth + 1) for child in reversed(el)]
    return "\n".join(lines)


def statute_sections(xml: str, title: int = 8) -> list[tuple[str, str, str, str]]:
    """(number, heading, body, status) of every section that is identified as one of the title."""
    out = []
    for el in ElementTree.fromstring(xml).iter():
        found = re.search(rf"/t{title}/s([\w.\-]+)$", el.get("identifier", "")) if _name(el) == "section" else None
        if found:
            head = next((c for c in el if _name(c) == "heading"), None)
            out.append((found[1], "" if head is None else _squeezed(head), statute_text(el), el.get("status") or ""))
    return out


def read_statutes(spark: SparkSession, path: str, title: int = 8, least: int = 80) -> DataFrame:
    """Documents of the sections in force of the XML files at ``path``, under both their numbers; files are parsed in parallel."""
    return statutes(spark.read.text(path, wholetext=True), title, least)


def statutes(files: DataFrame, title: int = 8, least: int = 80) -> DataFrame:
    """``read_statutes`` of the XML texts in ``value``."""
    spark = files.sparkSession

    def run(batches):
        for b in batches:
            for xml in b["value"]:
                yield pd.DataFrame(statute_sections(xml, title), columns=["number", "title", "body", "status"])

    rows = files.select("value").mapInPandas(run, "number string, title string, body string, status string")
    rows = rows.filter(~F.col("status").isin(*GONE) & (F.length("body") >= least))
    rows = rows.join(F.broadcast(crosswalk(spark)), F.col("number") == F.col("code_section"), "left")  # a fixed table of 143 rows
    code, act = F.concat(F.lit(f"{title} U.S.C. § "), "number"), F.concat(F.lit("INA § "), "act_section")
    names = F.concat(F.lit(f"{title} USC "), "number")
    both = F.concat(F.lit("INA "), "act_section", F.lit("; INA section "), "act_section", F.lit("; "), names, F.lit(f"; {title} U.S.C. "), "number")
    return rows.select(
        F.lit("ina").alias("source"),
        F.concat(F.lit(f"ina:{title}usc-"), "number").alias("doc_id"),
        F.coalesce(F.concat(act, F.lit(" ("), code, F.lit(")")), code).alias("citation"),
        "title",
        F.concat(F.lit("Citation aliases: "), F.coalesce(both, names), F.lit("\n\n"), "body").alias("text"),
        F.concat(F.lit(f"https://www.law.cornell.edu/uscode/text/{title}/"), "number").alias("url"),
        F.array(F.lit("Immigration and Nationality Act"), F.lit(f"{title} U.S.C.")).alias("breadcrumb"),
        F.create_map(F.lit("usc_section"), F.col("number"), F.lit("ina_section"), F.col("act_section")).alias("extra"),
    )


NOTICE = (
    "document_number string, title string, abstract string, publication_date string, type string, html_url string, effective_on string, "
    "action string, citation string, agencies array<struct<name:string>>"
)
#: The journal's fields that are asked for.
NOTICE_FIELDS = [c.split()[0] for c in re.sub("<.*?>", "", NOTICE).split(", ")]


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the journal's JSON arrays at ``path``, with their place in them."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{_fields(NOTICE)}>>").alias("r"))
    return rows.select("file", F.posexplode("r").alias("place", "n")).select("file", "place", "n.*")


def _fields(ddl: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def notices(rows: DataFrame, order: list[str], least: int = 80) -> DataFrame:
    """Documents of the first row of each document number in ``order``; those whose abstract is shorter than ``least`` are left out."""
    rows = rows.filter(_given("document_number").isNotNull())
    first = rows.withColumn("k_", F.row_number().over(Window.partitionBy("document_number").orderBy(*order))).filter("k_ = 1")
    abstract = F.coalesce(F.trim("abstract"), F.lit(""))
    agencies = F.coalesce(F.array_join(F.transform("agencies", lambda a: F.coalesce(a["name"], F.lit(""))), ", "), F.lit(""))
    kind = F.coalesce("type", F.lit(""))
    body = F.concat(
        F.lit("Document type: "), kind, F.lit("\nAction: "), F.coalesce(_given("action"), F.lit("n/a")), F.lit("\nAgency: "), agencies,
        F.lit("\nPublished: "), F.coalesce("publication_date", F.lit("None")), F.lit("\nEffective: "), F.coalesce(_given("effective_on"), F.lit("not specified")),
        F.lit("\n\n"), abstract,
    )
    return first.filter(F.length(abstract) >= least).select(
        F.lit("fedreg").alias("source"),
        F.concat(F.lit("fedreg:"), "document_number").alias("doc_id"),
        F.coalesce(_given("citation"), F.concat(F.lit("Fed. Reg. Doc. "), "document_number")).alias("citation"),
        F.coalesce(F.trim("title"), F.lit("")).alias("title"),
        body.alias("text"),
        F.coalesce(_given("html_url"), F.concat(F.lit("https://www.federalregister.gov/d/"), "document_number")).alias("url"),
        F.array(F.lit("Federal Register"), kind).alias("breadcrumb"),
        F.coalesce(_given("effective_on"), "publication_date").alias("effective_date"),
    )


def policy_pages(urls: DataFrame, url: str = "url", volumes: list[int] | None = None) -> DataFrame:
    """Distinct manual pages of a site's locations that hold text: url, volume, part, chapter. Volumes are all unless given."""
    at = F.rtrim(F.col(url), F.lit("/"))
    rows = urls.filter(F.col(url).contains("/policy-manual/") & ~F.col(url).contains("/es/")).select(at.alias("url")).distinct()
    part = [F.nullif(F.regexp_extract("url", PAGE, k), F.lit("")) for k in (1, 2, 3)]
    rows = rows.filter(F.col("url").rlike(PAGE)).select("url", part[0].cast("int").alias("volume"), part[1].alias("part"), part[2].cast("int").alias("chapter"))
    rows = rows.filter("part is not null or chapter is not null")
    return rows.filter(F.col("volume").isin(*volumes)) if volumes else rows
