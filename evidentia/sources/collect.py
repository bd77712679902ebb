"""Sources as documents: each is fetched through the cache table and parsed by its adapter."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.sources import adapters, fetch, pages, parsers
from evidentia.sources.fetch import Get

SOURCES = ("ecfr", "usc", "fam", "uscis_pm", "fedreg", "irs")
#: Where the sources stand, what is taken of them, and the pause between requests to one host in seconds.
CODE = "https://www.ecfr.gov/api/versioner/v1"
STATUTES = "https://uscode.house.gov/download/"
MANUAL, VOLUME = "https://fam.state.gov", "09FAM"
SITEMAP, VOLUMES = "https://www.uscis.gov/sitemap.xml", [2, 6, 7]
JOURNAL, AGENCIES, DAYS = "https://www.federalregister.gov/api/v1", ["u-s-citizenship-and-immigration-services", "state-department"], 730
PDFS = "https://www.irs.gov/pub/irs-pdf"
PAUSE = {"fam": 1.5, "uscis_pm": 10.0}


def as_documents(rows: DataFrame, day: str) -> DataFrame:
    """The columns of a document in their order; what a source doesn't give is null."""
    kinds = [c.strip().split(" ", 1) for c in parsers.DOCUMENT.replace("map<string,string>", "map<string;string>").split(",")]
    given = rows.withColumn("as_of", F.lit(day))
    return given.select(*((F.col(n) if n in given.columns else F.lit(None)).cast(k.replace(";", ",")).alias(n) for n, k in kinds))


def collect(spark: SparkSession, source: str, cache: str, get: Get, day: datetime.date, full: bool = False, extract: Callable[[bytes], str] | None = None, pause: float | None = None) -> DataFrame:
    """The documents of one of ``SOURCES`` as of ``day``. ``full`` takes all volumes of the policy manual; ``extract`` gives a PDF file's text."""
    delay = PAUSE.get(source, 1.0) if pause is None else pause

    def got(urls: list[str] | DataFrame) -> DataFrame:
        asked = spark.createDataFrame([(u,) for u in urls], "url string") if isinstance(urls, list) else urls
        return fetch.fetch(asked, cache, get, delay=delay)

    def page(url: str) -> str:
        found = got([url]).collect()  # one page that lists others
        if not found:
            raise LookupError(f"nothing at {url}")
        return bytes(found[0].body).decode("utf-8", "replace")

    text = F.make_valid_utf8(F.col("body").cast("string"))
    if source == "ecfr":
        url = fetch.regulations_url(CODE, 8, (day - datetime.timedelta(days=2)).isoformat())  # the latest days may not be there yet
        rows = parsers.regulations(got([url]).select(text.alias("value")), 8)
        rows = rows.withColumns({"source": F.lit("cfr"), "url": F.concat(F.lit("https://www.ecfr.gov/current/title-8/section-"), F.substring_index("citation", "§ ", -1))})
    elif source == "usc":
        archive = got([fetch.release_point(page(STATUTES + "download.shtml"), STATUTES)])

        @F.pandas_udf("string")
        def xml_of(bodies: pd.Series) -> pd.Series:
            return bodies.map(lambda b: fetch.first_xml(b).decode())

        rows = adapters.statutes(archive.select(xml_of("body").alias("value")))
    elif source == "fam":
        tree = spark.createDataFrame([(page(f"{MANUAL}/api/Tree/GetTreeByVolumeId?Id={VOLUME}"),)], "tree string")
        leaves = tree.select(F.posexplode(parsers.flatten_tree(F.col("tree"))).alias("pos", "leaf")).select("pos", "leaf.*")
        leaves = leaves.withColumn("k_", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter("k_ = 1").drop("k_", "pos")
        leaves = leaves.withColumn("breadcrumb", F.concat(F.array(F.lit(f"{VOLUME[:2]} FAM")), "breadcrumb")).withColumn("at", F.concat(F.lit(MANUAL), "url"))
        bodies = got(leaves.select(F.col("at").alias("url"))).select(F.col("url").alias("at"), text.alias("html"))
        rows = pages.manual_sections(leaves.join(bodies, "at"), VOLUME, MANUAL)
    elif source == "uscis_pm":
        listed = fetch.sitemap_locations(page(SITEMAP))
        for part in [u for u in listed if u.endswith(".xml")]:
            listed += fetch.sitemap_locations(page(part))
        urls = adapters.policy_pages(spark.createDataFrame([(u,) for u in listed], "url string"), volumes=None if full else VOLUMES)
        rows = pages.policy_documents(got(urls.select("url")).select("url", text.alias("html")))
    elif source == "fedreg":
        since = (day - datetime.timedelta(days=DAYS)).isoformat()
        found = fetch.notices_of(spark, JOURNAL, AGENCIES, since, adapters.NOTICE_FIELDS, get)
        found = found.select("agency", "place", F.from_json("row", adapters.NOTICE).alias("n")).select("agency", "place", "n.*")
        rows = adapters.notices(found, ["agency", "place"])
    elif source == "irs":
        if extract is None:
            raise ValueError("the text of PDF files needs an extractor")
        names = spark.createDataFrame([(f"{PDFS}/{p[4]}.pdf", p[0]) for p in pages.PUBLICATIONS], "url string, stem string")
        files = got(names.select("url")).join(F.broadcast(names), "url").select("stem", F.col("body").alias("content"))  # five fixed rows
        rows = pages.publication_documents(files, extract)
    else:
        raise ValueError(f"no source {source}")
    return as_documents(rows, day.isoformat())
