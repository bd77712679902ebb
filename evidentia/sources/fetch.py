"""Fetching with a cache table. Each address is fetched once; one task at a time touches a host, at the pace the host asks for."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.sinks import exists

#: What a client returns: the body, or None where nothing is there.
Get = Callable[[str], bytes | None]
CACHED = "url_hash string, url string, body binary"


def over_http(agent: str) -> Get:
    """A client of the standard library that names itself; a missing page is None, another failure raises."""

    def get(url: str) -> bytes | None:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": agent}), timeout=60) as answer:
                return answer.read()
        except HTTPError as e:
            if e.code == 404:
                return None
            raise

    return get


def insist(get: Get, url: str, tries: int = 3, pause: float = 5.0) -> bytes | None:
    """The body after up to ``tries`` attempts, with a longer pause after each failure; None where nothing is there or all failed."""
    for k in range(1, tries + 1):
        try:
            return get(url)
        except Exception:  # noqa: BLE001  a client may raise anything
            if k < tries:
                time.sleep(pause * k)
    return None


def _cached(spark: SparkSession, cache: str) -> DataFrame:
    return spark.read.schema(CACHED).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], CACHED)


def fetch(urls: DataFrame, cache: str, get: Get, url: str = "url", tries: int = 3, pause: float = 5.0, delay: float = 10.0) -> DataFrame:
    """(url, body) of the addresses that have one. What isn't in the cache table yet is fetched and appended to it."""
    spark = urls.sparkSession
    asked = urls.select(F.col(url).alias("url")).filter("url is not null").distinct().withColumn("url_hash", F.substring(F.sha1(F.col("url").cast("binary")), 1, 20))
    missing = asked.join(_cached(spark, cache).select("url_hash"), "url_hash", "left_anti")

    def run(batches):
        first = True
        for b in batches:
            rows = []
            for h, u in zip(b["url_hash"], b["url"], strict=True):
                if not first and delay:
                    time.sleep(delay)
                first = False
                body = insist(get, u, tries, pause)
                if body is not None:
                    rows.append((h, u, body))
            yield pd.DataFrame(rows, columns=["url_hash", "url", "body"])

    host = F.parse_url("url", F.lit("HOST"))
    missing.repartition(host).mapInPandas(run, CACHED).write.mode("append").parquet(cache)
    return asked.select("url_hash").join(_cached(spark, cache).dropDuplicates(["url_hash"]), "url_hash").select("url", "body")


def sitemap_locations(body: bytes | str) -> list[str]:
    """The addresses in a site map or an index of site maps, in order."""
    text = body.decode("utf-8", "replace") if isinstance(body, bytes) else body
    return [u.strip() for u in re.findall(r"<loc>([^<]+)</loc>", text)]


def notice_pages(api: str, agency: str, since: str, fields: list[str], get: Get, size: int = 200, most: int = 10) -> Iterator[dict]:
    """The journal's rows of an agency, newest first: up to ``most`` pages, and none after a page that isn't full."""
    for page in range(1, most + 1):
        query = [("per_page", size), ("page", page), ("order", "newest"), ("conditions[publication_date][gte]", since), ("conditions[agencies][]", agency)]
        body = insist(get, f"{api}/documents.json?{urlencode(query + [('fields[]', f) for f in fields])}")
        found = json.loads(body).get("results") or [] if body else []
        yield from found
        if len(found) < size:
            return


def notices_of(spark: SparkSession, api: str, agencies: list[str], since: str, fields: list[str], get: Get) -> DataFrame:
    """(agency, place, row): the journal's rows as JSON, one task an agency."""
    asked = spark.createDataFrame([(a,) for a in agencies], "agency string").repartition(max(1, len(agencies)), "agency")

    def run(batches):
        for b in batches:
            for a in b["agency"]:
                rows = [(a, i, json.dumps(r)) for i, r in enumerate(notice_pages(api, a, since, fields, get))]
                yield pd.DataFrame(rows, columns=["agency", "place", "row"])

    return asked.mapInPandas(run, "agency string, place long, row string")


def regulations_url(api: str, title: int, day: str) -> str:
    return f"{api}/full/{day}/title-{title}.xml"


def release_point(page: str, root: str, title: str = "08") -> str:
    """The address of a statute title's current archive on the download page."""
    found = re.search(rf'href="(releasepoints/[^"]*xml_usc{re.escape(title)}@[^"]+\.zip)"', page)
    if not found:
        raise ValueError(f"no release point of title {title} on the page")
    return urljoin(root, found[1])


def first_xml(archive: bytes) -> bytes:
    """The first XML file of a ZIP archive."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
        if name is None:
            raise ValueError("the archive holds no XML file")
        return z.read(name)
