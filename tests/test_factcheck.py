"""The index, the fact-check, the research loop, pages, fetching, sinks and the command line, on small sources written by hand."""

import io
import json
import sys
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidentia import __main__ as cli
from evidentia.operators import chunking, factcheck, research
from evidentia.operators.index import build_index, load_index, lookup_citations, resolve_gold
from evidentia.operators.retrieval import Params
from evidentia.sources import fetch, pages, parsers, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
STUDENT = "(f) Students in colleges—(1) Admission of student. An alien student must present a form to the officer at the port of entry before admission is granted to the student.\n(2) Duration of status. A student may stay for the length of the course of study and sixty days to prepare for departure.\n(h) Temporary employees—(1) Admission of worker. A worker in a specialty occupation may be admitted for up to three years, and the employer must file a petition."
DOCS = [
    ("cfr", "cfr:8-214.2", "8 CFR § 214.2", "Special requirements", STUDENT, "https://x/section-214.2", ["Title 8", "Part 214"]),
    ("fam", "fam:1", "9 FAM 402.1", "Overview", "A. Visa Classes\n" + "Officers must read the whole application of a student with care. " * 6, "https://x/1", []),
    ("fedreg", "fedreg:1", "89 FR 1", "Rule", "A rule on the employment of students in the summer. " * 5, "https://x/2", ["Federal Register"]),
    ("fedreg", "fedreg:2", "89 FR 2", "Short", "Too short.", "https://x/3", None),
]


def hashed(texts):
    out = np.zeros((len(texts), 16))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, sum(map(ord, w)) % 16] += 1
    return out


def overlap(q, t):
    return pd.Series([float(len(set(a.lower().split()) & set(b.lower().split()))) for a, b in zip(q, t, strict=True)])


def model(prompts):
    """Quotes a line that is there if the claim is on students, else one that isn't."""

    def one(p):
        if "CLAIM: A student" in p:
            return '```json\n{"verdict": "SUPPORTED", "confidence": "high", "explanation": "The student may stay for the course of study [S1].", "evidence": [{"tag": "S1", "quote": "A student may stay for the length of the course"}], "caveats": "none"}\n```'
        return '{"verdict": "CONTRADICTED", "confidence": "high", "explanation": "The rule says otherwise in S77.", "evidence": [{"tag": "S77", "quote": "words that nobody wrote"}]}'

    return prompts.map(one)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "source string, doc_id string, citation string, title string, text string, url string, breadcrumb array<string>").withColumns({"as_of": F.lit(None).cast("string"), "effective_date": F.when(F.col("source") == "fedreg", "2024-05-01")})
    path = str(tmp_path_factory.mktemp("ix") / "i")
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))
    return build_index(chunking.chunk_corpus(docs, least=100), path, hashed)


def test_chunks(index):
    rows = {r.chunk_id.split(":")[0] + r.citation: r for r in index.chunks.collect()}
    got = sorted((r.citation, r.authority_rank) for r in rows.values())
    assert got == [("8 CFR § 214.2(f)", 2), ("8 CFR § 214.2(h)", 2), ("89 FR 1", 4), ("9 FAM 402.1", 3)]
    f = next(r for r in rows.values() if r.citation.endswith("(f)"))
    assert f.url == "https://x/section-214.2#p-214.2(f)" and f.breadcrumb == ["Title 8", "Part 214", "(f)"]
    assert f.text.startswith("8 CFR § 214.2(f) — Special requirements [Title 8 > Part 214]\n\n(f) Students") and "\n\n(2) Duration" in f.text and "specialty" not in f.text
    assert next(r for r in rows.values() if r.source == "fedreg").text.startswith("A rule on")


def test_headed_blocks_are_those_of_the_native_form(spark):
    text = "before\n\nA. First Part\nbody one\nSECOND PART HERE\nbody two\n\n"
    want = [(r.body, r.heading) for r in chunking.heading_blocks(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("block").collect()]
    assert [(b, p[0][1] if p else "") for b, p in chunking.headed_blocks(text)] == want
    assert chunking.headed_blocks("") == [("", ())]


def test_search_modes(spark, index):
    asked = spark.createDataFrame([(1, "how long may a student stay"), (2, "specialty occupation worker petition")], "qid long, q string")
    for mode in ("hybrid", "dense", "sparse"):
        best = {r.qid: r for r in index.search(asked, "qid", "q", Params(authority=0.0), mode, embed=hashed, score=overlap).filter("final_rank = 0").collect()}
        assert best[2].citation == "8 CFR § 214.2(h)" and best[2].tag == "S1", mode
    assert {r.source for r in index.search(asked, "qid", "q", keep=["fedreg"]).collect()} <= {"fedreg"}
    with pytest.raises(ValueError, match="embedder"):
        index.search(asked, "qid", "q", mode="dense")
    assert len(index) == 4 and index.get([]).count() == 0


def test_load_needs_all_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="chunks"):
        load_index(spark, str(tmp_path))


def test_lookup_and_gold(spark, index):
    asked = spark.createDataFrame([("a", "8 cfr 214.2"), ("b", "none such")], "qid string, c string")
    assert [r.citation for r in lookup_citations(asked, "qid", "c", index.chunks).orderBy("rank").collect()] == ["8 CFR § 214.2(f)", "8 CFR § 214.2(h)"]
    gold = spark.createDataFrame([("a", "8 CFR 214.2(f)"), ("b", ""), ("c", "26 USC 1"), ("d", None)], "id string, g string")
    assert {r.id: r.status for r in resolve_gold(gold, "id", "g", index.chunks).collect()} == {"a": "ok", "b": "abstention", "c": "missing", "d": "abstention"}


def test_check(spark, index):
    claims = spark.createDataFrame([("c1", "A student may stay for the whole course of study. A worker must leave the country after just one week."), ("c2", "zzz qqq xxx"), ("c3", "A student may stay")], "claim_id string, claim string")
    parts, overall = factcheck.check(claims, lambda q: index.search(q, "qid", "claim", Params(authority=0.0)), model, factcheck.T.split_sentences(F.col("claim")))
    got = {(r.claim_id, r.part): r for r in parts.collect()}
    good, bad, none = got["c1", 1], got["c1", 2], got["c2", 1]
    assert good.verdict == "SUPPORTED" and good.quotes == 1 and good.valid_tags == ["S1"]
    assert (bad.grade, bad.confidence, bad.invalid_tags) == ("UNGROUNDED", "low", ["S77"]) and "S77" in bad.caveats[0] and "1 of 1 quotes" in bad.caveats[0]
    assert none.verdict == "NOT_ADDRESSED" and none.caveats == ["Nothing was retrieved that bears on this part."]
    whole = {r.claim_id: r for r in overall.collect()}
    assert whole["c1"].verdict == "PARTIALLY_SUPPORTED" and whole["c1"].n_parts == 2 and whole["c1"].confidence == "low"
    assert whole["c3"].summary == "The student may stay for the course of study [S1]."
    text = {r.claim_id: r.report for r in factcheck.markdown(overall, parts).collect()}["c1"]
    assert text.startswith("# [PARTIALLY SUPPORTED]") and "### 2. A worker" in text


def test_control_without_retrieval(spark):
    rows = factcheck.read_answers(spark.createDataFrame([('{"verdict": "SUPPORTED"}',), ('{"verdict": "NOT_ADDRESSED"}',)], "output string"))
    got = {r.verdict: r for r in factcheck.without_retrieval(rows).collect()}
    assert got["SUPPORTED"].grade == "UNGROUNDED" and got["SUPPORTED"].quote_fidelity == 0 and got["NOT_ADDRESSED"].quote_fidelity is None


def test_recent(spark):
    rows = spark.createDataFrame([("c", i, day, "t", "x", "u") for i, day in enumerate(["2020-01-01", "2024-01-01", None, "2024-02-01", "2024-03-01"])], "claim_id string, final_rank int, effective_date string, title string, citation string, url string")
    assert [r.date for r in factcheck.recent_changes(rows, ["claim_id"], "2024-06-01").orderBy("shown").collect()] == ["2024-01-01", "2024-02-01"]


def test_research(index):
    said = iter([
        {"content": "from memory"}, {"tool_calls": [{"id": "1", "function": {"name": "lookup_citation", "arguments": '{"citation": "8 CFR 214.2(f)"}'}}, {"id": "2", "function": {"name": "nothing", "arguments": "{}"}}]},
        {"tool_calls": [{"id": "3", "function": {"name": "compare_authorities", "arguments": '{"topic": "student employment"}'}}]}, {"content": "See 8 CFR § 214.2(f)."},
    ])
    heard = []
    done = research.Assistant(index).run("how long?", lambda talk: heard.append(len(talk)) or next(said))
    assert [t["tool"] for t in done["trace"]] == ["lookup_citation", "nothing", "compare_authorities"] and done["trace"][0]["n_results"] == 1
    assert any(c["citation"] == "8 CFR § 214.2(f)" for c in done["citations"]) and heard[:2] == [1, 3]
    assert research.Assistant(index).check_recent_changes("summer employment of students")["documents"][0]["effective_date"] == "2024-05-01"
    assert research.Assistant(index).run("q", lambda talk: {"content": "x"}, steps=2)["answer"] == "x"


@pytest.mark.parametrize("n", [1, 5, 40, 400])
def test_fit(n):
    rows = {"n_results": n, "passages": [{"citation": str(i), "text": "x" * 3000} for i in range(n)]}
    out = research.fit(rows)
    got = json.loads(out)
    assert len(out) <= 12_000 and (n > 40 or len(got["passages"]) == min(n, len(got["passages"])))
    assert json.loads(research.fit({"note": "y" * 20_000}))["note"].startswith("result too large")


def test_manual_and_policy_pages(spark):
    html = "<html><body><p>outside</p><div class='WordSection1 x'><p class='MsoHeader'>UNCLASSIFIED (U)</p><p>UNCLASSIFIED (U)</p><p>(CT:VISA-12; 03-04-2023)</p>" + "<p>Officers read the form.</p>" * 12 + "</div></body></html>"
    rows = spark.createDataFrame([("0402.1", "9 FAM\n402.1 OVERVIEW OF NIV'S CLASSES", "/a.html", ["Top"], html), ("0402.2", "402.2 Scope", "/b.html", None, html), ("x", "y", "/c.html", None, "<p>short</p>"), ("n", "n", "/n", None, None)], "id string, text string, url string, breadcrumb array<string>, html string")
    a, b = pages.manual_sections(rows, base="https://fam").orderBy("doc_id").collect()
    assert (b.citation, b.title, b.effective_date, b.url) == ("9 FAM 402.2", "Scope", "2023-03-04", "https://fam/b.html") and "outside" not in b.text and "UNCLASSIFIED" not in b.text
    assert a.breadcrumb == ["Top"]
    page = "<html><nav>menu</nav><article><nav>x</nav><h1>Chapter 2 - Eligibility | USCIS</h1><div class='toc'>toc</div>" + "<p>The officer decides.</p>" * 30 + "<footer>Last Reviewed/Updated: 05/06/2024</footer></article></html>"
    at = "https://www.uscis.gov/policy-manual/volume-7-part-a-chapter-2"
    (p,) = pages.policy_documents(spark.createDataFrame([(at, page), ("https://other", page), (at, "<p>x</p>")], "url string, html string")).collect()
    assert (p.citation, p.title, p.effective_date, p.breadcrumb) == ("USCIS Policy Manual Vol. 7, Part A, Ch. 2", "Eligibility", "2024-05-06", ["USCIS Policy Manual", "Volume 7", "Part A"])
    assert "toc" not in p.text and "menu" not in p.text and p.text.startswith("Chapter 2")


def test_publications(spark, tmp_path):
    (tmp_path / "irs_pub501.pdf").write_bytes(b"Page 1 of 9\nDepen-\ndents are\npersons.")
    (tmp_path / "irs_pub17.pdf").write_bytes(b" ")
    (tmp_path / "other.pdf").write_bytes(b"text")
    (one,) = pages.publications(spark, str(tmp_path), lambda b: bytes(b).decode()).collect()
    assert (one.doc_id, one.text, one.extra["pdf"]) == ("irs_pub:irs_pub501", "Dependents are persons.", "https://www.irs.gov/pub/irs-pdf/p501.pdf")


def test_fetch_once(spark, tmp_path):
    log = tmp_path / "log"

    def get(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return None if "missing" in url else url.encode()

    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://a/missing",), (None,)], "url string")
    for _ in range(2):
        assert [bytes(r.body) for r in fetch.fetch(urls, str(tmp_path / "cache"), get, delay=0).collect()] == [b"http://a/1"]
    assert log.read_text().split().count("http://a/1") == 1
    fails = iter([ValueError(), ValueError(), b"x"])

    def flaky(url):
        got = next(fails)
        if isinstance(got, Exception):
            raise got
        return got

    assert fetch.insist(flaky, "u", pause=0) == b"x"
    sizes = iter([200, 200, 3])
    body = lambda url: json.dumps({"results": [{"u": url}] * next(sizes)}).encode()
    assert len(list(fetch.notice_pages("http://api", "a", "2024-01-01", ["title"], body))) == 403
    assert fetch.release_point('<a href="releasepoints/us/pl/1/xml_usc08@1-2.zip">', "https://h/download/") == "https://h/download/releasepoints/us/pl/1/xml_usc08@1-2.zip"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "n")
        f.writestr("b.XML", "<x/>")
    assert fetch.first_xml(z.getvalue()) == b"<x/>"
    assert fetch.sitemap_locations(b"<loc> http://a </loc><loc>b</loc>") == ["http://a", "b"]


def test_sinks(spark, tmp_path):
    assert sinks.write_jsonl(spark.range(5), str(tmp_path / "r")) == 5
    for name, config in (("b", "full"), ("a", "no_retrieval")):
        sinks.write_report(spark, str(tmp_path / "rep" / name), {"generation_configs": {"table": [{"config": config, "acc": 0.5}]}})
    got = sinks.report_rows(sinks.read_reports(spark, str(tmp_path / "rep" / "*")))
    assert [r["row"]["config"] for r in got] == ["no_retrieval", "full"]
    assert sinks.markdown_table([{"a": 1, "b": None}]) == "| a | b |\n|---|---|\n| 1 | None |" and sinks.markdown_table([]) == "_(none)_"
    assert sinks.fixed_table([{"a": 1}, {"a": 22}]) == " a\n--\n 1\n22"
    with pytest.raises(ValueError, match="at most"):
        sinks.report_rows(spark.range(3), 2)


def test_command_line(spark, tmp_path, capsys):
    docs = [dict(zip(("source", "doc_id", "citation", "title", "text", "url", "breadcrumb"), d, strict=True)) for d in DOCS[:3]]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
    (tmp_path / "g.jsonl").write_text(json.dumps({"id": "1", "claim": "a student may stay", "gold_citation": "8 CFR 214.2(f)", "citation_granularity": "provision"}))
    at, gold = ["--index", str(tmp_path / "i")], ["--gold", str(tmp_path / "g.jsonl")]
    assert parsers.read_documents(spark, str(tmp_path / "d.jsonl")).count() == 3
    assert cli.main(["build-index", "--documents", str(tmp_path / "d.jsonl"), *at], spark) == 0
    assert cli.main(["ask", "a student may stay", "--retrieval-only", *at], spark) == 0
    assert cli.main(["verify-goldset", *gold, *at], spark) == 0
    assert cli.main(["evaluate", "--reports", str(tmp_path / "rep"), *gold, *at], spark) == 0
    out = capsys.readouterr().out
    assert '"tag":"S1"' in out and '{"ok": 1}' in out and "| BM25 only | 1 | 1.0" in out and "dense only" not in out


def splitter(prompts):
    return prompts.map(lambda p: '<think>two parts</think>{"subclaims": [{"text": "A student may stay for the course of study"}, {"text": "A worker must leave after one week only"}]}' if "and a worker" in p else "no idea")


def synthesizer(prompts):
    return prompts.map(lambda p: '{"verdict": "PARTIALLY_SUPPORTED", "confidence": "medium", "summary": "Half of it.", "explanation": "One part holds.", "caveats": ["ask"]}' if "course of study" in p else "?")


def test_splitter_and_synthesizer(spark, index):
    claims = spark.createDataFrame([("c1", "A student may stay for the course of study and a worker must leave after one week only"), ("c2", "A student may stay")], "claim_id string, claim string")
    parts, overall = factcheck.check(claims, lambda q: index.search(q, "qid", "claim", Params(authority=0.0), rerank=True), model, splitter=splitter, synthesizer=synthesizer)
    assert sorted((r.claim_id, r.part) for r in parts.collect()) == [("c1", 1), ("c1", 2), ("c2", 1)]
    got = {r.claim_id: r for r in overall.collect()}
    assert (got["c1"].verdict, got["c1"].confidence, got["c1"].summary, got["c1"].caveats) == ("PARTIALLY_SUPPORTED", "medium", "Half of it.", ["ask"])
    assert got["c2"].verdict == "SUPPORTED" and got["c2"].n_parts == 1
    (first, *_) = sorted(parts.collect(), key=lambda r: (r.claim_id, r.part))
    assert [s.tag for s in first.sources][:1] == ["S1"]


def test_lexical_rerank(spark, index):
    asked = spark.createDataFrame([(1, "specialty occupation worker petition")], "qid long, q string")
    rows = {r.citation: r.rerank for r in index.search(asked, "qid", "q", Params(authority=0.0), "sparse", rerank=True).collect()}
    assert rows["8 CFR § 214.2(h)"] == 1.0 and max(rows.values()) == 1.0


def test_generation_evaluation(spark, index, tmp_path, capsys):
    docs = [dict(zip(("source", "doc_id", "citation", "title", "text", "url", "breadcrumb"), d, strict=True)) for d in DOCS[:3]]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, docs)))
    gold = [
        {"id": "1", "claim": "A student may stay for the course of study", "gold_verdict": "SUPPORTED", "gold_citation": "8 CFR 214.2(f)"},
        {"id": "2", "claim": "An officer must read nothing", "gold_verdict": "NOT_ADDRESSED", "gold_citation": ""},
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, gold)))
    at = ["--index", str(tmp_path / "i")]
    assert cli.main(["build-index", "--documents", str(tmp_path / "d.jsonl"), "--embed", f"{__name__}:hashed", *at], spark) == 0
    run = ["evaluate", "--gold", str(tmp_path / "g.jsonl"), "--model", f"{__name__}:model", "--embed", f"{__name__}:hashed", "--reports", str(tmp_path / "rep"), *at]
    assert cli.main([*run, "--configs", "no_retrieval", "simple_retrieval", "full_no_decompose", "full"], spark) == 0
    rows = {r["row"]["config"]: r["row"] for r in sinks.report_rows(sinks.read_reports(spark, str(tmp_path / "rep" / "*")))}
    assert list(rows) == sinks.CONFIGS and all(float(r["accuracy"]) == 0.5 and r["n"] == "2" for r in rows.values())
    control, full = rows["no_retrieval"], rows["full_no_decompose"]
    assert float(control["residual_hallucination"]) == 1 and float(control["citation_precision"]) == 0
    assert float(full["citation_precision"]) == 1 and float(full["residual_hallucination"]) == 0.5 and float(full["quote_fidelity"]) == 0.5
    assert cli.main([*run, "--all"], spark) == 0
    out = capsys.readouterr().out
    assert "## retrieval" in out and "dense only" in out and "hybrid + rerank + auth" in out
    with pytest.raises(SystemExit, match="--model"):
        cli.main(["evaluate", "--generation", "--gold", str(tmp_path / "g.jsonl"), *at], spark)


LONG_PAGE = "<p>The officer reads the whole form with care.</p>" * 20


def stub(url):
    """The sources as a few pages."""
    text = "Long text of the section. " * 5
    pages_ = {
        "/full/": f"<D><DIV1 N='8'><HEAD>Title 8.</HEAD><DIV8 N='214.2'><HEAD>§ 214.2 Special requirements.</HEAD><P>{text}</P></DIV8></DIV1></D>",
        "download.shtml": '<a href="releasepoints/us/pl/1/xml_usc08@1-2.zip">',
        "GetTree": '[{"id": "1", "text": "9 FAM 400", "items": [{"id": "0402.1", "text": "402.1 OVERVIEW", "url": "/a.HTML"}, {"id": "2", "text": "again", "url": "/a.HTML"}]}]',
        "/a.HTML": f"<div class='WordSection1'>(CT:VISA-1; 13-45-2020){LONG_PAGE}</div>",
        "sitemap.xml": "<loc>https://www.uscis.gov/sitemap-1.xml</loc>",
        "sitemap-1.xml": "<loc>https://www.uscis.gov/policy-manual/volume-7-part-a-chapter-2</loc><loc>https://www.uscis.gov/policy-manual/volume-9-part-a</loc>",
        "/policy-manual/": f"<article><h1>Chapter 2 - Eligibility</h1>{LONG_PAGE}</article>",
        "documents.json": json.dumps({"results": [{"document_number": "n1", "title": "Rule", "abstract": "A rule that is long enough to be evidence of something, as it must have eighty letters.", "publication_date": "2024-01-02"}] if "state-dep" in url else []}),
    }
    if url.endswith(".zip"):
        z = io.BytesIO()
        with zipfile.ZipFile(z, "w") as f:
            f.writestr("usc08.xml", f'<u:doc xmlns:u="http://xml.house.gov/schemas/uslm/1.0"><u:section identifier="/us/usc/t8/s1184"><u:heading>Admission</u:heading><u:content>{text}</u:content></u:section></u:doc>')
        return z.getvalue()
    if url.endswith(".pdf"):
        return b"Dependents are persons." if "p501" in url else None
    return next(v for k, v in pages_.items() if k in url).encode()


def pdf_text(content):
    return bytes(content).decode()


def test_download_to_index(spark, tmp_path, capsys):
    out = str(tmp_path / "data")
    assert cli.main(["download", "--out", out, "--client", f"{__name__}:stub", "--pdf-text", f"{__name__}:pdf_text", "--pause", "0"], spark) == 0
    docs = {r.doc_id: r for r in parsers.read_documents(spark, f"{out}/documents").collect()}
    assert set(docs) == {"cfr:8-214.2", "ina:8usc-1184", "fam:09FAM-0402.1", "uscis_pm:volume-7-part-a-chapter-2", "fedreg:n1", "irs_pub:irs_pub501"}
    assert docs["cfr:8-214.2"].url == "https://www.ecfr.gov/current/title-8/section-214.2" and docs["ina:8usc-1184"].citation == "INA § 214 (8 U.S.C. § 1184)"
    assert docs["fam:09FAM-0402.1"].breadcrumb == ["09 FAM", "9 FAM 400"] and docs["fam:09FAM-0402.1"].effective_date is None
    assert all(d.as_of for d in docs.values())
    assert "TOTAL          6" in capsys.readouterr().out
    assert cli.main(["download", "--out", out, "--only", "irs"], spark) == 0  # without an extractor it is left out, and what is there stays
    assert cli.main(["build-index", "--documents", f"{out}/documents", "--index", str(tmp_path / "i")], spark) == 0
    assert cli.main(["ask", "dependents", "--retrieval-only", "--index", str(tmp_path / "i")], spark) == 0
