import glob
import os

import pytest
from pyspark.sql import functions as F

from evidentia import queries
from evidentia.functions import text as T
from evidentia.operators import chunking, metrics, retrieval, verification
from evidentia.sources import parsers
from evidentia.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("labels", "path"),
    [
        ("a", "(a)"), ("a 1", "(a)(1)"), ("a 1 2", "(a)(2)"), ("a 1 i ii", "(a)(1)(ii)"), ("a 1 i 2", "(a)(2)"), ("a 1 i b", "(b)"), ("h 4 i", "(h)(4)(i)"),
        ("h 4 i ii B", "(h)(4)(ii)(B)"), ("g h i j", "(j)"), ("a 1 i A 1 i", "(a)(1)(i)(A)(1)(i)"), ("w a", "(a)"), ("w a b", "(b)"), ("a c", "(c)"), ("a 1 5", "(a)(5)"),
    ],
)
def test_numbering(labels, path):
    at = ()
    for label in labels.split():
        at = chunking.advance(at, label)
    assert chunking.render(at) == path


def test_segments():
    assert [m for m, _ in chunking.segments("(a) Foreign government officials—(1) General. The determination")] == ["a", "1"]
    assert [m for m, _ in chunking.segments("The alien must qualify under section 101(a)(15)(F) of the Act (see paragraph (b)(2)).")] == [None]
    text = "(f) Students in colleges—(1) Admission of student.\nThe student must present a form.\n(9) Off-campus employment.\n(i) On-campus employment. It must be on premises.\n"
    paths = [chunking.render(p) for _, p in chunking.statutory_blocks(text)]
    assert paths == ["(f)", "(f)(1)", "(f)(9)", "(f)(9)(i)"]


def test_packing_keeps_lines_and_splits_large_groups():
    text = "\n".join(f"(a) Sentence number {i} of a long paragraph that says a thing. Another one follows; And more." for i in range(80))
    chunks = chunking.pack_blocks(chunking.statutory_blocks(text), True)
    assert all(f"number {i} " in " ".join(c for c, _ in chunks) for i in range(80)) and max(len(c) for c, _ in chunks) < 3000


def test_citations(spark):
    row = spark.range(1).select(
        chunking.cite(F.lit("ina"), F.lit("INA § 214 (8 U.S.C. § 1184)"), F.lit("(g)")).alias("dual"),
        T.citation_match(F.lit("8 CFR § 214.2(h)"), F.lit("8 CFR 214.2(f)")).alias("other"),
        T.citation_match(F.lit("INA § 214(g) (8 U.S.C. § 1184(g))"), F.lit("INA 214(g)(1)(A)")).alias("deeper"),
        T.citation_match(F.lit("INA § 101"), F.lit("")).alias("none"),
    ).first()
    assert row.dual == "INA § 214(g) (8 U.S.C. § 1184(g))" and not row.other and row.deeper and not row.none


def test_tokenize(spark):
    got = spark.range(1).select(T.tokenize(F.lit("8 CFR § 214.2(f)(9) and I-765, 8 U.S.C. 1101")).alias("t")).first().t
    assert got == ["8", "cfr", "section", "214.2(f)(9)", "214.2", "f", "9", "and", "i-765", "i765", "8", "usc", "1101"]


def test_quotes(spark):
    rows = spark.createDataFrame([("The  “quick” brown fox jumps over it", "the quick brown fox jumps over it all"), ("a made up quotation that is not there at all", "zz yy xx"), ("students must maintein full course of study", "that students must maintain full course of study here")], "q string, b string")
    got = [(r.similarity, r.found) for r in verification.verify_quotes(rows, "q", "b").orderBy("q").collect()]
    assert got[0] == (1.0, True) and got[1][1] is False and got[2][1] is True and got[2][0] < 1


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, "CONTRADICTED"), (1, "NOT_ADDRESSED"), (2, "CONTRADICTED"), (2, "SUPPORTED"), (3, "SUPPORTED"), (4, "NOT_ADDRESSED"), (5, "SUPPORTED"), (5, "NOT_ADDRESSED")], "c int, v string")
    got = {r.c: r.v for r in rows.groupBy("c").agg(metrics.overall_verdict(F.col("v")).alias("v")).collect()}
    assert got == {1: "CONTRADICTED", 2: "PARTIALLY_SUPPORTED", 3: "SUPPORTED", 4: "NOT_ADDRESSED", 5: "PARTIALLY_SUPPORTED"}


def test_loose_json(spark):
    texts = ['{"a": 1}', 'Here: ```json\n{"a": 2}\n``` done', 'so {"a": 3} it is', "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_json(T.parse_json_loose(F.col("t"))).alias("j"))
    assert [r.j for r in rows.collect()] == ['{"a":1}', '{"a":2}', '{"a":3}', None]


def test_regulations_and_tree(spark):
    xml = "<D><DIV1 N='8'><HEAD>Title 8.</HEAD><DIV5 N='214'><HEAD>Part 214</HEAD><DIV8 N='214.2'><HEAD>§ 214.2 Special requirements.</HEAD><P>" + "Long text of the section. " * 5 + "</P><CITA>[62 FR]</CITA></DIV8></DIV5></DIV1></D>"
    (s,) = parsers.sections_of_regulations(xml)
    assert s["citation"] == "8 CFR § 214.2" and s["title"] == "Special requirements" and s["breadcrumb"] == ["Title 8", "Part 214"] and "[Cita]" in s["text"]
    tree = '[{"id":"1","text":"Top","url":"","items":[{"id":"2","text":"Leaf","url":"x.html"}]}]'
    (leaf,) = spark.createDataFrame([(tree,)], "t string").select(parsers.flatten_tree(F.col("t")).alias("x")).first().x
    assert leaf.url == "x.html" and leaf.breadcrumb == ["Top"]


def test_crosswalk_is_one_to_one(spark):
    rows = parsers.crosswalk(spark).collect()
    assert len({r.act_section for r in rows}) == len({r.code_section for r in rows}) == len(rows)
    assert dict((r.act_section, r.code_section) for r in rows)["320"] == "1431"


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    windows = ingest.currency_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = windows.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_bm25_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "q long, t string")
    assert retrieval.bm25(docs, "doc_id", "text", asked, "q", "t", 3).count() == 0


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    text = lambda v: "null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == cols, name
        rows = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in want.fetchall())
        assert sorted(tuple(text(r[c]) for c in cols) for r in got.collect()) == rows, name


def test_queries_without_sql(spark):
    for name in sorted(queries.QUERIES.keys() - queries.SQL.keys()):
        assert queries.QUERIES[name](spark, SF).count() > 0, name


def test_found_before_rounding(spark):
    from evidentia.operators.verification import verify_quotes

    body = ("abcdefghijklmnopqrstuvw" * 3)[:48]
    rows = spark.createDataFrame([(body + "z" * 17, body), (body, body)], "quote string, body string")  # 96 / 113 = 0.84956
    assert sorted((r.similarity, r.found) for r in verify_quotes(rows, "quote", "body").collect()) == [(0.85, False), (1.0, True)]


def test_reasoning_is_left_out(spark):
    cases = {"<think>a</think> b": "b", "x <THINK>a\nb</think>y <think>c</think> z": "x y  z", "<think>cut off": "cut off", "a <think>b</think> c <think>d": "d", "plain": "plain"}
    rows = spark.createDataFrame(list(cases), "string").select("value", T.strip_think(F.col("value")).alias("t")).collect()
    assert {r.value: r.t for r in rows} == cases


def test_short_and_long_quotes(spark):
    import random

    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    quotes = [(i, " ".join(docs[i][1].split()[a : a + n])[cut:]) for i, (a, n, cut) in enumerate((rng.randint(0, 50), rng.randint(1, 9), rng.randint(0, 2)) for _ in range(30))] + [(99, "none of it is there at all"), (98, "")]
    want = {(q, d) for q, t in quotes for d, b in docs if t and t in b}
    got = verification.quotes_in(spark.createDataFrame(quotes, "q long, t string"), "q", "t", spark.createDataFrame(docs, "d long, b string"), "d", "b")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    few = verification.quotes_in(spark.createDataFrame(quotes, "q long, t string"), "q", "t", spark.createDataFrame(docs, "d long, b string"), "d", "b", most=1)
    assert {tuple(r) for r in few.collect()} == want


def test_best_window_is_that_of_all_windows():
    import difflib
    import random

    rng = random.Random(3)
    for _ in range(60):
        body = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 150)))
        quote = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 60)))
        step = max(1, len(quote) // 4)
        windows = [body[i : i + len(quote) + step] for i in range(0, len(body) - len(quote) + 1, step)] or [body]
        want = 1.0 if quote in body else max(difflib.SequenceMatcher(None, quote, w).ratio() for w in windows)
        assert verification.similarity(quote, body) == want
    assert verification.similarity("", "a") == verification.similarity("a", "") == 0


def test_cuts_are_those_of_a_fold():
    import random
    import re

    def fold(text, target, overlap):
        done, held = [], ""
        for s in re.split(r"(?<=[.;:])\s+(?=[A-Z(])", text):
            if held and len(held) + len(s) > target:
                done, held = [*done, held.strip()], f"{held[-overlap:] if overlap else ''} {s}"
            else:
                held = f"{held} {s}".strip()
        return [*done, held.strip()]

    rng = random.Random(4)
    for _ in range(200):
        text = "  ".join(f"{rng.choice('ABC(')}{'x y ' * rng.randint(0, 12)}z{rng.choice('.;:')}" for _ in range(rng.randint(1, 30)))
        target, overlap = rng.randint(5, 120), rng.randint(0, 30)
        assert chunking.split_oversized(text, target, overlap) == fold(text, target, overlap)


def test_odd_trees_and_dates(spark):
    trees = [None, "", "{broken", "[]", "[1, null]", '{"text": " a  b ", "url": "/X.HTML"}']
    rows = spark.createDataFrame(list(enumerate(trees)), "i int, t string").select("i", parsers.flatten_tree(F.col("t")).alias("x")).orderBy("i").collect()
    assert [len(r.x) for r in rows] == [0, 0, 0, 0, 0, 1] and rows[-1].x[0].text == "a b"
    dates = spark.createDataFrame([("(CT:VISA-1; 13-45-2020)",), ("(CT:VISA-1; 02-03-2020)",), (None,), ("none",)], "t string").select(parsers.effective_date(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in dates.collect()] == [None, "2020-02-03", None, None]
