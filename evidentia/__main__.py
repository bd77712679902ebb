"""Command line: python -m evidentia {download,build-index,ask,research,evaluate,verify-goldset,show-results}. Models are named as module:function."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import chunking, factcheck, metrics, research
from evidentia.operators.index import build_index, chunk_report, load_index, resolve_gold
from evidentia.operators.retrieval import Params
from evidentia.partitions import workspace
from evidentia.sources import collect, fetch, parsers, sinks

GOLD = "id string, claim string, gold_verdict string, gold_citation string, category string, difficulty string, notes string, citation_granularity string, domain string"


def _named(name: str | None):
    """The object behind module:attribute; None for None."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def download(spark, a) -> int:
    """Sources to JSON lines of documents, one folder each, and all of them in ``documents``, which build-index reads."""
    if not a.stats:
        day, get = datetime.date.today(), _named(a.client) or fetch.over_http(a.agent)
        for source in a.only or collect.SOURCES:
            if source == "irs" and not a.pdf_text:
                print("irs: left out, as --pdf-text names no function for PDF files")
                continue
            docs = collect.collect(spark, source, f"{a.out}/cache", get, day, a.full, _named(a.pdf_text), a.pause)
            print(f"{source}: {sinks.write_jsonl(docs, f'{a.out}/docs_{source}')} documents")
        held = [f"{a.out}/docs_{s}" for s in collect.SOURCES if sinks.exists(spark, f"{a.out}/docs_{s}/_SUCCESS")]
        sinks.write_jsonl(parsers.merge_corpora([parsers.read_documents(spark, p) for p in held]), f"{a.out}/documents")
    docs = parsers.read_documents(spark, f"{a.out}/documents")
    rows = docs.rollup("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars")).orderBy(F.asc_nulls_last("source"))
    print(sinks.fixed_table(sinks.report_rows(rows.withColumn("source", F.coalesce("source", F.lit("TOTAL")))), "corpus"))
    return 0


def build(spark, a) -> int:
    chunks = chunking.chunk_corpus(parsers.read_documents(spark, a.documents))
    print(sinks.fixed_table(sinks.report_rows(chunk_report(chunks).orderBy("source")), "chunks"))
    if not a.dry_run:
        print(len(build_index(chunks, a.index, _named(a.embed))), "chunks indexed")
    return 0


def _search(a, index):
    p = Params(final_k=a.k, authority=0.0 if getattr(a, "no_authority", False) else Params.authority)
    return lambda rows: index.search(rows, "qid", "claim", p, keep=a.sources, embed=_named(a.embed), score=None if a.no_rerank else _named(a.score), rerank=not a.no_rerank)


def _splitting(a) -> dict:
    """How claims are split and summed up: by models if there are any, else by sentences, or not at all."""
    splitter = None if a.no_decompose else _named(a.splitter)
    pieces = None if a.no_decompose or splitter else T.split_sentences(F.col("claim"))
    return {"pieces": pieces, "splitter": splitter, "synthesizer": _named(a.synthesizer)}


def ask(spark, a) -> int:
    index = load_index(spark, a.index)
    if a.retrieval_only or not a.model:
        rows = _search(a, index)(spark.createDataFrame([("q", a.claim)], "qid string, claim string")).orderBy("final_rank")
        print("\n".join(rows.select("tag", "citation", "title", "url", "found_by", "adjusted").toJSON().collect()))  # k rows
        return 0
    asked = spark.createDataFrame([("q", a.claim)], "claim_id string, claim string")
    parts, overall = factcheck.check(asked, _search(a, index), _named(a.model), threshold=a.threshold, **_splitting(a))
    print(factcheck.markdown(overall, parts).first().report if a.markdown else overall.toJSON().first())
    return 2 if overall.first().verdict == "CONTRADICTED" else 0


def ask_around(spark, a) -> int:
    done = research.Assistant(load_index(spark, a.index), search_with={"embed": _named(a.embed)}).run(a.question, _named(a.chat), a.steps)
    print(json.dumps(done) if a.json else done["answer"] + "\n\n" + "\n".join(r["citation"] for r in done["citations"]))
    return 0


def _gold(spark, a):
    rows = spark.read.schema(GOLD).json(a.gold)
    return rows.orderBy("id").limit(a.limit) if getattr(a, "limit", None) else rows


#: The retrieval ablation: name, mode, second ranker, weight of authority.
RETRIEVAL = [
    ("dense only", "dense", False, 0.0), ("BM25 only", "sparse", False, 0.0), ("hybrid (RRF)", "hybrid", False, 0.0),
    ("hybrid + rerank", "hybrid", True, 0.0), ("hybrid + rerank + auth", "hybrid", True, Params.authority),
]
#: What the generation configurations set: mode (None answers from memory), second ranker, weight of authority, splitting, acting on the checks.
GENERATION = {
    "no_retrieval": (None, False, 0.0, False, False), "simple_retrieval": ("dense", False, 0.0, False, False),
    "full_no_decompose": ("hybrid", True, Params.authority, False, True), "full": ("hybrid", True, Params.authority, True, True),
}


def _retrieval_table(a, index, gold) -> list[dict]:
    """The retrieval ablation on provision-level gold claims: one row a configuration. What needs an embedder isn't shown without one."""
    gold = gold.filter((F.coalesce("citation_granularity", F.lit("provision")) == "provision") & (F.coalesce("gold_citation", F.lit("")) != "")).select(F.col("id").alias("qid"), "claim", "gold_citation")
    embed, score, table = _named(a.embed), _named(a.score), []
    for name, mode, second, weight in RETRIEVAL:
        if mode == "dense" and embed is None:
            continue
        found = index.search(gold.select("qid", "claim"), "qid", "claim", Params(authority=weight), mode, embed=embed, score=score if second else None, rerank=second)
        hits = metrics.first_hit(found, gold.select("qid", "gold_citation"), "qid", "final_rank", T.citation_match(F.col("citation"), F.col("gold_citation")))
        table.append({"config": name, **metrics.retrieval_metrics(hits).first().asDict()})
    return table


def _generation_table(spark, a, index, gold, names: list[str]) -> list[dict]:
    """Verdicts of whole claims in each configuration against the gold ones. Latency is the batch's time over its claims."""
    claims, table = gold.select(F.col("id").alias("claim_id"), "claim"), []
    want = gold.select(F.col("id").alias("claim_id"), "gold_verdict", "gold_citation")
    for name in names:
        mode, second, weight, split, act = GENERATION[name]
        if mode == "dense" and not a.embed:
            print(f"{name}: left out, as it needs an embedder")
            continue
        search = None
        if mode:
            search = lambda rows, m=mode, s=second, w=weight: index.search(rows, "qid", "claim", Params(authority=w), m, embed=_named(a.embed), score=_named(a.score) if s else None, rerank=s)
        began, n = time.monotonic(), claims.count()
        how = _splitting(a) if split else {}
        parts, overall = factcheck.check(claims, search, _named(a.model), threshold=a.threshold, act=act, **how)
        found = factcheck.cases(want, parts, overall)
        rows = found.collect()  # a row a gold claim
        took = (time.monotonic() - began) / max(1, n)
        cases = spark.createDataFrame(rows, found.schema).withColumns({"latency_s": F.lit(took), "cost_usd": F.lit(0.0)})
        table.append({"config": name, **metrics.generation_metrics(cases).first().asDict()})
    return table


def evaluate(spark, a) -> int:
    """Retrieval and verdicts against the gold set; a report and tables. Without a choice: retrieval and, if there is a model, generation."""
    index, gold, report = load_index(spark, a.index), _gold(spark, a), {}
    generate = bool(a.generation or a.configs or a.all or (a.model and not a.retrieval))
    if generate and not a.model:
        raise SystemExit("generation needs --model")
    if a.retrieval or a.all or not generate or not (a.generation or a.configs):
        report["retrieval"] = {"table": _retrieval_table(a, index, gold)}
    if generate:
        one = "full_no_decompose" if a.no_decompose else "full"
        report["generation_configs"] = {"table": _generation_table(spark, a, index, gold, a.configs or [one])}
    stamp = datetime.datetime.now().strftime("%Y%m%d-%H%M%S")
    sinks.write_report(spark, f"{a.reports}/eval-{stamp}{a.tag}.json", report)
    for name, part in report.items():
        print(f"## {name}\n\n{sinks.markdown_table(part['table'])}\n")
    return 0


def verify_goldset(spark, a) -> int:
    rows = resolve_gold(_gold(spark, a), "id", "gold_citation", load_index(spark, a.index).chunks).groupBy("status").count()
    found = {r.status: r["count"] for r in rows.collect()}  # three rows
    print(json.dumps(found))
    return 1 if found.get("missing") else 0


def show_results(spark, a) -> int:
    print(sinks.fixed_table([{"file": r["file"], **r["row"]} for r in sinks.report_rows(sinks.read_reports(spark, a.reports))]))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="evidentia")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *flags, **options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag in flags:
            p.add_argument(f"--{flag}", action="store_true")
        for option, default in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", default=default, type=type(default) if isinstance(default, int | float) else str)
        return p

    p = command("download", download, "stats", "full", out="data", agent="evidentia", client=None, pdf_text=None)
    p.add_argument("--only", nargs="+", choices=collect.SOURCES)
    p.add_argument("--pause", type=float)
    command("build-index", build, "dry-run", documents="data/documents", index="data/index", embed=None)
    p = command("ask", ask, "json", "markdown", "retrieval-only", "no-rerank", "no-decompose", "no-authority", index="data/index", model=None, splitter=None, synthesizer=None, embed=None, score=None, threshold=-6.0)
    p.add_argument("claim")
    p.add_argument("--sources", nargs="*")
    p.add_argument("-k", type=int, default=8)
    p = command("research", ask_around, "json", index="data/index", chat=None, embed=None, steps=8)
    p.add_argument("question")
    p = command("evaluate", evaluate, "retrieval", "generation", "all", "no-decompose", gold="goldset.jsonl", index="data/index", model=None, splitter=None, synthesizer=None, embed=None, score=None, threshold=-6.0, reports="reports", tag="")
    p.add_argument("--limit", type=int)
    p.add_argument("--configs", nargs="+", choices=list(GENERATION))
    command("verify-goldset", verify_goldset, gold="goldset.jsonl", index="data/index")
    command("show-results", show_results, reports="reports/*.json")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("evidentia").getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(workspace(spark))
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
