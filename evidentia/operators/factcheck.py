"""Fact-checking in batches: split, retrieve, generate, verify, downgrade, sum up. Every model is a function that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import metrics, verification
from evidentia.operators.retrieval import top_k

VERDICTS = ("SUPPORTED", "CONTRADICTED", "PARTIALLY_SUPPORTED", "NOT_ADDRESSED")
#: Prompts to outputs, one each.
Model = Callable[[pd.Series], pd.Series]
EVIDENCE = "array<struct<tag:string,quote:string,relevance:string>>"
UNREADABLE = "The output could not be read."
#: Which columns say which claim and which part of it a row belongs to.
PART = ["claim_id", "part"]


def asked(prompt: Column, model: Model) -> Column:
    """A model's output of each prompt, in Arrow batches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield model(b)

    return run(prompt)


def split_claims(claims: DataFrame, text: str = "claim", pieces: Column | None = None, most: int = 6) -> DataFrame:
    """(claim_id, part, claim): the first ``most`` pieces of a claim or, if one of them is no assertion, the claim as one part."""
    whole = F.array(F.col(text))
    if pieces is not None:
        pieces = F.slice(F.filter(pieces, lambda s: F.trim(s) != ""), 1, most)
        whole = F.when(F.coalesce(metrics.usable_split(pieces, F.col(text)), F.lit(False)), pieces).otherwise(whole)
    return claims.select("claim_id", F.posexplode(whole).alias("part", "claim")).withColumn("part", F.col("part") + 1)


def split_by_model(claims: DataFrame, model: Model, text: str = "claim", most: int = 6) -> DataFrame:
    """``split_claims`` into the pieces that a model names as {"subclaims": [{"text": ...}]}; an output that can't be read leaves the claim whole."""
    told = T.parse_json_loose(T.strip_think(asked(F.concat(F.lit("SPLIT: "), F.col(text)), model)))
    pieces = F.transform(F.try_variant_get(told, "$.subclaims", "array<struct<text: string>>"), lambda s: F.coalesce(s["text"], F.lit("")))
    return split_claims(claims.withColumn("pieces_", pieces), text, F.col("pieces_"), most)


def contexts(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, context): the passages found for each query, in order, under their tags. A query has final_k of them at most."""
    c = lambda name: F.coalesce(name, F.lit(""))
    block = F.concat(F.lit("["), "tag", F.lit("] "), c("citation"), F.lit(" | "), c("title"), F.lit("\nsource="), c("source"), F.lit(" url="), c("url"), F.lit("\n---\n"), c("text"), F.lit("\n"))
    grouped = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("final_rank", block.alias("b")))).alias("p"))
    return grouped.select(*keys, F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("context"))


def read_answers(rows: DataFrame, output: str = "output") -> DataFrame:
    """``rows`` with verdict, confidence, explanation, evidence, caveats and conflicts of the model's output, whatever its shape.

    A verdict that isn't one is NOT_ADDRESSED. An output without JSON is NOT_ADDRESSED with low confidence and a caveat.
    """
    rows = rows.withColumn("v_", T.parse_json_loose(T.strip_think(F.coalesce(output, F.lit("")))))
    v, bad = F.col("v_"), F.col("v_").isNull()
    verdict, none = F.try_variant_get(v, "$.verdict", "string"), F.array().cast(EVIDENCE)
    return (
        rows.withColumn("verdict", F.when(verdict.isin(*VERDICTS), verdict).otherwise("NOT_ADDRESSED"))
        .withColumn("confidence", F.coalesce(F.try_variant_get(v, "$.confidence", "string"), F.lit("low")))
        .withColumn("explanation", F.coalesce(F.try_variant_get(v, "$.explanation", "string"), F.lit("")))
        .withColumn("evidence", F.coalesce(F.try_variant_get(v, "$.evidence", EVIDENCE.replace(":", ": ")), none))
        .withColumn("caveats", F.when(bad, F.array(F.lit(UNREADABLE))).otherwise(T.coerce_list(v, "$.caveats")))
        .withColumn("conflicts", T.coerce_list(v, "$.conflicts"))
        .drop("v_")
    )


def ground(answers: DataFrame, results: DataFrame, keys: list[str], threshold: float = 0.85) -> DataFrame:
    """``answers`` with a report of mechanical checks against the passages they were given: tags, quotes, cited sentences, grade, summary."""
    there = results.groupBy(*keys).agg(F.collect_set("tag").alias("there_"))
    quotes = answers.select(*keys, F.posexplode("evidence").alias("at_", "e_")).select(*keys, "at_", F.col("e_.tag").alias("tag"), F.trim(F.col("e_.quote")).alias("quote")).filter("quote <> ''")
    pairs = quotes.join(results.select(*keys, "tag", F.col("text").alias("body_"), F.col("citation").alias("source_citation")), [*keys, "tag"], "left")
    checks = verification.verify_quotes(pairs, "quote", "body_", threshold)
    note = F.when(F.col("body_").isNull(), F.concat(F.lit("tag "), F.coalesce("tag", F.lit("")), F.lit(" was not in the context"))).when(~F.col("found"), "quote not found in the cited source").otherwise("")
    per = checks.groupBy(*keys).agg(
        F.count("*").alias("quotes"), F.count_if("found").alias("verified"),
        F.array_sort(F.collect_list(F.struct("at_", "tag", "quote", "found", "similarity", note.alias("note")))).alias("quote_checks"),
    )
    none, text = F.array().cast("array<string>"), F.trim(F.col("explanation"))
    named = F.filter(F.transform("evidence", lambda e: e["tag"]), lambda t: t.isNotNull() & (t != ""))
    cited = F.array_sort(F.array_distinct(F.concat(verification.cited_tags(text), named)))
    rows = answers.join(there, keys, "left").join(per, keys, "left").withColumn("there_", F.coalesce("there_", none))
    rows = rows.withColumn("valid_tags", F.array_intersect(cited, "there_")).withColumn("invalid_tags", F.array_except(cited, "there_"))
    n, uncited = verification.coverage(text)
    rows = rows.withColumn("quotes", F.coalesce("quotes", F.lit(0))).withColumn("verified", F.coalesce("verified", F.lit(0))).withColumn("sentences", n).withColumn("uncited", uncited)
    rows = rows.withColumn("quote_fidelity", F.coalesce(F.try_divide("verified", "quotes"), F.lit(1.0))).withColumn("sentence_coverage", 1 - F.coalesce(F.try_divide("uncited", "sentences"), F.lit(0.0)))
    rows = rows.withColumn("grade", verification.grade(F.size("invalid_tags"), F.col("quote_fidelity"), F.col("sentence_coverage")))
    bad = F.when(F.size("invalid_tags") > 0, F.concat(F.lit("INVALID TAGS: "), F.array_join("invalid_tags", ", ")))
    summary = F.concat_ws(" | ", F.format_string("%d/%d quotes verbatim", "verified", "quotes"), F.format_string("%d/%d sentences cited", F.col("sentences") - F.col("uncited"), "sentences"), bad)
    return rows.withColumn("grounding", summary).drop("there_")


def downgrade(rows: DataFrame) -> DataFrame:
    """Lower confidence and a caveat for answers of ``ground`` that don't hold; the verdict stays."""
    tags = F.when(F.size("invalid_tags") > 0, F.concat(F.lit("cited sources that were not retrieved ("), F.array_join("invalid_tags", ", "), F.lit("). ")))
    quotes = F.when(F.col("quote_fidelity") < 1, F.format_string("%d of %d quotes could not be found in the cited sources. ", F.col("quotes") - F.col("verified"), "quotes"))
    failed = F.concat(F.coalesce(tags, F.lit("")), F.coalesce(quotes, F.lit("")), F.lit("Treat this answer as unverified and read the linked sources directly."))
    why = F.when(F.col("grade") == "UNGROUNDED", failed).otherwise(F.concat("grounding", F.lit(".")))
    confidence, caveats = verification.enforce(F.col("grade"), F.col("confidence"), F.col("caveats"), why)
    return rows.withColumn("c_", confidence).withColumn("caveats", caveats).withColumn("confidence", F.col("c_")).drop("c_")


def without_retrieval(rows: DataFrame) -> DataFrame:
    """The control: answers from memory. A decisive verdict has nothing behind it and is UNGROUNDED; what wasn't measured is null."""
    decisive = F.col("verdict").isin(*verification.DECISIVE)
    zero = F.when(decisive, 0.0)
    return rows.withColumn("evidence", F.array().cast(EVIDENCE)).withColumn("grade", F.when(decisive, "UNGROUNDED").otherwise("GROUNDED")).withColumn("quote_fidelity", zero).withColumn("sentence_coverage", zero)


def sum_up(parts: DataFrame, claims: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(claim_id, verdict, confidence, summary, explanation, caveats, n_parts, grounded): one part speaks for itself, more are aggregated.

    With a ``model`` and the ``claims`` (claim_id, claim), claims of several parts are summed up by it; what it doesn't say, or says in a
    form that can't be read, is aggregated.
    """
    kept = F.struct("part", "claim", "verdict", "confidence", "explanation", "caveats") if model else F.struct("part", "confidence", "explanation", "caveats")
    rows = parts.groupBy("claim_id").agg(
        metrics.overall_verdict(F.col("verdict")).alias("verdict"), F.array_sort(F.collect_list(kept)).alias("p"), F.count_if(F.col("grade") == "GROUNDED").alias("grounded"),
    )
    one, first = F.size("p") == 1, F.element_at("p", 1)
    lead = F.concat(F.regexp_replace(F.substring_index(first["explanation"], ". ", 1), r"^[. ]+|[. ]+$", ""), F.lit("."))
    out = rows.select(
        "claim_id", "verdict", F.when(one, first["confidence"]).otherwise("low").alias("confidence"), F.when(one, lead).otherwise("See the verdicts of the parts below.").alias("summary"),
        F.array_join(F.transform("p", lambda x: x["explanation"]), " ").alias("explanation"), F.flatten(F.transform("p", lambda x: x["caveats"])).alias("caveats"),
        F.size("p").alias("n_parts"), "grounded", *(["p"] if model else []),
    )
    if model is None:
        return out
    several = out.filter("n_parts > 1").join(claims.select("claim_id", "claim"), "claim_id")
    prompt = F.concat(F.lit("SUM UP: "), "claim", F.lit("\n\nPARTS:\n\n"), F.to_json("p"))
    several = several.withColumn("v_", T.parse_json_loose(T.strip_think(asked(prompt, model)))).drop("claim")
    said = lambda name: F.nullif(F.try_variant_get(F.col("v_"), f"$.{name}", "string"), F.lit(""))
    several = several.withColumns({
        "verdict": F.when(said("verdict").isin(*VERDICTS), said("verdict")).otherwise(F.col("verdict")), "confidence": F.coalesce(said("confidence"), "confidence"),
        "summary": F.coalesce(said("summary"), "summary"), "explanation": F.coalesce(said("explanation"), "explanation"),
        "caveats": F.when(F.col("v_").isNull() | F.try_variant_get(F.col("v_"), "$.caveats", "string").isNull(), F.col("caveats")).otherwise(T.coerce_list(F.col("v_"), "$.caveats")),
    }).drop("v_", "p")
    return out.filter("n_parts <= 1").drop("p").unionByName(several)


def answer_grade(grade: Column) -> Column:
    """The grade of a claim from those of its parts, as an aggregate: the worst."""
    worst = F.max(F.when(grade == "UNGROUNDED", 2).when(grade == "PARTIAL", 1).otherwise(0))
    return F.when(worst == 2, "UNGROUNDED").when(worst == 1, "PARTIAL").otherwise("GROUNDED")


def recent_changes(notices: DataFrame, keys: list[str], as_of: str, days: int = 365, pool: int = 4, most: int = 3) -> DataFrame:
    """Of a claim's ``pool`` best notices, the first ``most`` that took effect in the ``days`` before ``as_of`` or later."""
    recent = notices.filter(F.col("final_rank") < pool).filter(F.try_to_date("effective_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return top_k(recent, keys[0], [F.col("final_rank")], most, "shown").select(*keys, "shown", F.col("effective_date").alias("date"), "title", "citation", "url")


def check(
    claims: DataFrame, search: Callable[[DataFrame], DataFrame] | None, model: Model, pieces: Column | None = None, threshold: float = -6.0,
    keep: Callable[[DataFrame], DataFrame] | None = None, splitter: Model | None = None, synthesizer: Model | None = None, act: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(parts, overall) of ``claims`` (claim_id, claim).

    ``search`` maps (qid, claim) to the rows of ``Index.search``; without it the model answers from memory, which is the control. A part
    without passages, or whose best one scores below ``threshold``, isn't asked about. Claims are split into ``pieces`` or by a
    ``splitter``, and summed up by a ``synthesizer`` if there is one. Answers are always verified; ``act`` lowers those that don't hold.
    ``keep`` writes the models' outputs and rereads them; by default they are checkpointed, so that no call is made twice.
    """
    keep = keep or (lambda df: df.checkpoint())
    qid = F.concat_ws("#", "claim_id", "part")
    parts = keep(split_by_model(claims, splitter)) if splitter else split_claims(claims, "claim", pieces)
    parts = parts.withColumn("qid", qid)
    if search is None:
        told = keep(parts.withColumn("output", asked(F.concat(F.lit("CLAIM: "), "claim"), model)))
        none = F.array().cast("array<struct<final_rank:int,tag:string,citation:string,title:string,source:string,url:string>>")
        done = without_retrieval(read_answers(told)).withColumn("valid_tags", F.array().cast("array<string>")).withColumn("sources", none)
        return done, sum_up(done, claims, synthesizer)
    found = keep(search(parts.select("qid", "claim")))
    shown = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("final_rank", "tag", "citation", "title", "source", "url"))).alias("sources"))  # final_k of them
    best = found.filter("final_rank = 0").select("qid", F.col("rerank").alias("best_"))
    rows = parts.join(contexts(found, ["qid"]), "qid", "left").join(best, "qid", "left").join(shown, "qid", "left")
    ready = F.col("context").isNotNull() & (F.col("best_") >= threshold)
    prompt = F.concat(F.lit("CLAIM: "), "claim", F.lit("\n\nPASSAGES:\n\n"), "context")
    told = rows.filter(ready).withColumn("output", asked(prompt, model))
    silent = rows.filter(~F.coalesce(ready, F.lit(False))).withColumn("output", F.to_json(F.struct(F.lit("NOT_ADDRESSED").alias("verdict"), F.lit("low").alias("confidence"), F.array(F.lit("Nothing was retrieved that bears on this part.")).alias("caveats"))))
    answers = read_answers(keep(told.unionByName(silent).drop("context", "best_")))
    done = ground(answers, found, ["qid"])
    done = downgrade(done) if act else done
    return done, sum_up(done, claims, synthesizer)


def cases(gold: DataFrame, parts: DataFrame, overall: DataFrame) -> DataFrame:
    """The cases of ``metrics.generation_metrics`` for ``gold`` (claim_id, gold_verdict, gold_citation) and what ``check`` made of its claims.

    Cited are the sources whose tags an answer names, or else its parts' first three.
    """
    cite = lambda keep: F.flatten(F.collect_list(F.transform(F.filter(F.coalesce("sources", F.array().cast("array<struct<final_rank:int,tag:string,citation:string,title:string,source:string,url:string>>")), keep), lambda s: s["citation"])))
    per = parts.groupBy("claim_id").agg(
        cite(lambda s: F.array_contains(F.coalesce("valid_tags", F.array().cast("array<string>")), s["tag"])).alias("named"), cite(lambda s: s["final_rank"] < 3).alias("first"),
        F.avg("quote_fidelity").alias("quote_fidelity"), answer_grade(F.col("grade")).alias("grounding_grade"),
    )
    rows = gold.join(overall.select("claim_id", F.col("verdict").alias("predicted_verdict")), "claim_id").join(per, "claim_id")
    cited = F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("first"))
    asked_ = F.coalesce("gold_citation", F.lit(""))
    right = F.when((asked_ != "") & (F.size(cited) > 0), F.exists(cited, lambda c: T.citation_match(c, asked_)))
    return rows.select("claim_id", "gold_verdict", "predicted_verdict", right.alias("cited_gold"), "quote_fidelity", "grounding_grade")


def markdown(overall: DataFrame, parts: DataFrame) -> DataFrame:
    """(claim_id, report) as text for people."""
    piece = F.concat(F.format_string("### %d. ", "part"), "claim", F.lit("\n**"), "verdict", F.lit("** ("), "confidence", F.lit("), grounding: "), "grade", F.lit("\n\n"), "explanation")
    listed = parts.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("part", piece.alias("t")))).alias("p"))
    head = F.concat(F.lit("# ["), F.replace("verdict", F.lit("_"), F.lit(" ")), F.lit("] (confidence: "), "confidence", F.lit(")"))
    caveats = F.when(F.size("caveats") > 0, F.concat(F.lit("## Caveats\n\n- "), F.array_join("caveats", "\n- ")))
    body = F.concat_ws("\n\n", head, F.concat(F.lit("**Bottom line:** "), "summary"), "explanation", caveats, F.lit("## Parts"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"))
    return overall.join(listed, "claim_id").select("claim_id", body.alias("report"))
