"""Retrieval and verdict metrics as aggregates. Of no cases, fidelity and abstention recall are 1, other shares 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(results: DataFrame, gold: DataFrame, qid: str, rank: str, match: Column) -> DataFrame:
    """(qid, hit): the rank from 1 of each gold query's first match, or null."""
    hits = results.join(gold, qid).groupBy(qid).agg(F.min(F.when(match, F.col(rank) + 1)).alias("hit"))
    return gold.select(qid).distinct().join(hits, qid, "left")


def retrieval_metrics(hits: DataFrame, ks=(1, 3, 5, 8)) -> DataFrame:
    """One row: queries, recall at each k, mean reciprocal rank, nDCG at 5 (binary gain, first hit)."""
    recall = [F.round(F.avg((F.coalesce("hit", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"recall_{k}") for k in ks]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))), 6).alias("mrr")
    ndcg = F.round(F.avg(F.when(F.col("hit") <= 5, 1.0 / F.log2(F.col("hit") + 1)).otherwise(0.0)), 6).alias("ndcg_5")
    return hits.agg(F.count("*").alias("n"), *recall, mrr, ndcg)


def verdict_score(predicted: Column, gold: Column) -> Column:
    """1 if equal, 0.5 if one of the two is PARTIALLY_SUPPORTED and the other is decisive, else 0."""
    decisive = lambda c: c.isin("SUPPORTED", "CONTRADICTED")
    near = ((predicted == "PARTIALLY_SUPPORTED") & decisive(gold)) | ((gold == "PARTIALLY_SUPPORTED") & decisive(predicted))
    return F.when(predicted == gold, 1.0).when(near, 0.5).otherwise(0.0)


def generation_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group: accuracy, partial credit, citation precision, fidelity, hallucination and abstention rates, latency, cost.

    ``cases``: gold_verdict, predicted_verdict, cited_gold (boolean, null without a gold or a cited citation), quote_fidelity (null if there
    was no quote), grounding_grade, latency_s, cost_usd and, where answers may lose their verdict, downgraded. ``hallucination`` is of all
    cases, ``residual_hallucination`` of those shown as decisive, ``detected_hallucination`` of those decisive or downgraded.
    """
    gold, pred = F.col("gold_verdict"), F.col("predicted_verdict")
    bad, final = F.coalesce(F.col("grounding_grade") == "UNGROUNDED", F.lit(False)), pred.isin("SUPPORTED", "CONTRADICTED")
    decisive = final | F.coalesce("downgraded", F.lit(False)) if "downgraded" in cases.columns else final
    share = lambda part, whole, none=0.0: F.coalesce(F.round(F.try_divide(F.count_if(part), F.count_if(whole)), 6), F.lit(none))
    none = lambda c: c == "NOT_ADDRESSED"
    mean = lambda c, none: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 6), F.lit(none))
    return cases.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.round(F.avg((pred == gold).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(verdict_score(pred, gold)), 6).alias("score"),
        mean("cited_gold", 0.0).alias("citation_precision"),
        mean("quote_fidelity", 1.0).alias("quote_fidelity"),
        share(bad, F.lit(True)).alias("hallucination"),
        share(bad & final, final).alias("residual_hallucination"),
        share(bad & decisive, decisive).alias("detected_hallucination"),
        share(none(gold) & none(pred), none(pred)).alias("abstention_precision"),
        share(none(gold) & none(pred), none(gold), 1.0).alias("abstention_recall"),
        F.round(F.avg("latency_s"), 6).alias("latency_s"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def usable_split(parts: Column, claim: Column) -> Column:
    """Whether every piece is an assertion (five words, 25 characters) and a reduction of the claim; false for no pieces."""
    from evidentia.functions.text import word_count

    good = lambda p: (word_count(F.trim(p)) >= 5) & (F.length(F.trim(p)) >= 25) & (F.length(F.trim(p)) <= F.length(claim) + 40)
    return (F.size(parts) > 0) & F.forall(parts, good)


def overall_verdict(verdict: Column) -> Column:
    """The verdict of a claim from those of its parts, as an aggregate. No parts: SUPPORTED, as nothing speaks against it."""
    every = lambda *v: F.coalesce(F.bool_and(verdict.isin(*v)), F.lit(True))
    return (
        F.when(F.coalesce(F.bool_or(verdict == "CONTRADICTED"), F.lit(False)), F.when(every("CONTRADICTED", "NOT_ADDRESSED"), "CONTRADICTED").otherwise("PARTIALLY_SUPPORTED"))
        .when(every("SUPPORTED"), "SUPPORTED").when(every("NOT_ADDRESSED"), "NOT_ADDRESSED").otherwise("PARTIALLY_SUPPORTED")
    )
