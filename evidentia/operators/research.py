"""A research assistant: four batch tools over an index and the loop of a chat model that calls them. The loop runs on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.index import Index, lookup_citations
from evidentia.operators.retrieval import Params

#: Messages to the model's message: {"content": ..., "tool_calls": [{"id", "function": {"name", "arguments"}}]}.
Chat = Callable[[list[dict]], dict]
#: The sources of each kind of authority.
AUTHORITIES = {"statute": ["ina"], "regulation": ["cfr"], "agency_guidance": ["fam", "uscis_pm"]}
SEARCH_FIRST = "You answered without searching. Call search_corpus first and answer only from what it returns."
ANSWER_NOW = "The step limit is reached. Answer now from the tool results alone and say what stays open."


def fit(result: dict, budget: int = 12_000) -> str:
    """A tool's result as valid JSON of ``budget`` characters at most: shorter texts first, then fewer rows from the end."""
    key = next((k for k in ("passages", "documents", "results") if isinstance(result.get(k), list)), None)
    whole = json.dumps(result)
    if len(whole) <= budget:
        return whole
    if key:
        rows = result[key]
        clipped = lambda n, most: [{**r, "text": (r.get("text") or "")[:most]} for r in rows[:n]]
        for most in (1200, 600, 300, 200):
            out = json.dumps({**result, key: clipped(len(rows), most)})
            if len(out) <= budget:
                return out
        for n in range(len(rows) - 1, 0, -1):
            out = json.dumps({**result, key: clipped(n, 200), "truncated": f"showing {n} of {len(rows)} passages"})
            if len(out) <= budget:
                return out
    return json.dumps({"note": "result too large to include", "n_results": result.get("n_results")})


def newest_first(found: DataFrame, qid: str, most: int = 6) -> DataFrame:
    """The first ``most`` rows of each topic with their ``place``, the latest first; those without a date come last."""
    order = Window.partitionBy(qid).orderBy(F.desc_nulls_last("effective_date"), "final_rank")
    return found.filter(F.col("final_rank") < most).withColumn("place", F.row_number().over(order))


def per_authority(found: DataFrame, qid: str, kinds: dict[str, list[str]], k: int = 3, other: str | None = None) -> DataFrame:
    """The first ``k`` rows of each topic and kind of authority, by ``pool_rank``, with ``kind`` and ``place``; sources of no kind are ``other`` or left out."""
    kind = F.lit(other)
    for name, sources in kinds.items():
        kind = F.when(F.col("source").isin(*sources), name).otherwise(kind)
    place = F.row_number().over(Window.partitionBy(qid, "kind").orderBy("pool_rank"))
    return found.withColumn("kind", kind).filter("kind is not null").withColumn("place", place).filter(F.col("place") <= k)


def _plain(text: str) -> str:
    return re.sub("[§ ]", "", text.lower())


@dataclass
class Assistant:
    index: Index
    params: Params = Params()
    search_with: dict = field(default_factory=dict)
    seen: dict = field(default_factory=dict)

    def _found(self, text: str, k: int, keep: list[str] | None = None) -> DataFrame:
        spark = self.index.chunks.sparkSession
        rows = self.index.search(spark.createDataFrame([("q", text)], "qid string, q string"), "qid", "q", self.params, keep=keep, **self.search_with)
        return rows.filter(F.col("final_rank") < k).orderBy("final_rank")

    def _noted(self, rows: DataFrame, most: int = 1200) -> list[dict]:
        out = [r.asDict() for r in rows.select("citation", "title", "source", "url", F.substring("text", 1, most).alias("text")).collect()]  # k rows
        self.seen |= {r["citation"]: r for r in out}
        return out

    def search_corpus(self, query: str, sources: list[str] | None = None, k: int = 6) -> dict:
        rows = self._noted(self._found(query, k, sources))
        return {"n_results": len(rows), "passages": rows} if rows else {"n_results": 0, "note": "no candidates", "passages": []}

    def lookup_citation(self, citation: str) -> dict:
        spark = self.index.chunks.sparkSession
        hits = lookup_citations(spark.createDataFrame([("q", citation)], "qid string, c string"), "qid", "c", self.index.chunks)
        rows, how = self._noted(hits.orderBy("rank")), "exact"
        if not rows:
            rows, how = self._noted(self._found(citation, 5)), "lexical"
        return {"n_results": len(rows), "match": how, "passages": rows}

    def check_recent_changes(self, topic: str) -> dict:
        hits = newest_first(self._found(topic, 6, ["fedreg"]).withColumn("topic", F.lit(topic)), "topic").orderBy("place")
        rows = [r.asDict() for r in hits.select("citation", "title", "effective_date", "url", F.substring("text", 1, 500).alias("summary")).collect()]  # six rows
        return {"n_results": len(rows), "documents": rows}

    def compare_authorities(self, topic: str) -> dict:
        return {kind: self._noted(self._found(topic, 3, sources)) for kind, sources in AUTHORITIES.items()}

    def run(self, question: str, chat: Chat, steps: int = 8) -> dict:
        """{"answer", "citations", "trace"}: an answer before the first tool call is refused, one after the last step is asked for."""
        talk, trace = [{"role": "user", "content": question}], []
        tools = {t: getattr(self, t) for t in ("search_corpus", "lookup_citation", "check_recent_changes", "compare_authorities")}
        for _ in range(steps):
            said = chat(talk)
            talk.append(said)
            calls = said.get("tool_calls") or []
            if not calls and trace:
                return self._closed(said.get("content") or "", trace)
            if not calls:
                talk.append({"role": "user", "content": SEARCH_FIRST})
            for call in calls:
                name, given = call["function"]["name"], call["function"].get("arguments") or "{}"
                try:
                    result = tools[name](**json.loads(given))
                except Exception as e:  # noqa: BLE001  the model is told what went wrong
                    result = {"error": f"{type(e).__name__}: {e}"}
                trace.append({"tool": name, "arguments": given, "n_results": result.get("n_results", len(result))})
                talk.append({"role": "tool", "tool_call_id": call.get("id"), "content": fit(result)})
        talk.append({"role": "user", "content": ANSWER_NOW})
        return self._closed(chat(talk).get("content") or "", trace)

    def _closed(self, answer: str, trace: list[dict]) -> dict:
        """The sources that the answer names, or else the first eight seen."""
        plain = _plain(answer)
        named = [r for c, r in self.seen.items() if _plain(c)[:18] in plain]
        return {"answer": answer, "citations": named or list(self.seen.values())[:8], "trace": trace}
