"""Shells around a language model: batching, clamping, validation. The model is a callable, so tests use a fake."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Memories that one request asks about; the range of grades; queries kept from one answer.
BATCH, LOWEST, HIGHEST, MOST_QUERIES = 20, 0, 2, 8

Ask = Callable[[str], str]


def json_of(answer: str) -> dict:
    """The JSON object in an answer that may have a fence or prose around it; empty if there is none."""
    start, end = answer.find("{"), answer.rfind("}")
    try:
        found = json.loads(answer[start : end + 1]) if 0 <= start < end else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def clamp(grade: object) -> int:
    return min(HIGHEST, max(LOWEST, int(grade))) if isinstance(grade, (int, float)) and grade == grade else LOWEST


def judge(pairs: DataFrame, ask: Ask) -> DataFrame:
    """(query, doc, grade) of (query, query_text, doc, doc_text), BATCH at a time within a task; unknown docs are dropped.

    Pairs already judged should be left out before (`evaluate.unjudged`), so a retry asks no more than it must.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for query, group in b.groupby("query", sort=True):
                for lo in range(0, len(group), BATCH):
                    part = group.iloc[lo : lo + BATCH]
                    request = {"query": part["query_text"].iloc[0], "memories": [{"id": i, "text": t} for i, t in enumerate(part["doc_text"])]}
                    grades = json_of(ask(json.dumps(request, ensure_ascii=False))).get("grades")
                    for key, grade in (grades if isinstance(grades, dict) else {}).items():
                        if str(key).isdigit() and int(key) < len(part):
                            rows.append((query, part["doc"].iloc[int(key)], clamp(grade)))
            yield pd.DataFrame(rows, columns=["query", "doc", "grade"])

    kinds = dict(pairs.dtypes)
    return pairs.select("query", "query_text", "doc", "doc_text").sortWithinPartitions("query", "doc").mapInPandas(run, f"query {kinds['query']}, doc {kinds['doc']}, grade int")


def generated_queries(texts: DataFrame, ask: Ask) -> DataFrame:
    """(id, query): distinct, trimmed queries that the model writes for each text, MOST_QUERIES at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"], strict=True):
                found = json_of(ask(json.dumps({"text": text}, ensure_ascii=False))).get("queries")
                own = dict.fromkeys(q.strip() for q in found if isinstance(q, str) and q.strip()) if isinstance(found, list) else {}
                rows += [(i, q) for q in list(own)[:MOST_QUERIES]]
            yield pd.DataFrame(rows, columns=["id", "query"])

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, query string")


def valid(category: Column, query: Column, identifiers: Column, compounds: Column, rare: Column, tag_source: Column) -> Column:
    """Whether a query does what its category needs: names one of the target's features, or for parts none of its compounds."""

    def names(items: Column) -> Column:
        return F.exists(items, lambda x: F.contains(F.lower(query), F.lower(x)))

    return (
        F.when(category.isin("identifier", "mixed"), names(identifiers))
        .when(category == "part", ~names(compounds))
        .when(category == "name", names(rare))
        .when(category == "tagsource", names(tag_source))
        .otherwise(True)
    )


def log_queries(answers: DataFrame, path: str) -> None:
    """Append (time, space, query, results) records as JSON lines."""
    answers.select(F.col("time"), "space", "query", "results").write.mode("append").json(path)
