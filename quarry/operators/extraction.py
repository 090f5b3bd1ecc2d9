"""What models return: tolerant parsing of JSON, a taxonomy, pluggable embedders."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import text as T

#: The taxonomy of entities, and its classes whose importance is always 1.
TYPES = [
    "gamme_systeme", "profil_code", "concept_technique", "regle_pose", "performance_test",
    "pathologie_desordre", "composant_acc", "norme_doc", "materiau_finition", "garantie_duree",
]
CRITICAL = ["garantie_duree", "performance_test", "norme_doc"]
#: The shortest text that is asked about and the characters that are sent, for entities and for summaries; the most entities and questions.
ENTITY_TEXT, SUMMARY_TEXT = (20, 2000), (30, 3000)
MOST_ENTITIES, MOST_QUESTIONS, MOST_PIVOTS = 10, 3, 12


def unfenced(response: Column) -> Column:
    """What stands in a fence of three back quotes, or the whole response."""
    text = T.strip(response)
    return F.when(text.startswith("```"), F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*?)(?:\n```|$)", 1)).otherwise(text)


def entities(response: Column | str) -> Column:
    """An array of name, type, importance: the first ten entries with a name of two letters and a known type. Null if there is no JSON list."""
    text = F.regexp_extract(unfenced(T.col(response)), r"(?s)\[.*\]", 0)
    held = F.from_json(text, "array<struct<name:string,type:string,importance:double>>")
    kind = lambda e: F.lower(T.strip(F.coalesce(e["type"], F.lit(""))))
    weight = lambda e: F.when(kind(e).isin(CRITICAL), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["importance"], F.lit(1.0)))))
    good = F.filter(held, lambda e: (F.length(T.strip(F.coalesce(e["name"], F.lit("")))) >= 2) & kind(e).isin(TYPES))
    return F.slice(F.transform(good, lambda e: F.struct(T.strip(e["name"]).alias("name"), kind(e).alias("type"), weight(e).alias("importance"))), 1, MOST_ENTITIES)


def summary_questions(response: Column | str) -> Column:
    """summary and at most three questions that aren't blank."""
    held = F.from_json(F.regexp_extract(unfenced(T.col(response)), r"(?s)\{.*\}", 0), "struct<summary:string,questions:array<string>>")
    questions = F.slice(F.filter(F.transform(held["questions"], lambda q: T.strip(q)), lambda q: q != ""), 1, MOST_QUESTIONS)
    return F.struct(T.strip(F.coalesce(held["summary"], F.lit(""))).alias("summary"), F.coalesce(questions, F.array().cast("array<string>")).alias("questions"))


def asked(content: Column | str, bounds: tuple[int, int]) -> Column:
    """What is sent to a model: null for texts that are too short."""
    content = T.col(content)
    return F.when(F.length(T.strip(content)) >= bounds[0], F.substring(content, 1, bounds[1]))


def pivots(names: Column | str) -> Column:
    """Normalised names without repeats, in order, twelve at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(T.col(names), T.normalize_name), lambda x: x != "")), 1, MOST_PIVOTS)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 16, tries: int = 3, wait: float = 1.5) -> DataFrame:
    """rows (id, content) with embedding: blank texts get null; a batch that fails in all tries gets nulls, others aren't concerned.

    embedder gets at most batch texts and is run on the executors.
    """

    def vectors(texts: list[str]) -> list:
        for n in range(1, tries + 1):
            try:
                return list(embedder(texts))
            except Exception:
                if n < tries:
                    time.sleep(wait * n)
        return [None] * len(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, out = frame["content"].tolist(), [None] * len(frame)
            full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for a in range(0, len(full), batch):
                for i, v in zip(full[a : a + batch], vectors([texts[i] for i in full[a : a + batch]]), strict=True):
                    out[i] = v
            yield pd.DataFrame({"id": frame["id"], "embedding": out})

    return rows.select("id", "content").mapInPandas(run, "id long, embedding array<double>")
