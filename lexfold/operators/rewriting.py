"""Questions and documents turned into search strings by a model, which is injected."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 8000  # Fixed value: of a document that the model reads to find similar ones


def _asked(rows: DataFrame, name: str, model: Callable[[str], str | None]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f["text"]:
                answer = None
                if t is not None and t.strip():
                    try:
                        answer = model(t)
                    except Exception:  # the service may fail for one; the others go on
                        logging.getLogger(__name__).warning("no answer from the model", exc_info=True)
                out.append(None if answer is None else answer.strip())
            yield pd.DataFrame({"id": f["id"], name: out})

    return rows.mapInPandas(run, f"id long, {name} string")


def search_strings(questions: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """id, query of each question (id, text): null where it is blank or the model fails, empty where the model finds nothing to search for."""
    return _asked(questions.select("id", "text"), "query", model)


def similar_terms(docs: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """id, terms of each document (id, text), of whose text the model reads the first MOST_CHARS characters; null where there are none."""
    return _asked(docs.select("id", F.substring("text", 1, MOST_CHARS).alias("text")), "terms", model).select("id", F.nullif("terms", F.lit("")).alias("terms"))
