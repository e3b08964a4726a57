"""Pluggable scorer: any callable from report texts to coded replies, run in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.replies import parse_reply

Scorer = Callable[[pd.Series], pd.Series]


def _one_by_one(scorer: Scorer, texts: pd.Series) -> tuple[list[str | None], list[str | None]]:
    replies, errors = [], []
    for i in range(len(texts)):
        try:
            replies.append(scorer(texts.iloc[i:i + 1]).iloc[0])
            errors.append(None)
        except Exception as error:
            replies.append(None)
            errors.append(str(error) or type(error).__name__)
    return replies, errors


def score_reports(reports: DataFrame, key: str, text: str, make_scorer: Callable[[], Scorer], model: str, together: int = 1) -> DataFrame:
    """Coded reply of every report with its latency.

    ``make_scorer`` runs once per task, so a model is loaded there, not on the driver. Columns:
    key, ``reponse``, ``dp``, ``das``, ``latence_ms``, ``erreur``, ``modele``. The scorer gets ``together`` reports a call, and each has the latency of its
    call, which with one is its own. Where a call fails, its reports are scored one by one: a failing report has an error and no reply, the others go on.
    """
    schema = f"{reports.select(key).schema[0].name} {reports.select(key).schema[0].dataType.simpleString()}, reponse string, latence_ms double, erreur string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            if batch.empty:
                continue
            replies, errors, spent = [], [], []
            for at in range(0, len(batch), together):
                texts = batch[text].iloc[at:at + together]
                start = time.perf_counter()
                try:
                    found, failed = list(scorer(texts)), [None] * len(texts)
                except Exception:
                    found, failed = _one_by_one(scorer, texts)
                replies += found
                errors += failed
                spent += [round((time.perf_counter() - start) * 1000, 1)] * len(texts)
            yield pd.DataFrame({key: batch[key], "reponse": replies, "latence_ms": spent, "erreur": errors})

    scored = reports.select(key, text).mapInPandas(run, schema)
    parsed = parse_reply(F.col("reponse"))
    return scored.select(
        key, "reponse", parsed["dp"].alias("dp"), parsed["das"].alias("das"), "latence_ms", "erreur", F.lit(model).alias("modele"))

