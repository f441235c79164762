"""Values pulled over HTTP into a stage: one request for each sample and chunk of features, sent from the tasks.

The service answers POST {sample_id, feature_ids} with {"values": [{"feature_id", "present", "value"}, ...]}. A request is
tried again a few times, as is the task, so values must depend on the ids alone; rows reach the stage with its commit only.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.errors import DataError
from tracegrid.schema import RAW
from tracegrid.sources.session import Session

TRIES, TIMEOUT = 3, 30.0


def ask(url: str, sample_id: int, feature_ids: list[int]) -> list[tuple[int, int, float]]:
    body = json.dumps({"sample_id": sample_id, "feature_ids": feature_ids}).encode()
    for left in range(TRIES - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=TIMEOUT) as r:
                found = json.loads(r.read())["values"]
            return [(sample_id, x["feature_id"], float(x["value"])) for x in found if x.get("present") and x.get("value") is not None]
        except (urllib.error.URLError, TimeoutError, KeyError, ValueError) as fault:
            if not left:
                raise DataError(f"{url} gave no values of sample {sample_id}: {fault}") from fault
            time.sleep(0.1)
    return []


def pull(samples: DataFrame, n_features: int, url: str, chunk: int = 1000, tasks: int = 32) -> DataFrame:
    """(sample_id, feature_id, value) of the cells that the service has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for s, f in zip(b["sample_id"].tolist(), b["first"].tolist()) for r in ask(url, s, list(range(f, min(f + chunk, n_features))))]
            yield pd.DataFrame(rows, columns=["sample_id", "feature_id", "value"])

    firsts = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_features - 1)), F.lit(chunk)))
    wanted = samples.select(F.col("sample_id").cast("long").alias("sample_id"), firsts.alias("first"))
    return wanted.repartition(tasks, "sample_id", "first").mapInPandas(run, RAW)


def stage(session: Session, batch: str, samples: DataFrame, n_features: int, url: str, chunk: int = 1000) -> bool:
    """Pull the samples that the session lacks and stage them as one batch of its table `cells`."""
    todo = session.pending(samples.select("sample_id"))
    return session.write(batch, todo, cells=pull(todo, n_features, url, chunk))
