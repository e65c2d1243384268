"""Running a model over questions: an injectable scorer on each task's batches, and the columns around it."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mcq import parse_answer


class Scorer(Protocol):
    def generate(self, batch: list[list[dict]]) -> list[str]:
        """One output for each list of chat messages."""


class HttpScorer:
    """A chat-completions endpoint: some requests at a time, each tried again after 1, 2, 4, ... seconds, 60 at most.

    A request that fails every time gives ''.
    """

    def __init__(self, model: str, url: str, key: str, max_tokens: int = 8, temperature: float = 0.0, workers: int = 8, tries: int = 6, timeout: float = 120, post: Callable | None = None, sleep: Callable = time.sleep):
        self.model, self.url, self.key, self.max_tokens, self.temperature = model, url, key, max_tokens, temperature
        self.workers, self.tries, self.timeout, self.post, self.sleep = workers, tries, timeout, post or self._post, sleep

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)

    def _one(self, messages: list[dict]) -> str:
        for k in range(self.tries):
            if k:
                self.sleep(min(2 ** (k - 1), 60))
            try:
                return self.post({"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature})["choices"][0]["message"]["content"] or ""
            except Exception:  # rate limits, time-outs, server errors
                continue
        return ""

    def generate(self, batch: list[list[dict]]) -> list[str]:
        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(self._one, batch))


class LocalScorer:
    """A model that runs in the task's own process: its chat() takes a list of lists of messages and sampling settings, as
    the offline engines of inference servers do. load makes it when the first batch comes."""

    def __init__(self, load: Callable[[], object], settings: object | None = None):
        self.load, self.settings, self.model = load, settings, None

    def generate(self, batch: list[list[dict]]) -> list[str]:
        if self.model is None:
            self.model = self.load()
        return [o if isinstance(o, str) else o.outputs[0].text for o in self.model.chat(batch, self.settings)]


def score(df: DataFrame, make: Callable[[], Scorer], messages: str = "messages", out: str = "raw_output", batch: int = 32) -> DataFrame:
    """df with the scorer's output for each row's messages; each task makes one scorer and gives it `batch` rows a call."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in frames:
            said: list[str] = []
            for at in range(0, len(pdf), batch):
                part = pdf[messages].iloc[at : at + batch]
                said += scorer.generate([[dict(m) if isinstance(m, dict) else m.asDict() for m in row] for row in part])
            yield pdf.assign(**{out: said})

    return df.mapInPandas(run, schema)


def predictions(scored: DataFrame) -> DataFrame:
    """The log's columns: id, subject, category, answer, pred, raw_output, correct (false where nothing was parsed)."""
    pred = parse_answer(F.col("raw_output"), F.col("choices"))
    return scored.withColumn("pred", pred).select("id", "subject", "category", "answer", "pred", "raw_output", F.coalesce(F.col("pred") == F.col("answer"), F.lit(False)).alias("correct"))


def choice_scores_to_output(df: DataFrame, scores: str = "scores", out: str = "raw_output") -> DataFrame:
    """The number of the highest-scored option as output; a score that isn't finite is an error."""
    bad = F.exists(scores, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    best = F.array_position(F.col(scores), F.array_max(scores)).cast("string")
    return df.withColumn(out, F.when(bad, F.raise_error(F.lit("non-finite scores"))).otherwise(best))


def training_examples(df: DataFrame, prompt: str, full: str, max_len: int) -> tuple[DataFrame, DataFrame]:
    """(examples, skipped): token ids and labels of rows whose full text isn't too long, and how many are."""
    from ..functions.mcq import mask_labels

    short = F.size(full) <= max_len
    rows = df.filter(short).withColumn("labels", mask_labels(F.col(prompt), F.col(full))).withColumnRenamed(full, "input_ids").drop(prompt)
    return rows, df.agg(F.count(F.when(~short, 1)).alias("skipped"))
