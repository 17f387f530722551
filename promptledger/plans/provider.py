"""Answers from a caller's own batch functions, tried in order, as the log of attempts that the audit reads.

The library calls no model. What a caller hands in, a function over a list of requests, runs on the executors next to
the requests; the log of its attempts goes through `first_success` and `attach_responses` like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.responses import first_success


class Request(NamedTuple):
    request_id: int
    target_model: str | None
    text: str


class Answer(NamedTuple):
    """`error` says why there is no text; an answer may be an empty text."""

    text: str | None = None
    output_tokens: int | None = None
    error: str | None = None


#: From requests to as many answers, in their order.
Provider = Callable[[Sequence[Request]], Sequence[Answer]]

ATTEMPTS = "request_id bigint, attempt int, model string, ok boolean, text string, output_tokens int, error string"
BATCH = 256


def _asked(provider: Provider, requests: list[Request]) -> list[Answer]:
    """The answers; what is raised, or not as many as asked for, fails the whole call."""
    try:
        answers = [Answer(*a) for a in provider(requests)]
    except Exception as err:  # the caller's code
        return [Answer(error=f"{type(err).__name__}: {err}")] * len(requests)
    if len(answers) != len(requests):
        return [Answer(error=f"{len(answers)} answers to {len(requests)} requests")] * len(requests)
    return [a if a.error is not None or a.text is not None else Answer(error="no answer") for a in answers]


def attempts(sent: DataFrame, providers: Sequence[tuple[str, Provider]], batch: int = BATCH) -> DataFrame:
    """The attempts (`request_id`, `attempt`, `model`, `ok`, `text`, `output_tokens`, `error`) for each row of `sent`.

    `sent` has `request_id`, `target_model` and `text`, as `audit.forwarded` gives them. The providers, named, are tried in
    order, each with what all before it have failed, at most `batch` requests in a call. Null texts are asked as
    empty ones. Requests stay in the tasks that read them; a task that is run again asks again, so write the
    log before it is used more than once.
    """
    if not providers:
        raise ValueError("at least one provider is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = (rows.column(c).to_pylist() for c in ("request_id", "target_model", "text"))
            requests = [Request(*r) for r in zip(*columns)]
            for at in range(0, len(requests), batch):
                open_, log = requests[at:at + batch], []
                for number, (model, provider) in enumerate(providers):
                    if not open_:
                        break
                    answers = _asked(provider, open_)
                    log += [(r.request_id, number, model, a.error is None, a.text if a.error is None else None,
                             a.output_tokens if a.error is None else None, a.error) for r, a in zip(open_, answers)]
                    open_ = [r for r, a in zip(open_, answers) if a.error is not None]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*log), kinds)], names=[c.split()[0] for c in ATTEMPTS.split(", ")])

    rows = sent.select(F.col("request_id").cast("long").alias("request_id"), F.col("target_model").cast("string").alias("target_model"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ATTEMPTS)


def response_log(log: DataFrame) -> DataFrame:
    """Attempts as the answers that `attach_responses` joins: `request_id`, `text`, `latency_ms`, `output_tokens`, `error`.

    A request that no provider has answered has the reasons of all, in order, as its error. Latencies are not measured.
    """
    done = first_success(log)
    reasons = F.array_join(F.transform("failures", lambda f: F.concat(f["model"], F.lit(": "), F.coalesce(f["reason"], F.lit("")))), "; ")
    return done.select("request_id", "text", F.lit(None).cast("double").alias("latency_ms"), "output_tokens", F.when(F.col("failed"), reasons).alias("error"))
