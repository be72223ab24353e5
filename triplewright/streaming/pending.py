"""Prompts that wait for their answers: state by prompt_hash, with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "stage string, body string, due long, attempt int"
RESULT = "prompt_hash string, status string, attempt int, body string"


def events_of(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """prompt_hash, kind, body, at: one stream of prompts (prompt_hash, payload_json, at) and answers (prompt_hash, raw, at)."""
    asked = sent.select("prompt_hash", F.lit("sent").alias("kind"), F.col("payload_json").alias("body"), "at")
    return asked.union(answers.select("prompt_hash", F.lit("answer").alias("kind"), F.col("raw").alias("body"), "at"))


def followed(events: DataFrame, wait: int = 600, tries: int = 2, keep: int = 3600, delay: int = 60) -> DataFrame:
    """prompt_hash, status, attempt, body: what becomes of each prompt in a stream of events_of().

    ``at`` is the time of arrival; the watermark is ``delay`` seconds behind. Rows of status:

    - answered: the first answer to a prompt that waits, also if it came before the prompt did
    - ask: no answer within ``wait`` seconds; the prompt (body) is to be asked again, up to ``tries`` times in all
    - expired: no answer to the last try
    - late: the first answer to a prompt that had expired
    - unknown: an answer whose prompt did not come within ``keep`` seconds

    A second answer, a prompt sent again and a null answer (a failed call) change nothing. What is settled is forgotten
    after ``keep`` seconds. Rows without prompt_hash are left out. The state of one prompt is one row, so that no key is large.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, body, due, attempt = state.get if state.exists else (None, None, 0, 0)
        found: list[tuple[str, int, str | None]] = []
        if state.hasTimedOut:
            if stage == "waiting" and attempt < tries:
                attempt, due = attempt + 1, state.getCurrentWatermarkMs() + wait * 1000
                found.append(("ask", attempt, body))
            elif stage == "waiting":
                found.append(("expired", attempt, body))
                stage, body, due = "expired", None, state.getCurrentWatermarkMs() + keep * 1000
            else:
                if stage == "early":
                    found.append(("unknown", 0, body))
                stage = None
        else:
            rows = pd.concat(list(batches)).assign(last=lambda d: d["kind"] == "answer").sort_values(["at", "last", "body"], kind="stable")
            for kind, said, at in zip(rows["kind"], rows["body"], rows["at"], strict=True):
                now = int(at.timestamp() * 1000)
                if kind == "sent" and stage is None:
                    stage, body, due, attempt = "waiting", said, now + wait * 1000, 1
                elif kind == "sent" and stage == "early":
                    found.append(("answered", 1, body))
                    stage, body, due = "answered", None, now + keep * 1000
                elif kind == "answer" and said is not None and stage is None:
                    stage, body, due, attempt = "early", said, now + keep * 1000, 0
                elif kind == "answer" and said is not None and stage in ("waiting", "expired"):
                    found.append(("answered" if stage == "waiting" else "late", attempt, said))
                    stage, body, due = "answered", None, now + keep * 1000
        if stage is None:
            if state.exists:
                state.remove()
        else:
            state.update((stage, body, due, attempt))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *f) for f in found], columns=["prompt_hash", "status", "attempt", "body"])

    timed = events.where("prompt_hash is not null and at is not null").withWatermark("at", f"{delay} seconds")
    return timed.groupBy("prompt_hash").applyInPandasWithState(follow, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
