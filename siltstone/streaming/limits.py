"""Streaming forms of the session operators: rate limits, idle sessions, token streams, upserts."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import IDLE, limiter
from ..operators.store import BUCKETS, replace_documents

LIMITED = "session_id string, action string, event_id long, seconds double, accepted boolean, retry_after long"


def limit_stream(events: DataFrame, limit: int, window: float) -> DataFrame:
    """events: session_id, action, event_id, seconds. The limiter over a stream; its state is the accepted times still
    in the window, limit of them at most."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        # a key's events of one trigger come in batches, which are gone through in turn and not held together
        for batch in batches:
            rows = batch.sort_values(["seconds", "event_id"])
            said = list(limiter(rows["seconds"].tolist(), limit, window, held))
            yield rows.assign(accepted=[x[0] for x in said], retry_after=[x[1] for x in said])[[c.split()[0] for c in LIMITED.split(", ")]]
        state.update((list(held),))

    return events.groupBy("session_id", "action").applyInPandasWithState(run, LIMITED, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def idle_counts(events: DataFrame, ts: str, key: str, idle: int = IDLE, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream with their events, closed by the watermark. A gap just equal to the limit ends a session in
    batch, so the window is one microsecond shorter."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, f"{idle - 1} seconds 999999 microseconds")).agg(F.count("*").alias("events"))


def upsert_stream(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Applies each batch of chunks to a store saved at path; a batch that comes again gives the same store."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            replace_documents(path, batch, buckets)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def response_chunks(text: str, size: int = 16) -> list[str]:
    """Pieces of whole words: each ends at `size` characters, an empty line or a sentence's end."""
    if not text:
        return [""]
    out = [""]
    for part in re.findall(r"\S+\s*|\s+", text):
        out[-1] += part
        if len(out[-1]) >= size or "\n\n" in out[-1] or out[-1].rstrip().endswith((".", "!", "?", ":", ";")):
            out.append("")
    return out if out[-1] else out[:-1]


def held_back(text: str, endings: list[str]) -> int:
    """How many characters at the text's end may be the start of one of the endings."""
    return max((n for e in endings for n in range(1, min(len(e), len(text)) + 1) if e.startswith(text[-n:])), default=0)


def held_back_column(text: Column, endings: list[str]) -> Column:
    """held_back() of a column: what a stream must not send yet."""
    own = F.coalesce(text, F.lit(""))
    starts = [F.when(F.endswith(own, F.lit(e[:n])), n).otherwise(0) for e in endings for n in range(1, len(e) + 1)]
    return F.greatest(F.lit(0), *starts)


def echo_guard(pieces: Iterator[str], prompt: str, most: int = 220) -> Iterator[str]:
    """Holds a stream back while it repeats the prompt's start, up to `most` characters."""
    held, free = "", False
    squeeze = lambda x: " ".join(x.split()).lower()
    for piece in pieces:
        if free:
            yield piece
            continue
        held += piece
        if len(held) >= most or not squeeze(prompt).startswith(squeeze(held)):
            free = True
            yield held
    if not free and held and not squeeze(prompt).startswith(squeeze(held)):
        yield held
