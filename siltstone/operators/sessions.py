"""Session state: bounded history, keyed facts, time to live, rate limits, caches, state that carries forward.

Each function works by session; what needs earlier decisions is a fold over one session's ordered events.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Budgets of history and facts, and times to live.
HISTORY, HISTORY_CHARS, ROUTE_CHARS, KEPT, ANSWER_CHARS = 8, 12_000, 600, 20, 20_000
FACTS, FACT_CHARS, GRACE, IDLE, CACHED = 12, 1_200, 300, 1_800, 4


def selected_history(messages: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The last 8 messages, newest first while they fit in 12,000 characters; the newest always stays."""
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    rows = messages.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= HISTORY)
    running = F.sum(F.length(text)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__sum", running).where((F.col("__sum") <= HISTORY_CHARS) | (F.col("__rn") == 1)).drop("__sum", "__rn")


def speaker(role: Column) -> Column:
    return F.when(role == "user", F.lit("User")).otherwise(F.lit("Assistant"))


def format_history(messages: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    rows = selected_history(messages, session, order, text)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(speaker(F.col("role")), F.lit(": "), F.col(text)).alias("l")))), lambda x: x["l"])
    return rows.groupBy(session).agg(F.array_join(lines, "\n").alias("history"))


def middle_cut(text: Column, limit: int = ROUTE_CHARS) -> Column:
    """Both ends of a text that is too long."""
    half = (limit - 5) // 2
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def route_history(messages: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The last two messages, each cut in its middle."""
    rows = messages.withColumn("__rn", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where("__rn <= 2")
    cut = middle_cut(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(speaker(F.col("role")), F.lit(": "), cut).alias("l")))), lambda x: x["l"])
    return rows.groupBy(session).agg(F.array_join(lines, "\n").alias("history"))


def last_messages(messages: DataFrame, n: int = KEPT, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The last n messages of each session, answers cut to what is stored."""
    rows = messages.withColumn("__rn", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("__rn") <= n).drop("__rn")
    return rows.withColumn(text, F.when(F.col("role") == "assistant", F.substring(text, 1, ANSWER_CHARS)).otherwise(F.col(text)))


def merge_facts(facts: DataFrame, session: str, key: str, value: str, order: list[str], limit: int = FACTS) -> DataFrame:
    """The last value of each key; of each session the keys updated last."""
    place = F.struct(*order)
    last = facts.groupBy(session, key).agg(F.max_by(value, place).alias(value), F.max(place).alias("updated"))
    return last.withColumn("__rn", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("updated"), key))).where(F.col("__rn") <= limit).drop("__rn")


def fact_lines(merged: DataFrame, session: str, key: str, value: str, budget: int = FACT_CHARS) -> DataFrame:
    """Newest facts first while their lines fit; the newest always stays; joined oldest first."""
    newest = Window.partitionBy(session).orderBy(F.desc("updated"), key)
    rows = merged.withColumns({"line": F.concat(F.lit("- "), F.col(key), F.lit(": "), F.col(value).cast("string"))}).withColumns({"__rn": F.row_number().over(newest), "__sum": F.sum(F.length("line") + 1).over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    kept = rows.where((F.col("__sum") <= budget) | (F.col("__rn") == 1))
    return kept.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__rn")).alias("o"), "line"))), lambda x: x["line"]), "\n").alias("profile"))


def idle_sessions(events: DataFrame, user: str, ts: str, order: str, idle: int = IDLE) -> DataFrame:
    """Splits a user's events where the gap reaches the limit (session_window would join a gap equal to it)."""
    w = Window.partitionBy(user).orderBy(ts, order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(w)
    return events.withColumn("session_no", F.sum(F.when(gap >= idle, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def expired(sessions: DataFrame, now: Column, grace: int = GRACE, idle: int = IDLE) -> DataFrame:
    """sessions: last_access, scheduled_at, active. Expired once the grace after scheduling or the idle time is over;
    sessions in use wait for their end."""
    over = F.coalesce(now >= F.col("scheduled_at") + grace, F.lit(False)) | (now - F.col("last_access") >= idle)
    return sessions.withColumns({"expired": over & (F.col("active") == 0), "delete_pending": over & (F.col("active") > 0)})


def operations_open(events: DataFrame, session: str, order: list[str], begins: Column) -> DataFrame:
    """Running count of begun and not ended operations; a delete may run where it is 0."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("open", F.sum(F.when(begins, 1).otherwise(-1)).over(w))


def rate_window_count(events: DataFrame, keys: list[str], seconds: Column, window: int) -> DataFrame:
    """Events of the same key in the window up to each, all counted: not the limiter, which forgets rejected ones."""
    w = Window.partitionBy(*keys).orderBy("__s").rangeBetween(-(window - 1), 0)
    return events.withColumn("__s", F.floor(seconds).cast("long")).withColumn("in_window", F.count("*").over(w)).drop("__s")


def limiter(times: Iterator[float], limit: int, window: float, held: deque | None = None) -> Iterator[tuple[bool, int]]:
    """Accepted or not, and the seconds to wait, for each time in order. held: accepted times so far, kept up."""
    held = deque() if held is None else held
    for now in times:
        while held and held[0] <= now - window:
            held.popleft()
        if len(held) >= limit:
            yield False, max(1, int(window - (now - held[0])) + 1)
        else:
            held.append(now)
            yield True, 0


def rate_limit_log(events: DataFrame, keys: list[str], seconds: str, order: str, limit: int, window: float) -> DataFrame:
    """events: keys, seconds (double), order. Adds accepted and retry_after. Each decision depends on those before it, so
    a key's events are read in order, streaming through Arrow batches; no key is gathered."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for batch in batches:
            accepted, waits = [], []
            for key, t in zip(batch[keys].itertuples(index=False, name=None), batch[seconds], strict=True):
                if key != now:
                    now, held = key, deque()
                ok, wait = next(limiter(iter([t]), limit, window, held))
                accepted.append(ok), waits.append(wait)
            yield batch.assign(accepted=accepted, retry_after=waits)

    ordered = events.repartition(*keys).sortWithinPartitions(*keys, seconds, order)
    return ordered.mapInPandas(run, f"{fields}, accepted boolean, retry_after long")


def prune(events: DataFrame, seconds: Column, now: float, most: float) -> DataFrame:
    return events.where(seconds > now - most)


def bucket_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


def carry_forward(turns: DataFrame, session: str, order: str, columns: list[str]) -> DataFrame:
    """State columns keep their last value where a turn sets none."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def least_recent(accesses: list[str], capacity: int = CACHED, protected: frozenset[str] = frozenset()) -> tuple[list[str], list[str]]:
    """Fold of a cache: what is in it at the end, oldest first, and what was evicted, in order."""
    held: OrderedDict[str, None] = OrderedDict()
    gone = []
    for key in accesses:
        held[key] = None
        held.move_to_end(key)
        while len(held) > capacity and (victim := next((k for k in held if k not in protected and k != key), None)) is not None:
            del held[victim]
            gone.append(victim)
    return list(held), gone


def cache_log(accesses: DataFrame, cache: str, order: list[str], item: str, capacity: int = CACHED) -> DataFrame:
    """accesses: cache, order, item. Adds hit and evicted (the item that goes, or null) of a cache that keeps the
    `capacity` items used last. A cache's accesses are read in order, streaming; what is held is the cache itself."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in accesses.schema)
    kind = accesses.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, OrderedDict()
        for batch in batches:
            hits, gone = [], []
            for key, x in zip(batch[cache], batch[item], strict=True):
                if key != now:
                    now, held = key, OrderedDict()
                hits.append(x in held)
                held[x] = None
                held.move_to_end(x)
                gone.append(held.popitem(last=False)[0] if len(held) > capacity else None)
            yield batch.assign(hit=hits, evicted=pd.Series(gone, index=batch.index, dtype=object))

    ordered = accesses.repartition(cache).sortWithinPartitions(cache, *order)
    return ordered.mapInPandas(run, f"{fields}, hit boolean, evicted {kind}")
