"""Admissions, budgets and caches over event tables, as batch plans and as streams that give the same rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PER_MINUTE, ALL_PER_MINUTE = 6, 60
TTL_HOURS, CACHE_ROWS = 24, 100
TERMINAL = ("done", "error")
REQUEST_TOKENS, DAY_TOKENS, EACH_DAY_TOKENS = 2_000_000, 200_000_000, 16_000_000
RUNNING, WAITING, WAIT_SECONDS, RUN_SECONDS, MOST_IDENTITIES = 1, 8, 15, 90, 2_000


def admissions(events: DataFrame, each: int = PER_MINUTE, everyone: int = ALL_PER_MINUTE) -> DataFrame:
    """Requests with a decision (R2, R3): refused beyond so many a minute of one identity, or so many admitted of all.

    Columns: id, ts, identity. Minutes are aligned in UTC. A minute is a partition: what is counted never crosses one.
    """
    minute = F.date_trunc("minute", "ts")
    own = Window.partitionBy("minute", "identity").orderBy("ts", "id")
    rows = events.withColumn("minute", minute).withColumn("n", F.row_number().over(own)).withColumn("fits", (F.col("n") <= each).cast("int"))
    total = F.sum("fits").over(Window.partitionBy("minute").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("total", total).select("id", "minute", "identity", F.when(F.col("fits") == 0, "identity").when(F.col("total") > everyone, "global").otherwise("admitted").alias("decision"))


LADDER = "id long, decision string, retry_after int"


def ladder(events: DataFrame, each: int = PER_MINUTE, everyone: int = ALL_PER_MINUTE) -> DataFrame:
    """Every request with its decision and when to ask again (R3, R4). Columns: id, ts, identity, key, cached, seconds (that it runs).

    Rungs in order: too many identities, the minute of an identity or of all, a cached answer, the same question running, the day's
    tokens, a full queue, an own question running; else it runs, or waits until a place is free or its wait is over. The state of one
    service is one sequence, so a day is a task; leases don't pass midnight.
    """

    def day(pdf):
        import pandas as pd

        out, names, tokens, all_tokens, minute, counts, total = [], set(), {}, 0, None, {}, 0
        leases: list[dict] = []  # in order of arrival

        def settle(now: float) -> None:
            while True:
                leases[:] = [x for x in leases if x["until"] > now]
                free = RUNNING - sum(x["runs"] for x in leases)
                waiting = [x for x in leases if not x["runs"]]
                if free <= 0 or not waiting:
                    return
                waiting[0]["runs"], waiting[0]["until"] = True, now + min(RUN_SECONDS, waiting[0]["seconds"])

        for r in pdf.sort_values(["ts", "id"]).itertuples(index=False):
            now = r.ts.timestamp()
            settle(now)
            if int(now // 60) != minute:
                minute, counts, total = int(now // 60), {}, 0
            say = None
            if r.identity not in names and len(names) >= MOST_IDENTITIES:
                say = ("busy", 60)
            else:
                names.add(r.identity)
                if counts.get(r.identity, 0) >= each or total >= everyone:
                    say = ("minute", 60)
                else:
                    counts[r.identity], total = counts.get(r.identity, 0) + 1, total + 1
            if say is None and r.cached:
                say = ("cached", 0)
            if say is None and any(x["key"] == r.key for x in leases):
                say = ("same", 3)
            if say is None and (all_tokens + REQUEST_TOKENS > DAY_TOKENS or tokens.get(r.identity, 0) + REQUEST_TOKENS > EACH_DAY_TOKENS):
                say = ("budget", math.ceil(86_400 - now % 86_400))
            if say is None and len(leases) >= RUNNING + WAITING:
                say = ("full", 15)
            if say is None and any(x["identity"] == r.identity for x in leases):
                say = ("own", 3)
            if say is None:
                runs = sum(x["runs"] for x in leases) < RUNNING
                all_tokens, tokens[r.identity] = all_tokens + REQUEST_TOKENS, tokens.get(r.identity, 0) + REQUEST_TOKENS
                leases.append({"key": r.key, "identity": r.identity, "runs": runs, "seconds": r.seconds, "until": now + (min(RUN_SECONDS, r.seconds) if runs else WAIT_SECONDS)})
                say = ("active" if runs else "queued", 0)
            out.append((r.id, *say))
        return pd.DataFrame(out, columns=["id", "decision", "retry_after"])

    return events.select("id", "ts", "identity", "key", "cached", "seconds", F.to_date("ts").alias("day")).groupBy("day").applyInPandas(day, LADDER)


#: Kinds of events of a run's trace, in the order in which they can first come (R1). Fixed values.
TRACE = ("start", "terms", "pool", "shortlist", "candidates", "verify", "walk_step", "backtrack", "finish", "escalate", "map", "explain_seed", "explain_hop", "explain_evidence", "explain_edges", "warning", "done", "error")


def trace_faults(trace: DataFrame) -> DataFrame:
    """fault and how many runs have it: an append-only trace begins with a start, numbers its events without a gap, knows their kinds and
    has nothing after its end. Columns: run, seq, type."""
    runs = trace.groupBy("run").agg(
        F.min_by("type", "seq").alias("first"), (F.max("seq") - F.min("seq") + 1 != F.count("*")).alias("gap"), F.bool_or(~F.col("type").isin(*TRACE)).alias("unknown"),
        F.max(F.when(F.col("type").isin(*TERMINAL), F.col("seq"))).alias("end"), F.min(F.when(F.col("type").isin(*TERMINAL), F.col("seq"))).alias("first_end"), F.max("seq").alias("last"),
    )
    counts = runs.agg(F.count_if(F.col("first") != "start").alias("no start"), F.count_if("gap").alias("gap"), F.count_if("unknown").alias("unknown kind"), F.count_if(F.col("first_end") < F.col("last")).alias("after the end"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(f"`{c}`").alias("n")) for c in counts.columns])).alias("x")).select("x.fault", "x.n")


def answer_identity(*parts: Column) -> Column:
    """Key of a kept answer (V4): a new engine, revision, scope, mode or option is another answer."""
    return F.sha2(F.to_json(F.struct(F.lit(2).alias("version"), *parts)), 256)


def only_params(params: list[tuple[str, str]], allowed: tuple[str, ...]) -> dict[str, str]:
    """Parameters that are allowed and given once; others are an error (V2)."""
    names = [k for k, _ in params]
    for name in names:
        if name not in allowed or names.count(name) > 1:
            raise ValueError(f"unknown or repeated parameter: {name}")
    return dict(params)


def minute_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("minute", "ts").alias("minute"), "identity").agg(F.count("*").alias("n"))


def daily_budget(events: DataFrame, limit: float) -> DataFrame:
    """Spending that still fits a day's budget of each identity, in order of time (R6). Columns: id, ts, identity, amount."""
    day = F.to_date("ts")
    so_far = F.round(F.sum("amount").over(Window.partitionBy("identity", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)), 4)
    return events.withColumn("day", day).withColumn("spent", so_far).select("id", "identity", "day", "spent", (F.col("spent") <= limit).alias("within"))


def live_cache(answers: DataFrame, now: str, hours: int = TTL_HOURS, most: int = CACHE_ROWS) -> DataFrame:
    """The newest answer of each key that hasn't expired, the newest of these (R5). Columns: key, ts, id."""
    alive = answers.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")).where(F.col("ts") <= F.lit(now).cast("timestamp_ntz"))
    last = alive.groupBy("key").agg(F.max(F.struct("ts", "id")).alias("k")).select("key", "k.ts", "k.id")
    return last.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def final_state(trace: DataFrame) -> DataFrame:
    """The last event of each run (R7, R8). Columns: run, seq, type."""
    return trace.groupBy("run").agg(F.max_by("type", "seq").alias("last"), F.count("*").alias("events"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """An addition: sessions of an identity, closed after a gap."""
    return events.groupBy("identity", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("identity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_minutes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``minute_counts`` of a stream: a minute is given once no row of it can come any more. ``ts`` becomes a timestamp first, as
    watermarks need one."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 minute").alias("w"), "identity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "identity", "n")


def stream_admissions(events: DataFrame, each: int = PER_MINUTE) -> DataFrame:
    """Requests of a stream with the decision of their identity's minute, as they come; state goes when a minute is over."""

    def decide(key: tuple, pdfs: Iterator, state) -> Iterator:
        import pandas as pd

        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in pdfs:
            pdf = pdf.sort_values(["ts", "id"])
            out = pd.DataFrame({"id": pdf["id"], "identity": key[0], "admitted": [n + i < each for i in range(len(pdf))]})
            n += len(pdf)
            yield out
        state.update((n,))
        state.setTimeoutTimestamp(int(key[1].timestamp() * 1000) + 60_000 if state.getCurrentWatermarkMs() < int(key[1].timestamp() * 1000) + 60_000 else state.getCurrentWatermarkMs() + 1)

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").withColumn("minute", F.date_trunc("minute", "ts"))
    return rows.groupBy("identity", "minute").applyInPandasWithState(decide, "id long, identity string, admitted boolean", "n long", "append", "EventTimeTimeout")
