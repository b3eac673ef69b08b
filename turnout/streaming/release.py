"""Runs of vendor requests that are released when all answers are in or their time is up.

Two levels of state.  The first keeps for each company of a run when it was asked and whether it has answered in time;
a run's companies are dealt out to slots, so a run with very many requests is spread over tasks.  It tells the second
level, which knows runs, only counts.  A run is released by the answer that completes it, or by an event-time timer;
both levels clear their state when the time is up.

Each group handed to Python and each call to the state store costs far more than a row.  Both levels are therefore grouped by
a stated number of parts, hashes of the run (and slot), and a part keeps its records in cells, entries of some
records each: what is open divided by ``PARTS * CELLS``.  A batch reads and writes the cells of its rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS = 8
PARTS, CELLS = 2048, 32
COUNTS = "run_id string, n_asked long, hits long, started long, last long, at timestamp"
ANSWERED = "run_id string, company_id string, asked_at long, answered_at long, payload string"
RELEASED = "run_id string, n_asked long, answered long, complete boolean, released_at timestamp"


def millis(at: pd.Series) -> list[int]:
    return (at.astype("datetime64[ms]").astype("int64")).tolist()


def micros(at: pd.Series) -> list[int]:
    return (at.astype("datetime64[us]").astype("int64")).tolist()


def moments(ms: list[int]) -> pd.Series:
    return pd.Series(ms, dtype="int64").astype("datetime64[ms]")


class Celled(StatefulProcessor):
    """Records by key in the cells of a part, each until its ``end``; one timer tells when the first of them ends."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.swept = handle, {}
        self.cells = handle.getMapState("cells", "cell int", "until long, rows string")

    def end(self, record: list) -> int:
        raise NotImplementedError

    def over(self, ended: list[tuple[tuple, list]]) -> Iterator[pd.DataFrame]:
        """What records that have ended still say."""
        yield from ()

    def held(self, cell: int) -> dict[tuple, list]:
        found = self.cells.getValue((cell,))
        return self.read(found[1]) if found else {}

    def read(self, rows: str) -> dict[tuple, list]:
        return {tuple(k): v for k, v in json.loads(rows)}

    def keep(self, cell: int, records: dict[tuple, list]) -> int | None:
        """Write a cell; the first end of its records."""
        if not records:
            self.cells.removeKey((cell,))
            return None
        until = min(map(self.end, records.values()))
        self.cells.updateValue((cell,), (until, json.dumps(list(records.items()))))
        return until

    def wake(self, ends: list[int | None]) -> None:
        ends = [e for e in ends if e is not None]
        if ends:
            self.handle.registerTimer(min(ends) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.swept.get(key) == now:
            return  # another timer of this part and batch
        self.swept[key] = now
        ends, ended = [], []
        for (cell,), (until, rows) in list(self.cells.iterator()):
            if until < now:
                records = self.read(rows)
                gone = [(k, v) for k, v in records.items() if self.end(v) < now]
                for k, _ in gone:
                    del records[k]
                ended += gone
                until = self.keep(cell, records)
            ends.append(until)
        self.wake(ends)
        yield from self.over(ended)

    def close(self) -> None:
        pass


class Companies(Celled):
    """What companies have been asked and answered: the time of the request, whether an answer has counted, early answers.

    An answer counts once a company: from its request on, up to ``wait`` later.  One that arrives before its request
    is kept with its time and judged when the request is there.
    """

    def end(self, record: list) -> int:
        asked, _, early = record
        return max([asked, *early]) + self.wait

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told: dict[int, dict[tuple, tuple[list[int], list[int]]]] = {}
        runs: dict[str, list] = {}  # expected, hits, started, last, latest
        for frame in rows:
            for cell, run, company, at, n, ask in zip(*[frame[c].tolist() for c in ("cell", "run_id", "company_id")], millis(frame["at"]),
                                                      frame["n_asked"].tolist(), frame["ask"].tolist()):
                asks, says = told.setdefault(cell, {}).setdefault((run, company), ([], []))
                (asks if ask else says).append(at)
                counts = runs.setdefault(run, [0, 0, -1, 0, at])
                counts[4] = max(counts[4], at)
                if ask:
                    counts[0] = max(counts[0], n)
        ends = []
        for cell, companies in told.items():
            records = self.held(cell)
            for (run, company), (asks, says) in companies.items():
                asked, hit, early = records.get((run, company)) or (-1, False, [])
                counts, says = runs[run], says + early
                if asks:
                    asked = min(asks) if asked < 0 else min(asked, *asks)
                    counts[2] = asked if counts[2] < 0 else min(counts[2], asked)
                fit = [at for at in says if asked <= at <= asked + self.wait] if asked >= 0 else []
                if fit and not hit:
                    counts[1], counts[3], hit = counts[1] + 1, max(counts[3], min(fit)), True
                records[run, company] = [asked, hit, [] if asked >= 0 else says]
            ends.append(self.keep(cell, records))
        self.wake(ends)
        said = [(run, *counts) for run, counts in runs.items() if counts[0] or counts[1]]
        if said:
            *columns, at = zip(*said)
            yield pd.DataFrame(dict(zip(("run_id", "n_asked", "hits", "started", "last"), columns))).assign(at=moments(at))


class Runs(Celled):
    """Counts of runs, until all companies have answered or the time is up: asked, answered, deadline, last answer, released."""

    def end(self, record: list) -> int:
        return record[2]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told: dict[int, list[tuple]] = {}
        for frame in rows:
            for cell, *counts in zip(*[frame[c].tolist() for c in ("cell", "run_id", "n_asked", "hits", "started", "last")]):
                told.setdefault(cell, []).append(counts)
        ends, complete = [], []
        for cell, said in told.items():
            records = self.held(cell)
            for run, n, hits, started, last in said:
                record = records.setdefault((run,), [0, 0, -1, 0, False])
                record[:4] = max(record[0], n), record[1] + hits, max(record[2], started + self.wait if started >= 0 else -1), max(record[3], last)
            for (run,) in dict.fromkeys((counts[0],) for counts in said):
                n, hits, _, last, released = record = records[run,]
                if not released and n and hits >= n:
                    record[4] = True
                    complete.append((run, n, hits, True, last))
            ends.append(self.keep(cell, records))
        self.wake(ends)
        yield from self.released(complete)

    def over(self, ended: list[tuple[tuple, list]]) -> Iterator[pd.DataFrame]:
        return self.released([(run, n, hits, False, deadline) for (run,), (n, hits, deadline, _, released) in ended if deadline >= 0 and not released])

    def released(self, runs: list[tuple]) -> Iterator[pd.DataFrame]:
        if runs:
            *columns, at = zip(*runs)
            yield pd.DataFrame(dict(zip(("run_id", "n_asked", "answered", "complete"), columns))).assign(released_at=moments(at))


class Answers(Celled):
    """Requests of companies and their answers, in microseconds, until they can meet nothing that is not late.

    A request meets each answer from its time on, up to ``wait`` later, whichever of the two comes first.  One that has met none
    is told alone once its time is up.
    """

    def end(self, record: list) -> int:
        asks, says = record
        return min([at + self.wait for at, _ in asks] + [at for at, _ in says]) // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told: dict[int, dict[tuple, tuple[list, list]]] = {}
        for frame in rows:
            for cell, run, company, at, payload, ask in zip(*[frame[c].tolist() for c in ("cell", "run_id", "company_id")], micros(frame["at"]),
                                                            frame["payload"].tolist(), frame["ask"].tolist()):
                asks, says = told.setdefault(cell, {}).setdefault((run, company), ([], []))
                if ask:
                    asks.append([at, False])
                else:
                    says.append([at, payload])
        ends, met = [], []
        for cell, companies in told.items():
            records = self.held(cell)
            for who, (asks, says) in companies.items():
                old_asks, old_says = records.get(who) or ([], [])
                for some, others in ((asks, says + old_says), (old_asks, says)):
                    for one in some:
                        fit = [(at, payload) for at, payload in others if one[0] <= at <= one[0] + self.wait]
                        one[1] = one[1] or bool(fit)
                        met += [(*who, one[0], at, payload) for at, payload in fit]
                records[who] = [old_asks + asks, old_says + says]
            ends.append(self.keep(cell, records))
        self.wake(ends)
        yield from self.told(met)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.swept.get(key) == now:
            return  # another timer of this part and batch
        self.swept[key] = now
        ends, alone = [], []
        for (cell,), (until, rows) in list(self.cells.iterator()):
            if until < now:
                records = {}
                for who, (asks, says) in self.read(rows).items():
                    alone += [(*who, at, None, None) for at, met in asks if at + self.wait < now * 1000 and not met]
                    asks, says = [x for x in asks if x[0] + self.wait >= now * 1000], [x for x in says if x[0] >= now * 1000]
                    if asks or says:
                        records[who] = [asks, says]
                until = self.keep(cell, records)
            ends.append(until)
        self.wake(ends)
        yield from self.told(alone)

    def told(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            runs, companies, asked, answered, payloads = zip(*rows)
            yield pd.DataFrame({"run_id": runs, "company_id": companies, "asked_at": pd.Series(asked, dtype="int64"),
                                "answered_at": pd.Series(answered, dtype="Int64"), "payload": pd.Series(payloads, dtype="object")})


def placed(*by: str | Column) -> list[Column]:
    """The part and the cell of a record."""
    spot = F.pmod(F.xxhash64(*by), F.lit(PARTS * CELLS))
    return [F.floor(spot / CELLS).cast("int").alias("part"), F.pmod(spot, F.lit(CELLS)).cast("int").alias("cell")]


def assembled(requests: DataFrame, answers: DataFrame, wait_minutes: int) -> DataFrame:
    """Requests with each of their answers in time, or alone: run_id, company_id, asked_at, answered_at, payload (see ``Answers``)."""
    kinds = dict(requests.dtypes) | {"payload": dict(answers.dtypes)["payload"]}
    delay = f"{wait_minutes} minutes"
    ids = [F.col(c).cast("string").alias(c) for c in ("run_id", "company_id")]
    asks = requests.withWatermark("asked_at", delay).filter("asked_at IS NOT NULL").select(
        *ids, F.col("asked_at").alias("at"), F.lit(None).cast("string").alias("payload"), F.lit(True).alias("ask"))
    says = answers.withWatermark("answered_at", delay).filter("answered_at IS NOT NULL AND run_id IS NOT NULL AND company_id IS NOT NULL").select(
        *ids, F.col("answered_at").alias("at"), F.col("payload").cast("string").alias("payload"), F.lit(False).alias("ask"))
    events = asks.unionByName(says).select("*", *placed("run_id", "company_id"))
    met = events.groupBy("part").transformWithStateInPandas(Answers(wait_minutes * 60_000_000), ANSWERED, "Append", "EventTime")
    return met.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("run_id", "company_id")],
                      *[F.timestamp_micros(c).alias(c) for c in ("asked_at", "answered_at")], F.col("payload").cast(kinds["payload"]).alias("payload"))


def released_runs(requests: DataFrame, answers: DataFrame, wait_minutes: int = 10) -> DataFrame:
    """A row for each run at its release: how many were asked and have answered, whether that is all, and when.

    ``requests``: run_id, company_id, asked_at, n_asked (the run's number of companies); ``answers``: run_id,
    company_id, answered_at.  A run waits for ``wait_minutes`` from its last request on, and not
    at all once all its companies have answered.
    """
    wait = wait_minutes * 60_000
    asks = requests.withWatermark("asked_at", f"{wait_minutes} minutes").select(
        F.col("run_id").cast("string").alias("run_id"), F.col("company_id").cast("string").alias("company_id"), F.col("asked_at").alias("at"),
        F.col("n_asked").cast("long").alias("n_asked"), F.lit(True).alias("ask"))
    says = answers.withWatermark("answered_at", f"{wait_minutes} minutes").select(
        F.col("run_id").cast("string").alias("run_id"), F.col("company_id").cast("string").alias("company_id"), F.col("answered_at").alias("at"),
        F.lit(0).cast("long").alias("n_asked"), F.lit(False).alias("ask"))
    slot = F.pmod(F.xxhash64("company_id"), F.lit(SLOTS))
    events = asks.unionByName(says).select("*", *placed("run_id", slot))
    counts = events.groupBy("part").transformWithStateInPandas(Companies(wait), COUNTS, "Append", "EventTime", eventTimeColumnName="at")
    return counts.select("*", *placed("run_id")).groupBy("part").transformWithStateInPandas(Runs(wait), RELEASED, "Append", "EventTime")


def answers_at_release(released: DataFrame, requests: DataFrame, answers: DataFrame, wait_minutes: int = 10) -> DataFrame:
    """What released runs take along: every company that was asked, with its newest answer in time, or with none (batch side)."""
    asked = requests.select(F.col("run_id").cast("string").alias("run_id"), F.col("company_id").cast("string").alias("company_id"), "asked_at")
    asked = asked.groupBy("run_id", "company_id").agg(F.min("asked_at").alias("asked_at")).join(released.select("run_id", "released_at"), "run_id")
    said = answers.select(F.col("run_id").cast("string").alias("run_id"), F.col("company_id").cast("string").alias("company_id"), "answered_at", "payload")
    timely = said.join(asked, ["run_id", "company_id"]).filter(
        (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("released_at"))
        & (F.col("answered_at") <= F.col("asked_at") + F.make_dt_interval(mins=F.lit(wait_minutes))))
    newest = timely.groupBy("run_id", "company_id").agg(F.max_by("payload", F.struct("answered_at", "payload")).alias("payload"))
    return asked.join(newest, ["run_id", "company_id"], "left").select("run_id", "company_id", "payload", "released_at")
