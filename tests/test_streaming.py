import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from turnout.plans.analytics import analyse
from turnout.streaming import analysis as A, jobs as J, release as R

T0 = datetime(2026, 1, 1, 12, 0, 0)


def folder(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(path)
    return J.file_stream(spark, path, df.schema)


def test_unanswered_requests_are_released_empty(spark, tmp_path):
    asks = [("r", c, T0) for c in ("a", "b", "late")] + [("end", "z", T0 + timedelta(hours=5))]
    says = [("r", "a", T0 + timedelta(minutes=3), "A1"), ("r", "a", T0 + timedelta(minutes=4), "A2"), ("r", "late", T0 + timedelta(minutes=11), "L"),
            ("end", "y", T0 + timedelta(hours=5), "Y")]
    q = folder(spark, tmp_path, "asks", asks, "run_id string, company_id string, asked_at timestamp")
    a = folder(spark, tmp_path, "says", says, "run_id string, company_id string, answered_at timestamp, payload string")
    got = {x.company_id: x.payload for x in J.newest_answer(J.settle(J.assembled_answers(q, a))).collect() if x.run_id == "r"}
    assert got == {"a": "A2", "b": None, "late": None}


def test_replayed_dispatch_adds_nothing(spark, tmp_path):
    rows = [("e", 1, "a@x", "sent", "m1", T0), ("e", 2, "a@x", "sent", "m1", T0), ("e", 3, "b@x", "failed", "m2", T0), ("e", 4, "c@x", "sent", "m3", T0)]
    s = folder(spark, tmp_path, "sends", rows, "event_slug string, row_idx long, email string, status string, message_id string, sent_at timestamp")
    log = str(tmp_path / "log")
    J.log_sends(s, log)
    J.log_sends(s, log)
    assert sorted(x.message_id for x in spark.read.parquet(log).collect()) == ["m1", "m3"]


def test_late_rows_miss_a_closed_day(spark, tmp_path):
    path = str(tmp_path / "late")
    schema = "event_slug string, ts timestamp"
    spark.createDataFrame([("e", T0), ("e", T0 + timedelta(days=5))], schema).coalesce(1).write.parquet(path)
    stream = J.file_stream(spark, path, spark.read.parquet(path).schema)
    out, n = str(tmp_path / "out"), {}
    done = J.settle(J.daily_timeline(stream), path=out)
    n = {x.day: x.n for x in done.collect()}
    assert n == {"2026-01-01": 1}
    spark.createDataFrame([("e", T0)], schema).coalesce(1).write.mode("append").parquet(path)
    assert {x.day: x.n for x in J.settle(J.daily_timeline(stream), path=out).collect()} == n


def test_upsert_folds_batches_into_a_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "BASE_EVERY", 2)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_slug string, k int"
    for n in range(5):
        spark.createDataFrame([("e", 1), ("e", n + 10)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = J.file_stream(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=1)
    got = J.upsert(stream.groupBy("event_slug", "k").count(), ["event_slug", "k"], path=out)
    assert {r["k"]: r["count"] for r in got.collect()} == {1: 5, **{n + 10: 1 for n in range(5)}}
    assert J.folders(spark, out, "base") == [3] and J.folders(spark, out, "batch") == [4]


def test_refresh_replaces_the_reports(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_slug string, k int"
    spark.createDataFrame([("e", 1)], schema).coalesce(1).write.parquet(path)
    stream = J.file_stream(spark, path, spark.read.parquet(path).schema)
    analyse = lambda rows: {"total": rows.groupBy("event_slug").sum("k").toDF("event_slug", "n")}
    J.refresh(stream, out, analyse, ["total"])
    assert [r["n"] for r in spark.read.parquet(f"{out}/total").collect()] == [1]
    spark.createDataFrame([("e", 5)], schema).coalesce(1).write.mode("append").parquet(path)
    J.refresh(stream, out, analyse, ["total"])
    assert [r["n"] for r in spark.read.parquet(f"{out}/total").collect()] == [6]


def test_runs_are_released_by_count_or_by_time(spark, tmp_path):
    """Doubled, early, late and missing answers, over several batches and a restart in between."""
    asks, says = str(tmp_path / "asks"), str(tmp_path / "says")
    ask_schema = "run_id string, company_id string, asked_at timestamp, n_asked int"
    say_schema = "run_id string, company_id string, answered_at timestamp, payload string"
    minute = lambda n: T0 + timedelta(minutes=n)

    def add(path, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    out, seen = str(tmp_path / "released"), []

    def turn():
        streams = [J.file_stream(spark, p, spark.read.schema(s).parquet(p).schema) for p, s in ((asks, ask_schema), (says, say_schema))]
        seen.append({x.run_id: (x.n_asked, x.answered, x.complete, x.released_at) for x in J.settle(R.released_runs(*streams), path=out).collect()})

    add(asks, [("full", "a", T0, 2), ("full", "b", T0, 2), ("half", "a", T0, 2), ("half", "b", T0, 2), ("none", "a", T0, 1)], ask_schema)
    add(says, [("full", "a", minute(1), "A1"), ("full", "a", minute(2), "A2"), ("half", "a", minute(3), "H"), ("early", "x", minute(4), "E"), ("half", "b", minute(11), "too late")], say_schema)
    turn()
    assert seen[-1] == {}  # no run has all answers, no time is up
    add(asks, [("early", "x", minute(4), 1)], ask_schema)
    add(says, [("full", "b", minute(5), "B")], say_schema)
    turn()
    # complete ones do not wait for their time, and an answer that came before its request counts
    assert seen[-1] == {"full": (2, 2, True, minute(5)), "early": (1, 1, True, minute(4))}
    add(asks, [("end", "z", minute(300), 1)], ask_schema)
    add(says, [("full", "a", minute(300), "again"), ("end", "other", minute(300), "")], say_schema)
    turn()
    assert seen[-1] == {"full": (2, 2, True, minute(5)), "early": (1, 1, True, minute(4)), "half": (2, 1, False, minute(10)), "none": (1, 0, False, minute(10))}
    released = spark.read.parquet(out)
    got = {(x.run_id, x.company_id): x.payload for x in R.answers_at_release(released, spark.read.parquet(asks), spark.read.parquet(says)).collect()}
    assert got == {("full", "a"): "A2", ("full", "b"): "B", ("half", "a"): "H", ("half", "b"): None, ("none", "a"): None, ("early", "x"): "E"}


def test_analysis_by_batches_equals_the_analysis_of_all_rows(spark, tmp_path, monkeypatch):
    """After every batch each report is what a run over all rows so far gives; a replayed batch and folded parts change nothing."""
    monkeypatch.setattr(A, "FOLD", 2)
    own = random.Random(7)
    people = spark.createDataFrame([(e, f"p{i}@acme{i % 3}.com", "P", str(i), f"Acme {i % 3}", "lead", "attended" if i % 2 else "no_show") for e in "ab" for i in range(8)],
                                   "event_slug string, email string, firstname string, lastname string, company string, lifecyclestage string, attendance_status string")
    event_rows, change_rows = "event_id long, event_slug string, email string, type string, ts timestamp, asset string, source string", "row_idx long, event_slug string, email string, raw_stage string, ts timestamp, source string"
    mails = spark.createDataFrame([("a", T0)], "event_slug string, ts timestamp")
    paths = [str(tmp_path / n) for n in ("events", "changes")]
    kept, seen, changed = A.Analysis(spark, str(tmp_path / "kept")), [], []
    for turn in range(4):
        at = lambda: T0 + timedelta(days=20 * turn + own.randrange(-3, 20), minutes=own.randrange(999))
        new = [(1000 * turn + n, own.choice("ab"), f"p{own.choice([0, 0, 0, 1, 2, 5])}@acme{own.randrange(3)}.com", own.choice(["open", "click", "form_fill", "odd"]), at(), "x", "s") for n in range(60)]
        moves = [(100 * turn + n, own.choice("ab"), f"p{own.randrange(4)}@acme{own.randrange(3)}.com", own.choice(["lead", "subscriber", "", "opportunity"]), at(), own.choice(["seeded", "crm_history"])) for n in range(12)]
        seen, changed = seen + new, changed + moves
        for path, rows, schema in ((paths[0], new, event_rows), (paths[1], moves, change_rows)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        kept.refresh(*[J.file_stream(spark, p, spark.createDataFrame([], s).schema, maxFilesPerTrigger=1) for p, s in zip(paths, (event_rows, change_rows))])
        if turn == 3:
            kept.add(spark.createDataFrame(new, event_rows), turn, A.OF_ENGAGEMENT)
        if turn in (0, 3):
            got = kept.reports(people, mails)
            want = analyse(people, spark.createDataFrame(seen, event_rows), spark.createDataFrame(changed, change_rows), mails)
            for name, df in want.items():
                assert sorted(map(str, got[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), (turn, name)
    assert [m["upto"] for m in kept.log("totals").parts() if "upto" in m] == [3] and len(kept.log("totals").parts()) == 1
    assert kept.log("recent").read().count() < len(changed)  # what no window can hold any more is gone


def test_sends_meet_closes_by_spans_of_time(spark, tmp_path):
    """Both ends of the 24 hours count, over the edge of a span too, and the event is not the only key."""
    at = lambda d, h, m=0: datetime(2026, 1, d, h, m)
    sends = [("e", n, "x", t) for n, t in enumerate([at(3, 5), at(3, 4, 59), at(4, 5), at(4, 5, 1), at(3, 23), at(4, 0), at(2, 23)])] + [("f", 9, "x", at(3, 6))]
    closes = [("e", at(3, 5))]
    paths = []
    for name, rows, schema in (("s", sends, "event_slug string, row_idx int, email string, sent_at timestamp"), ("c", closes, "event_slug string, closed_at timestamp")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        paths.append(J.file_stream(spark, str(tmp_path / name), spark.read.parquet(str(tmp_path / name)).schema))
    joined = J.sla(*paths)
    assert sorted(r.row_idx for r in J.settle(joined, path=str(tmp_path / "out")).collect()) == [0, 2, 4, 5]
    assert "_span" in joined._jdf.queryExecution().analyzed().toString()


def test_batches_of_the_analysis_are_many_files(spark, monkeypatch):
    from turnout.queries import streams as Q
    seen = []

    class Kept:
        def __init__(self, *a):
            pass

        def refresh(self, *streams):
            for s in streams:
                J.each_batch(s, lambda batch, n: seen.append((batch.select(F.input_file_name()).distinct().count(), batch.count())))

        def reports(self, *a):
            return None

    class V:
        def __init__(self):
            self.spark = spark

        def __call__(self, name):
            return spark.range(900).selectExpr("id", "id % 4 AS k")

    monkeypatch.setattr(Q, "Analysis", Kept)
    monkeypatch.setattr(Q, "attending", lambda v: None)
    Q.kept_up_to_date(V())
    assert len(seen) == 6 and sum(n for _, n in seen) == 1800
    assert all(n > 150 for _, n in seen)
    assert max(files for files, _ in seen) > 1
