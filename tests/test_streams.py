"""Streams replayed from files, a few rows per micro-batch, against their batch twins."""

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from callytics.operators import attendance, stages, transcripts
from callytics.streaming import streams


@pytest.fixture
def replay(spark, tmp_path):
    """Write rows as ordered files, stream them in small batches, read the sink."""

    def source(df, name, order, per_batch=4):
        path = str(tmp_path / name)
        for row in df.orderBy(*order).toJSON().collect():
            spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)
        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch)
        return reader.json(path)

    def run(stream):
        streams.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), True).awaitTermination()
        return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))

    return source, run


def test_clock(spark, replay):
    source, run = replay
    attempts = fx.clock_events(spark).drop("sheets_synced", "sheets_error")
    extra = attempts.filter("id % 3 = 0").withColumn("id", F.col("id") + 100)
    attempts = attempts.union(extra).orderBy("event_at", "id")
    got = run(streams.stream_clock(source(attempts, "in", ["event_at", "id"])))
    want = attendance.clock_validate(attempts).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_live_status(spark, replay, tmp_path):
    source, _ = replay
    attempts = fx.clock_events(spark).drop("sheets_synced", "sheets_error")
    judged = streams.stream_clock(source(attempts, "in", ["event_at", "id"], 9))
    state = str(tmp_path / "state")
    streams.write_stream(judged, str(tmp_path / "out"), state, available_now=True).awaitTermination()
    want = {(r.agent_id, r.clocked_in, r.last_action) for r in attendance.clock_status(attempts).collect()}
    assert {(r.agent_id, r.clocked_in, r.last_action) for r in streams.live_status(spark, state).collect()} == want


def test_stages_with_a_pause(spark, replay):
    source, run = replay
    turns = fx.call(spark, pause_at=6, pause_ms=3_601_000)
    starts = turns.groupBy(F.col("session_id").alias("id")).agg(F.timestamp_millis(F.min("ts")).alias("started_at"))
    got = run(streams.stream_stages(source(turns, "turns", ["ts"], 3), source(starts, "starts", ["id"])))
    want = stages.stage_progression_ttl(turns, starts)
    names = ["session_id", "seq", "previous_stage", "stage", "changed"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert stages.signals(got).count() == 4


def test_silence(spark, replay):
    source, run = replay
    beats = spark.createDataFrame(
        [("a", s) for s in (0, 30, 90, 151, 160)] + [("b", s) for s in range(0, 181, 60)] + [("z", 10_000)],
        "session_id string, s bigint",
    ).select("session_id", F.timestamp_seconds("s").alias("ts"))
    got = run(streams.stream_silence(source(beats, "beats", ["ts"], 2))).select(
        "session_id", "outcome", F.unix_seconds("at").alias("s")
    )
    assert sorted(map(tuple, got.collect())) == [
        ("a", "closed", 150), ("a", "rejected", 151), ("a", "rejected", 160), ("b", "closed", 240),
    ]


def test_recent_lines(spark, replay):
    source, run = replay
    turns = fx.call(spark, pause_at=5, pause_ms=170_000)
    got = run(streams.stream_recent(source(turns, "turns", ["ts"], 3), 180_000, 4))
    requests = turns.select(F.col("seq").alias("request_id"), "session_id", F.col("ts").alias("at"))
    want = transcripts.excerpts_at(requests, turns, 180_000, 4)
    assert {r.seq: r.excerpt for r in got.collect()} == {r.request_id: r.excerpt for r in want.collect()}


def _ends(spark, *ends):
    df = spark.createDataFrame(list(ends), "session_id string, ms bigint")
    return df.select("session_id", F.timestamp_millis("ms").alias("ended_at"))


def test_transcript_buffer(spark, replay):
    source, run = replay
    lost = fx.call(spark, pause_at=6, pause_ms=3_600_000, session="s2")
    last = lost.agg(F.max("ts")).collect()[0][0]
    # s1 ends between its turns 6 and 7; s2 goes quiet for an hour, then ends.
    ends = _ends(spark, ("s1", 1_767_312_000_000 + 75_000), ("s2", last + 1_000))
    turns = source(fx.call(spark).union(lost), "turns", ["ts"], 100)
    got = run(streams.stream_transcripts(turns, source(ends, "ends", ["ended_at"], 100)))
    assert {(r.session_id, r.seq): r.outcome for r in got.collect()} == {
        **{("s1", n): "stored" if n < 7 else "late" for n in range(10)},
        **{("s2", n): "expired" if n < 6 else "stored" for n in range(10)},
    }


def test_buffer_survives_a_restart(spark, replay, tmp_path):
    source, run = replay
    lost = fx.call(spark, pause_at=6, pause_ms=3_600_000, session="s2")
    last = lost.agg(F.max("ts")).collect()[0][0]
    turns = source(fx.call(spark).union(lost), "turns", ["ts", "session_id"], 5)
    first = source(_ends(spark, ("s3", last)), "ends", ["ended_at"])
    assert {r.outcome for r in run(streams.stream_transcripts(turns, first)).collect()} == {"expired"}
    ends = source(_ends(spark, ("s1", last + 1_000), ("s2", last + 1_000)), "ends", ["ended_at"])
    got = run(streams.stream_transcripts(turns, ends)).collect()
    # s1 ends just before its buffer would be lost; s2 lost its first turns to the pause.
    assert {(r.session_id, r.seq): r.outcome for r in got} == {
        **{("s1", n): "stored" for n in range(10)},
        **{("s2", n): "expired" if n < 6 else "stored" for n in range(10)},
    }


def test_late_rows_are_judged(spark, replay):
    """Rows that arrive an hour of event time late, one file per micro-batch: as many rows out as in."""
    source, run = replay
    turns = fx.call(spark)
    late = turns.filter("seq in (2, 5)").withColumn("order", F.lit(99))
    arriving = turns.filter("seq not in (2, 5)").withColumn("order", F.col("seq"))
    far = turns.filter("seq = 0").withColumns(
        {"session_id": F.lit("other"), "ts": F.col("ts") + 7_200_000, "order": F.lit(50)}
    )
    rows = arriving.unionByName(far).unionByName(late)
    stream = source(rows, "turns", ["order", "seq"], 1).drop("order")
    got = run(streams.stream_stages(stream))
    assert got.count() == turns.count() + 1


def test_late_lines(spark, replay):
    source, run = replay
    turns = fx.call(spark)
    late = turns.filter("seq = 3").withColumn("order", F.lit(99))
    far = turns.filter("seq = 0").withColumns({"session_id": F.lit("x"), "ts": F.col("ts") + 7_200_000, "order": F.lit(50)})
    rows = turns.filter("seq <> 3").withColumn("order", F.col("seq")).unionByName(far).unionByName(late)
    got = run(streams.stream_recent(source(rows, "turns", ["order"], 1).drop("order"))).collect()
    assert sorted((r.session_id, r.seq) for r in got) == sorted([("s1", n) for n in range(10)] + [("x", 0)])


def test_late_turns_of_an_ended_session(spark, replay):
    source, run = replay
    turns = fx.call(spark)
    last = turns.agg(F.max("ts")).first()[0]
    late = turns.filter("seq in (1, 4)").withColumn("order", F.lit(99))
    far = turns.filter("seq = 0").withColumns({"session_id": F.lit("x"), "ts": F.col("ts") + 90_000_000, "order": F.lit(50)})
    rows = turns.filter("seq not in (1, 4)").withColumn("order", F.col("seq")).unionByName(far).unionByName(late)
    ends = source(_ends(spark, ("s1", last + 1_000), ("x", last + 90_000_000)), "ends", ["ended_at"], 100)
    got = run(streams.stream_transcripts(source(rows, "turns", ["order"], 3).drop("order"), ends)).collect()
    outcome = {(r.session_id, r.seq): r.outcome for r in got}
    assert len(got) == len(outcome) == 11
    assert outcome["s1", 1] == outcome["s1", 4] == "late"


def test_late_frames_after_the_close(spark, replay):
    source, run = replay
    beats = spark.createDataFrame(
        [(0, "a", 0), (1, "a", 30), (2, "b", 500_000), (3, "b", 500_010), (4, "a", 20), (5, "a", 200_000)], "n int, session_id string, s bigint"
    ).select("n", "session_id", F.timestamp_seconds("s").alias("ts"))
    got = run(streams.stream_silence(source(beats, "beats", ["n"], 1).drop("n")))
    rows = [(r.session_id, r.outcome, r.at.timestamp()) for r in got.collect() if r.session_id == "a"]
    assert sorted(rows) == [("a", "closed", 90.0), ("a", "rejected", 20.0), ("a", "rejected", 200_000.0)]


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """The given tables, events and conversations as folders of four files in order of time."""
    import os
    import shutil

    given, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("tables"))
    for name in os.listdir(given):
        table = name.removesuffix(".parquet")
        if table not in ("events", "conversations"):
            shutil.copy(f"{given}/{name}", out)
            continue
        df = spark.read.parquet(f"{given}/{name}")
        order = "ts" if table == "events" else "conv_id"
        bounds = df.approxQuantile("event_id" if table == "events" else order, [0.25, 0.5, 0.75], 0)
        key = F.col("event_id" if table == "events" else order)
        low = None
        for high in [*bounds, None]:
            part = df if low is None else df.filter(key > low)
            part = part if high is None else part.filter(key <= high)
            part.orderBy(order).coalesce(1).write.mode("append").parquet(f"{out}/{name}")
            low = high
    return out


@pytest.mark.parametrize("name", ["stream_clock", "stream_stages", "stream_silence", "stream_recent", "stream_transcripts"])
def test_folder_tables_in_several_batches(spark, folder_tables, name, monkeypatch):
    from callytics.sources import bindings, raw
    from queries import QUERIES

    def one_file(spark, folder, table):
        return raw.stream_raw(spark, folder, table, max_files=1)

    monkeypatch.setattr(bindings, "stream_raw", one_file)
    monkeypatch.setitem(QUERIES[name].__wrapped__.__globals__ if hasattr(QUERIES[name], "__wrapped__") else QUERIES[name].__globals__, "stream_raw", one_file)
    got = sorted(map(tuple, QUERIES[name](spark, folder_tables).collect()), key=repr)
    monkeypatch.undo()
    want = sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == want and got
