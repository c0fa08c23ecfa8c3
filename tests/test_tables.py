import pytest
from pyspark.sql import functions as F

import fixtures as fx
from callytics.operators import transcripts
from callytics.plans.keyed import latest_per_key, upsert, with_new_ids
from callytics.plans.lineage import cut
from callytics.plans.slices import SLICE, Spread, hot_keys, parted, sliced, with_neighbours
from callytics.sources.tables import append, conform, load, write_version

def test_append_fills_defaults_and_conforms(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "¿?"), (2, "s", "¡!")], "id int, session_id string, question string")
    append(rows, str(tmp_path), "questions", {"answer": "", "asked_at": F.timestamp_seconds(F.lit(1_770_000_000))})
    append(rows.filter("id = 2").withColumn("answer", F.lit("yes")), str(tmp_path), "questions", {"answer": ""})
    back = load(spark, str(tmp_path), "questions")
    assert back.columns == ["id", "session_id", "question", "answer", "asked_at"]
    assert sorted(r.answer for r in back.collect()) == ["", "", "yes"]


def test_partitioned_append(spark, tmp_path):
    append(fx.sales(spark), str(tmp_path), "sales", partition_by=("currency",))
    back = load(spark, str(tmp_path), "sales")
    assert set(back.columns) == set(fx.sales(spark).columns)
    assert back.count() == 30 and back.filter("currency = 'USD'").count() == 30


def test_versions_stand_side_by_side(spark, tmp_path):
    sales = fx.sales(spark)
    first = write_version(sales, str(tmp_path), "sales", 1)
    second = write_version(spark.read.parquet(first).filter("id > 10"), str(tmp_path), "sales", 2)
    assert spark.read.parquet(first).count() == 30 and spark.read.parquet(second).count() == 20


def test_transcripts_are_stored_once(spark, tmp_path):
    turns = fx.call(spark).union(fx.call(spark, pause_at=5, pause_ms=86_400_000, session="s2"))
    sessions = spark.createDataFrame([("s1", "ended"), ("s2", "ended"), ("s3", "active")], "id string, status string")
    flushed = transcripts.transcript_flush(turns, sessions)
    path, counts = str(tmp_path / "t"), []
    for part in (flushed.filter("seq < 3"), flushed.filter("seq < 3"), flushed, flushed):
        transcripts.write_transcripts(part, path)
        counts.append(spark.read.parquet(path).count())
    assert counts == [6, 6, 20, 20]
    assert spark.read.parquet(path).select("day").distinct().count() == 2


def test_recent_turns(spark):
    turns = fx.call(spark)
    last = turns.agg(F.timestamp_millis(F.max("ts")).alias("as_of")).withColumn("session_id", F.lit("s1"))
    assert transcripts.recent_turns(turns, last, 30_000).count() == 4
    assert transcripts.recent_turns(turns, "2026-01-02T00:01:40Z", 30_000).count() == 4


def test_upsert_keeps_what_is_not_set(spark):
    names = "agent_id string, username string, avatar string, created_at timestamp, updated_at timestamp"
    at = [F.timestamp_seconds(F.lit(s)) for s in (10, 20, 30)]
    stored = conform(spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "agent_id string, username string, avatar string"), "users")
    stored = stored.withColumns({"created_at": at[0], "updated_at": at[0]})
    changes = spark.createDataFrame([("b", "B2", None, 20), ("b", "B3", None, 30), ("c", "C", "z", 20)], "agent_id string, username string, avatar string, s bigint")
    changes = changes.select("agent_id", "username", "avatar", F.timestamp_seconds("s").alias("created_at"), F.timestamp_seconds("s").alias("updated_at"))
    got = upsert(stored, changes, ["agent_id"], ["username", "avatar", "updated_at"], "updated_at")
    rows = {
        r.agent_id: (r.username, r.avatar, r.c, r.u)
        for r in got.select("*", F.unix_seconds("created_at").alias("c"), F.unix_seconds("updated_at").alias("u")).collect()
    }
    assert rows == {"a": ("A", "x", 10, 10), "b": ("B3", None, 10, 30), "c": ("C", "z", 20, 20)}
    assert got.schema.names == [part.split()[0] for part in names.split(", ")]


def test_latest_per_key_takes_maps_too(spark):
    df = spark.range(10).select(
        (F.col("id") % 2).alias("k"), F.col("id").alias("n"), F.create_map(F.lit("v"), "id").alias("m")
    )
    assert sorted((r.k, r.n, r.m["v"]) for r in latest_per_key(df, ["k"], ["n"]).collect()) == [(0, 8, 8), (1, 9, 9)]


def test_new_ids_are_distinct_and_above(spark):
    df = spark.range(3_000).select(
        F.when(F.col("id") < 100, F.col("id")).alias("id"), F.concat(F.lit("c"), "id").alias("code")
    )
    got = [r.id for r in with_new_ids(df, ["code"], F.lit(99)).collect()]
    assert len(set(got)) == 3_000 and sorted(got)[:100] == list(range(100)) and min(x for x in got if x > 99) > 99


def test_neighbours_of_any_key_in_both_directions(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.timestamp_seconds(F.col("id") * F.col("id")).alias("at"),
        "id",
    )
    hot = hot_keys(df, ["k"], 100)
    assert [r.k for r in hot.keys.collect()] == ["hot"] and (hot.count, hot.rows) == (1, 167)
    found = [
        sorted(
            with_neighbours(df, ["k"], ["at", "id"], spread, {"p": "id"}, {"n": "id"})
            .select("id", "p", "n")
            .collect(),
            key=lambda r: r.id,
        )
        for spread in (Spread(0, 60), Spread(100, 20), Spread(10_000))
    ]
    assert found[0] == found[1] == found[2]
    rows = {r.id: r for r in found[0]}
    assert (rows[300].p, rows[300].n) == (297, 303) and rows[0].p is None and rows[498].n is None


def test_a_hot_key_is_cut_by_position_also_at_one_instant(spark):
    df = spark.range(1_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(5)).alias("at"), "id")
    rows = sliced(df, ["k"], ["at", "id"], Spread(10, 100))
    sizes = rows.groupBy(SLICE).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy(SLICE).collect()
    assert len(sizes) == 10 and max(r.n for r in sizes) < 250
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
    found = with_neighbours(df, ["k"], ["at", "id"], Spread(10, 100), {"p": "id"}).collect()
    assert {r.id: r.p for r in found} == {n: n - 1 if n else None for n in range(1_000)}


def test_short_slices_need_few_tasks_and_keep_ties_together(spark):
    df = spark.range(3_000).select(F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.floor(F.col("id") / 21).alias("at"), "id")
    _, placed = parted(df, ["k"], ["at"], Spread(10, 4))
    assert len(placed.inputFiles()) == 1
    counted = placed.groupBy("k", "at").agg(F.countDistinct(SLICE).alias("slices"))
    assert counted.filter("slices > 1").isEmpty() and placed.select(SLICE).distinct().count() > 300
    assert placed.count() == 3_000 and placed.columns == [*df.columns, SLICE]


def test_windows_of_normal_keys_share_one_exchange(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    once = with_neighbours(df, ["k"], ["id"], Spread(), {"p": "id"})
    twice = with_neighbours(once, ["k"], ["id"], Spread(), None, {"n": "id"})
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Join" not in plan and "Union" not in plan


def test_cut_keeps_rows_and_schema(spark):
    sales = fx.sales(spark)
    again = cut(sales, "sales")
    assert again.schema.simpleString() == sales.schema.simpleString() and again.count() == 30


def test_newest_version_is_read_alone(spark, tmp_path):
    from callytics.sources.tables import load_current, write_version

    def follow_ups(label):
        return spark.createDataFrame([("IMM", label, True)], "code string, label string, active boolean")

    for version, label in enumerate(["old", "new"]):
        write_version(follow_ups(label), str(tmp_path), "followup_codes", version)
    assert [r.label for r in load_current(spark, str(tmp_path), "followup_codes").collect()] == ["new"]
    # A version that is still being written has files, but no mark of its end.
    path = write_version(follow_ups("half"), str(tmp_path), "followup_codes", 10)
    import os

    os.remove(f"{path}/_SUCCESS")
    assert [r.label for r in load_current(spark, str(tmp_path), "followup_codes").collect()] == ["new"]
    with pytest.raises(FileNotFoundError):
        load_current(spark, str(tmp_path), "companies")


def test_rows_repeated_in_a_batch_are_stored_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from callytics.sources.tables import append_new

    path = str(tmp_path / "turns")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 1, "w"), ("a", 2, "y")], "session_id string, seq int, text string")
    for _ in range(2):
        append_new(rows, path, ["session_id", "seq"], F.to_timestamp(F.lit("2024-01-01")))
    assert sorted((r.seq, r.text) for r in spark.read.parquet(path).collect()) == [(1, "w"), (2, "y")]


def test_several_results_of_one_event(spark):
    from callytics.operators.sync import apply_sync_results

    events = spark.createDataFrame([(1, False, None), (2, False, "old"), (3, False, "kept")], "id int, sheets_synced boolean, sheets_error string")
    results = spark.createDataFrame(
        [(1, False, "late", 2), (1, True, None, 3), (1, False, "early", 1), (2, True, None, 1), (2, True, None, 1)],
        "id int, ok boolean, error string, at int",
    )
    got = {r.id: (r.sheets_synced, r.sheets_error) for r in apply_sync_results(events, results).collect()}
    assert got == {1: (True, "late"), 2: (True, "old"), 3: (False, "kept")}


def test_a_scope_removes_its_tables(spark):
    from callytics.plans.lineage import cut, scope

    with scope(spark):
        kept = cut(spark.range(5).toDF("id"), "five")
        path = kept.inputFiles()[0]
        assert kept.count() == 5
    import os

    assert not os.path.exists(os.path.dirname(path.removeprefix("file://")))
