from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from callytics.functions.text import tab_name
from callytics.functions.time import check_range, instant, local_time
from callytics.operators import attendance, sync
from callytics.plans.paging import clamp
from callytics.plans.slices import Spread

BASE = datetime(2026, 1, 1)


def test_summary_of_the_cases(spark):
    found = attendance.clock_summary(fx.clock_events(spark), fx.DAY_FROM, fx.DAY_TO, fx.DAY_NOW)
    got = {(r.agent_id, r.display_name): (r.total_minutes, r.shifts_count, r.currently_clocked) for r in found.collect()}
    assert got == {
        ("inside", "i"): (510, 1, False),
        ("start", "s"): (120, 1, False),
        ("end", "e"): (60, 1, False),
        ("open", "o"): (240, 1, True),
        ("edge", "g"): (0, 1, False),
        ("half", "h"): (3, 1, False),
        ("renamed", "A"): (60, 1, False),
        ("renamed", "B"): (120, 1, False),
    }
    minutes = [r.total_minutes for r in found.collect()]
    assert minutes == sorted(minutes, reverse=True)


def test_shift_list_shows_unclipped_lengths(spark):
    found = attendance.clock_shift_list(fx.clock_events(spark), fx.DAY_FROM, fx.DAY_TO).collect()
    lengths = {(r.agent_id, r.display_name): r.duration_minutes for r in found}
    assert lengths[("start", "s")] == 240
    assert lengths[("end", "e")] is None and lengths[("open", "o")] is None
    assert lengths[("half", "h")] == 3


def _attempts(actions, agent="a"):
    return [(i, agent, agent, a, BASE + timedelta(hours=i), False, None) for i, a in enumerate(actions)]


def test_validation_sequence(spark):
    out, in_ = "CLOCKOUT", "CLOCKIN"
    judged = attendance.clock_validate(fx.clock_events(spark, _attempts([out, in_, in_, out, out])))
    got = [(r.accepted, r.error, r.last_action) for r in judged.orderBy("id").collect()]
    assert got == [
        (False, "not_clocked_in", None),
        (True, None, None),
        (False, "already_clocked_in", in_),
        (True, None, in_),
        (False, "not_clocked_in", out),
    ]


def _sequential(rows):
    """The rule, one attempt after the other."""
    last, told = {}, {}
    for number, agent, _, action, at, *_ in sorted(rows, key=lambda r: (r[4], r[0])):
        state, since = last.get(agent, (None, None))
        ok = state != "CLOCKIN" if action == "CLOCKIN" else state == "CLOCKIN"
        told[number] = (ok, state, since)
        if ok:
            last[agent] = (action, at)
    return told


@pytest.mark.parametrize("slice_rows", [600, 7_200, 86_400])
def test_validation_equals_the_sequential_rule(spark, slice_rows):
    random, rows = Random(slice_rows), []
    for number in range(3_000):
        # One agent holds a third of all attempts; equal times are common.
        agent = "hot" if number % 3 == 0 else f"a{random.randrange(40)}"
        at = BASE + timedelta(minutes=5 * random.randrange(2_000))
        rows.append((number, agent, agent, random.choice(["CLOCKIN", "CLOCKOUT"]), at, False, None))
    judged = attendance.clock_validate(fx.clock_events(spark, rows), spread=Spread(100, slice_rows))
    judged = judged.withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
    assert {r.id: (r.accepted, r.last_action, r.last_at) for r in judged.collect()} == _sequential(rows)


def test_validation_continues_from_stored_events(spark):
    random, rows = Random(5), []
    for number in range(1_000):
        agent = f"a{random.randrange(15)}"
        at = BASE + timedelta(minutes=number)
        rows.append((number, agent, agent, random.choice(["CLOCKIN", "CLOCKOUT"]), at, False, None))
    told = _sequential(rows)
    stored = [r for r in rows[:500] if told[r[0]][0]]
    judged = attendance.clock_validate(
        fx.clock_events(spark, rows[500:]), fx.clock_events(spark, stored), Spread(50, 30)
    )
    judged = judged.withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
    got = {r.id: (r.accepted, r.last_action, r.last_at) for r in judged.collect()}
    assert got == {n: t for n, t in told.items() if n >= 500}


@pytest.mark.parametrize("hot_rows", [10, 120, 10_000])
def test_shifts_do_not_depend_on_the_slices(spark, hot_rows):
    random = Random(11)
    rows = [
        (n, f"a{random.randrange(5)}", "x", random.choice(["CLOCKIN", "CLOCKOUT"]), BASE + timedelta(minutes=7 * n),
         False, None)
        for n in range(600)
    ]
    start, end = BASE + timedelta(hours=20), BASE + timedelta(hours=50)
    found = attendance.clock_shifts(fx.clock_events(spark, rows), start, end, Spread(hot_rows, 25))
    found = found.withColumn("clock_out", F.col("clock_out").cast("timestamp_ntz"))
    want = {}
    for agent in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == agent and r[4] <= end]
        for row, after in zip(mine, [*mine[1:], None]):
            if row[3] == "CLOCKIN" and (after is None or after[4] >= start):
                want[row[0]] = after[4] if after is not None and after[3] == "CLOCKOUT" else None
    assert {r.id: r.clock_out for r in found.collect()} == want


def test_summary_of_a_stored_table_reads_the_range(spark, tmp_path):
    """The scan of ordered rows has the range pushed down, and one exchange carries event rows."""
    fx.clock_events(spark).write.parquet(str(tmp_path / "clock_events"))
    events = spark.read.parquet(str(tmp_path / "clock_events"))
    found = attendance.clock_summary(events, fx.DAY_FROM, fx.DAY_TO, fx.DAY_NOW)
    want = attendance.clock_summary(fx.clock_events(spark), fx.DAY_FROM, fx.DAY_TO, fx.DAY_NOW)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 2 and sum("PushedFilters: [IsNotNull(event_at), Grea" in s for s in scans) == 1
    # By agent: the rows put in order and the reduced rows outside; then the result's order.
    assert final.count("hashpartitioning(agent_id") == 2 and final.count("rangepartitioning") <= 1


def test_a_state_from_before_and_after_the_range(spark):
    rows = [
        (1, "in", "x", "CLOCKIN", BASE, False, None),
        (2, "later", "x", "CLOCKOUT", BASE + timedelta(days=9), False, None),
        (3, "later", "x", "CLOCKIN", BASE + timedelta(days=2), False, None),
        (4, "after", "x", "CLOCKIN", BASE + timedelta(days=9), False, None),
    ]
    start, end = BASE + timedelta(days=1), BASE + timedelta(days=3)
    found = attendance.clock_summary(fx.clock_events(spark, rows), start, end, BASE + timedelta(days=20))
    got = {r.agent_id: (r.total_minutes, r.shifts_count, r.currently_clocked) for r in found.collect()}
    assert got == {"in": (2_880, 1, True), "later": (1_440, 1, False)}


def test_status_history_and_bulk_clock_out(spark):
    events = fx.clock_events(spark)
    agents = spark.createDataFrame([("open",), ("inside",), ("nobody",)], "agent_id string")
    status = {r.agent_id: (r.clocked_in, r.last_action) for r in attendance.clock_status(events, agents).collect()}
    assert status == {"open": (True, "CLOCKIN"), "inside": (False, "CLOCKOUT"), "nobody": (False, None)}
    history = attendance.clock_history(events, "renamed", 3).collect()
    assert [r.display_name for r in history] == ["B", "B", "A"]
    out = attendance.bulk_clock_out(events, "2026-01-10T08:00:00Z").collect()
    assert [(r.agent_id, r.action, r.local_time) for r in out] == [("open", "CLOCKOUT", "00:00:00")]


def test_page_is_closed_and_clamped(spark):
    page = attendance.clock_events_page(fx.clock_events(spark), fx.DAY_FROM, fx.DAY_TO, limit=9_999).collect()
    assert len(page) == page[0].total == 12
    assert [clamp(x, 1, 500, 100) for x in (None, "x", "7", "12a", 0, 900)] == [100, 100, 7, 12, 1, 500]


def test_range_guard():
    check_range("2026-01-01", "2026-04-01", 90)
    for start, end in [("2026-01-02", "2026-01-02"), ("2026-01-02", "2026-01-01"), ("2026-01-01", "2026-04-02")]:
        with pytest.raises(ValueError):
            check_range(start, end, 90)


def test_export_and_its_bookkeeping(spark, tmp_path):
    names = spark.createDataFrame([("A[b]*?/\\c",), ("[]",), ("x" * 200,)], "name string")
    tabs = [r[0] for r in names.select(tab_name(F.col("name"), F.lit("123456789"))).collect()]
    assert tabs == ["Abc_456789", "Agente_456789", "x" * 94 + "_456789"]

    events = fx.clock_events(spark)
    sync.write_clock_export(sync.clock_export(events), str(tmp_path / "export"))
    back = spark.read.option("header", True).csv(str(tmp_path / "export"))
    assert back.count() == len(fx.clock_rows()) and set(back.columns) == {"Fecha", "Hora", "Acción", "tab_name"}

    results = spark.createDataFrame([(1, True, None), (2, False, "quota")], "id bigint, ok boolean, error string")
    after = {r.id: (r.sheets_synced, r.sheets_error) for r in sync.apply_sync_results(events, results).collect()}
    assert after[1] == (True, None) and after[2] == (False, "quota") and after[3] == (False, None)
    assert [r.id for r in sync.sync_report(events, 2).collect()] == [6, 5]


def test_midnight_renders_as_zero(spark):
    row = spark.range(1).select(local_time(instant("2026-01-02T08:00:00Z"))).collect()[0]
    assert row[0] == "00:00:00"
