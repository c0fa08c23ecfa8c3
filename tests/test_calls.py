from random import Random

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from callytics.operators import prompts, stages, suggestions, transcripts
from callytics.plans.slices import Spread
from callytics.sources.schemas import KEYWORD_GROUPS, STAGES

TURNS = "session_id string, seq bigint, speaker string, channel smallint, text string, ts bigint"


def test_vocabulary_sizes():
    assert {k: len(v) for k, v in KEYWORD_GROUPS.items()} == {
        "opening": 14, "discovery": 31, "product": 26, "objections": 52, "risk": 14, "closing": 22, "followUp": 16,
    }


def test_vocabulary_tables(spark):
    rows = [(g, n, w) for g, words in KEYWORD_GROUPS.items() for n, w in enumerate(words)]
    table = spark.createDataFrame(rows[::-1], "group string, position int, keyword string")
    assert stages.groups_from(table) == {g: list(w) for g, w in KEYWORD_GROUPS.items()}


def test_stages_and_signals_of_the_call(spark):
    progress = stages.stage_progression(fx.call(spark))
    rows = progress.orderBy("seq").collect()
    assert [(r.stage, r.changed) for r in rows] == [(c[2], c[3]) for c in fx.CALL]
    found = {r.seq: (r.signal_type, r.matched_keywords) for r in stages.signals(progress).collect()}
    assert found == {n: (c[4], c[5]) for n, c in enumerate(fx.CALL) if c[4]}
    reason = stages.signals(progress).filter("seq = 3").collect()[0].reason
    assert reason == "Objeción detectada: está caro, lo voy a pensar"


def test_repeated_keywords_are_kept(spark):
    matches = stages.keyword_matches(fx.call(spark)).filter("seq = 6").collect()[0]
    assert matches.discovery_matches == ["retiro", "retiro"]


def test_one_scan_finds_what_plain_searches_find(spark):
    """Nested, overlapping and repeated keywords, and letters that mean something in patterns."""
    random = Random(8)
    groups = {
        "a": ["ab", "abc", "b", "abcab", "Ab", "ab"], "b": ["c.c", "(a", "a|b", "bca", "é", "s&p 500"], "none": [], "c": ["ca", "a" * 6, "aa", "^", "\\"],
    }
    rows = [("s", n, "x", 0, "".join(random.choices("abcABé.(|^\\ ", k=random.randrange(30))), n) for n in range(600)]
    rows += [("s", 900, "x", 0, "S&P 500 c.c", 0), ("s", 901, "x", 0, "", 0), ("s", 902, "x", 0, None, 0)]
    found = stages.keyword_matches(spark.createDataFrame(rows, TURNS), groups)
    for r in found.collect():
        text = (r.text or "").lower()
        for name, words in groups.items():
            assert list(r[f"{name}_matches"] or []) == [w for w in words if w.lower() in text]
    for vocabulary in (KEYWORD_GROUPS, groups):
        words = [w for ws in vocabulary.values() for w in ws]
        table = [("s", n, "x", 0, f"{a} {b}", n) for n, (a, b) in enumerate(zip(words, reversed(words)))]
        for r in stages.keyword_matches(spark.createDataFrame(table, TURNS), vocabulary).collect():
            for name, listed in vocabulary.items():
                assert r[f"{name}_matches"] == [w for w in listed if w.lower() in r.text.lower()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("lower(text") == 1


def test_a_lapsed_stage_starts_from_idle(spark):
    turns = fx.call(spark, pause_at=6, pause_ms=3_601_000)
    starts = turns.groupBy(F.col("session_id").alias("id")).agg(
        F.timestamp_millis(F.min("ts")).alias("started_at")
    )
    row = stages.stage_progression_ttl(turns, starts).filter("seq = 6").collect()[0]
    assert (row.previous_stage, row.stage, row.changed) == ("idle", "discovery", True)


WORDS = {"followUp": ["f6"], "closing": ["c5"], "objections": ["o4"], "product": ["p3"], "discovery": ["d2"]}
RANKS = {"f6": 6, "c5": 5, "o4": 4, "p3": 3, "d2": 2}


def _random_turns(seed, sessions=40, turns=60, longest=900_000):
    random, rows = Random(seed), []
    for number in range(sessions):
        ts = 1_700_000_000_000 + random.randrange(10_000_000)
        # One session is as long as all others together.
        for seq in range(turns * (sessions if number == 1 else 1)):
            text = random.choice(["", "", "", *RANKS]) if number % 4 else random.choice(["", "", "", "", "d2", "o4"])
            rows.append((f"s{number}", seq, "cliente", 1, text, ts))
            ts += random.choice([0, 1_000, 60_000, random.randrange(longest)])
    return rows


def _fold(rows, ttl_ms=None):
    """The rule, one turn after the other; sessions open at their first turn."""
    state, told = {}, {}
    for session, seq, _, _, text, ts in rows:
        stage, at = state.get(session, (1, ts))
        if ttl_ms is not None and ts - at >= ttl_ms:
            stage = 0
        found = RANKS.get(text) or (1 if stage == 0 else stage)
        after = found if found == 4 or found >= stage else stage
        told[session, seq] = (STAGES[stage], STAGES[after])
        state[session] = (after, ts if after != stage else at)
    return told


@pytest.mark.parametrize("slice_rows", [60, 700, 10_000_000])
def test_progression_equals_the_fold(spark, slice_rows):
    rows = _random_turns(slice_rows)
    found = stages.stage_progression(spark.createDataFrame(rows, TURNS), WORDS, spread=Spread(100, slice_rows))
    assert {(r.session_id, r.seq): (r.previous_stage, r.stage) for r in found.collect()} == _fold(rows)


@pytest.mark.parametrize("hot_rows, slice_rows, ttl", [(0, 60, 3_600), (100, 300, 600), (0, 500, 7_200), (10_000, 1, 3_600)])
def test_expiring_progression_equals_the_fold(spark, hot_rows, slice_rows, ttl):
    rows = _random_turns(slice_rows + ttl)
    turns = spark.createDataFrame(rows, TURNS)
    starts = turns.groupBy(F.col("session_id").alias("id")).agg(
        F.timestamp_millis(F.min("ts")).alias("started_at")
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # sessions and slices go on from batch to batch
    try:
        found = stages.stage_progression_ttl(turns, starts, WORDS, ttl, Spread(hot_rows, slice_rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    assert {(r.session_id, r.seq): (r.previous_stage, r.stage) for r in found} == _fold(rows, ttl * 1000)


def test_slices_are_joined_many_sessions_at_a_time(spark):
    rows = [(f"s{k}", n, "cliente", 1, "o4", 1_700_000_000_000 + 1_000 * n) for k in range(30) for n in range(12)]
    turns = spark.createDataFrame(rows, TURNS)
    starts = turns.groupBy(F.col("session_id").alias("id")).agg(F.timestamp_millis(F.min("ts")).alias("started_at"))
    found = stages.stage_progression_ttl(turns, starts, WORDS, 5, Spread(3, 5))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    assert {(r.session_id, r.seq): (r.previous_stage, r.stage) for r in found.collect()} == _fold(rows, 5_000)


def test_stages_of_requests_are_computed_once(spark):
    from queries import QUERIES

    plan = QUERIES["manual_signals_hot"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


@pytest.mark.parametrize("texts", [["o4"], ["", "d2"], ["f6"], ["o4", "c5"]])
def test_a_session_without_pauses_is_cut(spark, texts):
    """Turns a second apart, never a pause: slices still split it, and each lapse depends on the one before it."""
    random = Random(len(texts))
    rows = [("s", n, "cliente", 1, random.choice(texts), 1_700_000_000_000 + 1_000 * n) for n in range(2_000)]
    turns = spark.createDataFrame(rows, TURNS)
    starts = turns.groupBy(F.col("session_id").alias("id")).agg(F.timestamp_millis(F.min("ts")).alias("started_at"))
    found = stages.stage_progression_ttl(turns, starts, WORDS, 67, Spread(100, 150)).collect()
    assert {(r.session_id, r.seq): (r.previous_stage, r.stage) for r in found} == _fold(rows, 67_000)


@pytest.mark.parametrize("seed", range(6))
def test_runs_compose(seed):
    """The map of a run from any state equals turn after turn, and that of two runs in a row."""
    import numpy as np

    from callytics.functions.lapsing import Run

    random, ttl = Random(seed), 50
    ts = np.cumsum([random.choice([0, 1, 9, 60 if seed % 2 else 20]) for _ in range(80)]) + 1_000
    rank = np.array([random.choice([0, 0, 2, 3, 4, 5, 6] if seed < 4 else [0, 4]) for _ in range(80)])

    def step(state, at, found):
        stage, set_at = state
        if stage and at - set_at >= ttl:
            stage = 0
        after = 4 if found == 4 else max(stage, found, 1)
        return (after, at) if after != stage else (stage, set_at)

    for low, middle, high in [(0, 30, 80), (10, 11, 60), (5, 50, 51)]:
        for state in [(0, 0), *((s, 990 - back) for s in range(1, 7) for back in (0, 10, 45, 49, 50, 300))]:
            want = state
            for at, found in zip(ts[low:high].tolist(), rank[low:high].tolist()):
                want = step(want, at, found)
            assert Run.of(ts[low:high], rank[low:high], ttl)(*state, ttl) == want
            half = Run.of(ts[low:middle], rank[low:middle], ttl)(*state, ttl)
            assert Run.of(ts[middle:high], rank[middle:high], ttl)(*half, ttl) == want


def test_silence_and_closing(spark):
    beats = spark.createDataFrame(
        [("a", s) for s in (0, 30, 90, 151)] + [("b", s) for s in (0, 60, 120)], "session_id string, s bigint"
    ).select("session_id", F.timestamp_seconds("s").alias("ts"))
    starts = spark.createDataFrame(
        [("a", "x", 0), ("b", "x", 0), ("c", "y", 0), ("d", "y", 40)], "id string, agent_id string, s bigint"
    ).select("id", "agent_id", F.lit("n").alias("agent_name"), F.timestamp_seconds("s").alias("started_at"))
    silence = transcripts.sessions_silence(starts, beats)
    ends = silence.select("session_id", F.unix_seconds("silence_at").alias("s")).collect()
    assert {r.session_id: r.s for r in ends} == {"a": 150, "b": 180, "c": 60, "d": 100}

    asked = spark.createDataFrame([("b", 100), ("b", 90)], "session_id string, s bigint").select(
        "session_id", F.timestamp_seconds("s").alias("ended_at")
    )
    closed = transcripts.sessions_close(starts, asked, silence, "1970-01-01T00:01:35Z")
    got = {r.id: (r.status, r.s) for r in closed.select("id", "status", F.unix_seconds("ended_at").alias("s")).collect()}
    # a is replaced by b at once, b is ended at 90 s, c is replaced by d, d is still open.
    assert got == {"a": ("ended", 0), "b": ("ended", 90), "c": ("ended", 40), "d": ("active", None)}


def test_excerpts(spark):
    turns, sessions = fx.call(spark), spark.createDataFrame([("s1",), ("s2",)], "id string")
    found = {r.session_id: r.excerpt for r in transcripts.transcript_excerpt(turns, sessions, 2).collect()}
    assert found == {
        "s1": "agente (00:01:30): Mañana lo llamo\ncliente (00:01:40): Gracias",
        "s2": "(sin transcript disponible)",
    }


@pytest.mark.parametrize("spread", [Spread(), Spread(50, 30)])
@pytest.mark.parametrize("max_turns", [None, 3])
def test_excerpts_at_any_time_equal_the_plain_search(spark, max_turns, spread):
    random = Random(9)
    rows = [
        (f"s{random.randrange(3)}", n, "agente", 0, f"t{n}", 1_700_000_000_000 + 20_000 * n + random.randrange(9_000))
        for n in range(400)
    ]
    asked = [(n, f"s{random.randrange(4)}", 1_700_000_000_000 + random.randrange(9_000_000)) for n in range(200)]
    found = transcripts.excerpts_at(
        spark.createDataFrame(asked, "request_id bigint, session_id string, at bigint"),
        spark.createDataFrame(rows, TURNS), 180_000, max_turns, slice_seconds=200, spread=spread,
    )
    want = {}
    for number, session, at in asked:
        said = [r[4] for r in sorted(rows, key=lambda r: r[5]) if r[0] == session and at - 180_000 <= r[5] <= at]
        want[number] = said if max_turns is None else said[-max_turns:]
    got = {r.request_id: [x.split("): ")[1] for x in r.excerpt.split("\n")] if "): " in r.excerpt else [] for r in found.collect()}
    assert got == want


BOOK = """# Book
intro
## Rol central del Co-Pilot
one
### Detail
two
## Etapa opening - Paso 1
three
#### deep
four
# Appendix
five
## Principios finales
six

"""


def test_playbook(spark):
    docs = spark.createDataFrame([("b", BOOK)], "doc string, markdown string")
    sections = prompts.playbook_sections(docs)
    got = {r.heading: (r.level, r.body) for r in sections.collect()}
    assert got == {
        "Rol central del Co-Pilot": (2, "## Rol central del Co-Pilot\none\n### Detail\ntwo"),
        "Detail": (3, "### Detail\ntwo"),
        "Etapa opening - Paso 1": (2, "## Etapa opening - Paso 1\nthree\n#### deep\nfour"),
        "Principios finales": (2, "## Principios finales\nsix"),
    }
    guide = {r.stage: r.guidance for r in prompts.stage_guidance(sections).collect()}
    rule = "\n\n---\n\n"
    assert set(guide) == set(STAGES)
    assert guide["opening"] == rule.join(got[h][1] for h in ("Rol central del Co-Pilot", "Etapa opening - Paso 1", "Principios finales"))
    assert guide["ended"].count("## Principios finales") == 2
    assert max(len(r.guidance) for r in prompts.stage_guidance(sections, max_chars=10).collect()) == 10


def test_prompt_texts(spark):
    progress = stages.stage_progression(fx.call(spark))
    raised = stages.signals(progress).withColumn("request_id", F.col("seq"))
    requests = raised.select("request_id", "session_id", F.col("ts").alias("at"))
    excerpts = prompts.copilot_excerpts(requests, fx.call(spark))
    guidance = spark.createDataFrame([("closing", "Cerrar.")], "stage string, guidance string")
    rows = {r.request_id: r for r in prompts.copilot_prompts(raised, excerpts, guidance, "SYS").collect()}
    assert rows[5].user_prompt.startswith(
        "[ESTADO DE LA LLAMADA]\nEtapa: closing\nSeñal: closing_opportunity\n"
        "Motivo: Oportunidad de cierre detectada: siguiente paso\nKeywords: siguiente paso\n\n[TRANSCRIPT RECIENTE]\nagente ("
    )
    assert "\n\n[FUENTE OPERATIVA UNICA]\nCerrar.\n\nUsa exclusivamente" in rows[5].user_prompt
    assert "(sin perfil operativo disponible)" in rows[3].user_prompt
    assert rows[4].transcript_excerpt.count("\n") == 4

    last = fx.call(spark).agg(F.max("ts")).first()[0]
    changes = stages.stage_changes(progress)
    manual = stages.manual_signals(
        spark.createDataFrame([(100, "s1", last), (101, "zz", 1), (102, "s1", last + 3_600_000)], "request_id bigint, session_id string, at bigint"),
        stages.stage_intervals(changes),
    )
    assert {(r.request_id, r.session_id, r.stage, r.confidence) for r in manual.collect()} == {
        (100, "s1", "follow_up", 1.0), (101, "zz", "idle", 1.0), (102, "s1", "idle", 1.0),
    }
    row = prompts.copilot_prompts(manual, excerpts, guidance, "SYS").filter("session_id = 'zz'").collect()[0]
    assert "Keywords: (ninguna)" in row.user_prompt and "(sin transcript disponible)" in row.user_prompt


@pytest.mark.parametrize("spread", [Spread(), Spread(20, 15)])
def test_as_of_equals_the_plain_search(spark, spread):
    from callytics.plans.intervals import as_of

    random, intervals = Random(3), []
    for key in ("a", "b", "hot", "hot2"):
        at = random.randrange(50)
        for n in range(200 if key.startswith("hot") else 12):
            end = at + random.choice([0, 1, 7, 40, 95])
            intervals.append((key, at, end, f"{key}{n}"))
            at = end + random.choice([0, 0, 3, 200])
    asked = [(n, random.choice(["a", "b", "hot", "hot2", "none"]), random.randrange(6_000)) for n in range(400)] + [(900, "hot", 10), (900, "hot", 10)]
    found = as_of(
        spark.createDataFrame(asked, "n int, key string, t bigint"), spark.createDataFrame(intervals, "key string, start bigint, end bigint, name string"),
        ["key"], "t", 50, spread,
    ).collect()
    want = sorted((n, k, t, next((name for key, a, b, name in intervals if key == k and a <= t < b), "")) for n, k, t in asked)
    assert sorted((r.n, r.key, r.t, r.name or "") for r in found) == want


@pytest.mark.parametrize("levels", [0, 4, 12])
def test_stabbed_equals_the_plain_search(spark, levels):
    from callytics.plans.intervals import stabbed

    random = Random(levels)
    intervals = [
        (random.choice("ab"), a := random.randrange(-20, 400), random.choice([None, a, a + 1, a + random.randrange(300)]), f"i{n}") for n in range(120)
    ]
    asked = [(n, random.choice("abc"), random.randrange(-30, 700)) for n in range(300)]
    found = stabbed(
        spark.createDataFrame(asked, "n int, key string, t bigint"), spark.createDataFrame(intervals, "key string, start bigint, end bigint, name string"),
        ["key"], "t", levels,
    ).collect()
    want = {}
    for n, key, t in asked:
        open_ = [(a, b if b is not None else 10_000, name) for k, a, b, name in intervals if k == key and a <= t and (b is None or t < b)]
        latest = max((a for a, _, _ in open_), default=None)
        want[n] = {name for a, _, name in open_ if a == latest}
    assert len(found) == 300 and all((r.name in want[r.n]) if want[r.n] else r.name is None for r in found)


def test_requests_are_judged_by_owner_and_session(spark):
    sessions = spark.createDataFrame([("s1", "a", 0, None), ("s2", "b", 0, 50)], "id string, agent_id string, s bigint, e bigint").select(
        "id", "agent_id", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("ended_at")
    )
    asked = spark.createDataFrame(
        [(1, "s1", "a", 10), (2, "s1", "b", 10), (3, "s2", "b", 49), (4, "s2", "b", 50), (5, "zz", "a", 1), (6, "s1", "a", -1), (7, "s1", None, 5)],
        "request_id bigint, session_id string, agent_id string, s bigint",
    )
    judged = stages.judged_requests(asked, sessions, F.timestamp_seconds("s"))
    assert {r.request_id: r.reason for r in judged.collect()} == {
        1: None, 2: "forbidden", 3: None, 4: "session_not_found", 5: "session_not_found", 6: "session_not_found", 7: "forbidden",
    }


def test_responses_and_feedback(spark):
    texts = ["'a'", "\"b\"", "'\"c\"'", "\"'d'\"", "''e''", " 'f' ", "'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    got = [r[0] for r in df.orderBy("n").select(suggestions.clean_response(F.col("t"))).collect()]
    assert got == ["a", "b", "c", "'d'", "'e'", "'f'", ""]

    shown = spark.createDataFrame([(1, "s1", None), (2, "s2", None)], "id bigint, session_id string, accepted boolean")
    sessions = spark.createDataFrame(
        [("s1", "a", 0, None), ("s2", "b", 0, 50)], "id string, agent_id string, b bigint, e bigint"
    ).select("id", "agent_id", F.timestamp_seconds("e").alias("ended_at"))
    given = spark.createDataFrame(
        [(1, "a", True, 10), (1, "a", False, 20), (1, "x", True, 30), (2, "b", True, 50), (9, "b", True, 1)],
        "suggestion_id bigint, agent_id string, accepted boolean, s bigint",
    ).select("suggestion_id", "agent_id", "accepted", F.timestamp_seconds("s").alias("at"))
    updated, rejected = suggestions.suggestion_feedback(shown, sessions, given)
    assert {r.id: r.accepted for r in updated.collect()} == {1: False, 2: None}
    assert sorted((r.suggestion_id, r.reason) for r in rejected.collect()) == [
        (1, "forbidden"), (2, "forbidden"), (9, "suggestion_not_found"),
    ]


def test_turns_from_speech(spark):
    rows = [
        ('{"channel_index":[0,2],"channel":{"alternatives":[{"transcript":" Hola "}]}}', ("agente", 0, "Hola")),
        ('{"channel_index":[2],"channel":{"alternatives":[{"transcript":"Sí"}]}}', ("cliente", 1, "Sí")),
        ('{"channel":{"alternatives":[{"transcript":"x"}]}}', ("agente", 0, "x")),
        ('{"channel_index":[1],"channel":{"alternatives":[{"transcript":"  "}]}}', None),
        ('{"channel_index":[],"channel":{"alternatives":[]}}', None),
        ('{"type":"Metadata"}', None),
    ]
    df = spark.createDataFrame([("s", i, 5, r[0]) for i, r in enumerate(rows)], "session_id string, seq bigint, ts bigint, payload string")
    got = {r.seq: (r.speaker, r.channel, r.text) for r in transcripts.turns_build(df).collect()}
    assert got == {i: r[1] for i, r in enumerate(rows) if r[1]}
