"""DuckDB twins of the queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

FROM, TO, NOW = "timestamp '2024-01-05'", "timestamp '2024-01-20'", "timestamp '2024-02-01'"
SOLD = "sold_at >= timestamp '1996-01-01' and sold_at < timestamp '1999-01-01'"
AS_OF = "timestamp '2024-01-03'"
TAG = "mock_dashboard_seed"

# Shared tables, by name; `sql` adds those a query mentions.
TABLES: dict[str, str] = {}

TABLES["att"] = """
  select event_id id, user_id::varchar agent_id, 'User#' || user_id display_name,
         case when event_type in ('signup', 'view') then 'CLOCKIN' else 'CLOCKOUT' end as action, ts event_at,
         value < 100 sheets_synced, case when value > 200 then 'e' || event_type end sheets_error
  from events"""
TABLES["judged"] = """
  select *, coalesce(lag(action) over (partition by agent_id order by event_at, id), 'CLOCKOUT') <> action accepted
  from att"""
TABLES["ck"] = "select * exclude (accepted) from judged where accepted"
TABLES["latest"] = """
  select * from ck qualify row_number() over (partition by agent_id order by event_at desc, id desc) = 1"""
TABLES["shifts"] = f"""
  select agent_id, display_name, id, event_at clock_in, case when na = 'CLOCKOUT' then nt end clock_out
  from (select *, lead(action) over w na, lead(event_at) over w nt from ck where event_at <= {TO}
        window w as (partition by agent_id order by event_at, id))
  where action = 'CLOCKIN' and (nt is null or nt >= {FROM})"""
TABLES["agents"] = "select c_custkey::varchar agent_id from customer"

TABLES["companies"] = """
  select n_nationkey::bigint id, upper(n_name) code, 'Company ' || n_name as name, n_regionkey <> 4 active
  from nation"""
_PRODUCT = (
    "c_nationkey::bigint * 10 + list_position("
    "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment)"
)
TABLES["products"] = f"""
  select distinct {_PRODUCT} id, c_nationkey::bigint company_id, c_mktsegment code,
         upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as name, c_mktsegment <> 'MACHINERY' active
  from customer"""
TABLES["codes"] = """
  select * from (values ('IMM', 'Firmado en el momento', true), ('UW', 'Underwriting', true)) t(code, label, active)"""
TABLES["sales"] = f"""
  select o_orderkey id, 'i' || o_orderkey discord_interaction_id, o_orderkey::varchar discord_message_id,
         null::varchar discord_guild_id, null::varchar discord_channel_id, c_custkey::varchar agent_id,
         c_name agent_name, c_nationkey::bigint company_id, {_PRODUCT} product_id, c_name client_name,
         floor(o_totalprice * 100 + 0.5)::bigint amount_cents, 'USD' currency,
         case o_orderpriority when '1-URGENT' then 'once' when '2-HIGH' then 'year' else 'month' end billing_period,
         case o_orderstatus when 'F' then 'IMM' when 'P' then 'UW' else 'DATE' end signature_status,
         case when o_orderstatus = 'O' then o_orderdate::date + 7 end signature_date,
         case o_orderstatus when 'F' then 'IMM' when 'P' then 'UW' end followup_code, null::varchar raw_text,
         case o_orderpriority when '3-MEDIUM' then '{TAG}' when '1-URGENT' then null else o_orderpriority end notes,
         o_orderdate sold_at, o_orderdate created_at, o_orderdate updated_at
  from orders join customer on o_custkey = c_custkey"""


def enriched(sales: str, companies: str = "companies", products: str = "products") -> str:
    return f"""
  select s.id, discord_interaction_id, discord_message_id, discord_guild_id, discord_channel_id, agent_id,
         agent_name, c.code company_code, c.name company_name, p.code product_code, p.name product_name,
         client_name, amount_cents, currency, billing_period, signature_status,
         signature_date::varchar signature_date, followup_code, raw_text, notes, sold_at, created_at, updated_at
  from {sales} s join {companies} c on c.id = s.company_id join {products} p on p.id = s.product_id"""


TABLES["enriched"] = enriched("sales")
TABLES["filtered"] = f"select * from enriched where {SOLD}"
TABLES["lines"] = f"""
  select * from (
    select l_suppkey::varchar agent_id, s_name agent_name, p_brand company_code, p_brand company_name,
           p_type product_code, p_type product_name, floor(l_extendedprice * 100 + 0.5)::bigint amount_cents,
           l_shipdate sold_at
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)
  where {SOLD}"""

TABLES["raw"] = """
  select o_orderkey id,
         case when o_orderpriority <> '1-URGENT' then o_custkey || '-' || year(o_orderdate) end discord_message_id,
         year(o_orderdate) y, c_custkey::varchar agent_id, c_name agent_name, upper(n_name) company_code,
         case when c_mktsegment = 'MACHINERY' and o_orderpriority = '2-HIGH' then '' else c_mktsegment end product_code,
         case when c_mktsegment = 'BUILDING' and o_orderpriority = '2-HIGH' then '  '
              when c_mktsegment = 'FURNITURE' and o_orderpriority = '2-HIGH' then '' else c_name end client_name,
         case when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'P' then 'n/a'
              when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'F' then '-1'
              else o_totalprice::varchar end amount,
         case when o_orderstatus = 'O' then 'MXN' else 'USD' end currency,
         case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P' then 'week'
              when o_orderpriority = '3-MEDIUM' then 'year' else 'month' end billing_period,
         case o_orderkey % 5 when 0 then 'imm' when 1 then ' UW ' when 2 then strftime(o_orderdate, '%Y-%m-%d')
              when 3 then day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate)
              else 'x' end signature_input,
         case o_orderkey % 5 when 0 then 'IMM' when 1 then 'UW' when 4 then null else 'DATE' end signature_status,
         case when o_orderkey % 5 in (2, 3) then strftime(o_orderdate, '%Y-%m-%d') end signature_date,
         o_orderpriority = '5-LOW' and o_orderstatus = 'F' bad_time,
         case when o_orderstatus <> 'P' then o_orderdate end sold_at
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""
TABLES["ingest"] = """
  select *, case when billing_period = 'week' or bad_time or client_name = '' then 'invalid_body'
                 when coalesce(try_cast(amount as double), 0) <= 0 then 'invalid_amount'
                 when signature_status is null then 'invalid_signature_input'
                 when product_code = '' then 'invalid_product'
                 when trim(client_name) = '' then 'invalid_client_name' end error,
         case when signature_status <> 'DATE' then signature_status end followup_code
  from raw"""
TABLES["wanted"] = """
  select distinct case when billing_period = 'year' then 'NEW_' || company_code else company_code end company_code,
         case when currency = 'MXN' then 'NEW_' || product_code else product_code end product_code
  from ingest where error is null"""
TABLES["wanted_less"] = """
  select distinct case when company_code <= 'NATION_15' then 'NEW_' || company_code else company_code end company_code,
         case when product_code = 'FURNITURE' then 'NEW_FURNITURE' else product_code end product_code
  from wanted"""

_CASE = """case when contains(lower(text), 'queci') then 6 when contains(lower(text), 'erlich') then 5
              when contains(lower(text), 'nicht') or contains(lower(text), 'thored') then 4
              when contains(lower(text), 'enber') then 3
              when contains(lower(text), 'anble') or contains(lower(text), 'inble') then 2 end"""
_NAMES = "['idle', 'opening', 'discovery', 'presentation', 'objection_handling', 'closing', 'follow_up']"
TABLES["turns"] = """
  select conv_id::varchar session_id, turn seq, case role when 'user' then 'cliente' else 'agente' end speaker,
         case role when 'user' then 1 else 0 end::smallint channel, text,
         1704067200000 + conv_id * 3600000 + turn * 45000 ts
  from conversations"""
TABLES["ranked"] = f"""
  select *, {_CASE} r, row_number() over (partition by session_id order by ts, seq) n from turns"""
TABLES["walk"] = """
  select session_id, n, 1 previous, case when r = 4 then 4 else greatest(1, coalesce(r, 1)) end state
  from ranked where n = 1
  union all
  select w.session_id, t.n, w.state, case when t.r = 4 then 4 else greatest(w.state, coalesce(t.r, 1)) end
  from walk w join ranked t on t.session_id = w.session_id and t.n = w.n + 1"""
TABLES["progress"] = f"""
  select t.*, {_NAMES}[previous + 1] previous_stage, {_NAMES}[state + 1] stage, previous <> state changed
  from ranked t join walk w using (session_id, n)"""
TABLES["walk_ttl"] = """
  select session_id, 0::bigint n, 1 previous, 1 state, min(ts) set_at from ranked group by session_id
  union all
  select session_id, n, live, next, case when live <> next then ts else set_at end
  from (select *, case when r = 4 then 4 else greatest(live, coalesce(r, 1), 1) end as next
        from (select t.session_id, t.n, t.r, t.ts, w.set_at,
                     case when t.ts - w.set_at >= 90000 then 0 else w.state end live
              from walk_ttl w join ranked t on t.session_id = w.session_id and t.n = w.n + 1))"""
TABLES["sig"] = """
  select session_id, seq, ts, speaker, kind signal_type, stage, words,
         case kind when 'objection_detected' then 0.82 when 'risk_detected' then 0.78
              else 0.74 end::double confidence,
         case kind when 'objection_detected' then 'Objeción detectada: '
              when 'risk_detected' then 'Riesgo de compliance detectado: '
              else 'Oportunidad de cierre detectada: ' end || array_to_string(words, ', ') reason
  from (select *, case when speaker = 'cliente' and (contains(l, 'nicht') or contains(l, 'thored'))
                       then 'objection_detected'
                       when contains(l, 'enung') then 'risk_detected'
                       when speaker = 'cliente' and contains(l, 'erlich') then 'closing_opportunity' end kind,
               case when speaker = 'cliente' and (contains(l, 'nicht') or contains(l, 'thored'))
                    then list_filter(['nicht', 'thored'], lambda w: contains(l, w))
                    when contains(l, 'enung') then ['enung'] else ['erlich'] end words
        from (select *, lower(text) l from progress))
  where kind is not null"""

TABLES["starts"] = """
  select session_id id, (session_id::bigint % 10)::varchar agent_id, epoch_ms(min(ts)) started_at,
         epoch_ms(max(ts)) last_at
  from turns group by session_id"""
TABLES["silent"] = """
  select session_id id, min(heard) + interval 60 second silence_at
  from (select *, lead(heard) over (partition by session_id order by heard) nx
        from (select session_id, epoch_ms(ts) heard from turns))
  where nx is null or nx - heard > interval 60 second group by session_id"""
TABLES["sessions"] = f"""
  select id, agent_id, 'Agent ' || agent_id agent_name,
         case when e <= {AS_OF} then 'ended' else 'active' end status, started_at,
         case when e <= {AS_OF} then e end ended_at
  from (select *, least(case when id::bigint % 2 = 0 then last_at end,
                        lead(started_at) over (partition by agent_id order by started_at, id), silence_at) e
        from (select * from starts where started_at <= {AS_OF}) join silent using (id))"""
_LINE = "speaker || ' (' || strftime(epoch_ms(ts), '%H:%M:%S') || '): ' || text"
_ID = "session_id::bigint * 1048576 + seq"

TABLES["md"] = r"""
  select doc_id doc, '# ' || source || chr(10) || regexp_replace(regexp_replace(text, '\n', chr(10) || '## ', 'g'),
         '\. (L|R|D)', '.' || chr(10) || '### \1', 'g') m
  from documents"""
TABLES["mdlines"] = r"""
  select doc, generate_subscripts(string_split(m, chr(10)), 1) pos, unnest(string_split(m, chr(10))) line from md"""
TABLES["heads"] = """
  select doc, pos, line, lev,
         min(case when lev <= 2 then pos end) over w e2, min(pos) over w e3, max(pos) over (partition by doc) mp
  from (select doc, pos, line, case when line like '# %' then 1 when line like '## %' then 2
                                    when line like '### %' then 3 end lev
        from mdlines)
  where lev is not null
  window w as (partition by doc order by pos rows between 1 following and unbounded following)"""
TABLES["sections"] = r"""
  select h.doc, h.pos, h.lev as level, ltrim(h.line, '#')[2:] heading,
         trim(string_agg(l.line, chr(10) order by l.pos), e' \t\n\r') body
  from heads h join mdlines l on l.doc = h.doc and l.pos >= h.pos
       and l.pos < coalesce(case when h.lev = 2 then h.e2 else h.e3 end, 1000000000)
  where h.lev > 1 group by h.doc, h.pos, h.lev, h.line"""


def _guide() -> str:
    """(stage, position, phrase) rows of the section map used by the query."""
    special = {"opening": ["ment"], "closing": ["zz9", "Le "]}
    names = ["idle", "opening", "discovery", "presentation", "objection_handling", "closing", "follow_up", "ended"]
    rows = []
    for stage in names:
        for n, phrase in enumerate(["tion", "La ", *special.get(stage, []), "que"]):
            rows.append(f"('{stage}', {n}, '{phrase}')")
    return ", ".join(rows)


TABLES["guide"] = f"""
  select doc, stage, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n) text
  from (select doc, stage, n, arg_min(body, pos) body
        from sections join (values {_guide()}) g(stage, n, phrase) on contains(heading, phrase)
        group by doc, stage, n)
  group by doc, stage"""
TABLES["lapsing"] = f"""
  select session_id, seq, ts, {_NAMES}[state + 1] stage, {_NAMES}[case when ts + 1000 - set_at >= 90000 then 1 else state + 1 end] later
  from walk_ttl join ranked using (session_id, n)"""
TABLES["asked"] = f"""
  select t.session_id::bigint * 1048576 + t.seq request_id, t.session_id, case when t.session_id::bigint % 5 = 0 then 'nobody'
                                              else (t.session_id::bigint % 10)::varchar end agent_id, t.ts + 1000 "at", l.later stage, t.seq,
         case when s.id is null or epoch_ms(t.ts + 1000) < s.started_at
                   or epoch_ms(t.ts + 1000) >= coalesce(s.ended_at, timestamp '9999-01-01') then 'session_not_found'
              when t.session_id::bigint % 5 = 0 then 'forbidden' end reason
  from turns t left join sessions s on s.id = t.session_id join lapsing l on l.session_id = t.session_id and l.seq = t.seq"""


def _prompt_table(raised: str) -> str:
    """Prompts of signals: request_id, session_id, at, signal_type, stage, words, reason."""
    return f"""
  select request_id, session_id, signal_type trigger_type, s.stage,
         array_to_string(words, '|') matched_keywords, 'Sugiere una sola frase.' system_prompt,
         '[ESTADO DE LA LLAMADA]' || chr(10) || 'Etapa: ' || s.stage || chr(10) || 'Señal: ' || signal_type || chr(10)
         || 'Motivo: ' || reason || chr(10) || 'Keywords: '
         || case when len(words) = 0 then '(ninguna)' else array_to_string(words, ', ') end || chr(10) || chr(10)
         || '[TRANSCRIPT RECIENTE]' || chr(10) || x || chr(10) || chr(10) || '[FUENTE OPERATIVA UNICA]' || chr(10)
         || coalesce(g.g, '(sin perfil operativo disponible)') || chr(10) || chr(10)
         || 'Usa exclusivamente la fuente operativa anterior, la etapa detectada y el transcript reciente para decidir'
         || ' que debe hacer el agente ahora.' || chr(10)
         || 'Genera solo UNA frase lista para decir al cliente.' user_prompt, x transcript_excerpt
  from (select r.*, (select string_agg({_LINE}, chr(10) order by t.ts, t.seq) from turns t
                     where t.session_id = r.session_id and t.ts <= r."at" and t.ts >= r."at" - 180000) x
        from ({raised}) r) s
  left join (select stage, arg_min(left(text, 5200), doc) g from guide group by stage) g on g.stage = s.stage"""


TABLES["copilot"] = _prompt_table(
    "select sig.session_id::bigint * 1048576 + sig.seq request_id, sig.session_id, sig.ts \"at\", signal_type, words, reason, l.stage "
    "from sig join lapsing l on l.session_id = sig.session_id and l.seq = sig.seq"
)
TABLES["manual"] = _prompt_table(
    "select request_id, session_id, \"at\", 'manual_request' signal_type, []::varchar[] words, "
    "'El agente pidió manualmente una recomendación.' reason, stage from asked where reason is null"
)
TABLES["resp"] = f"""
  select {_ID} request_id,
         case when session_id::bigint % 9 <> 0 then
              case speaker when 'agente' then '''" ' || text || ' "''' else '"''' || text || '''"' end end raw,
         case when session_id::bigint % 9 <> 0 then
              case speaker when 'agente' then trim(text, e' \\t\\n\\r') else '''' || text || '''' end end response_text,
         case when session_id::bigint % 9 = 0 then 'timeout' end error, length(text) latency_ms
  from turns"""
TABLES["fb"] = f"""
  select {_ID} suggestion_id, session_id, session_id::bigint % 5 <> 0 owned, session_id::bigint % 2 = 0 accepted,
         case when session_id::bigint % 5 = 0 then 'nobody' else (session_id::bigint % 10)::varchar end agent_id,
         epoch_ms(ts + 30000) "at"
  from sig"""
TABLES["fbj"] = """
  select fb.*, owned and s.id is not null and fb."at" < coalesce(ended_at, timestamp '9999-01-01') ok
  from fb left join sessions s on s.id = fb.session_id"""

TABLES["walk_stream"] = (
    TABLES["walk_ttl"]
    .replace("walk_ttl", "walk_stream")
    .replace(
        "min(ts) set_at from ranked group by session_id",
        "1704067200000 + conv_id * 3600000 set_at from conversations where turn = 0",
    )
    .replace("select session_id, 0::bigint n", "select conv_id::varchar session_id, 0::bigint n")
)
RECURSIVE = {"walk", "walk_ttl", "walk_stream"}


def sql(query: str) -> str:
    """The query with the shared tables it needs, in order of definition."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                if name not in text[:0]:
                    visit(TABLES[name])

    visit(query)
    if not needed:
        return query
    parts = ", ".join(f"{name} as ({TABLES[name]})" for name in TABLES if name in needed)
    return f"with {'recursive ' if needed & RECURSIVE else ''}{parts} {query}"


_SUM = "count(*) sales_count, coalesce(sum(amount_cents), 0)::bigint total_amount_cents"
_MIN = "cast(round(sum({}) / 60000000.0) as bigint)"

Q: dict[str, str] = {}

Q["clock_validate"] = """
  select id, agent_id, action, event_at, accepted,
         case when not accepted then case action when 'CLOCKIN' then 'already_clocked_in' else 'not_clocked_in' end end error,
         last_value(case when accepted then action end ignore nulls) over w last_action,
         last_value(case when accepted then event_at end ignore nulls) over w last_at
  from judged
  window w as (partition by agent_id order by event_at, id rows between unbounded preceding and 1 preceding)"""
Q["clock_status"] = """
  select agent_id, coalesce(action = 'CLOCKIN', false) clocked_in, action last_action, event_at last_at
  from agents left join latest using (agent_id)"""
Q["clock_history"] = """
  select id, action, display_name, event_at, sheets_synced from ck where agent_id = '7'
  order by event_at desc, id desc limit 50"""
Q["clock_history_all"] = """
  select * from (select agent_id, id, action, display_name, event_at, sheets_synced,
                        row_number() over (partition by agent_id order by event_at desc, id desc) as position from ck)
  where position <= 5"""
Q["latest_per_agent"] = "select agent_id, event_at, id, display_name, action from latest"
Q["bulk_clock_out"] = f"""
  select agent_id, display_name, 'CLOCKOUT' as action, {NOW} event_at, '16:00:00' local_time
  from latest where action = 'CLOCKIN'"""
Q["clock_shifts"] = "select * from shifts"
Q["clock_shifts_clipped"] = f"""
  select *, greatest(clock_in, {FROM}) clipped_in, least(coalesce(clock_out, {NOW}), {TO}) clipped_out from shifts"""
Q["clock_summary"] = f"""
  select s.agent_id, s.display_name,
         {_MIN.format(f"epoch_us(least(coalesce(clock_out, {NOW}), {TO})) - epoch_us(greatest(clock_in, {FROM}))")}
           total_minutes,
         count(*) shifts_count, coalesce(any_value(l.action) = 'CLOCKIN', false) currently_clocked
  from shifts s left join latest l using (agent_id) group by all"""
Q["clock_shift_list"] = """
  select agent_id, display_name, clock_in, clock_out,
         cast(round((epoch_us(clock_out) - epoch_us(clock_in)) / 60000000.0) as bigint)::varchar duration_minutes
  from shifts"""
Q["clock_events_page"] = f"""
  select id, agent_id, display_name, action, event_at, sheets_synced, count(*) over () total
  from ck where event_at between {FROM} and {TO} order by event_at desc, id desc limit 40 offset 25"""
Q["clock_events_count"] = f"select count(*) total from ck where event_at between {FROM} and {TO}"
Q["clock_export"] = """
  select id, display_name || '_' || right(agent_id, 6) tab_name,
         strftime(event_at - interval 8 hour, '%Y-%m-%d') fecha, strftime(event_at - interval 8 hour, '%H:%M:%S') hora,
         action accion
  from ck"""
Q["clock_sync_apply"] = """
  select id, agent_id, case when event_type = 'signup' or value >= 200 then true else sheets_synced end sheets_synced,
         case when value >= 150 and value < 200 then 'again ' || event_type
              when event_type <> 'signup' then 'failed ' || event_type else sheets_error end sheets_error
  from ck join (select event_id id, event_type, value from events) using (id)"""
Q["clock_sync_pending"] = "select * from ck where not sheets_synced"
Q["clock_sync_report"] = """
  select id, agent_id, action, sheets_synced, sheets_error from ck order by event_at desc, id desc limit 20"""
Q["users_upsert"] = """
  select coalesce(c.c_custkey::varchar, u.agent_id) agent_id, coalesce(u.username, c.c_name) username,
         case when u.agent_id is null then c.c_mktsegment else u.avatar end avatar,
         case when c.c_custkey is null then u.ts else timestamp '2020-09-13 12:26:40' end created_at,
         coalesce(u.ts, timestamp '2020-09-13 12:26:40') updated_at
  from customer c full join (
    select (user_id + 1400)::varchar agent_id, event_type || '#' || user_id username,
           case when value < 100 then event_type end avatar, ts
    from events qualify row_number() over (partition by user_id order by ts desc) = 1
  ) u on u.agent_id = c.c_custkey::varchar"""

Q["sales_ingest"] = f"""
  select id, null::varchar discord_interaction_id, discord_message_id, null::varchar discord_guild_id,
         null::varchar discord_channel_id, agent_id, agent_name, company_code, product_code, client_name,
         floor(amount::double * 100 + 0.5)::bigint amount_cents, currency, billing_period, signature_status,
         signature_date, followup_code, null::varchar raw_text, null::varchar notes, coalesce(sold_at, {NOW}) sold_at,
         {NOW} created_at, {NOW} updated_at
  from ingest where error is null"""
Q["sales_rejects"] = "select id, agent_id, amount, signature_input, error from ingest where error is not null"
Q["sales_signature"] = """
  select id, signature_input, signature_status, signature_date, followup_code, signature_status is not null understood
  from ingest"""
Q["sales_dedup"] = """
  select id, discord_message_id, agent_id from raw r
  where discord_message_id is null
     or (y >= 1996 and id = (select min(id) from raw q where q.discord_message_id = r.discord_message_id))"""
Q["sales_duplicates"] = """
  select id, discord_message_id, agent_id from (
    select *, row_number() over (partition by discord_message_id order by id) n,
           max(case when amount = 'n/a' then 1 else 0 end) over (partition by discord_message_id) stored
    from raw where discord_message_id is not null)
  where n > 1 or stored = 1"""
Q["sales_recorded"] = """
  select id, agent_id, case when id % 4 = 0 then 'NEW_' else '' end || company_code company_code,
         case when id % 4 = 0 then 'NEW_' else '' end || company_code company_name, product_code,
         product_code product_name, floor(amount::double * 100 + 0.5)::bigint amount_cents
  from ingest where error is null
  qualify discord_message_id is null or row_number() over (partition by discord_message_id order by id) = 1"""
Q["catalog_upsert"] = """
  select 'company' kind, '' company, coalesce(c.code, w.company_code) code,
         case when w.company_code is null then c.name else w.company_code end as name,
         w.company_code is not null or c.active active, c.id::varchar known_id
  from companies c
  full join (select distinct company_code from wanted) w on w.company_code = c.code
  union all
  select 'product', coalesce(p.cc, w.company_code), coalesce(p.code, w.product_code),
         case when w.product_code is null then p.name else w.product_code end,
         w.product_code is not null or p.active, null
  from (select p.*, c.code cc from products p join companies c on c.id = p.company_id) p
  full join wanted w on w.company_code = p.cc and w.product_code = p.code"""
Q["catalog_reconcile"] = """
  select 'company' kind, '' company, coalesce(w.company_code, c.code) code, coalesce(w.company_code, c.name) as name,
         w.company_code is not null active, c.id::varchar known_id
  from companies c full join (select distinct company_code from wanted_less) w on w.company_code = c.code
  union all
  select 'product', coalesce(w.company_code, p.cc), coalesce(w.product_code, p.code), coalesce(w.product_code, p.name),
         w.product_code is not null, null
  from (select p.*, c.code cc from products p join companies c on c.id = p.company_id) p
  full join wanted_less w on w.company_code = p.cc and w.product_code = p.code"""
Q["sales_catalog"] = """
  select c.id company_id, c.code company_code, c.name company_name, p.id product_id, p.code product_code,
         p.name product_name
  from companies c left join products p on p.company_id = c.id and p.active where c.active"""
Q["followup_codes"] = """
  select code, label from codes where active and code in (select followup_code from sales) order by code"""
Q["catalog_matrix"] = """
  select c.id company_id, c.code company_code, s.code, upper(s.code[1]) || lower(s.code[2:]) as name
  from companies c join (select distinct c_mktsegment code from customer) s on true"""
Q["constraint_audit"] = """
  select * from (
    select 'transcript_turns.speaker' as rule, count(*) filter (speaker not in ('agente', 'cliente')) bad_rows from turns
    union all select 'transcript_turns.channel', count(*) filter (channel not in (0, 1)) from turns
    union all select 'clock_events.action', count(*) filter (action not in ('CLOCKIN', 'CLOCKOUT')) from ck
    union all select 'clock_events unique (id)', count(*) - count(distinct id) from ck
    union all select 'sales.amount_cents', count(*) filter (amount_cents < 0) from sales
    union all select 'sales.billing_period', count(*) filter (notes = '5-LOW') from sales
    union all select 'sales.signature_status', 0 from sales limit 7)
  union all
  select 'sales.signature_date', count(*) filter (signature_status = 'DATE' and amount_cents <= 10000000) from sales
  union all select 'sales unique (discord_message_id)', count(*) - count(distinct agent_id || '-' || year(sold_at)) from sales
  union all select 'companies unique (code)', 0
  union all select 'products unique (company_id, code)', 0
  union all select 'followup_codes unique (code)', 0
  union all select 'sales.company_id references companies', count(*) from sales
            where notes = '4-NOT SPECIFIED'
  union all select 'sales.product_id references products', 0
  union all select 'sales.followup_code references followup_codes', count(*) from sales where notes = '2-HIGH'
  union all select 'products.company_id references companies', count(*) from products where not active"""

Q["sales_enriched"] = "select * from enriched"
Q["sale_by_id"] = "select * from enriched where id = 42"
Q["sales_filtered"] = """
  select * from filtered where company_code = 'NATION_3' and product_code = 'BUILDING'"""
Q["sales_filtered_agent"] = "select * from filtered where agent_id = '12'"


def _totals(table: str) -> str:
    return f"""
  select {_SUM}, coalesce(round(avg(amount_cents)), 0)::bigint average_ticket_cents,
         count(distinct agent_id) active_agents from {table}"""


def _by(table: str, *keys: str, tail: str = "") -> str:
    return f"select {', '.join(keys)}, {_SUM} from {table} group by {', '.join(keys)} {tail}"


Q["sales_totals"] = _totals("filtered")
Q["sales_rank_closings"] = _by("filtered", "agent_id", "agent_name")
Q["sales_rank_amount"] = _by(
    "filtered", "agent_id", "agent_name",
    tail="order by total_amount_cents desc, sales_count desc, agent_id, agent_name limit 25",
)
Q["sales_by_company"] = _by("filtered", "company_code", "company_name")
Q["sales_by_product"] = _by("filtered", "company_code", "product_code", "product_name")
Q["sales_lines_totals"] = _totals("lines")
Q["sales_lines_rank_amount"] = _by("lines", "agent_id", "agent_name")
Q["sales_lines_by_company"] = _by("lines", "company_code", "company_name")
Q["sales_lines_by_product"] = _by("lines", "company_code", "product_code", "product_name")
Q["sales_summary"] = f"""
  select 'totals' part, 'all' as key, {_SUM} from filtered
  union all select 'by_closings', agent_id, {_SUM} from filtered group by agent_id, agent_name
  union all select 'by_amount', agent_id, {_SUM} from filtered group by agent_id, agent_name
  union all select 'by_company', company_code, {_SUM} from filtered group by company_code, company_name
  union all select 'by_product', company_code || '/' || product_code, {_SUM} from filtered
            group by company_code, product_code, product_name"""
Q["sales_page"] = """
  select id, agent_id, company_code, amount_cents, sold_at, count(*) over () total from filtered
  order by sold_at desc, id desc limit 30 offset 60"""
Q["sales_page_after"] = """
  select id, agent_id, company_code, amount_cents, sold_at from filtered
  where (sold_at, id) < (timestamp '1998-06-01', 1000) order by sold_at desc, id desc limit 30"""

_PATCHED = f"""
  select s.* replace (
      case when p then 'New client' else client_name end as client_name,
      case when notes = '5-LOW' and ok then floor(o_totalprice * 2 * 100 + 0.5)::bigint else amount_cents end as amount_cents,
      case when notes = '2-HIGH' and ok then 'UW' else signature_status end as signature_status,
      case when notes = '2-HIGH' and ok then null else signature_date end as signature_date,
      case when notes = '2-HIGH' and ok then 'UW' else followup_code end as followup_code,
      case when notes = '5-LOW' and ok then null else notes end as notes,
      case when ok then {NOW} else updated_at end as updated_at),
    notes = '2-HIGH' and ok moved, ok
  from (select s.*, o_totalprice, coalesce(notes in ('5-LOW', '2-HIGH'), false) and o_orderstatus <> 'F' ok,
               coalesce(notes in ('5-LOW', '2-HIGH'), false) and o_orderstatus = 'P' p
        from sales s join orders on o_orderkey = s.id) s"""
Q["sales_update"] = f"""
  select s.id, discord_interaction_id, discord_message_id, discord_guild_id, discord_channel_id, agent_id,
         agent_name, case when moved then 'NATION_99' else c.code end company_code,
         case when moved then 'NATION_99' when c.id in (select company_id from patched where ok and not moved) then c.code
              else c.name end company_name,
         p.code product_code,
         case when moved or p.id in (select product_id from patched where ok and not moved) then p.code
              else p.name end product_name,
         client_name, amount_cents, currency, billing_period, signature_status,
         signature_date::varchar signature_date, followup_code, raw_text, notes, sold_at, created_at, updated_at
  from patched s join companies c on c.id = s.company_id join products p on p.id = s.product_id"""
TABLES["patched"] = _PATCHED
Q["sales_update_missing"] = """
  select max(o_orderkey) + 1 id from orders"""
Q["sales_update_rejected"] = """
  select o_orderkey id, o_orderdate patched_at, 'invalid_client_name' error from orders
  where o_orderpriority in ('5-LOW', '2-HIGH') and o_orderstatus = 'F'"""
Q["sales_delete"] = """
  select id, agent_id, amount_cents, signature_status from sales where signature_status <> 'UW'"""
Q["sales_delete_missing"] = "select max(id) + 5 id from sales"
Q["sales_reload"] = f"""
  select id, agent_id, amount_cents, notes from sales where notes is null or notes <> '{TAG}'
  union all
  select -id - 1, agent_id, amount_cents, '{TAG}' from sales
  where signature_status = 'IMM' and billing_period = 'year'"""

Q["turns_build"] = r"""
  select session_id, seq, case when seq = 0 then 'agente' else speaker end speaker,
         case when seq = 0 then 0 else channel end::smallint channel, trim(text, e' \t\n\r') text, ts
  from turns where not contains(text, 'nicht') and trim(text, e' \t\n\r') <> ''"""
Q["sessions_silence"] = """
  select session_id, min(ts) + interval 7200 second silence_at
  from (select user_id::varchar session_id, ts, lead(ts) over (partition by user_id order by ts) nx from events)
  where nx is null or nx - ts > interval 7200 second group by session_id"""
Q["sessions_close"] = "select * from sessions"
Q["transcript_flush"] = """
  select session_id, seq, speaker, channel, text, ts from turns
  where session_id in (select id from sessions where status = 'ended')"""
Q["recent_turns"] = """
  select * exclude (mx) from (select *, max(ts) over (partition by session_id) mx from turns) where ts >= mx - 180000"""
Q["transcript_excerpt"] = f"""
  select session_id, string_agg({_LINE}, chr(10) order by ts, seq) excerpt
  from (select *, row_number() over (partition by session_id order by ts desc, seq desc) n from turns)
  where n <= 4 group by session_id"""
Q["transcript_excerpts_at"] = f"""
  select {_ID} request_id,
         case when pts >= ts + 1000 - 100000 then pl || chr(10) else '' end || line excerpt
  from (select *, lag(ts) over w pts, lag(line) over w pl from (select *, {_LINE} line from turns)
        window w as (partition by session_id order by ts, seq))"""
Q["session_status"] = """
  select agent_id, id is not null active, id session_id, started_at
  from agents left join (select * from sessions where status = 'active'
                         qualify row_number() over (partition by agent_id order by started_at desc, id desc) = 1)
  using (agent_id)"""


def _matches(*words: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"array_to_string(list_filter([{listed}], lambda w: contains(lower(text), w)), '|')"


Q["keyword_matches"] = f"""
  select session_id, seq, speaker, channel, ts, {_matches('tiontion')} opening_matches,
         {_matches('anble', 'inble')} discovery_matches, {_matches('enber')} product_matches,
         {_matches('nicht', 'thored')} objections_matches, {_matches('enung')} risk_matches,
         {_matches('erlich')} closing_matches, {_matches('queci')} "followUp_matches"
  from turns"""
Q["turn_stage_detect"] = f"""
  select session_id, seq, speaker, channel, ts, {_NAMES}[r + 1] detected_stage from ranked"""
Q["stage_progression"] = "select session_id, seq, previous_stage, stage, changed from progress"
Q["stage_changes"] = "select session_id, seq, ts, previous_stage, stage from progress where changed"
Q["current_stage"] = """
  select session_id, coalesce(arg_max(stage, ts), 'idle') stage
  from (select conv_id::varchar session_id from conversations union select agent_id from agents)
  left join progress using (session_id) group by session_id"""
Q["stage_progression_ttl"] = f"""
  select session_id, ts, seq, {_NAMES}[previous + 1] previous_stage, {_NAMES}[state + 1] stage,
         previous <> state changed
  from walk_ttl join ranked using (session_id, n)"""
Q["signals"] = """
  select session_id, seq, ts, speaker, signal_type, confidence, reason, array_to_string(words, '|') matched_keywords,
         stage
  from sig"""
Q["manual_signals"] = """
  select request_id, session_id, "at" ts, 'agente' speaker, 'manual_request' signal_type,
         1.0::double confidence, 'El agente pidió manualmente una recomendación.' reason, '' matched_keywords, stage
  from asked where reason is null"""
Q["manual_rejected"] = """
  select request_id, session_id, agent_id, "at", reason from asked where reason is not null
  union all select -1, 'none', '1', max(ts), 'session_not_found' from turns"""
Q["manual_prompts"] = "select * from manual"
Q["manual_suggestions"] = f"""
  select request_id id, session_id, trigger_type, stage, matched_keywords, transcript_excerpt,
         response_text suggestion, 'gpt_api' source, {NOW} shown_at
  from manual join resp using (request_id) where error is null"""
Q["playbook_sections"] = "select doc, level::bigint as level, heading, length(body) chars, md5(body) body_md5 from sections"
Q["stage_guidance"] = """
  select doc, stage, length(left(text, 5200)) chars, md5(left(text, 5200)) text_md5 from guide"""
Q["copilot_prompts"] = "select * from copilot"
TABLES["late_sessions"] = """
  select id, agent_id, started_at, case when id::bigint % 3 = 0 then ended_at + interval 12 hour else ended_at end ended_at
  from sessions"""
TABLES["questions"] = f"""
  select q.request_id, q.ts, q.question, arg_max(s.id, (s.started_at, s.id)) session_id
  from (select {_ID} request_id, case when session_id::bigint % 7 = 0 then 'nobody' else (session_id::bigint % 10)::varchar end agent_id,
               text question, ts + 1000 ts
        from turns where speaker = 'cliente') q
  left join late_sessions s on s.agent_id = q.agent_id and s.started_at <= epoch_ms(q.ts)
            and epoch_ms(q.ts) < coalesce(s.ended_at, timestamp '9999-01-01')
  group by all"""
Q["ask_prompts"] = f"""
  select request_id, session_id, 'Sugiere una sola frase.' system_prompt,
         '[TRANSCRIPT RECIENTE - últimos 5 minutos]' || chr(10)
         || coalesce(x, '(sin transcript disponible)') || chr(10) || chr(10)
         || '[PREGUNTA DEL AGENTE]' || chr(10) || question user_prompt
  from (select q.*, (select string_agg({_LINE}, chr(10) order by t.ts, t.seq) from turns t
                     where t.session_id = q.session_id and t.ts <= q.ts and t.ts >= q.ts - 300000) x
        from questions q)"""
Q["response_clean"] = "select request_id, response_text, error from resp"
Q["playbook_suggestions"] = """
  select session_id, signal_type trigger_type, stage, array_to_string(words, '|') matched_keywords,
         'Para asegurarme de darle una recomendación correcta, ¿qué parte le gustaría aclarar primero: '
         || 'costo, beneficios o cómo funciona la póliza?' suggestion, 'playbook' source, null::varchar model
  from sig"""
Q["suggestion_log_suggestions"] = f"""
  select request_id id, session_id, trigger_type, stage, matched_keywords, transcript_excerpt,
         response_text suggestion, 'gpt_api' source, {NOW} shown_at
  from copilot join resp using (request_id) where error is null"""
Q["suggestion_log_requests"] = f"""
  select request_id id, session_id, case when error is null then request_id end::varchar suggestion_id, 'gpt_api' provider,
         'm1' model, trigger_type, stage, system_prompt, user_prompt, transcript_excerpt, response_text, error,
         latency_ms, {NOW} created_at
  from copilot join resp using (request_id)"""
Q["suggestion_feedback"] = """
  select suggestion_id id, sig.session_id, stage, case when ok then accepted end::varchar accepted
  from sig join fbj on fbj.suggestion_id = sig.session_id::bigint * 1048576 + sig.seq"""
Q["suggestion_feedback_rejected"] = """
  select suggestion_id, agent_id, accepted, "at", 'forbidden' reason from fbj where not ok
  union all select -suggestion_id - 1, agent_id, accepted, "at", 'suggestion_not_found' from fbj"""

Q["stream_clock"] = Q["clock_validate"].replace("agent_id, action", "agent_id, display_name, action")
Q["stream_status"] = """
  select agent_id, action = 'CLOCKIN' clocked_in, action last_action, event_at last_at from latest"""
Q["stream_stages"] = f"""
  select session_id, seq, ts, speaker, {_NAMES}[previous + 1] previous_stage, {_NAMES}[state + 1] stage,
         previous <> state changed
  from walk_stream join ranked using (session_id, n)"""
Q["stream_silence"] = f"""
  with quiet as ({Q['sessions_silence']}), f as (select user_id::varchar session_id, ts from events)
  select session_id, 'closed' outcome, silence_at "at" from quiet
  where silence_at < (select max(ts) - interval 10 second from f)
     or silence_at < (select max(ts) from f where f.session_id = quiet.session_id)
  union all
  select session_id, 'rejected', ts from f join quiet using (session_id) where ts > silence_at"""
Q["stream_recent"] = f"""
  select session_id, seq, ts, case when pts >= ts - 100000 then pl || chr(10) else '' end || line excerpt
  from (select *, lag(ts) over w pts, lag(line) over w pl from (select *, {_LINE} line from turns)
        window w as (partition by session_id order by ts, seq))"""
Q["stream_transcripts"] = """
  select session_id, seq, speaker, channel, text, ts, outcome
  from (select t.*, case when e is null then case when max(ts) over (partition by session_id) + 3600000
                                                        <= least(max(ts) over (), max(e) over ()) - 10000 then 'expired' end
                         when ts <= e then 'stored' else 'late' end outcome
        from turns t left join (select conv_id::varchar session_id, 1704067200000 + conv_id * 3600000 + 226000 e
                                from conversations where turn = 5) using (session_id))
  where outcome is not null"""
Q["append_defaults"] = f"""
  select {_ID} id, session_id, text question, '' answer, {NOW} asked_at from turns where speaker = 'cliente'"""

ORACLES: dict[str, str] = {name: sql(query) for name, query in Q.items()}

# The same rows whichever keys count as hot.
for _name in ("clock_validate", "clock_shifts", "stage_progression", "stage_progression_ttl", "manual_signals"):
    ORACLES[f"{_name}_hot"] = ORACLES[_name]
