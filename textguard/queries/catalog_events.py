"""Queries over activity events, installs and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import lexicon as L
from textguard.operators import policy
from textguard.plans import activity as A
from textguard.plans import quota, rollups
from textguard.queries import frames
from textguard.queries import oracle_text as O
from textguard.queries.registry import query
from textguard.sources import readers, sinks

ACT = """act AS (SELECT event_id, user_id::VARCHAR AS install_id, CASE event_type WHEN 'click' THEN 'caught' WHEN 'view' THEN 'covered'
    WHEN 'purchase' THEN 'rephrased' WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'sent_anyway' ELSE event_type END AS kind,
    least(value / 50e0, 1e0) AS score, CASE WHEN least(value / 50e0, 1e0) < 0.02e0 THEN NULL WHEN least(value / 50e0, 1e0) < 0.55e0 THEN 'Sharp'
    WHEN least(value / 50e0, 1e0) < 0.78e0 THEN 'Harsh' ELSE 'Cruel' END AS severity,
    regexp_extract(props, '"k": *(\\d+)', 1)::INTEGER AS text_length, ts AS occurred_at FROM events)"""
TR = """tr AS (SELECT event_id, user_id::VARCHAR AS install_id, ts AS occurred_at, ts::DATE AS day,
    CASE WHEN value < 15 THEN 'rules' WHEN value < 60 THEN 'on_device' WHEN value < 150 THEN 'context' ELSE 'cache' END AS tier,
    value AS latency_ms, value >= 60 AND value < 150 AS escalated FROM events)"""
INST = """inst AS (SELECT c_custkey::VARCHAR AS install_id,
    CASE c_custkey % 7 WHEN 0 THEN 'light' WHEN 1 THEN 'attentive' WHEN 2 THEN 'strict' ELSE 'balanced' END AS sensitivity,
    c_acctbal > 0 AS outgoing_on, c_mktsegment = 'BUILDING' AS incoming_on,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE sha256(c_name || ':' || (100000 + c_custkey)::VARCHAR) END AS passcode_digest,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS passcode_salt, c_custkey % 2 = 0 AS share_stats,
    timestamp '2024-01-01' + to_days((c_custkey % 20)::INTEGER) AS created_at, timestamp '2024-01-01' + to_days((20 + c_nationkey)::INTEGER) AS last_seen_at FROM customer)"""
DAILY = """daily AS (SELECT install_id, day, count(*) FILTER (kind = 'caught') AS caught, count(*) FILTER (kind = 'rephrased') AS rewritten,
    count(*) FILTER (kind = 'deleted') AS dropped, count(*) FILTER (kind = 'sent_anyway') AS sent_anyway, count(*) FILTER (kind = 'covered') AS covered,
    count(*) FILTER (tier = 'rules') AS tier_rules, count(*) FILTER (tier = 'on_device') AS tier_device, count(*) FILTER (tier = 'context') AS tier_context,
    max(occurred_at) AS updated_at FROM (SELECT install_id, occurred_at::DATE AS day, kind, NULL AS tier, occurred_at FROM act
        UNION ALL SELECT install_id, day, NULL, tier, occurred_at FROM tr) GROUP BY install_id, day)"""
COLS = ", ".join(rollups.COUNTERS)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.daily_stats_build(frames.activity(spark, sf), frames.traces(spark, sf))


# ------------------------------------------------------------------ sinks
@query("sink_daily_stats", f"""WITH {ACT}, {TR}, {DAILY}, both_ AS (SELECT * FROM daily UNION ALL
    SELECT * REPLACE (caught + 1 AS caught, updated_at + INTERVAL 1 HOUR AS updated_at) FROM daily WHERE day >= DATE '2024-01-15')
SELECT install_id, day, {COLS}, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY install_id, day ORDER BY updated_at DESC) AS k FROM both_) WHERE k = 1""")
def sink_daily_stats(spark, sf):
    stored = daily(spark, sf)
    later = stored.filter("day >= DATE'2024-01-15'").withColumns({
        "caught": F.col("caught") + 1, "updated_at": F.expr("updated_at + INTERVAL 1 HOUR")})
    return sinks.merge_daily_stats(stored, later).select("install_id", "day", *rollups.COUNTERS, "updated_at")


@query("sink_events", f"WITH {ACT} SELECT event_id, install_id, kind, round(least(greatest(score * 1.2e0, 0e0), 1e0), 6) AS score, occurred_at::DATE AS day FROM act")
def sink_events(spark, sf):
    df = frames.activity(spark, sf).withColumn("score", F.expr("score * 1.2e0"))
    path = frames.folder(spark, "events")
    sinks.sink_events(df, path)
    return spark.read.parquet(path).select("event_id", "install_id", "kind", F.round("score", 6).alias("score"), "day")


@query("sink_installs", f"""WITH {INST}, seen AS (SELECT i.* REPLACE ('attentive' AS sensitivity, f.lo AS created_at, f.hi AS last_seen_at) FROM inst i
    JOIN (SELECT user_id::VARCHAR AS install_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1) f USING (install_id)),
u AS (SELECT * FROM inst UNION ALL SELECT * FROM seen)
SELECT install_id, arg_max(sensitivity, last_seen_at) AS sensitivity, min(created_at) AS created_at, max(last_seen_at) AS last_seen_at FROM u GROUP BY install_id""")
def sink_installs(spark, sf):
    stored = frames.installs(spark, sf)
    span = frames.activity(spark, sf).groupBy("install_id").agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    seen = stored.join(span, "install_id").withColumns({
        "sensitivity": F.lit("attentive"), "created_at": F.col("lo"), "last_seen_at": F.col("hi")}).select(*stored.columns)
    first, second = frames.folder(spark, "installs"), frames.folder(spark, "installs")
    sinks.sink_installs(stored, first + "-none", first)
    return sinks.sink_installs(seen, first, second).select("install_id", "sensitivity", "created_at", "last_seen_at")


LABELS = " ".join(f"WHEN '{k}' THEN {O.q(v)}" for k, v in sinks.KIND_LABELS.items())
ENTRY = f"""concat_ws(chr(10), '### ' || strftime(occurred_at, '%Y-%m-%d %H:%M'), '', '- **What happened:** ' || CASE kind {LABELS} ELSE kind END,
    CASE WHEN score > 0 THEN '- **Severity:** ' || CASE WHEN score < 0.55e0 THEN 'Sharp' WHEN score < 0.78e0 THEN 'Harsh' ELSE 'Cruel' END
        || ' (' || floor(score * 100)::INTEGER || '%)' END,
    CASE WHEN app IS NOT NULL THEN '- **Where:** ' || app END, CASE WHEN reason <> '' THEN '- **Why it was flagged:** ' || reason END,
    CASE WHEN text IS NOT NULL THEN '- **Message:** ' || text END, '')"""


@query("report_markdown", f"""WITH {ACT}, e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'app ' || event_id % 5 END AS app,
    CASE WHEN event_id % 2 = 0 THEN coalesce(severity, '') END AS reason, 'event ' || event_id AS text FROM act),
r AS (SELECT install_id, event_id, {ENTRY} AS entry, -epoch_us(occurred_at) AS k FROM e)
SELECT install_id, event_id, k AS place, md5(entry) AS digest FROM r""")
def report_markdown(spark, sf):
    df = frames.activity(spark, sf).withColumns({
        "app": F.expr("if(event_id % 3 = 0, concat('app ', event_id % 5), null)"),
        "reason": F.expr("if(event_id % 2 = 0, coalesce(severity, ''), null)"),
        "text": F.expr("concat('event ', event_id)"), "rewritten": F.lit(None).cast("string")})
    return sinks.report_entries(df).select("install_id", "event_id", "place", F.md5("entry").alias("digest"))


@query("review_verdicts", """WITH r AS (SELECT event_id, least(greatest(value / 50e0 - 0.1e0, 0e0), 1e0) AS s, least(value / 100e0, 1e0) AS c,
    event_id % 5 = 0 AS own, event_id % 4 AS k FROM events WHERE event_id % 7 <> 0)
SELECT event_id, round(CASE WHEN own THEN 0e0 ELSE s END, 6) AS score, round(c, 6) AS confidence,
    CASE k WHEN 0 THEN '' WHEN 1 THEN 'insult' WHEN 2 THEN 'threat,slur' ELSE 'exclusion' END AS categories, own AS self_directed FROM r""")
def review_verdicts(spark, sf):
    """Reviewer JSON made from the events; every seventh reply is cut short and goes to quarantine."""
    cats = "CASE event_id % 4 WHEN 0 THEN array('nonsense') WHEN 1 THEN array('insult') WHEN 2 THEN array('threat', 'slur') ELSE array('exclusion', 'x') END"
    reply = f"""to_json(named_struct('score', value / 50e0 - 0.1e0, 'confidence', value / 100e0, 'categories', {cats},
        'rationale', concat(' because ', event_id, ' '), 'self_directed_distress', event_id % 5 = 0))"""
    raw = frames.table(spark, sf, "events").select("event_id", F.expr(f"if(event_id % 7 = 0, left({reply}, 20), {reply})").alias("raw"))
    good, _ = readers.review_verdicts(raw, "event_id")
    return good.select("event_id", F.round("r_score", 6).alias("score"), F.round("r_confidence", 6).alias("confidence"),
                       F.array_join("r_categories", ",").alias("categories"), F.col("r_self_directed").alias("self_directed"))


@query("review_quarantine", "SELECT event_id FROM events WHERE event_id % 7 = 0")
def review_quarantine(spark, sf):
    raw = frames.table(spark, sf, "events").select("event_id", F.expr(
        """if(event_id % 7 = 0, '{"score": 0.5, "conf', concat('{"score": 0.5, "confidence": 1, "categories": [], "rationale": "r', event_id, '", "self_directed_distress": false}'))""").alias("raw"))
    return readers.review_verdicts(raw, "event_id")[1].select("event_id")


@query("telemetry_snapshot", f"WITH {TR} SELECT day, tier, count(*) AS n FROM tr WHERE day = DATE '2024-01-20' GROUP BY day, tier")
def telemetry_snapshot(spark, sf):
    per = frames.traces(spark, sf).groupBy("day", "tier").agg(F.count("*").alias("n"))
    path = frames.folder(spark, "telemetry")
    sinks.telemetry_snapshot(per, path)
    return sinks.reload_snapshot(spark.read.parquet(path), "DATE'2024-01-20'").select(*per.columns)


# ------------------------------------------------------------------ gates and checks
APPS = f"({O.arr(L.EXCLUDED_APPS)} || ['chat.one', 'chat.two', 'mail.app'])[event_id % 27 + 1]"


def with_app(spark: SparkSession, sf: str) -> DataFrame:
    apps = F.expr(f"get({frames.words([*L.EXCLUDED_APPS, 'chat.one', 'chat.two', 'mail.app'])}, cast(event_id % 27 AS int))")
    return frames.activity(spark, sf).withColumn("app_id", apps)


@query("excluded_apps", f"WITH {ACT}, a AS (SELECT event_id, {APPS} AS app_id FROM act) SELECT * FROM a WHERE app_id NOT IN (SELECT unnest({O.arr(L.EXCLUDED_APPS)}))")
def excluded_apps(spark, sf):
    return A.excluded_apps(with_app(spark, sf)).select("event_id", "app_id")


@query("length_gate", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 8 AND 2000 AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) >= 3")
def length_gate(spark, sf):
    return A.length_gate(frames.table(spark, sf, "documents"), "text", 8, 2000, min_words=3).select("doc_id")


@query("direction_filter", f"WITH {ACT} SELECT CASE WHEN kind = 'covered' THEN 'incoming' ELSE 'outgoing' END AS direction, count(*) AS n, round(sum(score), 4) AS score FROM act GROUP BY 1")
def direction_filter(spark, sf):
    df = frames.activity(spark, sf)
    sides = [A.direction_filter(df, d).withColumn("direction", F.lit(d)) for d in ("incoming", "outgoing")]
    return sides[0].unionByName(sides[1]).groupBy("direction").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("consent_gate", f"WITH {ACT}, {INST} SELECT event_id FROM act WHERE install_id IN (SELECT install_id FROM inst WHERE share_stats)")
def consent_gate(spark, sf):
    return A.consent_gate(frames.activity(spark, sf), frames.installs(spark, sf)).select("event_id")


@query("constraint_check", f"""WITH {INST} SELECT install_id, concat_ws(',', CASE WHEN sensitivity NOT IN ('light', 'balanced', 'attentive') THEN 'sensitivity' END,
    CASE WHEN (passcode_digest IS NULL) <> (passcode_salt IS NULL) THEN 'passcode_complete' END) AS violations FROM inst
WHERE sensitivity NOT IN ('light', 'balanced', 'attentive') OR (passcode_digest IS NULL) <> (passcode_salt IS NULL)""")
def constraint_check(spark, sf):
    _, bad = A.constraint_check(frames.installs(spark, sf), "installs")
    return bad.select("install_id", F.array_join("violations", ",").alias("violations"))


@query("constraint_check_events", f"""WITH {ACT}, w AS (SELECT event_id, score * 1.3e0 AS score, severity, text_length - 5 AS text_length, kind FROM act)
SELECT event_id, concat_ws(',', CASE WHEN NOT score BETWEEN 0 AND 1 THEN 'score' END, CASE WHEN text_length < 0 THEN 'text_length' END) AS violations
FROM w WHERE NOT score BETWEEN 0 AND 1 OR text_length < 0""")
def constraint_check_events(spark, sf):
    df = frames.activity(spark, sf).withColumns({"score": F.expr("score * 1.3e0"), "text_length": F.col("text_length") - 5,
                                                 "tier": F.lit(None).cast("string")})
    return A.constraint_check(df, "events")[1].select("event_id", F.array_join("violations", ",").alias("violations"))


@query("referential_check", f"WITH {ACT}, {INST} SELECT event_id, install_id FROM act WHERE install_id NOT IN (SELECT install_id FROM inst WHERE outgoing_on)")
def referential_check(spark, sf):
    return A.referential_check(frames.activity(spark, sf), frames.installs(spark, sf).filter("outgoing_on")).select("event_id", "install_id")


@query("cascade_delete", f"WITH {ACT}, {INST} SELECT install_id, count(*) AS n FROM act WHERE install_id NOT IN (SELECT install_id FROM inst WHERE incoming_on) GROUP BY install_id")
def cascade_delete(spark, sf):
    left = A.cascade_delete(frames.activity(spark, sf), frames.installs(spark, sf).filter("incoming_on"))
    return left.groupBy("install_id").agg(F.count("*").alias("n"))


@query("acceptance_window", f"WITH {ACT} SELECT event_id, occurred_at FROM act WHERE occurred_at > timestamp '2024-01-21 12:00:00' - INTERVAL 1 DAY")
def acceptance_window(spark, sf):
    return A.acceptance_window(frames.activity(spark, sf), "timestamp'2024-01-21 12:00:00'").select("event_id", "occurred_at")


@query("acceptance_window_daily", f"WITH {ACT}, {TR}, {DAILY} SELECT install_id, day, caught FROM daily WHERE day BETWEEN DATE '2024-01-18' AND DATE '2024-01-21'")
def acceptance_window_daily(spark, sf):
    return A.acceptance_window(daily(spark, sf), "DATE'2024-01-20'", "daily_stats").select("install_id", "day", "caught")


# ------------------------------------------------------------------ roll-ups
@query("daily_totals", f"""WITH {ACT}, {TR}, {DAILY} SELECT day, count(*) AS installs, {', '.join(f'sum({c})::BIGINT AS {c}' for c in rollups.COUNTERS)},
    round(100e0 * sum(rewritten + dropped) / nullif(sum(caught), 0), 1) AS pct_reconsidered FROM daily GROUP BY day""")
def daily_totals(spark, sf):
    return rollups.daily_totals(daily(spark, sf))


OVERVIEW = f"""WITH {ACT}, {INST} SELECT i.install_id, any_value(i.sensitivity) AS sensitivity, any_value(i.outgoing_on) AS outgoing_on, any_value(i.incoming_on) AS incoming_on,
    any_value(i.passcode_digest) IS NOT NULL AS passcode_set, any_value(i.created_at) AS created_at, any_value(i.last_seen_at) AS last_seen_at,
    count(event_id) FILTER (kind = 'caught') AS caught, count(event_id) FILTER (kind = 'rephrased') AS rephrased,
    count(event_id) FILTER (kind = 'covered') AS covered, count(event_id) FILTER (kind = 'sent_anyway') AS sent_anyway,
    round(avg(score) FILTER (kind IN ('caught', 'covered')), 2) AS avg_severity FROM inst i LEFT JOIN act USING (install_id) GROUP BY i.install_id"""


@query("install_overview", OVERVIEW)
def install_overview(spark, sf):
    return rollups.install_overview(frames.installs(spark, sf), frames.activity(spark, sf))


@query("severity_mix", f"WITH {ACT} SELECT occurred_at::DATE AS day, severity, count(*) AS events FROM act WHERE severity IS NOT NULL GROUP BY 1, 2")
def severity_mix(spark, sf):
    return rollups.severity_mix(frames.activity(spark, sf))


@query("tier_telemetry", f"""WITH {TR}, p AS (SELECT day, tier, count(*) AS n, sum(latency_ms) AS ls, avg(latency_ms) AS la, count(*) FILTER (escalated) AS escalated FROM tr GROUP BY day, tier)
SELECT day, tier, n, round(ls, 4) AS latency_sum, round(la, 4) AS latency_avg, escalated, round(n / sum(n) OVER (PARTITION BY day), 6) AS share,
    (100 * sum(escalated) OVER (PARTITION BY day) // sum(n) OVER (PARTITION BY day))::INTEGER AS day_escalated_pct FROM p""")
def tier_telemetry(spark, sf):
    df = rollups.tier_telemetry(frames.traces(spark, sf))
    return df.withColumns({"latency_sum": F.round("latency_sum", 4), "latency_avg": F.round("latency_avg", 4), "share": F.round("share", 6)})


@query("outcome_counters", f"""WITH {ACT} SELECT occurred_at::DATE AS day, count(*) FILTER (kind = 'caught') AS holds, count(*) FILTER (kind = 'sent_anyway') AS sent_anyway,
    count(*) FILTER (kind = 'rephrased') AS edited, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'covered') AS covered FROM act GROUP BY 1""")
def outcome_counters(spark, sf):
    return rollups.outcome_counters(frames.activity(spark, sf))


@query("daily_stats_build", f"WITH {ACT}, {TR}, {DAILY} SELECT install_id, day, {COLS}, updated_at FROM daily")
def daily_stats_build(spark, sf):
    return daily(spark, sf)


@query("latency_percentiles", f"""WITH {TR}, r AS (SELECT tier, latency_ms, row_number() OVER (PARTITION BY tier ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY tier) AS n FROM tr)
SELECT tier, any_value(n) AS n, max(latency_ms) FILTER (k = n // 2) AS median, max(latency_ms) FILTER (k = floor(0.95e0 * n)::BIGINT) AS p95,
    max(latency_ms) FILTER (k = n // 2) < 40 AND max(latency_ms) FILTER (k = floor(0.95e0 * n)::BIGINT) < 100 AS within_limits FROM r GROUP BY tier""")
def latency_percentiles(spark, sf):
    return rollups.latency_percentiles(frames.traces(spark, sf), "tier", median_limit=40, p95_limit=100)


@query("worst_examples", f"""WITH {ACT}, r AS (SELECT kind, 'event ' || event_id AS t, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS k FROM act WHERE score > 0.9)
SELECT kind, string_agg(t, ' | ' ORDER BY k) AS worst FROM r WHERE k <= 5 GROUP BY kind""")
def worst_examples(spark, sf):
    df = frames.activity(spark, sf).filter("score > 0.9").withColumn("t", F.expr("concat('event ', event_id)"))
    return rollups.worst_examples(df, "kind", "event_id", "t")


# ------------------------------------------------------------------ event-time windows
@query("transition_filter", f"""WITH {ACT}, l AS (SELECT *, lag(kind) OVER (PARTITION BY install_id ORDER BY occurred_at, event_id) AS p FROM act)
SELECT event_id, install_id, kind FROM l WHERE p IS NULL OR p <> kind""")
def transition_filter(spark, sf):
    return A.transition_filter(frames.activity(spark, sf), "install_id", "occurred_at", "kind", "event_id").select("event_id", "install_id", "kind")


@query("debounce", f"""WITH {ACT}, l AS (SELECT *, lead(occurred_at) OVER (PARTITION BY kind ORDER BY occurred_at, event_id) AS nx FROM act)
SELECT event_id, kind FROM l WHERE nx IS NULL OR nx - occurred_at >= INTERVAL 600 SECOND""")
def debounce(spark, sf):
    return A.debounce(frames.activity(spark, sf), "kind", "occurred_at", "event_id", 600).select("event_id", "kind")


@query("running_quota", f"""WITH {ACT}, q AS (SELECT event_id, kind, count(*) OVER (PARTITION BY kind ORDER BY occurred_at RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_minute,
    row_number() OVER (PARTITION BY kind, occurred_at::DATE ORDER BY occurred_at, event_id) AS in_day FROM act)
SELECT *, in_minute > 2 OR in_day > 40 AS over_budget FROM q""")
def running_quota(spark, sf):
    df = A.running_quota(frames.activity(spark, sf), "kind", "occurred_at", "event_id", 2, 40)
    return df.select("event_id", "kind", "in_minute", "in_day", "over_budget")


@query("recent_per_key", f"""WITH {ACT}, r AS (SELECT event_id, install_id, row_number() OVER (PARTITION BY install_id ORDER BY occurred_at DESC, event_id DESC) AS rank FROM act)
SELECT event_id, install_id, rank FROM r WHERE rank <= 60""")
def recent_per_key(spark, sf):
    return A.recent_per_key(frames.activity(spark, sf), "install_id", "occurred_at", "event_id").select(
        "event_id", "install_id", F.col("rank").cast("bigint").alias("rank"))


# The tables hold events minutes apart, so the pause that ends a session is scaled up to hours.
SESSION_GAP = 6 * 3600


@query("typing_sessions", f"""WITH {ACT}, k AS (SELECT *, kind || ' ' || text_length || ' ' AS typed, text_length % 2 AS app FROM act),
l AS (SELECT *, lag(app) OVER w AS pa, lag(occurred_at) OVER w AS pt FROM k WINDOW w AS (PARTITION BY install_id ORDER BY occurred_at, event_id)),
s AS (SELECT *, sum(CASE WHEN pt IS NULL OR pa <> app OR occurred_at - pt > INTERVAL {SESSION_GAP} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY install_id ORDER BY occurred_at, event_id) AS session FROM l)
SELECT install_id, session::BIGINT AS session, any_value(app) AS app, min(occurred_at) AS started, max(occurred_at) AS ended, count(*) AS edits,
    right(string_agg(typed, '' ORDER BY occurred_at, event_id), 800) AS text FROM s GROUP BY install_id, session""")
def typing_sessions(spark, sf):
    df = frames.activity(spark, sf).withColumns({"typed": F.expr("concat(kind, ' ', text_length, ' ')"), "app": F.expr("text_length % 2")})
    return A.typing_sessions(df, "install_id", "app", "occurred_at", "typed", "event_id", SESSION_GAP)


@query("allow_window", f"""WITH {ACT} SELECT m.event_id, m.install_id FROM act m WHERE m.kind <> 'sent_anyway' AND NOT EXISTS (
    SELECT 1 FROM act a WHERE a.kind = 'sent_anyway' AND a.install_id = m.install_id AND m.occurred_at >= a.occurred_at AND m.occurred_at <= a.occurred_at + INTERVAL 600 SECOND)""")
def allow_window(spark, sf):
    df = frames.activity(spark, sf)
    return A.allow_window(df.filter("kind != 'sent_anyway'"), df.filter("kind = 'sent_anyway'"), "install_id", "occurred_at").select("event_id", "install_id")


@query("tail_covers", r"""WITH u AS (SELECT conv_id * 100000 + turn AS session, text AS typed FROM conversations),
f AS (SELECT conv_id * 100000 + turn AS session, CASE WHEN turn % 2 = conv_id % 2 THEN text ELSE left(text, length(text) // 2) END AS field FROM conversations),
j AS (SELECT session, right(regexp_replace(lower(typed), '\s', '', 'g'), 12) AS tail, regexp_replace(lower(field), '\s', '', 'g') AS field FROM u JOIN f USING (session))
SELECT session, length(tail) < 3 OR contains(field, tail) AS covers FROM j""")
def tail_covers(spark, sf):
    conv = frames.table(spark, sf, "conversations")
    typed = conv.select(F.expr("conv_id * 100000 + turn").alias("session"), F.col("text").alias("typed"))
    field = conv.select(F.expr("conv_id * 100000 + turn").alias("session"), F.expr("if(turn % 2 = conv_id % 2, text, left(text, char_length(text) div 2))").alias("field"))
    return A.tail_covers(typed, field, "session", "typed", "field").select("session", "covers")


@query("top_events", f"WITH {ACT} SELECT event_id, kind, occurred_at FROM act ORDER BY occurred_at DESC, event_id DESC LIMIT 60")
def top_events(spark, sf):
    return A.top_events(frames.activity(spark, sf), 60).select("event_id", "kind", "occurred_at")


@query("budgeted_batch", f"WITH {ACT} SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY event_id) > 80 AS deferred FROM act")
def budgeted_batch(spark, sf):
    return A.budgeted_batch(frames.activity(spark, sf), "kind", "event_id").select("event_id", "kind", "deferred")


@query("rate_limit")
def rate_limit(spark, sf):
    df = frames.activity(spark, sf).select("event_id", "kind", "occurred_at")
    return quota.rate_limit(df, "kind", "occurred_at", "event_id", 2, 40)


# ------------------------------------------------------------------ labels of time
@query("age_label", """SELECT event_id, CASE WHEN s < 2 THEN 'now' WHEN s < 60 THEN s::VARCHAR || 's' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm'
    ELSE strftime(ts, '%H:%M:%S') END AS age FROM (SELECT event_id, ts, (epoch(date_trunc('second', timestamp '2024-01-31 00:00:00')) - epoch(date_trunc('second', ts)))::BIGINT AS s FROM events)""")
def age_label(spark, sf):
    df = frames.table(spark, sf, "events").withColumn("s", F.expr("unix_seconds(timestamp'2024-01-31 00:00:00') - unix_seconds(cast(ts AS timestamp))"))
    return df.select("event_id", policy.age_label("s", "date_format(ts, 'HH:mm:ss')").alias("age"))


@query("speed_label", """SELECT event_id, CASE WHEN ms < 1 THEN '<1 ms' WHEN ms < 1000 THEN round_even(ms, 0)::BIGINT || ' ms' ELSE printf('%.1f s', round_even(ms / 1000, 1)) END AS speed
FROM (SELECT event_id, value * 10 AS ms FROM events)""")
def speed_label(spark, sf):
    df = frames.table(spark, sf, "events").withColumn("ms", F.expr("value * 10"))
    return df.select("event_id", policy.speed_label("ms").alias("speed"))
