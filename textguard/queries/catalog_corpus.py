"""Queries over corpora, files and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators import cascade, normalize
from textguard.operators.phrase_index import stored
from textguard.plans import corpus, evaluate, rollups, traces
from textguard.queries import catalog_events as E
from textguard.queries import catalog_text as X
from textguard.queries import frames
from textguard.queries import oracle_text as O
from textguard.queries.registry import query
from textguard.sources import readers, sinks
from textguard.streaming import streams


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with three classes and six flags, all taken from the labels."""
    df = frames.table(spark, sf, "labels")
    flags = {"toxic": "toxic", "obscene": "if(toxic = 1 AND doc_id % 2 = 0, 1, 0)", "insult": "if(toxic = 1 AND doc_id % 3 = 0, 1, 0)",
             "threat": "if(toxic = 1 AND doc_id % 7 = 0, 1, 0)", "identity_hate": "0", "severe_toxic": "if(toxic = 1 AND doc_id % 11 = 0, 1, 0)"}
    return df.select("doc_id", "quality", F.expr("CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END").alias("class"),
                     *[F.expr(e).alias(n) for n, e in flags.items()])


LAB = """lab AS (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS class, toxic,
    CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS obscene, CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS insult,
    CASE WHEN toxic = 1 AND doc_id % 7 = 0 THEN 1 ELSE 0 END AS threat, 0 AS identity_hate, CASE WHEN toxic = 1 AND doc_id % 11 = 0 THEN 1 ELSE 0 END AS severe_toxic FROM labels)"""
CLS = """cls AS (SELECT doc_id, CASE WHEN insult = 1 OR threat = 1 OR identity_hate = 1 OR severe_toxic = 1 THEN 'pos' WHEN toxic = 0 AND obscene = 0 THEN 'neg'
    WHEN obscene = 1 AND insult = 0 THEN 'swear' END AS cls FROM lab)"""


def draw_sql(key: str, seed: int) -> str:
    return f"(('0x' || left(md5({key}::VARCHAR || ':{seed}'), 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("label_3class", f"WITH {LAB} SELECT doc_id, CASE class WHEN 0 THEN 'harmful' ELSE 'ok' END AS label FROM lab WHERE class IN (0, 2)")
def label_3class(spark, sf):
    return corpus.label_3class(labelled(spark, sf)).select("doc_id", "label")


@query("label_multi", f"WITH {LAB}, {CLS} SELECT doc_id, cls FROM cls WHERE cls IS NOT NULL")
def label_multi(spark, sf):
    return corpus.label_multi(labelled(spark, sf)).select("doc_id", "cls")


@query("class_cap", f"""WITH {LAB}, {CLS}, r AS (SELECT doc_id, cls, row_number() OVER (PARTITION BY cls ORDER BY {draw_sql('doc_id', 11)}, doc_id) AS k FROM cls WHERE cls IS NOT NULL)
SELECT doc_id, cls FROM r WHERE cls = 'pos' OR (cls = 'neg' AND k <= 100) OR (cls = 'swear' AND k <= 10)""")
def class_cap(spark, sf):
    return corpus.class_cap(corpus.label_multi(labelled(spark, sf)), {"neg": 100, "swear": 10}).select("doc_id", "cls")


def tail_rows(tails) -> str:
    return f"(SELECT unnest({O.arr(tails)}) AS tail)"


@query("template_expand", rf"SELECT item_id, tail, md5(trim(regexp_replace(text || ' ' || tail, '\s+', ' ', 'g'))) AS digest FROM benchmark, {tail_rows(corpus.TEMPLATE_TAILS)}")
def template_expand(spark, sf):
    return corpus.template_expand(frames.table(spark, sf, "benchmark")).select("item_id", "tail", F.md5("expanded").alias("digest"))


# A small grammar in our own words.
FRAMES = ["{you} {fill}{noun}{tail}", "what a {noun}{tail}", "this {thing} is so {adj}{tail}", "{you} look a little tired{tail}"]
SLOTS = {"you": ["you're", "ur", "you are"], "fill": ["a ", "such a ", "the biggest "], "noun": ["idiot", "clown", "loser", "genius", "artist"],
         "adj": ["bad", "awful", "easy"], "thing": ["essay", "exam", "printer"], "tail": ["", " lol", "!", " honestly"]}


@query("slot_fill")
def slot_fill(spark, sf):
    return corpus.slot_fill(frames.table(spark, sf, "events").select("event_id"), FRAMES, SLOTS, "event_id")


@query("oversample", "SELECT item_id, copy FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS copy)")
def oversample(spark, sf):
    return corpus.oversample(frames.table(spark, sf, "benchmark")).select("item_id", "copy")


UNION = f"""WITH {LAB}, u AS (SELECT 'documents' AS origin, CASE class WHEN 0 THEN 'harmful' ELSE 'ok' END AS label FROM lab WHERE class IN (0, 2)
    UNION ALL SELECT 'curated', 'ok' FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS copy))"""


def union(spark: SparkSession, sf: str) -> DataFrame:
    labels = corpus.label_3class(labelled(spark, sf)).select("doc_id", "label")
    texts = X.docs(spark, sf).join(labels, "doc_id").select("text", "label")
    curated = frames.table(spark, sf, "benchmark").select("text", F.lit("ok").alias("label"))
    return corpus.corpus_union(("documents", texts, 1), ("curated", curated, 4))


@query("corpus_union", f"""WITH {LAB} SELECT origin, label, md5(text) AS digest, count(*) AS n FROM (
    SELECT 'documents' AS origin, CASE class WHEN 0 THEN 'harmful' ELSE 'ok' END AS label, text FROM lab JOIN documents USING (doc_id) WHERE class IN (0, 2)
    UNION ALL SELECT 'curated', 'ok', text FROM benchmark, (SELECT unnest([1, 2, 3, 4]) AS copy)) GROUP BY ALL""")
def corpus_union(spark, sf):
    return union(spark, sf).groupBy("origin", "label", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("label_counts", f"{UNION} SELECT origin, label, count(*) AS n FROM u GROUP BY origin, label")
def label_counts(spark, sf):
    return corpus.label_counts(union(spark, sf))


@query("exact_dedupe", "SELECT md5(text) AS digest FROM documents GROUP BY text")
def exact_dedupe(spark, sf):
    return corpus.exact_dedupe(X.docs(spark, sf).select("text"), "text").select(F.md5("text").alias("digest"))


@query("split", f"SELECT doc_id, CASE WHEN {draw_sql('doc_id', 11)} < 0.85 THEN 'train' ELSE 'test' END AS side FROM documents")
def split(spark, sf):
    train, test = corpus.split(frames.table(spark, sf, "documents").select("doc_id"), "doc_id")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def training(spark: SparkSession, sf: str) -> DataFrame:
    labels = frames.table(spark, sf, "labels").select("doc_id", F.expr("if(toxic = 1, 'harmful', 'ok')").alias("label"))
    rows = normalize.normalize(X.docs(spark, sf).join(labels, "doc_id"), keep=["tokens"])
    rows = rows.select("doc_id", F.expr("coalesce(tokens, cast(array() AS array<string>))").alias("tokens"), "label")  # a null text has no words
    return stored(rows, frames.folder(spark, "training"))  # the stages of the classifier each read it again


@query("train_bow")
def train_bow(spark, sf):
    """A classifier trained on 85 % of the labelled documents, counted on the rest."""
    train, test = corpus.split(training(spark, sf), "doc_id")
    score = corpus.model_scorer(corpus.train_bow(train, path=frames.folder(spark, "bow")))
    judged = score(test).select(F.expr("if(label = 'harmful', 1, 0)").alias("actual"), F.expr("if(model_score >= 0.5, 1, 0)").alias("predicted"))
    return evaluate.evaluate_classifier(judged)


@query("probe_table", f"""WITH {O.MESSAGES}, {O.norm_ctes('msg')}, {O.L10}
SELECT carrier, count(*) AS n, round(max(model_score), 6) AS max_score FROM (SELECT l10.model_score, ({O.arr(frames.CARRIERS)})[(msg.conv_id * 13 + (msg.seq // 100000) * 7 + (msg.seq % 100000) // 4) % {len(frames.CARRIERS)} + 1] AS carrier
    FROM l10 JOIN msg USING (id)) GROUP BY carrier""")
def probe_table(spark, sf):
    """What the scorer says of each probe line, wherever the messages carry it."""
    probe = f"get({frames.words(frames.CARRIERS)}, cast((conv_id * 13 + (seq div 100000) * 7 + (seq % 100000) div 4) % {len(frames.CARRIERS)} AS int))"
    found = corpus.probe_table(X.normal_messages(spark, sf).withColumn("carrier", F.expr(probe)), "carrier", cascade.lexical_scorer)
    return found.withColumn("max_score", F.round("max_score", 6))


# ------------------------------------------------------------------ files: written, read back
@query("read_label_csv", f"""SELECT CASE WHEN toxic = 1 THEN '1' ELSE '0' END AS label, md5(text || chr(10) || '"quoted", text') AS digest FROM documents JOIN labels USING (doc_id)""")
def read_label_csv(spark, sf):
    path = frames.folder(spark, "csv")
    df = X.docs(spark, sf).join(frames.table(spark, sf, "labels"), "doc_id")
    df.select("doc_id", F.expr("""concat(text, '\n"quoted", text')""").alias("comment_text"), F.col("toxic").alias("label")).write.option(
        "header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.read_label_csv(spark, path, "comment_text", "label").select("label", F.md5("text").alias("digest"))


@query("read_fixtures", "SELECT conv_id::VARCHAR || '-' || turn AS id, CASE WHEN role = 'user' THEN 'hold' ELSE 'pass' END AS expect, md5(text) AS digest, 2::INTEGER AS lines FROM conversations")
def read_fixtures(spark, sf):
    """Fixture files of one conversation each, written as JSON and read back as cases."""
    path = frames.folder(spark, "fixtures")
    case = F.struct(F.expr("concat(conv_id, '-', turn)").alias("id"), F.lit("t").alias("title"), F.lit("").alias("note"),
                    F.expr("if(role = 'user', 'hold', 'pass')").alias("expect"), F.array("role", "text").alias("context"), F.col("text").alias("draft"))
    # One case per file entry keeps every line small; a file holds as many entries as its task writes.
    frames.table(spark, sf, "conversations").select(F.lit(1).alias("version"), F.array(case).alias("cases")).write.json(path)
    cases = readers.read_fixtures(spark, path, lines=True)
    return cases.select("id", "expect", F.md5("draft").alias("digest"), F.size("context").alias("lines"))


@query("read_wordlist", f"""WITH w AS (SELECT DISTINCT unnest({O.tokens('lower(text)')}) AS term FROM benchmark)
SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM w""")
def read_wordlist(spark, sf):
    """The benchmark's distinct words as a word list in range-sorted text files, read back with line numbers."""
    from textguard.functions import text as T
    path = frames.folder(spark, "words")
    words = frames.table(spark, sf, "benchmark").select(F.explode(T.tokenize(F.lower("text"))).alias("value")).distinct()
    words.orderBy("value").write.text(path)
    return readers.read_wordlist(spark, path).select("term", F.col("id").cast("bigint").alias("id"))


@query("read_curated", "SELECT md5(text) AS digest, 'ok' AS label FROM benchmark")
def read_curated(spark, sf):
    path = frames.folder(spark, "curated")
    rows = F.array(F.struct("text", F.lit("ok").alias("label"))).alias("rows")
    frames.table(spark, sf, "benchmark").select(rows).write.json(path)
    return readers.read_curated(spark, path, lines=True).select(F.md5("text").alias("digest"), "label")


@query("write_train_json", f"{UNION} SELECT label, count(*) AS n FROM u GROUP BY label")
def write_train_json(spark, sf):
    return sinks.write_train_json(union(spark, sf).select("text", "label"), frames.folder(spark, "train"))


# ------------------------------------------------------------------ streams
#: Covers whatever order the files of a table are read in.
ANY_ORDER = "4000 days"


def streamed(spark: SparkSession, df: DataFrame, build, mode: str = "append", ends: str | None = None) -> DataFrame:
    """A batch frame written as files, streamed through ``build`` to its end, and read back.

    ``ends`` names the event time (a timestamp, or microseconds) of a stream that holds rows until the watermark: a last row
    far ahead, without a key, then lets all others go.
    """
    source, sink, state = (frames.folder(spark, n) for n in ("in", "out", "state"))
    df.write.parquet(source)
    stream = readers.message_stream(spark, source, df.schema, files_per_trigger=4)

    def run() -> None:
        q = (build(stream).writeStream.outputMode(mode).format("parquet").option("path", sink)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    if ends:
        ahead = F.expr("timestamp'2200-01-01'")
        last = [(F.unix_micros(ahead) if f.dataType.typeName() == "long" else ahead) if f.name == ends else F.lit(None) for f in df.schema]
        spark.range(1).select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(last, df.schema)]).coalesce(1).write.mode("append").parquet(source)
        run()
    return spark.read.parquet(sink)


def replayed(spark: SparkSession, df: DataFrame | list[DataFrame], ts: str, build, slices: int = 3, mode: str = "append", write=None, ahead: dict[str, str] | None = None) -> DataFrame:
    """Batch frames streamed as they came about: slices of event time arrive one after the other, each as unordered files.

    The stream is started anew for each slice and goes on from its checkpoint. A last row far ahead, without other values than those
    of ``ahead``, then passes the watermark over all the rest. (A join's key needs a value there: rows without one are
    dropped before the watermark sees them.) ``build`` makes the result of the streams; ``write`` may start it otherwise than into a table.
    """
    dfs = df if isinstance(df, list) else [df]
    sink, state = (frames.folder(spark, n) for n in ("out", "state"))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    feeds = []
    edges = dfs[0].agg(F.percentile_approx(at, [k / slices for k in range(1, slices)])).first()[0] or []
    for one in dfs:
        staged, source = frames.folder(spark, "staged"), frames.folder(spark, "in")
        one.withColumn("_slice", sum((F.when(at > e, 1).otherwise(0) for e in edges), F.lit(0))).write.partitionBy("_slice").parquet(staged)
        far = {ts: F.expr("timestamp'2200-01-01'"), **{c: F.lit(v) for c, v in (ahead or {}).items()}}
        end = spark.range(1).select(*[far.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in one.schema])
        parts = spark.read.schema(f"{schema_text(one)}, _slice int").parquet(staged)
        feeds.append((source, one.schema, [*[parts.where(F.col("_slice") == k).drop("_slice") for k in range(len(edges) + 1)], end]))

    def into_table(out: DataFrame):
        return out.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()

    for step in range(len(edges) + 2):
        for source, _, parts in feeds:
            parts[step].write.mode("append").parquet(source)
        out = build(*[readers.message_stream(spark, source, schema, files_per_trigger=100_000) for source, schema, _ in feeds])
        (write(out, sink, state) if write else into_table(out)).awaitTermination()
    return sink if write else spark.read.parquet(sink)


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


@query("stream_moderate", f"WITH {O.MESSAGES}, {O.local_ctes('msg')} SELECT msg_id, round(score, 6) AS score, {O.held('balanced')} AS held FROM local")
def stream_moderate(spark, sf):
    out = streamed(spark, frames.messages(spark, sf).select("msg_id", "ts", "text"), lambda s: streams.stream_moderate(s).select("msg_id", "score", "held"))
    return out.select("msg_id", F.round("score", 6).alias("score"), "held")


@query("offer_once", f"WITH {O.MESSAGES}, {O.tier0_ctes('msg')} SELECT DISTINCT squashed FROM t0 WHERE distress")
def offer_once(spark, sf):
    df = frames.messages(spark, sf).select("msg_id", "ts", "text")
    return streamed(spark, df, lambda s: streams.offer_once(s, delay="400 days").select("squashed"))


@query("cover_once", f"WITH {E.ACT} SELECT DISTINCT install_id, severity FROM act WHERE kind = 'covered' AND severity IS NOT NULL")
def cover_once(spark, sf):
    df = frames.activity(spark, sf).filter("kind = 'covered' AND severity IS NOT NULL").select(
        F.col("occurred_at").cast("timestamp").alias("ts"), "install_id", "severity", F.concat_ws("/", "install_id", "severity").alias("cover"))
    return streamed(spark, df, lambda s: streams.cover_once(s, "cover", delay="400 days")).select("install_id", "severity")


@query("stream_sessions", f"""WITH {E.ACT}, l AS (SELECT *, lag(occurred_at) OVER (PARTITION BY install_id, kind ORDER BY occurred_at) AS p FROM act),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR occurred_at - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY install_id, kind ORDER BY occurred_at) AS g FROM l)
SELECT install_id, kind, min(occurred_at) AS started, max(occurred_at) + INTERVAL 12 HOUR AS ended, count(*) AS edits FROM s GROUP BY install_id, kind, g""")
def stream_sessions(spark, sf):
    """Sessions as the stream closes them, slice by slice."""
    df = frames.activity(spark, sf).select("install_id", "kind", F.col("occurred_at").cast("timestamp").alias("ts"))
    return replayed(spark, df, "ts", lambda s: streams.stream_sessions(s, "install_id", "kind", gap="12 hours", delay="1 hour"))


@query("stream_daily_rollup", f"WITH {E.ACT}, {E.TR}, {E.DAILY} SELECT install_id, day, {E.COLS}, updated_at FROM daily")
def stream_daily_rollup(spark, sf):
    """Events and traces streamed into the daily table, batch by batch; no row comes after the last, as counters are in update mode."""
    events = frames.activity(spark, sf).select("install_id", "kind", F.lit(None).cast("string").alias("tier"), F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    traces = frames.traces(spark, sf).select("install_id", F.lit(None).cast("string").alias("kind"), "tier", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    path = replayed(spark, events.unionByName(traces), "occurred_at", lambda s: s.where("install_id IS NOT NULL"),
                    write=lambda out, sink, state: streams.push_daily_rollup(out, sink, state, availableNow=True))
    return streams.daily_rollup_table(spark, path).select("install_id", "day", *rollups.COUNTERS, F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("stream_rate_limit")
def stream_rate_limit(spark, sf):
    df = frames.activity(spark, sf).select("event_id", "kind", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("at"))
    return streamed(spark, df, lambda s: streams.rate_limit(s, "kind", "at", "event_id", 2, 40, ordered=True, delay=ANY_ORDER), ends="at")


@query("stream_context", """SELECT conv_id, turn, len(c) AS n, md5(array_to_string(c, '|')) AS context FROM (SELECT conv_id, turn,
    coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), []) AS c FROM conversations)""")
def stream_context(spark, sf):
    """A conversation's turns follow each other by a minute, and conversations start ten minutes apart."""
    df = frames.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.expr(f"timestamp_seconds(unix_seconds(timestamp'{frames.DAY} 00:00:00') + conv_id * 600 + turn * 60)").alias("ts"))
    out = replayed(spark, df, "ts", lambda s: streams.stream_context(s, "conv_id", "turn", ts="ts", delay="1 hour", width="1 hour", ordered=True))
    return out.select("conv_id", "turn", F.size("context").cast("bigint").alias("n"), F.md5(F.array_join("context", "|")).alias("context"))


@query("debounced_stream", f"""WITH {E.ACT}, l AS (SELECT *, lead(occurred_at) OVER (PARTITION BY install_id ORDER BY occurred_at, event_id) AS nx FROM act)
SELECT event_id, install_id, kind FROM l WHERE nx IS NULL OR nx - occurred_at >= CASE WHEN kind = 'covered' THEN INTERVAL 60 SECOND ELSE INTERVAL 600 SECOND END""")
def debounced_stream(spark, sf):
    """Drafts are the kinds of events; one that ends in a full stop ('covered.') has the short gap."""
    df = frames.activity(spark, sf).select("event_id", "install_id", F.col("occurred_at").cast("timestamp").alias("ts"), F.expr("if(kind = 'covered', 'covered.', kind)").alias("text"))
    out = replayed(spark, df, "ts", lambda s: streams.debounced_stream(
        s, "install_id", gap_seconds=600, short_gap_seconds=60, delay="1 hour", width="1 day", ordered=True, tie=["event_id"]))
    return out.select("event_id", "install_id", F.expr("rtrim('.', text)").alias("kind"))


LATE = """late_in AS (SELECT event_id, ts::DATE AS day, ts + to_hours((event_id % 40)::INTEGER) AS received_at, ts AS occurred_at FROM events),
daily_in AS (SELECT event_id, day, day + to_days((event_id % 5)::INTEGER) AS received_at FROM late_in)"""


@query("late_policy", f"""WITH {LATE} SELECT 'events' AS rule, event_id, CASE WHEN occurred_at > received_at - INTERVAL 1 DAY THEN 'in time' ELSE 'late' END AS verdict FROM late_in
UNION ALL SELECT 'daily', event_id, CASE WHEN day > received_at - INTERVAL 2 DAY THEN 'in time' ELSE 'late' END FROM daily_in""")
def late_policy(spark, sf):
    """Both rules over streams: events a day late, daily rows two; each row lands in one of two tables."""
    df = frames.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("occurred_at"))
    events = df.withColumn("received_at", F.expr("occurred_at + make_interval(0, 0, 0, 0, cast(event_id % 40 AS int), 0, 0)"))
    daily = df.select("event_id", F.date_trunc("day", "occurred_at").alias("occurred_at")).withColumn("received_at", F.expr("occurred_at + make_interval(0, 0, 0, cast(event_id % 5 AS int))"))
    out = []
    for rule, rows, limit in (("events", events, "1 DAY"), ("daily", daily, "2 DAY")):
        path = replayed(spark, rows, "occurred_at", lambda s: s.where("event_id IS NOT NULL"), slices=2, write=lambda o, sink, state, limit=limit: streams.push_late_split(
            o, sink, state, limit=limit, received="received_at", availableNow=True))
        for name, verdict in (("accepted", "in time"), ("quarantine", "late")):
            out.append(spark.read.schema("event_id long").parquet(f"{path}/{name}").select(F.lit(rule).alias("rule"), "event_id", F.lit(verdict).alias("verdict")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("allow_ttl", f"""WITH {E.ACT} SELECT m.event_id, m.install_id FROM act m WHERE m.kind <> 'sent_anyway' AND NOT EXISTS (
    SELECT 1 FROM act a WHERE a.kind = 'sent_anyway' AND a.install_id = m.install_id AND m.occurred_at >= a.occurred_at AND m.occurred_at <= a.occurred_at + INTERVAL 12 HOUR)""")
def allow_ttl(spark, sf):
    """Messages and allows as two streams. The events are sparse, so an allow lasts half a day here."""
    df = frames.activity(spark, sf).select("event_id", "install_id", "kind", F.col("occurred_at").cast("timestamp").alias("ts"))
    messages, allows = df.filter("kind != 'sent_anyway'").drop("kind"), df.filter("kind = 'sent_anyway'").select("install_id", "ts")
    out = replayed(spark, [messages, allows], "ts", lambda m, a: streams.allow_ttl(m, a, "install_id", ttl="12 hours", delay="1 hour"), ahead={"install_id": "nobody"})
    return out.where("event_id IS NOT NULL").select("event_id", "install_id")


@query("stream_trace_hook", f"""WITH {E.TR} SELECT tier, count(*) AS n, round(sum(latency_ms), 3) AS latency_sum, round(avg(latency_ms), 6) AS latency_avg, count(*) FILTER (escalated) AS escalated,
    round(count(*) / sum(count(*)) OVER (), 9) AS share FROM tr GROUP BY tier""")
def stream_trace_hook(spark, sf):
    """Traces streamed into their table; the telemetry is what the listener saw go by."""
    df = frames.traces(spark, sf).select("event_id", F.col("occurred_at").cast("timestamp").alias("occurred_at"), "day", "tier", "latency_ms", "escalated")
    totals = traces.Totals()
    spark.streams.addListener(totals)
    try:
        def write(out, sink, state):
            return traces.stream_traces(out, sink, state, availableNow=True)

        replayed(spark, df, "occurred_at", lambda s: s.where("event_id IS NOT NULL"), write=write)
        totals.ended.wait(60)
    finally:
        spark.streams.removeListener(totals)
    return traces.telemetry(spark, totals.sums).withColumns({"latency_sum": F.round("latency_sum", 3), "latency_avg": F.round("latency_avg", 6), "share": F.round("share", 9)})
