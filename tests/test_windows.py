"""Windows that work in chunks give what one big window would, whatever the chunk."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textguard.operators import context
from textguard.plans import activity as A
from textguard.plans import quota, rollups


@pytest.fixture(scope="module")
def events(spark):
    """400 events; one key has a third of them, with long and short pauses."""
    rng, t, rows = random.Random(5), datetime(2024, 1, 1, 22, 0), []
    for i in range(400):
        t += timedelta(seconds=rng.choice([1, 2, 5, 20, 70, 400, 5000]))
        rows.append((i, "hot" if i % 3 == 0 else f"k{rng.randrange(9)}", t, rng.choice(["a", "b", None]), "x" * rng.randrange(0, 300)))
    return spark.createDataFrame(rows, "id long, k string, ts timestamp, v string, text string").cache()


@pytest.mark.parametrize("chunk", [3, 50, 10 ** 6])
def test_lookback(events, chunk):
    got = context.lookback(events, "k", "id", 12, "v", "prev", chunk)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(-12, -1)
    want = events.withColumn("want", F.collect_list(F.struct("v")).over(w))
    joined = got.select("id", "prev").join(want.select("id", F.expr("want.v").alias("want")), "id")
    assert joined.count() == 400 and joined.filter("NOT prev <=> want").count() == 0


def test_newest(events):
    got = {(r.k, r.id) for r in context.newest(events, "k", "id", 5).collect()}
    rows = events.collect()
    want = {(k, i) for k in {r.k for r in rows} for i in sorted((r.id for r in rows if r.k == k), reverse=True)[:5]}
    assert got == want


def by_key(events):
    out = {}
    for r in sorted(events.collect(), key=lambda r: r.id):
        out.setdefault(r.k, []).append(r)
    return out


@pytest.mark.parametrize("chunk", [A.SECOND * 30, A.HOUR])
def test_transition_and_debounce(events, chunk):
    kept = {r.id for r in A.transition_filter(events, "k", "ts", "v", "id", chunk).collect()}
    quiet = {r.id for r in A.debounce(events, "k", "ts", "id", 60, chunk).collect()}
    want_kept, want_quiet = set(), set()
    for rows in by_key(events).values():
        for i, r in enumerate(rows):
            if i == 0 or rows[i - 1].v != r.v:
                want_kept.add(r.id)
            if i + 1 == len(rows) or (rows[i + 1].ts - r.ts).total_seconds() >= 60:
                want_quiet.add(r.id)
    assert kept == want_kept and quiet == want_quiet


@pytest.mark.parametrize("chunk", [A.SECOND * 40, A.HOUR])
def test_typing_sessions(events, chunk):
    typed = events.withColumn("app", F.expr("id % 40 div 20"))
    got = {(r.k, r.started): (r.edits, r.text) for r in A.typing_sessions(typed, "k", "app", "ts", "text", "id", 120, 800, chunk).collect()}
    want = {}
    for k, rows in by_key(typed).items():
        run = []
        for r in rows + [None]:
            if run and (r is None or r.app != run[-1].app or (r.ts - run[-1].ts).total_seconds() > 120):
                want[k, run[0].ts] = (len(run), "".join(x.text for x in run)[-800:])
                run = []
            run.append(r)
    assert got == want


def test_running_quota_by_brute_force(events):
    got = {r.id: (r.in_minute, r.in_day) for r in A.running_quota(events, "k", "ts", "id").collect()}
    for rows in by_key(events).values():
        for i, r in enumerate(rows):
            minute = sum(1 for x in rows if 0 <= (r.ts - x.ts).total_seconds() <= 60)
            day = sum(1 for x in rows[:i + 1] if x.ts.date() == r.ts.date())
            assert got[r.id] == (minute, day)


def test_allow_window_by_brute_force(events):
    allows = events.filter("v = 'a'")
    got = {r.id for r in A.allow_window(events, allows, "k", "ts").collect()}
    rows = events.collect()
    want = {m.id for m in rows if not any(a.v == "a" and a.k == m.k and 0 <= (m.ts - a.ts).total_seconds() <= 600 for a in rows)}
    assert got == want


def test_rate_limit_by_brute_force(spark):
    rng, t, rows = random.Random(9), datetime(2024, 1, 1, 23, 50), []
    for i in range(500):
        t += timedelta(seconds=rng.choice([1, 3, 9, 30, 65, 300]))
        rows.append((i, "hot" if i % 3 else "cold", t, rng.choice(["ok", "ok", "ok", "failed", "limited"])))
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, outcome string")
    got = {r.id: r.granted for r in quota.rate_limit(df, "k", "ts", "id", 3, 40, "outcome").collect()}
    want = {}
    for key in ("hot", "cold"):
        stamps, used, day = [], 0, None
        for i, k, at, outcome in rows:
            if k != key:
                continue
            if at.date() != day:
                day, used = at.date(), 0
            stamps = [s for s in stamps if (at - s).total_seconds() <= 60]
            want[i] = used < 40 and len(stamps) < 3
            if want[i]:
                if outcome != "failed":
                    used, stamps = used + 1, [*stamps, at]
                if outcome == "limited":
                    stamps = [at] * 3
    assert got == want


@pytest.mark.parametrize("bins", [1, 7, 256])
def test_percentiles_are_index_picks(spark, bins):
    rng = random.Random(3)
    values = [round(rng.uniform(0, 90), 1) for _ in range(333)]
    df = spark.createDataFrame([("a" if i % 4 else "b", v) for i, v in enumerate(values)], "by string, latency_ms double")
    got = {r.by: (r.median, r.p95) for r in rollups.latency_percentiles(df, "by", bins=bins).collect()}
    for name in "ab":
        mine = sorted(v for i, v in enumerate(values) if ("a" if i % 4 else "b") == name)
        assert got[name] == (mine[len(mine) // 2], mine[int(0.95 * len(mine))])


def test_context_carried_over_chunks_is_the_same(spark):
    from textguard.operators.normalize import normalize
    raw = spark.range(60).selectExpr("id % 3 AS conv_id", "id AS turn", "concat('these words ', id, ' make some lines') AS text")
    done = normalize(raw)
    want = {r.turn: r for r in context.with_context(done).collect()}
    for r in context.with_context(done, chunk=4, source=raw).collect():
        assert r.context_size == want[r.turn].context_size
        assert [sorted(w) for w in r.context_words] == [sorted(w) for w in want[r.turn].context_words]
