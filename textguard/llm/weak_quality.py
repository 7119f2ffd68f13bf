"""Quality classifier from weak labels.

Ten heuristic labellers look at a text, and each says good, bad or nothing. Expectation-maximisation over the counts of vote patterns
of all documents estimates how often each labeller says what about good and bad texts; this gives every pattern a posterior. On a
sample of documents the posteriors train a linear scorer over hashed shapes of the text and hashed steps of its measures, and that scorer judges
every document. No gold label is used.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from textguard.llm.common import texts_of

#: Documents the linear scorer is trained on, about; at most twice as many reach the driver.
SAMPLE = 4000
FEATURES = 2048
#: A bad vote is taken to be wrong on at most this share of good texts; else rare kinds of junk, which few labellers see, count as good.
FALSE_ALARM = 0.002
#: And each labeller is taken to see at least this share of the bad texts it votes on.
LEAST_SEEN = 0.1
#: Good votes say much the same of one text (junk of one kind looks good to all who look for another): their evidence counts by this share.
GOOD_WEIGHT = 0.5
#: Fewer words, runs or lines than these are too few for a labeller that looks at shares of them.
LEAST_WORDS, LEAST_LINES = 30, 5
#: A labeller that calls more than this share of the texts it votes on bad has its false alarms estimated, without the bound above.
WIDE = 0.2
#: Where more than this share of the letters are of scripts beyond Latin (many of them without spaces), measures by words give no vote.
BEYOND_LATIN = 0.5
#: Measure, "good" if within (low, high), "bad" beyond the bounds (below, above); else no vote.
LABELLERS = [
    ("symbols", (-1.0, 0.01), (-1.0, 0.05)),
    ("capitals", (0.001, 0.08), (-1.0, 0.3)),
    ("bars", (-1.0, 0.002), (-1.0, 0.04)),
    ("shouts", (-1.0, 0.004), (-1.0, 0.02)),
    ("repeated lines", (-1.0, 0.1), (-1.0, 0.4)),
    ("repeated runs", (-1.0, 0.04), (-1.0, 0.3)),
    ("word length", (4.0, 7.5), (2.5, 12.0)),
    ("short words", (0.15, 0.6), (0.02, 0.9)),
    ("sentence ends", (0.01, 0.3), (-1.0, 0.6)),
    ("digits", (-1.0, 0.05), (-1.0, 0.25)),
]
MEASURES = [name for name, _, _ in LABELLERS]
NO_VOTE, GOOD, BAD = 0, 1, 2
SYMBOLS = b"%$#&*@^~<>{}[]=+_\\/`"
#: Bytes that go on with a code point, and the first bytes of letters of scripts beyond Latin: Greek to NKo, Indic to Khmer, kana, Han, Hangul.
GOES_ON, OTHER_SCRIPTS = bytes(range(0x80, 0xC0)), bytes([*range(0xCE, 0xE2), *range(0xE3, 0xEE)])
CAPITALS, LETTERS, DIGITS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), bytes(range(48, 58))


def shape_classes() -> bytes:
    """A class for each byte: lower letter, capital, digit, space, line end, sentence mark, shout, bar, symbol, other mark, other script, control."""
    table = bytearray([11] * 32 + [9] * 96 + [10] * 128)
    for k, chars in enumerate([bytes(range(97, 123)), CAPITALS, DIGITS, b" \t", b"\n\r", b".,;:?", b"!", b"|", SYMBOLS]):
        for c in chars:
            table[c] = k
    return bytes(table)


SHAPES = shape_classes()


def measures(raw: bytes) -> list[float]:
    """The labellers' measures of a text in UTF-8; not a number where the text is too short for one or its script has no say in it, throughout
    for an empty text. Words are as long as they have code points."""
    n, words = len(raw), raw.split()
    if not words:
        return [math.nan] * len(MEASURES)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters, long = share(LETTERS), len(words) >= LEAST_WORDS
    points, other = (raw, 0) if raw.isascii() else (raw.translate(None, GOES_ON), n - len(raw.translate(None, OTHER_SCRIPTS)))
    # One byte a code point; its letters are ASCII or first bytes.
    spelt = not other or other <= BEYOND_LATIN * (len(points) - len(points.translate(None, LETTERS)))
    sizes = [len(w) for w in points.split()] or [0]
    return [share(SYMBOLS), share(CAPITALS) / letters if letters else math.nan, share(b"|"), share(b"!"),
            1 - len(set(lines)) / len(lines) if len(lines) >= LEAST_LINES else math.nan,
            1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if long else math.nan,
            sum(sizes) / len(sizes) if spelt else math.nan, sum(k <= 3 for k in sizes) / len(sizes) if long and spelt else math.nan,
            (raw.count(b".") + raw.count(b"?")) / len(words) if long and spelt else math.nan, share(DIGITS) if long else math.nan]


def votes(found: list[float]) -> list[int]:
    return [NO_VOTE if math.isnan(x) else BAD if not below <= x <= above else GOOD if low <= x <= high else NO_VOTE
            for x, (_, (low, high), (below, above)) in zip(found, LABELLERS, strict=True)]


def pattern(found: list[float]) -> int:
    return sum(v * 3**k for k, v in enumerate(votes(found)))


def label_model(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Probability of a bad text for each vote pattern, by expectation-maximisation over all patterns and their counts.

    Each labeller has its own chance of a bad vote on bad and on good texts, among the texts it votes on; no vote is no evidence. The
    bounds ``FALSE_ALARM`` and ``LEAST_SEEN`` keep the classes from changing places. A labeller over ``WIDE`` is first taken to fire alike on
    both, and its chances are found from the others'. No pattern: nothing.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes.tolist()], float)
    said = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    bad, good = (said == BAD).astype(float), (said == GOOD).astype(float)
    fires = n @ bad / (n @ (bad + good) + 20)
    most = np.where(fires > WIDE, np.minimum(fires, 0.95), FALSE_ALARM)
    prior, seen, alarm = 0.15, np.maximum(0.25, most), most
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + bad @ np.log(seen / alarm) + GOOD_WEIGHT * (good @ np.log((1 - seen) / (1 - alarm)))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        of_bad, of_good = post * n, (1 - post) * n
        prior = (of_bad.sum() + 1.5) / (n.sum() + 10)
        seen = np.clip((of_bad @ bad + 1) / (of_bad @ (bad + good) + 4), LEAST_SEEN, 0.95)
        alarm = np.clip((of_good @ bad + 0.01) / (of_good @ (bad + good) + 4), 1e-4, most)
    return dict(zip(codes.tolist(), post.tolist(), strict=True))


def features(raw: bytes, found: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their weights: how often each run of three shapes stands in the text, and which step each measure reaches."""
    shape = np.frombuffer(raw.translate(SHAPES), np.uint8).astype(np.int64)
    steps = np.array([zlib.crc32(f"{name}:{'' if math.isnan(x) else math.floor(8 * math.log2(1 + 20 * x))}".encode()) % FEATURES for name, x in zip(MEASURES, found, strict=True)])
    if len(shape) < 3:
        return steps, np.ones(len(steps))
    seen = np.bincount(shape[:-2] * 144 + shape[1:-1] * 12 + shape[2:], minlength=1728)
    runs = np.flatnonzero(seen)
    slots = (runs * 2654435761 >> 7) % FEATURES
    return np.r_[slots, steps], np.r_[np.sqrt(seen[runs] / len(shape)), np.ones(len(steps))]


def train(rows: list[Row], bad: dict[int, float], rounds: int = 300) -> np.ndarray:
    """Weights (the last one the bias) of a logistic scorer for bad texts, by gradient descent on the soft labels."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        return weights
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for r, row in zip(x, rows, strict=True):
        np.add.at(r, row["slots"], row["weights"])
    x[:, -1] = 1
    y = np.array([bad[row["pattern"]] for row in rows])
    m = v = np.zeros(FEATURES + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        g = x.T @ (p - y) / len(y) + 1e-4 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


class Judge(NamedTuple):
    """A fitted classifier: probability of a bad text for each vote pattern, and the scorer's weights."""

    bad: dict[int, float]
    weights: np.ndarray

    def quality(self, raw: bytes, found: list[float]) -> float:
        slots, x = features(raw, found)
        return 1 / (1 + math.exp(max(-30.0, min(30.0, float(self.weights[slots] @ x + self.weights[-1])))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Judge:
    """Label model over all documents, scorer from a sample of about ``sample``. The driver gets the counts of at most 3^10 vote patterns
    and the features of at most 2 * ``sample`` documents. An empty table gives a judge that finds every text good."""
    texts = texts_of(docs)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(measures(t.encode())) for t in batch.column(1).to_pylist()], pa.int64())], names=["pattern"])

    counts = {r["pattern"]: r["count"] for r in texts.mapInArrow(vote, "pattern long").groupBy("pattern").count().collect()}
    bad, total = label_model(counts), sum(counts.values())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                raw = t.encode()
                found = measures(raw)
                slots, weights = features(raw, found)
                rows.append({"pattern": pattern(found), "slots": slots.tolist(), "weights": weights.tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("pattern", pa.int64()), ("slots", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))]))

    share = min(1.0, sample / max(1, total))
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return Judge(bad, train(drawn.mapInArrow(describe, "pattern long, slots array<long>, weights array<double>").limit(2 * sample).collect(), bad))


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality_score (1: surely good), weak_score (the label model's own), votes (g, b or - for each labeller), keep.

    keep: quality_score >= 0.5. On a null or empty text no labeller votes; it is judged like any other. Repeated rows give repeated rows;
    rows without doc_id are dropped; other columns are ignored; an empty table gives an empty result. Two passes over the texts, no
    shuffle of them.
    """
    judge = fit(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, weak, said = [], [], []
            for t in batch.column(1).to_pylist():
                raw = t.encode()
                found = measures(raw)
                good.append(judge.quality(raw, found))
                weak.append(1 - judge.bad[pattern(found)])
                said.append("".join("-gb"[v] for v in votes(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.float64()), pa.array(weak, pa.float64()), pa.array(said, pa.string()), pa.array([g >= 0.5 for g in good], pa.bool_())],
                                             names=["doc_id", "quality_score", "weak_score", "votes", "keep"])

    return texts_of(docs).mapInArrow(run, "doc_id long, quality_score double, weak_score double, votes string, keep boolean")


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` keeps."""
    judge, at = fit(docs, sample), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([judge.quality(raw, measures(raw)) >= 0.5 for raw in raws], pa.bool_()))

    return docs.where("doc_id is not null").mapInArrow(run, docs.schema)
