"""Secrets in texts: fixed patterns, and strings that look drawn at random.

A candidate is a run of characters of one class (hexadecimal, capitals and digits, small letters and digits, base 64). A window slides
over it; its Shannon entropy comes from counts that are brought up to date as one character leaves and another enters. Where windows
reach the class's entropy, their union is a find, unless an allow-list knows it as something else: an id, a digest that says so, a
placeholder, a row of neighbouring characters, or words.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import texts_of

Span = tuple[str, int, int]

#: The patterns whose finds always count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
#: Any run of 32 or more is a run of `[0-9a-f]+`, and none that is longer is cut by it.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    runs: re.Pattern[str]
    needs: tuple[re.Pattern[str], ...]
    width: int
    #: Bits a character. A window drawn at random has 3.4 (16 characters to draw from), 3.9 (36) or 4.1 (64) on average, with a deviation of 0.15.
    entropy: float


DIGIT, THREE_DIGITS, SMALL, LARGE = re.compile("[0-9]"), re.compile("[0-9].*[0-9].*[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
WIDTH = 20
CLASSES = (
    CharacterClass("entropy_hex", re.compile("(?<![A-Za-z0-9])(?:[0-9a-f]{20,}|[0-9A-F]{20,})(?![A-Za-z0-9])"), (DIGIT, re.compile("[A-Fa-f]")), WIDTH, 2.8),
    CharacterClass("entropy_upper", re.compile("(?<![A-Za-z0-9])[A-Z0-9]{20,}(?![A-Za-z0-9])"), (THREE_DIGITS, LARGE), WIDTH, 3.3),
    CharacterClass("entropy_lower", re.compile("(?<![A-Za-z0-9])[a-z0-9]{20,}(?![A-Za-z0-9])"), (THREE_DIGITS, SMALL), WIDTH, 3.3),
    CharacterClass("entropy_base64", re.compile("[A-Za-z0-9+/_=-]{20,}"), (DIGIT, SMALL, LARGE), WIDTH, 3.6),
)
KINDS = ("assign", "access", "hex", *[c.kind for c in CLASSES])
#: Only here can a candidate be; texts are mostly without.
ANY_RUN = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: The allow-list: what stands right before a digest or an id, whole finds, and parts of placeholders.
BEFORE = re.compile(r"(?:sha-?(?:1|224|256|384|512)|md5|crc32|etag|commit|revision|checksum|integrity|fingerprint|digest|uuid|guid|base64)[\s\"'=:,(-]{1,4}$", re.IGNORECASE)
UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PLACEHOLDER = re.compile("example|sample|placeholder|changeme|dummy|your|redacted|xxxx|0000000|1234567|abcdefg|lorem|deadbeef", re.IGNORECASE)
WORD = re.compile("[A-Z]?[a-z]{3,}|[A-Z]{6,}(?![a-z])")
VOWEL, CLUSTER = re.compile("[aeiouy]", re.IGNORECASE), re.compile("[b-df-hj-np-tv-xz]{4}", re.IGNORECASE)

#: c * log2(c) of each count in a window, in units of 2^-32, so that sums are exact however they are brought up to date.
UNIT = 1 << 32
WEIGHT = [0, 0, *[round(c * math.log2(c) * UNIT) for c in range(2, WIDTH + 1)]]


def entropies(run: str, width: int = WIDTH) -> Iterator[float]:
    """The entropy, in bits a character, of each window of a run, from the first to the last."""
    counts: dict[str, int] = {}
    weight, whole = 0, math.log2(width)
    for k, new in enumerate(run):
        c = counts.get(new, 0)
        counts[new] = c + 1
        weight += WEIGHT[c + 1] - WEIGHT[c]
        if k >= width - 1:
            yield whole - weight / (UNIT * width)
            old = run[k - width + 1]
            c = counts[old]
            counts[old] = c - 1
            weight += WEIGHT[c - 1] - WEIGHT[c]


def dense(run: str, kind: CharacterClass) -> list[tuple[int, int]]:
    """The unions of the windows that reach the class's entropy."""
    out: list[list[int]] = []
    for a, bits in enumerate(entropies(run, kind.width)):
        if bits >= kind.entropy:
            if out and a <= out[-1][1]:
                out[-1][1] = a + kind.width
            else:
                out.append([a, a + kind.width])
    return [(a, b) for a, b in out]


def neighbours(found: str) -> float:
    """The share of characters that repeat the one before or follow it in the alphabet, forwards or backwards."""
    return sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(found, found[1:])) / max(1, len(found) - 1)


def wordy(found: str) -> float:
    """The share of characters in runs of letters that read as words: long ones, with a vowel, without four consonants in a row."""
    return sum(len(w) for w in WORD.findall(found) if VOWEL.search(w) and not CLUSTER.search(w)) / len(found)


def allowed(text: str, a: int, b: int) -> bool:
    """Whether the allow-list knows a find as no secret."""
    found = text[a:b]
    if PLACEHOLDER.search(found) or neighbours(found) >= 0.5 or wordy(found) >= 0.6 or BEFORE.search(text[max(0, a - 24):a]):
        return True
    return any(m.start() <= a and b <= m.end() for m in UUID.finditer(text, max(0, a - 36), b + 36))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' finds, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] if "AKIA" in text else []
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, base: list[Span]) -> list[Span]:
    """What the windows find beside the base spans; of two classes' finds that overlap, the narrower class's counts."""
    found: list[Span] = []
    covered = bytearray(len(text) if base else 0)
    for _, a, b in base:
        covered[a:b] = b"\1" * (b - a)
    for place in ANY_RUN.finditer(text):
        if not DIGIT.search(place[0]):
            continue
        low, taken = place.start(), bytearray(len(place[0]))
        for kind in CLASSES:
            # A run is searched in its text, so that its pattern sees what stands before it.
            for m in kind.runs.finditer(text, low, place.end()):
                if not all(n.search(m[0]) for n in kind.needs):
                    continue
                for a, b in dense(m[0], kind):
                    a, b = a + m.start(), b + m.start()
                    if any(taken[a - low:b - low]) or base and all(covered[a:b]):
                        continue
                    if all(n.search(text, a, b) for n in kind.needs) and not allowed(text, a, b):
                        found.append((kind.kind, a, b))
                        taken[a - low:b - low] = b"\1" * (b - a)
    return found


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base, spans: secrets of every whole text; base are the fixed patterns' finds, spans these and the windows'.

    Spans are (kind, start, end) in code points, end exclusive, by start, then kind in the order of ``KINDS``. A find of the windows that
    lies within a base span is left out. Null or empty text: none. Repeated rows give repeated rows; rows without doc_id are dropped;
    other columns are ignored; an empty table gives an empty result. Map-only.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            every = [ordered(b + random_spans(t, b)) for t, b in zip(texts, base, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([rows(b) for b in base], kind), pa.array([rows(s) for s in every], kind)], names=["doc_id", "text", "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return texts_of(docs).mapInArrow(run, f"doc_id long, text string, base {span}, spans {span}")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base finds of each kind, the hash of the base spans, and all spans as one string."""
    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": count(kind) for kind in KINDS[:3]}
    return find(docs).withColumns(counts).select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
