"""Personal data: fixed patterns, and a character tagger that finds what they miss.

The tagger is a bidirectional LSTM over characters with a linear-chain CRF on top, written and trained in numpy on generated texts
with labelled spans (a fixed seed: every run trains the same model). Gates are clipped straight lines instead of
sigmoids. Texts are cut into overlapping windows that are read side by side; each window is decoded by itself, and at each character
the window in which it stands farthest from a border decides. Runs over the whole text then make the spans.
"""
from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone")
HIDDEN, WINDOW, OVERLAP, LANES = 12, 256, 32, 2048
TRAIN_STEPS, TRAIN_BATCH, TRAIN_LENGTH, LEARNING_RATE = 450, 64, 64, 0.03
#: Slope of the clipped lines beyond their ends, and the most that an error carries back over one step, while training.
LEAK, MOST_CARRIED = 0.02, 0.05
# The fixed patterns of the contract.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGITS = b"0123456789"
#: A span that the tagger adds has so many characters, and so many digits or (an address) an @, or "at" and a dot, or (an ip) groups of hex digits.
LEAST_CHARS, LEAST_DIGITS = 7, 4
AT = re.compile(r"@|\bat\b.*(?:\bdot\b|\.[a-z])", re.DOTALL | re.IGNORECASE)
#: Hex groups between colons, some left out or at least four.
GROUPS = re.compile(r"(?<![0-9a-z])(?:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*|(?:[0-9a-f]{1,4}:){3,}[0-9a-f]{1,4})(?![0-9a-z])", re.IGNORECASE)
#: What every such span holds at least one of: a digit, an @, the end of an address in words, two colons of an ip.
SIGN = re.compile(r"[0-9@]|\bdot\b|\.[a-z]|:[0-9a-f]{0,4}:", re.IGNORECASE)
#: An address in words with capitals, which the tagger has not been trained on: its text is read once more in small letters.
LOUD = re.compile(r"\b(?:AT|At|aT)\b.{0,80}?(?:\b(?i:dot)\b|\.[A-Za-z])|\bat\b.{0,80}?(?:\b(?:DOT|Dot)\b|\.[A-Z])", re.DOTALL)
SMALL = {k: k + 32 for k in range(65, 91)}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def fits(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by kind, then start (code points, end exclusive); failing matches are dropped."""
    raw = text.encode("utf-8")
    some_digits = len(raw) != len(raw.translate(None, DIGITS))
    asked = {"email": b"@" in raw, "ip": some_digits and b"." in raw, "card": some_digits, "phone": some_digits and b"+" in raw}
    return [(kind, m.start(), m.end()) for kind in KINDS if asked[kind] for m in PATTERNS[kind].finditer(text) if fits(kind, m[0])]


# Labelled texts to train on.

def syllables(r: random.Random) -> str:
    parts = ("the", "on", "er", "in", "ti", "ou", "re", "an", "ha", "ed", "sh", "st", "ly", "nd", "es", "or", "ble", "ch", "ge", "ei", "ä", "ü", "é", "ció", "ñ", "la", "qu", "eau", "ver", "of", "to", "at")
    word = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    return r.choice((word, word, word, word.capitalize(), word.upper() if r.random() < 0.3 else word))


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def personal(r: random.Random) -> tuple[str, str]:
    """(text, kind) of one piece of personal data, in the patterns' forms and in others."""
    name = "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 9)))
    name += r.choice(("", "." + digits(r, 2), digits(r, 2), "_" + name[:3]))
    host, top = r.choice(("mail" + digits(r, 1), "example", "post", name[:4] or "web", "inbox")), r.choice(("com", "org", "net", "de", "example.com", "co.uk", "fr"))
    kind = r.choice(KINDS)
    if kind == "email":
        return r.choice((f"{name}@{host}.{top}",) * 3 + (f"{name} [at] {host} [dot] {top}", f"{name}(at){host}.{top}", f"{name} at {host} dot {top.split('.')[0]}", f"{name} @ {host}.{top}")), kind
    if kind == "ip":
        four = ".".join(str(r.randint(0, 255)) for _ in range(4))
        six = ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))
        return r.choice((four, four, four, six, four.replace(".", "[.]"))), kind
    if kind == "card":
        d, sep = r.choice("3456") + digits(r, 15), r.choice(("", "", " ", "-", "."))
        return sep.join(d[k:k + 4] for k in range(0, 16, 4)), kind
    a, b, c, land = digits(r, 3), digits(r, 3), digits(r, 4), r.choice(("1", "44", "49", "33", "34"))
    return r.choice((f"+{land} ({a}) {b}-{c}",) * 2 + (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{land} {a} {b} {c}", f"00{land} {a} {b}{c}", f"+{land}{a}{b}{c}")), kind


def harmless(r: random.Random) -> str:
    """Figures and signs that are no personal data."""
    d = lambda n: digits(r, n)
    return r.choice((f"{r.randint(1900, 2030)}", f"{d(2)}.{d(2)}.{r.randint(1990, 2030)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}", f"version {d(1)}.{d(1)}.{d(1)}", f"{d(2)}:{d(2)}", f"${d(3)}.{d(2)}",
                     f"{d(1)},{d(3)},{d(3)}", f"{d(2)}%", f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}", f"AKIA{''.join(r.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}",
                     f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(26))}"', f"{d(2)}-{d(2)}", f"no. {d(5)}", "%%% the&&& on***", "a | b | c", "OUT!! OF!!", f"({d(2)})", f"x{d(6)}", d(r.randint(5, 9))))


def labelled(r: random.Random, length: int) -> tuple[str, list[Span]]:
    """A text of exactly ``length`` characters, and its spans (what the end cuts off is left unlabelled)."""
    text, spans = "", []
    while len(text) < length:
        x = r.random()
        if x < 0.16:
            piece, kind = personal(r)
            if len(text) + len(piece) <= length:
                spans.append((kind, len(text), len(text) + len(piece)))
            elif len(text):
                text += "\0" * (length - len(text))
                break
        else:
            piece = harmless(r) if x < 0.28 else syllables(r)
        text += piece + r.choice((" ", " ", " ", " ", ", ", ". ", "\n"))
    return text[:length], [s for s in spans if s[2] <= length]


# The network.

PAD, CLASSES = 0, 99


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point below 1024; beyond, the last one's: none, printable ASCII each by itself, controls, letters, others."""
    table = np.full(1025, 98, np.int64)
    table[:32], table[127], table[0] = 96, 96, PAD
    table[32:127] = np.arange(1, 96)
    table[0xC0:0x250] = 97
    table[[0xD7, 0xF7]] = 98
    table[0x370:1024] = 97
    return table


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return class_table()[np.minimum(points, 1024)]




def run_lstm(wx: np.ndarray, wh: np.ndarray, x: np.ndarray, trace: list | None = None) -> Iterator[np.ndarray]:
    """Hidden states, one (lanes, HIDDEN) array for each row of ``x`` (steps, lanes); the yielded array is used again."""
    lanes, n = x.shape[1], wh.shape[0]
    h, c = (np.zeros((lanes, n), np.float32) for _ in range(2))
    z, g, t = np.empty((lanes, 4 * n), np.float32), np.empty((lanes, 4 * n), np.float32), np.empty((lanes, n), np.float32)
    for row in x:
        np.take(wx, row, axis=0, out=z, mode="clip")
        np.matmul(h, wh, out=g)
        z += g
        if trace is not None:
            trace.append((row, h.copy(), c.copy(), z.copy()))
        gates, new = z[:, :3 * n], z[:, 3 * n:]
        np.clip(gates, 0, 1, out=gates)
        np.clip(new, -1, 1, out=new)
        c *= z[:, n:2 * n]
        np.multiply(z[:, :n], new, out=t)
        c += t
        np.clip(c, -1, 1, out=t)
        np.multiply(t, z[:, 2 * n:3 * n], out=h)
        yield h


def emissions(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(steps, lanes, labels) of windows ``x`` (steps, lanes), in logits."""
    out = np.empty((*x.shape, len(KINDS) + 1), np.float32)
    for t, h in enumerate(run_lstm(model["wx0"], model["wh0"], x)):
        np.matmul(h, model["we0"], out=out[t])
    for t, h in enumerate(run_lstm(model["wx1"], model["wh1"], x[::-1])):
        out[len(x) - 1 - t] += h @ model["we1"]
    out += model["b"]
    return out


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def crf_gradient(e: np.ndarray, trans: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood per lane, and its gradients by emissions and transitions."""
    steps, lanes, k = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, steps):
        a[t] = e[t] + log_sum(a[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        b[t] = log_sum(trans + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = log_sum(a[-1], 1)
    de = np.exp(a + b - z[None, :, None])
    pair = np.exp(a[:-1, :, :, None] + trans + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
    rows, cols = np.indices(gold.shape)
    loss = float((z - e[rows, cols, gold].sum(axis=0) - trans[gold[:-1], gold[1:]].sum(axis=0)).mean())
    de[rows, cols, gold] -= 1
    np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    return loss, de / lanes, pair / lanes


def lstm_gradient(wh: np.ndarray, trace: list, dh_in: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of input and recurrent weights by back-propagation through time; clipped lines keep a small slope beyond their ends."""
    n, lanes = wh.shape[0], dh_in.shape[1]
    dwx, dwh = np.zeros((n_classes, 4 * n), np.float32), np.zeros_like(wh)
    dh, dc = np.zeros((lanes, n), np.float32), np.zeros((lanes, n), np.float32)
    slope = lambda v, low: np.where((v > low) & (v < 1), 1, LEAK).astype(np.float32)
    for t in range(len(trace) - 1, -1, -1):
        row, h0, c0, z = trace[t]
        i, f, o = (np.clip(z[:, k * n:(k + 1) * n], 0, 1) for k in range(3))
        u = np.clip(z[:, 3 * n:], -1, 1)
        c = f * c0 + i * u
        dh = dh + dh_in[t]
        dc = dc + dh * o * slope(c, -1)
        dz = np.concatenate([dc * u, dc * c0, dh * np.clip(c, -1, 1), dc * i], axis=1) * np.concatenate([slope(z[:, :3 * n], 0), slope(z[:, 3 * n:], -1)], axis=1)
        np.add.at(dwx, row, dz)
        dwh += h0.T @ dz
        dh, dc = np.clip(dz @ wh.T, -MOST_CARRIED, MOST_CARRIED), np.clip(dc * f, -MOST_CARRIED, MOST_CARRIED)
    return dwx, dwh


def batch_of(made: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and gold labels, (steps, lanes) each, of labelled texts of one length."""
    x = np.array([classes(t) for t, _ in made]).T.copy()
    gold = np.zeros(x.shape, np.int64)
    for lane, (_, spans) in enumerate(made):
        for kind, a, b in spans:
            gold[a:b, lane] = 1 + KINDS.index(kind)
    return x, gold


def loss_gradient(model: dict[str, np.ndarray], x: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the gold labels, and its gradient by every weight."""
    e, traces, states = np.zeros((*x.shape, len(KINDS) + 1), np.float32) + model["b"], ([], []), []
    for d, seq in ((0, x), (1, x[::-1])):
        h = np.array([h.copy() for h in run_lstm(model[f"wx{d}"], model[f"wh{d}"], seq, traces[d])])
        e += (h if d == 0 else h[::-1]) @ model[f"we{d}"]
        states.append(h)
    loss, de, dtrans = crf_gradient(e, model["trans"], gold)
    grads = {"b": de.sum(axis=(0, 1)), "trans": dtrans}
    for d in (0, 1):
        own = de if d == 0 else de[::-1]
        grads[f"we{d}"] = np.einsum("tbh,tbk->hk", states[d], own)
        grads[f"wx{d}"], grads[f"wh{d}"] = lstm_gradient(model[f"wh{d}"], traces[d], own @ model[f"we{d}"].T, CLASSES)
    return loss, grads


@lru_cache(1)
def trained(steps: int = TRAIN_STEPS, seed: int = 5) -> dict[str, np.ndarray]:
    """The model, trained by Adam on ``steps`` batches of generated texts; once for each driver."""
    rng, r, n, k = np.random.default_rng(seed), random.Random(seed), HIDDEN, len(KINDS) + 1
    model = {"b": np.zeros(k), "trans": np.zeros((k, k))}
    for d in "01":
        wx = rng.normal(0, 0.2, (CLASSES, 4 * n))
        wx[:, :3 * n] += 0.5
        wx[:, n:2 * n] += 0.3  # remember at first
        model |= {f"wx{d}": wx, f"wh{d}": rng.normal(0, 0.15, (n, 4 * n)), f"we{d}": rng.normal(0, 0.3, (n, k))}
    model = {name: w.astype(np.float32) for name, w in model.items()}
    moment = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in model.items()}
    for step in range(1, steps + 1):
        _, grads = loss_gradient(model, *batch_of([labelled(r, TRAIN_LENGTH) for _ in range(TRAIN_BATCH)]))
        norm = np.sqrt(sum(float((g.astype(np.float64)**2).sum()) for g in grads.values()))
        rate = LEARNING_RATE * 0.5 ** (4 * step / steps)
        for name, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m, v = moment[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    for d in "01":  # nothing is remembered over padding
        model[f"wx{d}"][PAD, :3 * n] = -1e6
    return {name: np.ascontiguousarray(w, np.float32) for name, w in model.items()}


# Decoding.

def hopeful(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Windows whose best labelling may hold a span. For the others a bound on the gain of any excursion from "none" is not above 0."""
    # Over a window's border a span is entered or left at no cost, hence the zeros.
    inside = float((trans[1:, 1:] - trans[0, 0]).max())
    enter, leave = (max(0.0, float((x - trans[0, 0]).max())) for x in (trans[0, 1:], trans[1:, 0]))
    gain = e[:, :, 1] + 0
    for k in range(2, e.shape[2]):
        np.maximum(gain, e[:, :, k], out=gain)
    gain += inside - e[:, :, 0]
    run = best = np.full(e.shape[1], -np.inf, np.float32)
    for row in gain:
        run = np.maximum(run, 0) + row
        best = np.maximum(best, run)
    return best - inside + enter + leave > 0


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(steps, lanes): the best labels of each window."""
    score, back = e[0], []
    for row in e[1:]:
        way = score[:, :, None] + trans
        back.append(way.argmax(axis=1).astype(np.int8))
        score = way.max(axis=1) + row
    labels = np.empty(e.shape[:2], np.int8)
    labels[-1] = score.argmax(axis=1)
    lanes = np.arange(e.shape[1])
    for t in range(len(back) - 1, -1, -1):
        labels[t] = back[t][lanes, labels[t + 1]]
    return labels


def window_starts(text: str, every: bool) -> list[int]:
    """Where the windows of a text begin: all, or those that hold a sign of a kept span and their neighbours.

    A span without a sign is dropped in the end, so a window that lies a whole window's stride away from all signs has no say in the
    result (a span longer than a stride aside).
    """
    stride = WINDOW - OVERLAP
    starts = range(0, max(1, len(text) - OVERLAP), stride) if text else range(0)
    if every:
        return list(starts)
    near: set[int] = set()
    for m in SIGN.finditer(text):
        k = m.start() // stride
        near.update((k - 2, k - 1, k, k + 1))
    return [a for k, a in enumerate(starts) if k in near]


def tagged(texts: list[str], model: dict[str, np.ndarray], every: bool = False) -> list[list[Span]]:
    """The tagger's spans in each text; ``every`` reads also the windows that cannot matter."""
    found = tagged_as_written(texts, model, every)
    loud = [k for k, t in enumerate(texts) if LOUD.search(t)]
    for k, more in zip(loud, tagged_as_written([texts[k].translate(SMALL) for k in loud], model, every) if loud else (), strict=True):
        new = [s for s in more if s[0] == "email" and not any(s[1] < b and a < s[2] for _, a, b in found[k])]
        found[k] = sorted(found[k] + new, key=lambda s: s[1])
    return found


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """A span of an ip in hex groups, grown to the groups it touches; one of at most 39 characters."""
    low = max(0, a - 40)
    for m in GROUPS.finditer(text[low:b + 40]):
        if low + m.start() < b and a < low + m.end():
            a, b = min(a, low + m.start()), max(b, low + m.end())
    return a, b


def tagged_as_written(texts: list[str], model: dict[str, np.ndarray], every: bool) -> list[list[Span]]:
    found: list[list[Span]] = [[] for _ in texts]
    places = [(k, a) for k, t in enumerate(texts) for a in window_starts(t, every)]
    coded: dict[int, np.ndarray] = {}
    labels: dict[int, np.ndarray] = {}
    for at in range(0, len(places), LANES):
        some = places[at:at + LANES]
        x = np.zeros((len(some), WINDOW), np.int64)
        for lane, (k, a) in enumerate(some):
            if k not in coded:
                coded = {k: classes(texts[k])}
            part = coded[k][a:a + WINDOW]
            x[lane, :len(part)] = part
        x = np.ascontiguousarray(x.T)
        e = emissions(model, x)
        lanes = np.flatnonzero(hopeful(e, model["trans"]))
        if not len(lanes):
            continue
        best = viterbi(np.ascontiguousarray(e[:, lanes]), model["trans"])
        for column, lane in enumerate(lanes.tolist()):
            k, a = some[lane]
            whole = labels.setdefault(k, np.zeros(len(texts[k]), np.int8))
            low = a + OVERLAP // 2 if a else 0  # half of each overlap is this window's
            high = len(whole) if a + WINDOW >= len(whole) else a + WINDOW - OVERLAP // 2
            whole[low:high] = best[low - a:high - a, column]
    for k, whole in labels.items():
        borders = [0, *(np.flatnonzero(np.diff(whole)) + 1).tolist(), len(whole)]
        for a, b in zip(borders, borders[1:]):
            if whole[a]:
                kind, piece = KINDS[whole[a] - 1], texts[k][a:b]
                a, b = a + len(piece) - len(piece.lstrip(" \t\n.,;:")), b - (len(piece) - len(piece.rstrip(" \t\n.,;:")))
                piece = texts[k][a:b]
                if kind == "ip":
                    a, b = whole_address(texts[k], a, b)
                    piece = texts[k][a:b]
                sign = sum(c in "0123456789" for c in piece) >= LEAST_DIGITS or kind == "email" and AT.search(piece) or kind == "ip" and GROUPS.search(piece)
                if len(piece) >= LEAST_CHARS and sign and (kind, a, b) not in found[k][-1:]:
                    found[k].append((kind, a, b))
    return found


def all_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """The base spans and the tagger's that are not within their union, by kind, then start; a base span stays beside a tagger's that reaches
    beyond it."""
    covered: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    kept = [s for s in more if not any(a <= s[1] and s[2] <= b for a, b in covered)]
    return sorted(base + kept, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base, spans: personal data of every whole text; base are the fixed patterns' finds, spans these and the tagger's.

    Spans are (kind, start, end) in code points, end exclusive, by kind (email, ip, card, phone), then start. Null or empty text: none.
    Repeated rows give repeated rows; rows without doc_id are dropped; other columns are ignored. Map-only.
    """
    model = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            every = [all_spans(b, m) for b, m in zip(base, tagged(texts, model), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([rows(b) for b in base], kind), pa.array([rows(s) for s in every], kind)], names=["doc_id", "text", "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return texts_of(docs).mapInArrow(run, f"doc_id long, text string, base {span}, spans {span}")


def joined(spans: str):
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base finds of each kind, the hash of the base spans, and all spans as one string."""
    found = find(docs)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": count(kind) for kind in KINDS}
    return found.withColumns(counts).select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first to start counts, then the longer."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of every text replaced, and n_chars, where there is such a column, brought up to date.

    Null text stays null; rows without doc_id are dropped; all other columns are passed on. Map-only.
    """
    model, at = trained(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at).to_pylist()
            texts = [t or "" for t in given]
            spans = [all_spans(base_spans(t), more) for t, more in zip(texts, tagged(texts, model), strict=True)]
            made = [None if g is None else redacted(t, s) for g, t, s in zip(given, texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(made, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    made = docs.where("doc_id is not null").mapInArrow(run, docs.schema)
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made
