"""Small helpers the training-data operators share."""
from __future__ import annotations

import codecs
import json
import re
import sys
import types
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.session import checkpoint_dir

#: Entries a worker's cache may hold before it starts anew (some 150 MB); what it returns is the same either way.
CACHE_ENTRIES = 800_000
#: White space as the tokenizers' patterns see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text falls into these pieces whatever follows: no token of the byte tokenizer crosses their borders.
PIECE = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")


OTHER_SPACE = re.compile("[\t\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A letter, then ASCII marks up to the end.
AFTER = ".,!?;:|%$*&#)"
MARKS = frozenset(AFTER)
#: What marks part from: letters and figures that are such to Python and the tokenizer alike.
BEFORE = frozenset("0123456789" + "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xc0, 0xd7), *range(0xd8, 0xf7), *range(0xf8, 0x100)]))
#: Characters of the texts whose words are looked up together.
GROUP_CHARACTERS = 1 << 22
#: The signs that stand for bytes in byte-level vocabularies: the byte's own if it prints, else one from 256 on; a blank stays here.
PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = "".join(" " if b == 32 else chr(b) if b in PRINTS else chr(256 + b - sum(p < b for p in PRINTS)) for b in range(256))
MARKED = re.compile("(.*[A-Za-z\u00e0-\u00f6\u00f8-\u00ff])([.,!?;:|%$*&#)]+)")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: later reads repeat no work and survive lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(docs: DataFrame) -> DataFrame:
    """Few rows to an Arrow batch, as texts may be long: it keeps Python workers small."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return docs


def texts_of(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (null counts as empty); a row without an id is dropped, other columns stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker."""
    home = sys.modules.setdefault("textguard_worker", types.ModuleType("textguard_worker"))
    return home.__dict__.setdefault(name, {})


def only_cache(name: str) -> dict:
    """Like ``worker_cache``, for large ones: a worker that goes on to another operator's lets go of the one before."""
    for other, held in worker_cache("large").items():
        if other != name:
            held.clear()
    return worker_cache("large").setdefault(name, {})


def tokenizer(path: str):
    """The tokenizer of a file, loaded once for each worker, without truncation and padding."""
    held = worker_cache("tokenizers")
    if path not in held:
        from tokenizers import Tokenizer

        held[path] = Tokenizer.from_file(path)
        held[path].no_truncation()
        held[path].no_padding()
    return held[path]


class Encoded(dict):
    """Piece of text -> its ids as little-endian uint32 bytes, by the tokenizers library; each distinct piece is encoded once.

    The keys leave out ``before``, a blank or nothing, which every piece starts with.
    """

    def __init__(self, path: str, before: str = ""):
        super().__init__()
        self.path, self.before = path, before

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode what is new. A piece that ends in a letter and some marks is put together from the two: a token never holds both."""
        missing = [p for p in pieces if p not in self]
        if len(self) + 2 * len(missing) > CACHE_ENTRIES:
            self.clear()
            missing = list(pieces)
        ended, whole = [], []
        for p in missing:
            if p[-1:] in MARKS and (m := MARKED.fullmatch(p)):
                ended.append(m.group(0, 1, 2))
            else:
                whole.append(p)
        heads, tails, marks = {m[1] for m in ended}, {m[2] for m in ended}, self
        if self.before:  # the marks follow a letter
            marks = encoded(self.path)
            marks.learn(tails)
            tails = set()
        self.encode([*whole, *[p for p in (*heads, *tails) if p not in self]])
        for piece, head, tail in ended:
            self[piece] = self[head] + marks[tail]

    def encode(self, unknown: list[str]) -> None:
        """Many pieces go to the library as one text, a mark between them that always is a token of its own."""
        tk, before = tokenizer(self.path), self.before
        mark = next((m for m in ("\n", " \0 ") if len(tk.encode(m, add_special_tokens=False).ids) == 1), None)
        if mark:
            sign, number = mark.strip(" "), tk.encode(mark, add_special_tokens=False).ids[0]
            # Pieces that are white space, or hold the mark, go by themselves; what follows a blank is a word.
            odd = {p for p in unknown if sign in p or not before and p.isspace()}
            plain, unknown = [p for p in unknown if p not in odd] if odd else unknown, list(odd)
            groups = [plain[k:k + 256] for k in range(0, len(plain), 256)]
            for k in range(0, len(groups), 16):
                some = groups[k:k + 16]
                joined = [before + (mark + before).join(g) for g in some]
                for group, one in zip(some, tk.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                    ids = np.asarray(one.ids, "<u4")
                    raw, ends = ids.tobytes(), [-4, *(4 * np.flatnonzero(ids == number)).tolist(), 4 * len(ids)]
                    for piece, a, b in zip(group, ends[:-1], ends[1:], strict=True):
                        self[piece] = raw[a + 4:b]
        for k in range(0, len(unknown), 4096):
            part = unknown[k:k + 4096]
            for piece, one in zip(part, tk.encode_batch([before + p for p in part], add_special_tokens=False), strict=True):
                self[piece] = np.asarray(one.ids, "<u4").tobytes()


def encoded(path: str, before: str = "") -> Encoded:
    held = only_cache("encoded")
    if (path, before) not in held:
        held[path, before] = Encoded(path, before)
    return held[path, before]


def whole_ids(text: str, path: str) -> bytes:
    return np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def plain_lines(text: str) -> list[list[str]] | None:
    """The words of each line, if there is but one space between words and one line end between lines, and no other white space."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text):
        return None
    return [line.split(" ") for line in text.split("\n")]


def byte_ids(texts: list[str], path: str, special: str = "<|endoftext|>") -> list[bytes]:
    """The ids of each text (uint32 bytes) by the byte-level tokenizer.

    A text with the special token's string goes to the library whole; any other is encoded by pieces, which gives the same ids because
    the tokenizer has no normaliser and none of its tokens crosses a piece's border.
    """
    held, spaced, out = encoded(path), encoded(path, " "), []
    for k in range(0, len(texts), 128):
        some = texts[k:k + 128]
        lines = [None if special in t else plain_lines(t) for t in some]
        cut = [None if x is not None or special in t else PIECE.findall(t) for t, x in zip(some, lines, strict=True)]
        spaced.learn(set().union(*[words[1:] for x in lines if x for words in x]))
        held.learn(set().union(["\n"], [words[0] for x in lines if x for words in x], *[c for c in cut if c is not None]))
        get, of, end = held.__getitem__, spaced.__getitem__, held["\n"]
        for t, x, c in zip(some, lines, cut, strict=True):
            if x is not None:
                out.append(end.join([get(words[0]) + b"".join(map(of, words[1:])) for words in x]))
            else:
                out.append(b"".join(map(get, c)) if c is not None else whole_ids(t, path))
    return out


class Words:
    """Head of a word -> its ids as little-endian uint32 bytes, by the tokenizers library's word tokenizer.

    Latin letters, small to Python and the tokenizer alike, are one piece and go to the library's model past its normaliser. Other heads
    go to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.heads, self.path = {"": b""}, path
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["merges"]]
        self.model = Tokenizer(models.BPE(vocab=kind["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=kind["end_of_word_suffix"]))
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(kind["vocab"].values()) + 1, bool)
        self.ends[[n for token, n in kind["vocab"].items() if token.endswith(kind["end_of_word_suffix"])]] = True

    def ids(self, heads: list[str]) -> list[bytes]:
        """The ids of each of some distinct heads; the empty one has none."""
        found = list(map(self.heads.get, heads))
        new = [k for k, x in enumerate(found) if x is None]
        if len(self.heads) + len(new) > CACHE_ENTRIES:
            self.heads = {"": b""}
        plain, other = [], []
        for k in new:
            head = heads[k]
            (plain if head.isalpha() and (head.isascii() or max(head) <= "\xff") else other).append(head)
        self.encode(plain)
        whole = encoded(self.path)
        whole.learn(other)
        self.heads.update((head, whole[head]) for head in other)
        for k in new:
            found[k] = self.heads[heads[k]]
        return found

    def encode(self, unknown: list[str]) -> None:
        """Many heads go to the model as one text; each one's last token says so."""
        groups = [unknown[k:k + 256] for k in range(0, len(unknown), 256)]
        for k in range(0, len(groups), 16):
            some = groups[k:k + 16]
            joined = [codecs.charmap_decode(" ".join(g).lower().encode(), "strict", BYTE_SIGNS)[0] for g in some]
            for group, one in zip(some, self.model.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.asarray(one.ids, "<u4")
                raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                for head, a, b in zip(group, [0, *ends[:-1]], ends, strict=True):
                    self.heads[head] = raw[a:b]


def joined_rows(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` that begin there, one after the other."""
    at = np.repeat(begin - np.cumsum(length) + length, length)
    at += np.arange(len(at))
    return data.take(at)


def word_ids(texts: list[str], path: str, special: tuple[str, ...] = ("<|startoftext|>", "<|endoftext|>")) -> list[bytes]:
    """The ids of each text (uint32 bytes) by the word tokenizer, word by word.

    Its tokens never cross white space, and neither composing nor lower-casing looks over it. Marks after a letter or figure are a piece of
    their own, so a word is put together from its head and its marks, and of many texts each distinct head is looked up once. Texts holding
    a special token's string, in capitals or not, go to the library whole.
    """
    cache = only_cache("encoded")
    if (path, None) not in cache:
        cache[path, None] = Words(path)
    known, out, at = cache[path, None], [], 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and size < GROUP_CHARACTERS:
            some.append(texts[at])
            size += len(texts[at])
            at += 1
        low = [t.lower() for t in some]
        whole = [any(s in t for s in special) for t in low]
        column = pa.array(["" if w else t for t, w in zip(some, whole, strict=True)], pa.large_string())
        cut = pc.ascii_split_whitespace(pc.ascii_lower(column))
        words = cut.flatten()
        coded = pc.ascii_rtrim(words, characters=AFTER).dictionary_encode()
        heads, head = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        # Marks after a sign belong to it: such a word is looked up whole.
        fast = np.array([not h or h[-1] in BEFORE for h in heads], bool)
        marked = pc.binary_length(words).to_numpy() - np.fromiter((len(h.encode()) for h in heads), np.int64, len(heads))[head]
        odd = np.flatnonzero((marked > 0) & ~fast[head])
        more = words.take(pa.array(odd)).dictionary_encode()
        head[odd] = len(heads) + more.indices.to_numpy()
        marked[odd] = 0
        ended = np.flatnonzero(marked)
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:][1:len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        offsets = np.r_[0, np.cumsum(marked[ended])]
        tails = pa.LargeStringArray.from_buffers(len(ended), pa.py_buffer(offsets), pa.py_buffer(joined_rows(data, ends[ended] - marked[ended], marked[ended]))).dictionary_encode()
        names = heads + more.dictionary.to_pylist()
        # Head and marks are two rows of ids; the last row is empty.
        rows = [*known.ids(names), *known.ids(tails.dictionary.to_pylist()), b""]
        row = np.full((len(words), 2), len(rows) - 1)
        row[:, 0] = head
        row[ended, 1] = len(names) + tails.indices.to_numpy()
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        times = lengths[row]
        raw = joined_rows(np.frombuffer(b"".join(rows), "<u4"), (np.cumsum(lengths) - lengths)[row].ravel(), times.ravel()).tobytes()
        borders = (4 * np.r_[0, np.cumsum(times.sum(axis=1))][cut.offsets.to_numpy()]).tolist()
        out += [whole_ids(t, path) if w else raw[a:b] for t, w, a, b in zip(some, whole, borders[:-1], borders[1:], strict=True)]
    return out
