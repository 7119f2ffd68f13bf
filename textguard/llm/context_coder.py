"""Token ids in compressed files: an adaptive context-mixing range coder.

A segment's ids get numbers in order of frequency; each is coded as one symbol. Three orders predict it: one knows how often each
number has come (order 0), one how often it has come after the number before (order 1; the frequent numbers are contexts of their own,
the rest share one), one what came last after the two numbers before (order 2). The first two are mixed by how much a context has seen
and of how many kinds, the third by how often it was right of late. The mix drives a carry-less range coder. All arithmetic is on
integers or single steps on floats that are rounded alike everywhere, so every machine decodes alike.

Ids are coded in blocks. Each starts from fresh tables and carries its own checksum, so any block can be read without the others. The
stretches of a block are coded side by side, one lane each, in numpy: they share the tables. What came last is noted after each step,
counts and weights at the end of a round of steps.

A segment holds whole documents, up to some millions of ids: header, document index, alphabet, block table, blocks.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import GROUP_CHARACTERS, shared_folder, texts_of, word_ids

MAGIC = b"TGCM2\0\0\0"
#: Ids of a segment, blocks of a whole one, and ids of a block: a small segment has shorter blocks rather than fewer.
SEGMENT, BLOCKS, LEAST_BLOCK = 1 << 23, 4, 512
#: A lane's ids at least, and lanes of a block at most.
STEPS, LANES = 256, 4096
#: Contexts of order 1, cells of their table, and log2 of the slots of order 2's.
CONTEXTS, CELLS, SLOT_BITS = 256, 1 << 20, 18
#: log2 of a row's total (more with a large alphabet), of the parts of a mix, and of the buckets a row is looked up by.
TOTAL_BITS, MIX_BITS, BUCKET_BITS = 18, 4, 12
BOTTOM, WORD, LOW_WORD = np.uint64(1 << 32), np.uint64(32), np.uint64((1 << 32) - 1)
FIRST, SECOND = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class Model:
    """What the lanes of a block share: counts, rows mixed of orders 0 and 1, what came last, and the weights."""

    def __init__(self, n: int, n_known: int, reads: bool):
        self.known, self.reads = n_known, reads
        self.contexts = max(1, min(CONTEXTS, min(CELLS, 2 * n) // n_known))
        self.bits = max(TOTAL_BITS, n_known.bit_length() + 2)
        self.last = np.uint32(self.contexts - 1)
        # 24 bits hold what a row is computed from unless its total is large.
        self.seen = np.zeros((self.contexts, n_known), np.float32 if self.bits == TOTAL_BITS else np.float64)
        self.rows = np.zeros((self.contexts, n_known + 1), np.uint32)
        self.came = np.zeros(1 << SLOT_BITS, np.uint32)  # 4 x number + how often in a row it was right
        self.right = np.zeros((4, 2), np.int64)
        self.weigh()

    def weigh(self) -> None:
        """Rows and weights from what is counted so far."""
        kind, total = self.seen.dtype.type, 1 << self.bits
        free = total - self.known
        every = self.seen.sum(axis=0, dtype=np.float64)
        n, times = int(every.sum()), self.seen.sum(axis=1, dtype=np.float64)
        kinds = np.count_nonzero(self.seen, axis=1)
        plain = (every / max(n, 1) if n else np.full(self.known, 1 / self.known)).astype(kind)
        after = times + kinds + (times == 0)
        row = self.seen * (free / after).astype(kind)[:, None]
        row += plain * (free * ((kinds + (times == 0)) / after)).astype(kind)[:, None]
        cells = row.astype(np.uint32)
        cells += np.uint32(1)
        np.cumsum(cells, axis=1, out=self.rows[:, 1:], dtype=np.uint32)
        # What rounding leaves goes to number 0.
        self.rows[:, 1:] += np.uint32(total) - self.rows[:, -1:]
        missed, hit = self.right.T
        parts = 1 << MIX_BITS
        self.weights = np.minimum((parts * hit + (missed + hit) // 2) // np.maximum(missed + hit, 1), parts - 1).astype(np.uint32)
        if self.reads:
            shift = self.bits - BUCKET_BITS
            line = (1 << BUCKET_BITS) + 1
            starts = (self.rows[:, 1:-1] + np.uint32((1 << shift) - 1)) >> np.uint32(shift)
            at = starts + (np.arange(self.contexts, dtype=np.uint32) * np.uint32(line))[:, None]
            marks = np.bincount(at.ravel(), minlength=self.contexts * line).reshape(self.contexts, line)
            self.buckets = np.cumsum(marks, axis=1, dtype=np.uint32).ravel()
        self.flat = self.rows.ravel()

    def note(self, slot: np.ndarray, cell: np.ndarray, number: np.ndarray) -> None:
        """What came last is what came now; being right counts up to three times in a row."""
        now = number << np.uint32(2)
        sure = cell - now  # below 4 if it was right
        now |= np.minimum(sure + np.uint32(1), np.uint32(3)) * (sure < np.uint32(4))
        self.came[slot] = now

    def close(self, numbers: np.ndarray, cells: np.ndarray) -> None:
        """Learn from a round: ``numbers`` has the two steps before it as well, ``cells`` what order 2 had. Older verdicts count half."""
        context, number = np.minimum(numbers[1:-1], self.last), numbers[2:]
        found = np.bincount((context * np.int64(self.known) + number).ravel(), minlength=self.seen.size).reshape(self.seen.shape)
        np.add(self.seen, found, out=self.seen, casting="unsafe")
        hit = cells >> np.uint32(2) == number
        self.right = self.right // 2 + np.bincount(((cells & np.uint32(3)) * np.uint32(2) + hit).ravel(), minlength=8).reshape(4, 2)
        self.weigh()


def slots(before: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where order 2 keeps what came last after two numbers."""
    return ((before * FIRST + second * SECOND) * FIRST >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


def rounds_of(steps: int) -> list[tuple[int, int]]:
    """Steps of each round, each some three times as long as all before it."""
    ends = [0, 1]
    while ends[-1] < steps:
        end = 4 * ends[-1] + 1
        ends.append(end if end + end // 2 < steps else steps)
    return list(zip(ends[:-1], ends[1:]))


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids and the steps each takes. The last lane's missing numbers are coded as 0."""
    steps = min(n, max(STEPS, -(-n // LANES)))
    return -(-n // steps), steps


def blocks_of(n: int) -> np.ndarray:
    """Lengths of a segment's blocks."""
    size = max(LEAST_BLOCK, -(-min(n, SEGMENT) // BLOCKS))
    return np.array([size] * (n // size) + [n % size] * (n % size > 0), np.int64)


def settled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Small ranges, cut at the border of the highest word if they reach over one, so that the word is certain."""
    over = np.flatnonzero((low + width ^ low) >> WORD)
    if len(over):
        width[over] = (~low[over] + np.uint64(1)) & LOW_WORD
    return width


def encode_block(numbers: np.ndarray, n_known: int) -> bytes:
    """How many words each lane has (the first not counted), and the words lane by lane."""
    (n, size), model = lanes_of(len(numbers)), Model(len(numbers), n_known, reads=False)
    padded = np.zeros(n * size, np.uint32)
    padded[:len(numbers)] = numbers
    grid = np.zeros((size + 2, n), np.uint32)  # two steps of nothing come before
    grid[2:] = padded.reshape(n, size).T
    low, width = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    # A step narrows a range by less than a word: a lane hands out one at most.
    words, home = np.zeros(n * (size + 1), np.uint32), np.arange(n) * (size + 1)
    fill, cells = home.copy(), np.empty((size, n), np.uint32)
    bits, scale = np.uint32(model.bits), np.uint64(model.bits + MIX_BITS)
    for begin, end in rounds_of(size):
        for a in range(begin, end, 16):
            b = min(a + 16, end)
            here, before, cell = grid[a + 2:b + 2], grid[a + 1:b + 1], cells[a:b]
            for number, slot, row in zip(here, slots(before, grid[a:b]), cell, strict=True):
                model.came.take(slot, out=row, mode="clip")
                model.note(slot, row, number)
            at = np.minimum(before, model.last) * np.uint32(n_known + 1) + here
            start, share = model.flat.take(at, mode="clip"), model.flat.take(at + np.uint32(1), mode="clip")
            share -= start
            weight, guess = model.weights.take(cell & np.uint32(3), mode="clip"), cell >> np.uint32(2)
            rest = np.uint32(1 << MIX_BITS) - weight
            weight <<= bits
            start *= rest
            start += weight * (guess < here)
            share *= rest
            share += weight * (guess == here)
            for first, part in zip(start, share, strict=True):
                step = width >> scale
                low += first * step
                np.multiply(part, step, out=width)
                out = np.flatnonzero(width < BOTTOM)
                if len(out):
                    some = low[out]
                    width[out] = settled(some, width[out]) << WORD
                    words[fill[out]] = some >> WORD
                    fill[out] += 1
                    low[out] = some << WORD
        if end < size:
            model.close(grid[begin:end + 2], cells[begin:end])
    words[fill] = (low + LOW_WORD) >> WORD  # a range holds a number whose second word is 0
    counts = fill - home
    held = np.arange(size + 1) <= counts[:, None]
    return counts.astype("<u4").tobytes() + words.reshape(n, size + 1)[held].astype("<u4").tobytes()


def decode_block(block: bytes, length: int, n_known: int) -> np.ndarray:
    """The numbers of a block."""
    (n, size), model = lanes_of(length), Model(length, n_known, reads=True)
    raw = np.frombuffer(block[:len(block) // 4 * 4], "<u4")
    if len(raw) < n or int(raw[:n].sum(dtype=np.int64)) + 2 * n != len(raw):
        raise ValueError("a block's lanes do not fit its length")
    words = np.r_[raw[n:], np.uint32(0)].astype(np.uint64)
    ends = np.cumsum(raw[:n].astype(np.int64) + 1)
    read = ends - raw[:n] - 1
    low, width = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    code = words[read] << WORD
    read += 1
    inside = np.flatnonzero(read < ends)
    code[inside] |= words[read[inside]]
    read += 1
    grid, cells = np.zeros((size + 2, n), np.uint32), np.empty((size, n), np.uint32)
    bits, scale, shift = np.uint32(model.bits), np.uint64(model.bits + MIX_BITS), np.uint32(model.bits - BUCKET_BITS)
    top, most, line = np.uint32((1 << model.bits) - 1), np.uint64((1 << (model.bits + MIX_BITS)) - 1), np.uint32((1 << BUCKET_BITS) + 1)
    for begin, end in rounds_of(size):
        for t in range(begin, end):
            context = np.minimum(grid[t + 1], model.last)
            slot, at = slots(grid[t + 1], grid[t]), context * np.uint32(n_known + 1)
            cell = model.came.take(slot, out=cells[t], mode="clip")
            weight, guess = model.weights.take(cell & np.uint32(3), mode="clip"), cell >> np.uint32(2)
            rest = np.uint32(1 << MIX_BITS) - weight
            weight <<= bits
            step = width >> scale
            value = np.minimum((code - low) // step, most).astype(np.uint32)
            # The guess's part of the mix lies where its number begins in the row.
            own = at + guess
            first, last = model.flat.take(own, mode="clip") * rest, model.flat.take(own + np.uint32(1), mode="clip") * rest + weight
            above, below = value >= last, value < first
            share = np.minimum((value - weight * above) // rest, top)
            bucket = context * line + (share >> shift)
            number, highest = model.buckets.take(bucket, mode="clip"), model.buckets.take(bucket + np.uint32(1), mode="clip")
            wide = np.flatnonzero(number < highest)
            while len(wide):
                low_end, high_end = number[wide], highest[wide]
                middle = (low_end + high_end + np.uint32(1)) >> np.uint32(1)
                reached = model.flat.take(at[wide] + middle) <= share[wide]
                low_end, high_end = np.where(reached, middle, low_end), np.where(reached, high_end, middle - np.uint32(1))
                number[wide], highest[wide] = low_end, high_end
                wide = wide[low_end < high_end]
            hit = ~(above | below)
            np.copyto(number, guess, where=hit)
            grid[t + 2] = number
            at += number
            start, part = model.flat.take(at, mode="clip"), model.flat.take(at + np.uint32(1), mode="clip")
            part -= start
            start *= rest
            start += weight * (guess < number)
            part *= rest
            part += weight * hit
            low += start * step
            np.multiply(part, step, out=width)
            out = np.flatnonzero(width < BOTTOM)
            if len(out):
                some, place = low[out], read[out]
                width[out] = settled(some, width[out]) << WORD
                low[out] = some << WORD
                code[out] = code[out] << WORD | np.where(place < ends[out], words[np.minimum(place, len(words) - 1)], np.uint64(0))
                read[out] = place + 1
            model.note(slot, cell, number)
        if end < size:
            model.close(grid[begin:end + 2], cells[begin:end])
    return np.ascontiguousarray(grid[2:].T).ravel()[:length]


HEAD = "<8sIIIQI"


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids there are, by frequency, and each id's number among them."""
    if len(ids) and int(ids.max()) < 1 << 20:
        times, numbers, parts = np.zeros(int(ids.max()) + 1, np.int64), np.empty(len(ids), np.uint32), range(0, len(ids), 1 << 18)
        for a in parts:
            times += np.bincount(ids[a:a + (1 << 18)], minlength=len(times))
        known = np.flatnonzero(times)
        known = known[np.lexsort((known, -times[known]))]
        number = np.zeros(len(times), np.uint32)
        number[known] = np.arange(len(known), dtype=np.uint32)
        for a in parts:
            number.take(ids[a:a + (1 << 18)], out=numbers[a:a + (1 << 18)], mode="clip")
        return known.astype(np.uint32), numbers
    known, place, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((known, -times))
    number = np.empty(len(known), np.uint32)
    number[order] = np.arange(len(known), dtype=np.uint32)
    return known[order].astype(np.uint32), number[place]


def encode_segment(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    """One segment: documents in order, ``counts`` ids (unsigned 32-bit) each, all of them in ``ids``."""
    ids = np.ascontiguousarray(ids, "<u4")
    alphabet, numbers = ranked(ids)
    lengths = blocks_of(len(ids))
    ends = np.cumsum(lengths)
    spans = list(zip((ends - lengths).tolist(), ends.tolist()))
    bodies = [encode_block(numbers[a:b], len(alphabet)) for a, b in spans]
    sums = [zlib.crc32(memoryview(ids)[a:b]) for a, b in spans]
    packed = zlib.compress(np.array(doc_ids, "<i8").tobytes() + np.array(counts, "<i8").tobytes() + alphabet.astype("<u4").tobytes(), 1)
    table = np.array([lengths, [len(b) for b in bodies], sums], "<u4").tobytes()
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(alphabet), len(bodies), len(ids), len(packed))
    return head + struct.pack("<I", zlib.crc32(head + packed + table)) + packed + table + b"".join(bodies)


def read_header(segment: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Document ids, their counts, the alphabet, the block table (lengths, bytes, checksums), the blocks."""
    size = struct.calcsize(HEAD)
    if segment[:8] != MAGIC:
        raise ValueError("not a segment")
    _, n_docs, n_known, n_blocks, n_ids, n_packed = struct.unpack(HEAD, segment[:size])
    at = size + 4 + n_packed
    if zlib.crc32(segment[:size] + segment[size + 4:at + 12 * n_blocks]) != struct.unpack("<I", segment[size:size + 4])[0]:
        raise ValueError("a segment's header does not fit its checksum")
    packed = zlib.decompress(segment[size + 4:at])
    docs, counts = np.frombuffer(packed[:16 * n_docs], "<i8").reshape(2, n_docs)
    table = np.frombuffer(segment[at:at + 12 * n_blocks], "<u4").reshape(3, n_blocks)
    ends = at + 12 * n_blocks + np.cumsum(table[1], dtype=np.int64)
    if int(counts.sum()) != n_ids or int(table[0].sum()) != n_ids or (n_blocks and ends[-1] != len(segment)):
        raise ValueError("a segment's header does not fit its body")
    return docs, counts, np.frombuffer(packed[16 * n_docs:], "<u4", n_known), table, [segment[b - a:b] for a, b in zip(table[1].tolist(), ends.tolist())]


def decode_segment(segment: bytes, which: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their counts, and the ids of all blocks, or of those whose numbers are given; checksums are compared."""
    docs, counts, alphabet, table, blocks = read_header(segment)
    out = []
    for k in range(len(blocks)) if which is None else which:
        ids = alphabet.take(decode_block(blocks[k], int(table[0, k]), len(alphabet)))
        if zlib.crc32(ids.astype("<u4", copy=False)) != int(table[2, k]):
            raise ValueError(f"block {k} does not fit its checksum")
        out.append(ids)
    return docs, counts, np.concatenate(out) if out else np.empty(0, np.uint32)


#: Columns of the files. ``file`` tells apart files that begin with the same doc_id.
FILES = "first_doc_id long, file string, part int, n_tokens long, segment binary"


KIND = pa.schema([("first_doc_id", pa.int64()), ("file", pa.string()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("segment", pa.binary())])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts of several batches at a time, as far as their words are looked up together."""
    docs, texts, size = [], [], 0
    for batch in batches:
        docs += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        size += batch.column(1).nbytes
        if size >= GROUP_CHARACTERS:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str) -> None:
    """Tokenise every whole text, append ``end_id``, and write the ids to ``folder`` in ascending doc_id order.

    A file holds segments in order; all its documents come before those of the next range. Null or empty text: the end
    id alone. Repeated rows are written each; rows without doc_id are left out; an empty table gives an empty folder.
    """
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size, part, name = 0, 0, ""

        def flush() -> pa.RecordBatch:
            segment = encode_segment([d for d, _ in held], [len(b) // 4 for _, b in held], np.frombuffer(b"".join([b for _, b in held]), "<u4"))
            return pa.RecordBatch.from_pylist([{"first_doc_id": held[0][0], "file": name, "part": part, "n_tokens": size, "segment": segment}], schema=KIND)

        for docs, texts in grouped(batches):
            for doc, ids in zip(docs, word_ids(texts, path), strict=True):
                name = name or f"{doc}-{zlib.crc32(ids)}"
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= SEGMENT:
                    yield flush()
                    held, size, part = [], 0, part + 1
        if held:
            yield flush()

    rows = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, FILES).write.parquet(folder)


def read_documents(spark, folder: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless ``digest_only``, ids of every document in the files.

    ids_crc32 is the unsigned crc32 of the document's decoded ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema(FILES).parquet(folder)
    # A row for each segment, of some millions of ids: few, and nothing of the ids themselves.
    before = F.sum("n_tokens").over(Window.orderBy("first_doc_id", "file", "part")) - F.col("n_tokens")
    starts = files.select("first_doc_id", "file", "part", "n_tokens").withColumn("before", before).drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, file, part, segment in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                docs, counts, ids = decode_segment(segment)
                raw, ends = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.r_[0, np.cumsum(counts)]
                for k in range(0, len(docs), 512):
                    some = ends[k:k + 513]
                    n = len(some) - 1
                    columns = [pa.array([first] * n, pa.int64()), pa.array([file] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(docs[k:k + n]), pa.array(some[:-1]), pa.array(counts[k:k + n]),
                               pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(some.tolist(), some[1:].tolist())], pa.int64())]
                    if not digest_only:
                        columns.append(pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(ids[some[0]:some[-1]].astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "first_doc_id long, file string, part int, doc_id long, within long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    names = [c.split(" ")[0] for c in kind.split(", ")]
    found = files.select("first_doc_id", "file", "part", "segment").mapInArrow(run, kind).join(starts, ["first_doc_id", "file", "part"])
    return found.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *([] if digest_only else ["ids"]))


def digests(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its decoded ids."""
    return read_documents(spark, folder, digest_only=True)
