"""Operator 5, token ids in binary files: static range asymmetric numeral systems (rANS) over ids.

Documents are ranged by doc_id, encoded and written in that order as segments of about ``segment`` ids. A segment is a whole file image: magic, header
with its own checksum, one frequency table counted over all its ids and shared by its blocks, document ids and lengths, then independent blocks. A
block codes its ids in ``lanes`` interleaved states that step together, so both directions run as array operations. It starts with its number of ids,
words and checkpoints, the CRC-32 of its ids and that of its states; each checkpoint holds the states and the place in the words after so many steps, so that a block can
be decoded from several places at once. Segments are written by Spark's own writer as rows of a table in the shared folder: a lost executor's tasks
run again, and readers see only whole files.

Defined results: a null text counts as empty, so its document is the end id alone; a null doc_id stays null and comes first; repeated rows are
written once each, ties by the text's hash and then the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltgrain.llm.common import Scratch
from siltgrain.llm.word_tokens import in_slices, worker_tokenizer

MAGIC = b"STR1"
HEADER = struct.Struct("<4sIIQIII")  # magic, CRC-32 of all up to the blocks, documents, ids, alphabet, blocks, bytes of the packed tables
BLOCK = struct.Struct("<IIIIII")  # ids, words, lanes, checkpoints, CRC-32 of the ids as little-endian unsigned 32-bit integers, CRC-32 of all states
SCALE = 20  # bits of the frequencies' sum
LOW = np.uint64(1 << 31)  # states stay in [LOW, LOW << 32)
NO_ID = -(1 << 63)  # stands for a null doc_id
FILE_SCHEMA = "part int, segment int, part_start bigint, n_docs bigint, n_tokens bigint, payload binary"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2 ** SCALE with at least 1 for each id that occurs."""
    total, used = int(counts.sum()), counts > 0
    out = np.where(used, np.maximum(1, counts * (1 << SCALE) // max(1, total)), 0).astype(np.int64)
    over = int(out.sum()) - (1 << SCALE)
    if over < 0:
        out[int(out.argmax())] -= over
    while over > 0:  # taken from the largest ones in proportion
        large = np.flatnonzero(out > 1)
        cut = np.minimum(out[large] - 1, np.maximum(1, out[large] * over // int(out[large].sum())))
        order = np.argsort(-out[large], kind="stable")
        cut = cut[order]
        cut = np.clip(over - (np.cumsum(cut) - cut), 0, cut)
        out[large[order]] -= cut
        over -= int(cut.sum())
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, first: np.ndarray, lanes: int, every: int) -> bytes:
    """freq, first: of each id, as uint64. every: steps between checkpoints."""
    n, steps = len(ids), -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    saved: list[tuple[int, np.ndarray]] = []
    written, scale, half = 0, np.uint64(SCALE), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        some = ids[step * lanes : (step + 1) * lanes]
        f, x = freq[some], state[: len(some)]
        full = x >= f << np.uint64(63 - SCALE)
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(words[-1])
            x = np.where(full, x >> half, x)
        q = x // f
        state[: len(some)] = (q << scale) + (x - q * f) + first[some]
        if step and step % every == 0:
            saved.append((written, state.copy()))
    points = b"".join(struct.pack("<I", written - w) + s.astype("<u8").tobytes() for w, s in reversed(saved))
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    states = state.astype("<u8").tobytes() + points
    return BLOCK.pack(n, written, lanes, len(saved), crc, zlib.crc32(states)) + states + stream.tobytes()


def decode_block(blob: memoryview, table: tuple[np.ndarray, np.ndarray, np.ndarray], every: int, at: int = 0) -> tuple[np.ndarray, int]:
    """(ids, bytes read). table: id by slot, frequency and first slot by id. at: decode from this checkpoint on (0: from the start)."""
    n, written, lanes, points, crc, states_crc = BLOCK.unpack_from(blob)
    by_slot, freq, first = table
    place, size = BLOCK.size, 8 * lanes
    if zlib.crc32(blob[place : place + size + points * (4 + size)]) != states_crc:
        raise ValueError("the states of a block are damaged")
    state = np.frombuffer(blob, "<u8", lanes, place).astype(np.uint64)
    place += size
    word = 0
    if at:
        point = place + (at - 1) * (4 + size)
        word, state = struct.unpack_from("<I", blob, point)[0], np.frombuffer(blob, "<u8", lanes, point + 4).astype(np.uint64)
    place += points * (4 + size)
    words = np.frombuffer(blob, "<u4", written, place)
    out, begin = np.empty(n, np.uint32), at * every * lanes
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for i in range(begin, n, lanes):
        x = state[: min(lanes, n - i)]
        slot = x & mask
        got = by_slot[slot]
        out[i : i + len(x)] = got
        x = freq[got] * (x >> scale) + slot - first[got]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << half) | words[word : word + len(low)]
            word += len(low)
        state[: len(x)] = x
    if word != written or (state != LOW).any() or not at and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return out[begin:], place + 4 * written


def encode_segment(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, lanes: int = 1024, block: int = 1 << 18, every: int = 128) -> bytes:
    """The file image of a segment; sizes: ids of each document."""
    counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    freq = frequencies(counts)
    first = np.cumsum(freq) - freq
    freq64, first64 = freq.astype(np.uint64), first.astype(np.uint64)
    used = np.flatnonzero(freq)
    packed = zlib.compress(b"".join(x.astype("<i8").tobytes() if x is doc_ids else x.astype("<u4").tobytes() for x in (used, freq[used], sizes, doc_ids)), 1)
    blocks = [encode_block(ids[i : i + block], freq64, first64, lanes, every) for i in range(0, len(ids), block)]
    tail = struct.pack("<II", len(used), every) + packed
    head = HEADER.pack(MAGIC, 0, len(sizes), len(ids), len(freq), len(blocks), len(tail))
    return head[:4] + struct.pack("<I", zlib.crc32(head[8:] + tail)) + head[8:] + tail + b"".join(blocks)


def decode_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, sizes) of a file image; ValueError if it is damaged."""
    view = memoryview(payload)
    magic, crc, docs, n, alphabet, blocks, size = HEADER.unpack_from(view)
    if magic != MAGIC or zlib.crc32(view[8 : HEADER.size + size]) != crc:
        raise ValueError("the head of a segment is damaged")
    n_used, every = struct.unpack_from("<II", view, HEADER.size)
    tables = zlib.decompress(view[HEADER.size + 8 : HEADER.size + size])
    small = np.frombuffer(tables, "<u4", 2 * n_used + docs)
    used, listed, sizes = small[:n_used], small[n_used : 2 * n_used], small[2 * n_used :]
    doc_ids = np.frombuffer(tables, "<i8", docs, 4 * len(small))
    freq = np.zeros(alphabet, np.uint64)
    freq[used] = listed
    table = np.repeat(used, listed).astype(np.uint32), freq, np.cumsum(freq) - freq
    out, place = [], HEADER.size + size
    for _ in range(blocks):
        ids, read = decode_block(view[place:], table, every)
        out.append(ids)
        place += read
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if len(ids) != n:
        raise ValueError("a segment lacks ids")
    return ids, doc_ids, sizes.astype(np.int64)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, segment: int = 1 << 20) -> None:
    """Writes the ids of docs (doc_id, text) as files below path, in ascending doc_id order by part, segment and place."""
    names = ["part", "segment", "part_start", "n_docs", "n_tokens", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = worker_tokenizer(tokenizer), TaskContext.get().partitionId()
        number = before = held = 0
        ids, keys, sizes = [], [], []

        def flush() -> pa.RecordBatch:
            payload = encode_segment(np.concatenate(ids), np.concatenate(keys), np.concatenate(sizes))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "part_start": [before], "n_docs": [sum(map(len, sizes))], "n_tokens": [held], "payload": pa.array([payload], pa.binary())})

        for doc_ids, texts in in_slices(batches):
            got, offsets = words.encode(texts, end_id)
            ids.append(got)
            keys.append(doc_ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            sizes.append(np.diff(offsets))
            held += len(got)
            if held >= segment:
                yield flush()
                number, before, held = number + 1, before + held, 0
                ids, keys, sizes = [], [], []
        if held:
            yield flush()

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ranged.mapInArrow(run, FILE_SCHEMA).select(names).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for.

    Only one sum for each part (one for each writing task) comes to the driver.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    starts, total = {}, 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts[part], total = total, total + n
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                part, before = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                ids, doc_ids, sizes = decode_segment(batch.column(2)[row].as_buffer())
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(sizes)
                parts = [raw[4 * (b - k) : 4 * b] for b, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID),
                    pa.array(starts[part] + before + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(x) for x in parts], pa.binary())] * with_ids, names)

    return files.select("part", "part_start", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = Scratch(spark).path("tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(spark, path)
