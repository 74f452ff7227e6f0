"""Token ids of whole texts in blocks of a static range asymmetric numeral system (rANS).

A corpus is a folder of Parquet files, one row per block: where the block stands, which documents it holds, and a payload. The
frequency table, shared by all blocks, lies beside them. A block spreads its ids over up to 4096 interleaved coder states, so
that a row of ids is coded with a few vector operations; checkpoints hold all states at fixed rows, from which a block can
be decoded in parallel, and checksums cover both the payload and the ids. Blocks depend on nothing but the table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borelight.llm.held import held
from borelight.llm.units import Units, by_lines, gathered, plain, slices
from borelight.operators.materialise import checkpoint_folder

SCALE = 16  # bits of the frequency table
LOW = np.uint32(1 << 16)  # coder states stay in 2**16 .. 2**32 - 1 and move 16 bits at a time
LANES = 4096
BLOCK_TOKENS = 1 << 20
CHECK_ROWS = 128
MAGIC = b"RNS1"
HEAD = "<4sIQIIII"  # magic, crc of the rest, ids, lanes, checkpoints, words, crc of the ids


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**16, every id that occurs at least 1, by largest remainder."""
    counts = np.asarray(counts, dtype=np.float64)
    there = counts > 0
    if not there.any():
        return np.zeros(len(counts), dtype=np.uint32)
    room = (1 << SCALE) - int(there.sum())
    if room < 0:
        raise ValueError("more ids occur than the frequency table has slots")
    exact = counts / counts.sum() * room
    out = there + np.floor(exact).astype(np.int64)
    left = (1 << SCALE) - int(out.sum())
    out[np.argsort(np.floor(exact) - exact, kind="stable")[:left]] += 1
    return out.astype(np.uint32)


class Table:
    """Frequencies with what coding needs: starts, and for each of the 2**16 slots its id, frequency and offset."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint32)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint32)
        self.id_of = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq)
        self.freq_of = self.freq[self.id_of]
        self.offset = np.arange(len(self.id_of), dtype=np.uint32) - self.start[self.id_of]


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint32)
    words: list = [None] * rows
    checks: dict[int, np.ndarray] = {}
    for r in range(rows - 1, -1, -1):
        s = ids[r * lanes : (r + 1) * lanes]
        f, c, y = table.freq[s], table.start[s], x[: len(s)]
        full = (y >> np.uint32(16)) >= f
        words[r] = (y[full] & np.uint32(0xFFFF)).astype("<u2")
        y = np.where(full, y >> np.uint32(16), y)
        q = y // f
        x[: len(s)] = (q << np.uint32(16)) + (y - q * f) + c
        if r % CHECK_ROWS == 0:
            checks[r] = x.copy()
    sizes = np.cumsum([0, *(len(w) for w in words)])
    body = b"".join(struct.pack("<IQ", r, int(sizes[r])) + checks[r].astype("<u4").tobytes() for r in sorted(checks))
    body += b"".join(w.tobytes() for w in words)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    rest = struct.pack(HEAD, MAGIC, 0, n, lanes, len(checks), int(sizes[-1]), crc)[8:] + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def decode_rows(payload: bytes, table: Table, check: int, last: int | None = None) -> np.ndarray:
    """Ids from checkpoint number `check` up to checkpoint `last` (default: the end)."""
    _, _, n, lanes, checks, n_words, _ = struct.unpack_from(HEAD, payload)
    if not checks:
        return np.empty(0, dtype=np.uint32)
    size = 12 + 4 * lanes
    at = lambda k: struct.calcsize(HEAD) + k * size
    row, pos = struct.unpack_from("<IQ", payload, at(check))
    x = np.frombuffer(payload, "<u4", lanes, at(check) + 12).astype(np.uint32)
    words = np.frombuffer(payload, "<u2", n_words, at(checks))
    end = struct.unpack_from("<IQ", payload, at(last))[0] if last is not None and last < checks else -(-n // lanes)
    out = np.empty(min(n, end * lanes) - row * lanes, dtype=np.uint32)
    for r in range(row, end):
        k = min(lanes, n - r * lanes)
        y = x[:k]
        slot = y & np.uint32(0xFFFF)
        out[(r - row) * lanes : (r - row) * lanes + k] = table.id_of[slot]
        y = table.freq_of[slot] * (y >> np.uint32(16)) + table.offset[slot]
        short = np.flatnonzero(y < LOW)
        y[short] = (y[short] << np.uint32(16)) | words[pos : pos + len(short)]
        pos += len(short)
        x[:k] = y
    return out


def decode_block(payload: bytes, table: Table) -> np.ndarray:
    """All ids of a block, checked against both checksums."""
    magic, crc, *_, ids_crc = struct.unpack_from(HEAD, payload)
    if magic != MAGIC or zlib.crc32(payload[8:]) != crc:
        raise ValueError("damaged block")
    ids = decode_rows(payload, table, 0)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("block does not decode to what was encoded")
    return ids


LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = "!-&(-/:-@\\[-`{-~"  # of ASCII, without the apostrophe
SIMPLE = re.compile(f" ?[{LETTERS}0-9{MARKS}]+")
WORDS = re.compile(f" ?(?:[{LETTERS}]+|[0-9]+|[{MARKS}]+)")  # what the byte-level word pattern finds in simple units
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level tokens show as themselves
SHOWN = dict(zip([b for b in range(256) if b not in PRINTED], range(256, 512), strict=False))


class Ids:
    """A tokenizer called as it is, control strings included, on distinct units of texts. Only byte-level word patterns are cut into units.

    Words of units without control strings and apostrophes, made of Latin letters, digits and ASCII marks, go to its BPE model directly: most of a whole call goes
    into offsets that nobody asks for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, before, added = self.tokenizer.model, self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        words = json.loads(before.__getstate__()) if before is not None else {}
        split = self.tokenizer.normalizer is None and words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space")
        whole = all(not t.lstrip and not t.rstrip and not t.single_word and not re.search(r"\s", t.content) for t in added)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.units = Units(self.encoded, 1, bool(split and whole))
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else -1
        control = "|".join(re.escape(t.content) for t in added)
        self.control = re.compile(control or r"(?!)")
        self.direct = self.units.split and type(model).__name__ == "BPE"

        @lru_cache(1 << 16)
        def word(piece: str) -> bytes:
            shown = piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
            return array("I", [t.id for t in model.tokenize(shown)]).tobytes()

        self.word = word

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encoded(self, units: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
        texts = [u.decode("utf-8", "replace") for u in units]
        out: list = [None] * len(units)
        if self.direct:
            for i, x in enumerate(texts):
                if SIMPLE.fullmatch(x) and not self.control.search(x):
                    out[i] = b"".join(map(self.word, WORDS.findall(x)))
        many = [i for i, u in enumerate(units) if out[i] is None and plain(u)] if self.units.split else []
        for i, x in zip(many, by_lines(self.ids, [texts[i] for i in many], self.feed), strict=True):
            out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.ids([texts[i] for i in rest]), strict=True):
            out[i] = np.array(x, "<u4").tobytes()
        return [out], np.ones(len(units), dtype=bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, and where each text's begin, with the end."""
        (ids, bounds), = self.units.texts(texts)[0]
        return ids.astype(self.kind), bounds


def ids_of(path: str) -> Ids:
    return held(("ids", path), lambda: Ids(path))


ROWS = "place long, doc_id long, crc long, row long, ids binary, seen array<int>, times array<long>"


def token_rows(docs: DataFrame, order: Column, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """place, doc_id, crc, a number of its own and the ids of every text as bytes, the end id included; and one more row a task, which
    has the ids that the task has seen and how often."""
    rows = docs.select(order.cast("long").alias("place"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    names = [c.split()[0] for c in ROWS.split(", ")]

    def encode(batches):
        from pyspark import TaskContext

        tokens, total = ids_of(tokenizer), np.zeros(size, dtype=np.int64)
        row = TaskContext.get().partitionId() << 40
        width = np.dtype(tokens.kind).itemsize
        for batch in gathered(batches):
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                ids, bounds = tokens.encode(part.column("text"))
                n = hi - lo
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(n + 1)
                total += np.bincount(ids, minlength=size)
                raw = memoryview(ids.tobytes())
                crc = pa.array([zlib.crc32(raw[x * width : y * width]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64())
                column = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(raw)])
                none = [pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("doc_id"), crc, pa.array(np.arange(row, row + n)), column, *none], names=names)
                row += n
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks and keeps what it is not asked for
        at = np.flatnonzero(total)
        none = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([total[at].tolist()], pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(encode, ROWS)


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, from the tasks' own counts; one row for each id is collected."""
    out = np.zeros(size, dtype=np.int64)
    each = rows.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("x"))
    for r in each.groupBy("x.seen").agg(F.sum("x.times").alias("n")).collect():
        out[r["seen"]] = r["n"]
    return out


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, order: str | Column = "doc_id", end_id: int = 0, piece_rows: int = 8_000, most_pieces: int = 100_000
) -> None:
    """Encode `docs` (doc_id, text) into `folder` by ascending `order` (nulls first; equal places by id, then by ids' checksum).

    Texts are encoded once into the shared folder and counted on the way for the common table, dealt into ranges of the order (rows of
    one place may be in several) and coded block by block; a lost task is simply run again. Null text: empty, one end id. No rows: no blocks.
    Control strings in texts become their ids, as the tokenizer has it. Other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = ids_of(tokenizer)
    kind, size = tokens.kind, max(tokens.tokenizer.get_vocab_size(), end_id + 1)
    plain = f"{checkpoint_folder(spark)}/ids-{uuid.uuid4().hex}"
    place = F.col(order) if isinstance(order, str) else order
    token_rows(docs, place, tokenizer, end_id, size).write.option("compression", "zstd").parquet(plain)
    rows = spark.read.schema(ROWS).parquet(plain)
    freq = frequencies(id_counts(rows, size))
    spark.createDataFrame(pa.table({"freq": pa.array([freq.astype("<u4").tobytes()], pa.binary())})).coalesce(1).write.parquet(f"{folder}/table")
    rows = rows.where("row is not null").select("place", "doc_id", "crc", "row", "ids")
    keys = [F.col("place").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "crc", "row"]
    placed = rows.repartitionByRange(min(most_pieces, max(1, -(-rows.count() // piece_rows))), *keys).sortWithinPartitions(*keys)

    def blocks(batches):
        from pyspark import TaskContext

        table, width = Table(freq), np.dtype(kind).itemsize
        held: list = []
        state = {"block": 0, "start": 0, "n": 0}

        def close():
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            row = {
                "piece": [TaskContext.get().partitionId()], "block": [state["block"]], "start_in_piece": [state["start"]], "n_tokens": [len(ids)],
                "doc_ids": [[d for d, _ in held]], "lengths": [[len(x) // width for _, x in held]], "payload": [encode_block(ids, table)],
            }
            state.update(block=state["block"] + 1, start=state["start"] + len(ids), n=0)
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=BLOCK_SCHEMA)

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if state["n"] >= BLOCK_TOKENS:
                    yield close()
                held.append((d, x))
                state["n"] += len(x) // width
        if held:
            yield close()

    placed.select("doc_id", "ids").mapInArrow(blocks, BLOCK_DDL).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


BLOCK_DDL = "piece int, block long, start_in_piece long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"
BLOCK_SCHEMA = pa.schema(
    [("piece", pa.int32()), ("block", pa.int64()), ("start_in_piece", pa.int64()), ("n_tokens", pa.int64()),
     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    freq = np.frombuffer(spark.read.parquet(f"{folder}/table").first()["freq"], "<u4")
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{folder}/blocks")
    sums = spark.read.schema(BLOCK_DDL).parquet(f"{folder}/blocks").groupBy("piece").agg(F.sum("n_tokens").alias("n"))
    base, total = [], 0
    for p, n in sorted((r["piece"], r["n"]) for r in sums.collect()):  # a row a piece, at most about 100,000
        base.append((p, total))
        total += n
    bases = spark.createDataFrame(pa.table({"piece": pa.array([p for p, _ in base], pa.int32()), "base": pa.array([n for _, n in base], pa.int64())}))

    def decode(batches):
        table = Table(freq)
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, lengths, start, payload = (batch.column(c)[r] for c in ("doc_ids", "lengths", "start", "payload"))
                ids = decode_block(payload.as_py(), table).astype("<u4")
                doc_ids, lengths = doc_ids.as_py(), lengths.as_py()
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64()), pa.array(start.as_py() + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = blocks.join(F.broadcast(bases), "piece").select("doc_ids", "lengths", (F.col("start_in_piece") + F.col("base")).alias("start"), "payload")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def encoded(docs: DataFrame, tokenizer: str, order: str | Column = "doc_id") -> DataFrame:
    """Write `docs` to a new folder beside the checkpoints and read its documents back."""
    folder = f"{checkpoint_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, order)
    return read_tokens(docs.sparkSession, folder)
