"""Align the tokens of two tokenizers over the same bytes: merge the ends of both sides by merge-path pieces.

A document has two rising lists of token ends. Merging them walks a path through a grid; the diagonals of the grid at every PIECE steps
are searched by bisection for the point where the path crosses, which cuts both lists into pieces of equal work that are merged
independently, wherever Spark puts them. A piece carries the last A token before it, so that ends that meet on a diagonal are seen.
Groups that go over a border are stitched when a document's pieces are read in order. Counts over the corpus are made per block, a run of
about BLOCK merged ends of whole documents: blocks send one row for each pair of ids they hold and get its total back.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelight.llm.held import held
from borelight.llm.units import Units, Vocabulary, by_lines, plain, slices
from borelight.operators.materialise import materialised

PIECE = 8192  # merged ends of a piece
BLOCK = 1 << 20
MERGED = 1 << 18
COMMON = 50_000  # at most so many pairs are in more than a COMMON-th of all block rows

PIECES = "block long, uid long, doc_id long, piece int, last boolean, start_a long, start_b long, prev_a long, n_a int, n_b int, a binary, b binary"
COUNTED = "block long, key long, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups array<string>"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with their units remembered, and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # control strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = byte_of_char()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [t.encode() if t in added else bytes(chars[c] for c in t) for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.known_a, self.known_b = Vocabulary(self.bytes_a), Vocabulary(self.bytes_b)
        self.length_a, self.length_b = self.known_a.lengths, self.known_b.lengths
        self.kind = "<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4"
        feed = self.a.encode("\n", add_special_tokens=False).ids
        self.feed_a = feed[0] if len(feed) == 1 else -1
        ordinary = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        split = not any("▁" in p.lstrip("▁") or "\n" in p for p in ordinary)
        probe = self.b.encode("\nx")
        self.feed = probe[:2] if split and [self.bytes_b[i] for i in probe[:2]] == [b" ", b"\n"] else None
        self.units = Units(self.encoded, 2, split and self.feed is not None)

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def encoded(self, units: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
        """A ids and B ids of every unit as bytes, and whether both sides give the unit's bytes back."""
        texts = [u.decode("utf-8", "replace") for u in units]
        a, b = [None] * len(units), [None] * len(units)
        many = [i for i, u in enumerate(units) if plain(u)] if self.units.split else []
        lines = [texts[i] for i in many]
        for i, x, y in zip(many, by_lines(self.ids_a, lines, self.feed_a), by_lines(self.ids_b, lines, self.feed[1], "\n", 2) if many else [], strict=True):
            a[i], b[i] = x, y
        rest = [i for i in range(len(units)) if a[i] is None or b[i] is None]
        # B puts a space before every text: a unit without one is encoded behind a line feed, and both are dropped
        later = [texts[i][:1] != " " for i in rest]
        for i, x, y, drop in zip(rest, self.ids_a([texts[i] for i in rest]), self.ids_b(["\n" + texts[i] if d else texts[i][1:] for i, d in zip(rest, later, strict=True)]), later, strict=True):
            a[i], b[i] = np.array(x, "<u4").tobytes(), np.array(y[2:] if drop else y, "<u4").tobytes()
        return [a, b], self.known_a.spells(a, units) & self.known_b.spells(b, units)

    def encode(self, texts: pa.Array) -> tuple:
        """Ids of A and bounds per text, ids of B and bounds per text, and which texts have tokens."""
        texts, none = texts.cast(pa.large_string()), pa.scalar("", pa.large_string())
        given = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0)
        whole = pc.if_else(given, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts, none), none), none)
        ((a, at_a), (b, at_b)), good = self.units.texts(whole)
        return a, at_a, b, at_b, good & given.to_numpy(zero_copy_only=False)


def pair_of(path_a: str, path_b: str) -> Pair:
    return held(("pair", path_a, path_b), lambda: Pair(path_a, path_b))


def crossings(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many of the sorted `a` lie before the path's crossing of each diagonal step, 2 step ..; of equal values `a` comes first."""
    d = np.arange(step, len(a) + len(b), step)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        less = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - 1 - mid, 0, len(b) - 1)])
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def pieces(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE) -> DataFrame:
    """Every text encoded on both sides and cut into pieces; a text without tokens is one empty piece."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def encode(batches):
        from pyspark import TaskContext

        pair = pair_of(path_a, path_b)
        part = TaskContext.get().partitionId()
        uid, block, filled = part << 40, part << 24, 0
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                a, at_a, b, at_b, ok = pair.encode(batch.column("text").slice(lo, hi - lo))
                rows = []
                for k, doc_id in enumerate(ids):
                    x, y = (a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]]) if ok[k] else (a[:0], b[:0])
                    if filled >= BLOCK:
                        block, filled = block + 1, 0
                    filled += len(x) + len(y)
                    uid += 1
                    if len(x) + len(y) <= piece:
                        rows.append((block, uid, doc_id, 0, True, 0, 0, None, *kept(x, y, pair.kind)))
                        continue
                    ends_a, ends_b = np.cumsum(pair.length_a[x]), np.cumsum(pair.length_b[y])
                    i = np.concatenate([[0], crossings(ends_a, ends_b, piece), [len(x)]])
                    j = np.concatenate([[0], np.arange(piece, len(x) + len(y), piece), [len(x) + len(y)]]) - i
                    for p in range(len(i) - 1):
                        before = int(i[p]) - 1
                        rows.append((
                            block, uid, doc_id, p, p == len(i) - 2, int(ends_a[before]) if before >= 0 else 0, int(ends_b[j[p] - 1]) if j[p] else 0,
                            int(x[before]) if before >= 0 else None, *kept(x[i[p] : i[p + 1]], y[j[p] : j[p + 1]], pair.kind),
                        ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


class Merged:
    """Pieces merged side by side: ids of both sides, where each piece's begin, and the links, by the places of their tokens."""

    def __init__(self, batch, pair: Pair):
        get = lambda c: batch.column(c)
        self.a, self.at_a = flat(get("a"), get("n_a"), pair.kind)
        self.b, self.at_b = flat(get("b"), get("n_b"), pair.kind)
        n = batch.num_rows
        start_a, start_b = get("start_a").to_numpy(), get("start_b").to_numpy()
        self.prev = pc.fill_null(get("prev_a"), -1).to_numpy()
        base = np.arange(n, dtype=np.int64) << 32  # keeps the ends of one piece apart from the next one's
        ends_a = rising(pair.length_a[self.a], self.at_a, start_a + base)
        ends_b = rising(pair.length_b[self.b], self.at_b, start_b + base)
        # the token before a piece takes part with its end
        carried = np.insert(ends_a, self.at_a[:-1], np.where(self.prev >= 0, start_a + base, base - 1))
        at = np.minimum(np.searchsorted(carried, ends_b), len(carried) - 1)
        hit = carried[at] == ends_b
        self.link_b = np.flatnonzero(hit)
        piece = np.searchsorted(self.at_b, self.link_b, "right") - 1
        self.link_a = at[hit] - piece - 1  # the place in `a`; for a token before the piece one less than the piece's first
        before = self.link_a < self.at_a[piece]
        ids = self.a[np.maximum(self.link_a, 0)] if len(self.a) else np.zeros(len(piece), self.a.dtype)
        ids_a = np.where(before, self.prev[piece], ids.astype(np.int64))
        self.keys = (ids_a << 32) | self.b[self.link_b].astype(np.int64)
        self.at_link = np.searchsorted(self.link_b, self.at_b)


def kept(a: np.ndarray, b: np.ndarray, kind: str) -> tuple[int, int, bytes, bytes]:
    """Numbers of ids, and the ids of both sides packed."""
    return len(a), len(b), *(pa.compress(x.astype(kind).tobytes(), "zstd", asbytes=True) for x in (a, b))


def flat(column: pa.Array, sizes: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of packed rows, one after the other, and where each row's begin, with the end."""
    sizes, width = sizes.to_numpy().astype(np.int64), np.dtype(kind).itemsize
    parts = [pa.decompress(x, n, "zstd", asbytes=True) if n else b"" for x, n in zip(column.to_pylist(), (sizes * width).tolist(), strict=True)]
    return np.frombuffer(b"".join(parts), kind).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def rising(lengths: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of tokens, each row counted from its start."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ends[1:] + np.repeat(starts - ends[at[:-1]], np.diff(at))


def merged(batches, pair: Pair):
    """(rows, Merged) of some pieces at a time, about MERGED ids."""
    for batch in batches:
        sizes = np.cumsum(pc.add(batch.column("n_a"), batch.column("n_b")).to_numpy().astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + MERGED, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, Merged(part, pair)
            lo = hi


def pair_counts(cut: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """How often each pair of ids (A id << 32 | B id) is linked in each block, in one row for each or a few of them."""

    def count(batches):
        pair, now, held_keys = pair_of(path_a, path_b), None, []

        def close():
            keys, n = np.unique(np.concatenate(held_keys), return_counts=True)
            held_keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now)), pa.array(keys), pa.array(n.astype(np.int64))], names=["block", "key", "n"])

        for rows, m in merged(batches, pair):
            blocks = rows.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held_keys and blocks[lo] != now:
                    yield close()
                now = blocks[lo]
                held_keys.append(m.keys[m.at_link[lo] : m.at_link[hi]])
        if held_keys:
            yield close()

    return cut.mapInArrow(count, COUNTED)


def totals(counted: DataFrame) -> DataFrame:
    """(block, key, total, best) for the pairs of every block: the count over the corpus, and whether it is the highest of its B id.

    Pairs found in very many blocks are few (each holds more than a COMMON-th of all rows) and are broadcast; no other key has more
    than that share of the rows of the shuffled join. A row for each B id, at most one for each entry of B's vocabulary, is broadcast too.
    """
    sums = materialised(counted.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")))
    b_id = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")
    highest = sums.groupBy(b_id).agg(F.max("total").alias("most"))
    known = sums.select("*", b_id).join(F.broadcast(highest), "b_id").select("key", "total", (F.col("total") == F.col("most")).alias("best"), "rows")
    known = materialised(known)
    limit = known.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] / COMMON
    common, rest = known.where(F.col("rows") > limit).drop("rows"), known.where(F.col("rows") <= limit).drop("rows")
    pairs = counted.select("block", "key")
    frequent = pairs.join(F.broadcast(common), "key")
    others = pairs.join(F.broadcast(common.select("key")), "key", "left_anti").join(rest, "key")
    return frequent.unionByName(others).select("block", "key", "total", "best")


def digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. size - 1, left-justified with one place more, and their number."""
    names = [str(i) for i in range(size)]
    width = len(names[-1]) + 1
    return np.frombuffer("".join(n.ljust(width) for n in names).encode(), np.uint8).reshape(size, width), np.array(list(map(len, names)), np.int64)


def written(a: np.ndarray, b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2;` of closed groups, the last of whose tokens stand at the links; and where the text of each group ends."""
    per_a, per_b = np.diff(link_a, prepend=-1), np.diff(link_b, prepend=-1)
    n = len(a) + len(b)
    ids, seps = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    places_a = np.arange(len(a)) + np.repeat(link_b + 1 - per_b, per_a)
    places_b = np.arange(len(b)) + np.repeat(link_a + 1, per_b)
    ids[places_a], ids[places_b] = a, b
    seps[places_a[link_a]], seps[places_b[link_b]] = ord("|"), ord(";")
    table, lengths = held(("digits", size), lambda: digits(size))
    chars, many = table[ids], lengths[ids]
    chars[np.arange(n), many] = seps
    out = chars[np.arange(chars.shape[1]) <= many[:, None]]
    return out, np.cumsum(many + 1)[places_b[link_b]]


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, piece: int = PIECE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): tokens on both sides, groups, links, how many links are of the commonest pair of their B
    id, the sum of the links' counts over the corpus, the SHA-256 of the groups as text, and, if asked for, that text in parts.

    A encodes a space and the text, B the text, which it puts a space before; control strings in texts are ordinary text. A group ends
    where a token of both sides ends, which also links these two. Null and empty texts, and texts that a side does not give back
    byte for byte, have no tokens: zeros and an empty digest. Repeated rows and null ids are rows like any other; other columns are ignored.
    A document is never cut at the size of a task: its pieces are merged one by one.
    """
    cut = materialised(pieces(docs, path_a, path_b, piece))
    known = totals(materialised(pair_counts(cut, path_a, path_b)))
    kinds = dict(c.split() for c in PIECES.split(", ")) | {"key": "long", "total": "long", "best": "boolean"}

    def row(df: DataFrame, kind: int) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])

    both = row(known, 0).unionByName(row(cut, 1)).repartition("block").sortWithinPartitions("block", "kind", "uid", "piece")

    def stitch(batches):
        pair = pair_of(path_a, path_b)
        size = max(len(pair.bytes_a), len(pair.bytes_b))
        block, keys, total, best, fresh = None, [], [], [], False
        doc: dict = {}

        def opened(doc_id):
            none = np.zeros(0, np.int64)
            doc.update(doc_id=doc_id, n=np.zeros(6, np.int64), sha=hashlib.sha256(), a=none, b=none, text=[], any=False)

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            blocks = batch.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(kind) != 0) | (np.diff(blocks) != 0)) + 1, [len(kind)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    if blocks[lo] != block or not fresh:
                        block, keys, total, best, fresh = blocks[lo], [], [], [], True
                    for held_rows, c in ((keys, "key"), (total, "total"), (best, "best")):
                        held_rows.append(part.column(c).to_numpy(zero_copy_only=False))
                    continue
                if fresh:
                    order = np.argsort(all_keys := np.concatenate(keys))
                    sorted_keys, sums, highest = all_keys[order], np.concatenate(total)[order], np.concatenate(best)[order]
                    fresh = False
                out = []
                for rows, m in merged([part], pair):
                    if len(m.keys):
                        at = np.searchsorted(sorted_keys, m.keys)
                        assert (sorted_keys[at] == m.keys).all()
                        link_sum, link_best = (np.concatenate([[0], np.cumsum(x)]) for x in (sums[at], highest[at].astype(np.int64)))
                    else:
                        link_sum = link_best = np.zeros(1, np.int64)
                    sizes = np.stack([
                        np.diff(m.at_a), np.diff(m.at_b), np.diff(m.at_link), np.diff(m.at_link), np.diff(link_best[m.at_link]), np.diff(link_sum[m.at_link]),
                    ], axis=1)
                    number, last = rows.column("piece").to_numpy(), rows.column("last").to_numpy(zero_copy_only=False)
                    ids = rows.column("doc_id").to_pylist()
                    whole = (number == 0) & last
                    if whole.all():  # nothing to stitch: all groups of these documents are closed, so their text is made at once
                        text, ends = written(m.a, m.b, m.link_a, m.link_b, size)
                        ends = np.concatenate([[0], ends])[m.at_link]
                        text = text.tobytes()
                    for k in range(rows.num_rows):
                        if number[k] == 0:
                            opened(ids[k])
                        doc["n"] += sizes[k]
                        if whole.all():
                            said = text[ends[k] : ends[k + 1]]
                        else:
                            links = slice(m.at_link[k], m.at_link[k + 1])
                            a = np.concatenate([doc["a"], m.a[m.at_a[k] : m.at_a[k + 1]]])
                            b = np.concatenate([doc["b"], m.b[m.at_b[k] : m.at_b[k + 1]]])
                            link_a = m.link_a[links] - m.at_a[k] + len(doc["a"])
                            link_b = m.link_b[links] - m.at_b[k] + len(doc["b"])
                            closed_a, closed_b = (int(x[-1]) + 1 if len(x) else 0 for x in (link_a, link_b))
                            said = written(a[:closed_a], b[:closed_b], link_a, link_b, size)[0].tobytes()
                            doc.update(a=a[closed_a:], b=b[closed_b:])
                        if said:
                            doc["sha"].update((b";" if doc["any"] else b"") + said[:-1])
                            doc["any"] = True
                            if with_groups:
                                doc["text"].append(said[:-1].decode())
                        if last[k]:
                            assert not len(doc["a"]) and not len(doc["b"])
                            out.append((doc["doc_id"], *doc["n"].tolist(), doc["sha"].hexdigest() if doc["any"] else "", doc["text"] if with_groups else None))
                if out:
                    kinds_out = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.string())]
                    names = [c.split()[0] for c in RESULT.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_out, strict=True)], names=names)

    result = both.mapInArrow(stitch, RESULT)
    return result if with_groups else result.drop("groups")
