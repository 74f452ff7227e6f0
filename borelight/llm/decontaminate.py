"""Benchmark passages inside documents: q-gram lemma filter in diagonal bands, then banded alignment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelight.llm.held import held, latest
from borelight.llm.shingles import GOLD, mix

Q = 12
WINDOW = 64
EDITS = 3  # in a window
BAND = 16
BLOCK_CHARS = 2_000_000
FOUND = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, edits long"


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case with one blank for what lies between them; and the place of each in `text`."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = held(("alnum",), lambda: np.array([chr(c).isalnum() for c in range(1 << 16)]))
    solid = word[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    return np.where(solid[at], codes[at], np.uint32(32)), at


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all runs of q characters, by joining runs of doubling length."""
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    have, n, out, size = codes.astype(np.uint64) + GOLD, 1, None, 0
    while True:
        if q & n:
            out, size = (have, n) if out is None else (out[: len(out) - n] * GOLD ^ mix(have[size:]) if size else have, size + n)
        if 2 * n > q:
            return mix(out[: len(codes) - q + 1])
        have = mix(have[:-n] * GOLD + have[n:])
        n *= 2


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.codes = [plain(t)[0].copy() for _, t in items]
        for k, c in enumerate(self.codes):
            if len(c) and c[-1] == 32:
                self.codes[k] = c[:-1]
        grams = [qgrams(c) for c in self.codes]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.h, self.first, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.h >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the document, item, place in the item) of all shared q-grams."""
        g = qgrams(codes)
        p = np.flatnonzero(self.seen[(g >> np.uint64(44)).astype(np.int64)])
        if not len(p):
            return p, p, p
        k = np.searchsorted(self.h, g[p])
        k[k == len(self.h)] = 0
        same = self.h[k] == g[p]
        p, k = p[same], k[same]
        n = self.n[k]
        at = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(p, n), self.item[at], self.place[at]


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance inside a diagonal band of half-width `most`; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if np.array_equal(a, b):
        return 0
    a, b = a.tolist(), b.tolist()
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, c in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most + 1) + 1
            if j:
                best = min(best, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (b[j - 1] != c))
            new[j] = best
        if min(new.values()) > most:
            return most + 1
        row = new
    return min(row[len(b)], most + 1)


def near_windows(item: np.ndarray, codes: np.ndarray, first: int, last: int, low: int, high: int) -> list[tuple]:
    """(item start, item end, document start, document end): windows of `item` that start in first..last and lie in `codes`
    with at most their budget of edits, on diagonals (document place - item place) low..high. All windows go through the rows of
    one banded alignment together; its ends are free in the document."""
    w = min(WINDOW, len(item))
    most = min(EDITS, max(1, w * EDITS // WINDOW))
    n = high - low + 1
    step = np.arange(n) * n  # one more document character costs n; what is left over is the diagonal of the start
    out = []
    for lo in range(first, last + 1, 4096):
        a = np.arange(lo, min(lo + 4096, last + 1))
        base, stop = int(a[0]) + low, int(a[-1]) + w + high
        near = np.full(stop - base, -1, dtype=np.int64)
        have = slice(max(base, 0), max(min(stop, len(codes)), 0))
        if have.stop <= have.start:
            continue
        near[have.start - base : have.stop - base] = codes[have]
        own, place = item.astype(np.int64), (a - a[0])[:, None] + np.arange(n)
        cost = np.broadcast_to(np.arange(n), (len(a), n))
        for r in range(w):
            new = cost + n * (near[place + r] != own[a + r, None])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + n)
            cost = np.minimum.accumulate(new - step, axis=1) + step
            if r % 16 == 15:
                live = cost.min(axis=1) < (most + 1) * n
                if not live.any():
                    break
                a, place, cost = a[live], place[live], cost[live]
        else:
            end = cost.argmin(axis=1)
            best = cost[np.arange(len(a)), end]
            for x, c, e in zip(a.tolist(), best.tolist(), end.tolist(), strict=True):
                d0, d1 = max(0, x + low + c % n), min(len(codes), x + w + low + e)
                if c < (most + 1) * n and d1 > d0:
                    out.append((x, x + w, d0, d1))
    return out


def joined(windows: list[tuple], whole: list[tuple]) -> list[tuple]:
    """Windows (item start, item end, document start, document end) that overlap on about one diagonal, as one passage each;
    those inside a passage of `whole` are left out."""
    runs: list[list] = []
    for i0, i1, d0, d1 in sorted(windows):
        if any(i0 >= x[0] - EDITS and i1 <= x[1] + EDITS and d0 >= x[2] - EDITS and d1 <= x[3] + EDITS for x in whole):
            continue
        for x in reversed(runs):
            if i0 < x[1] and d0 < x[3] and x[2] < d1 and abs(d0 - i0 - x[4]) <= EDITS:
                x[1:] = max(x[1], i1), min(x[2], d0), max(x[3], d1), d0 - i0
                break
        else:
            runs.append([i0, i1, d0, d1, d0 - i0])
    return [tuple(x[:4]) for x in runs]


def regions(text: str, index: Index) -> list[tuple]:
    """(item number, document start and end, item start and end, edits): places in `text` and in the plain item.

    A passage of `WINDOW` characters with at most `EDITS` edits shares at least WINDOW - Q + 1 - EDITS * Q q-grams with its item,
    all on diagonals at most EDITS apart. Bands of BAND diagonals overlap by EDITS, so they lie in one band. Windows that reach
    the count are joined to regions and confirmed by alignment: in all, or else every window of the item that touches the region
    by itself, as its shared q-grams may cover only a part of it. Items shorter than a window count as one window of their length.
    """
    codes, at = plain(text)
    p, item, place = index.hits(codes)
    if not len(p):
        return []
    sizes = np.array([len(c) for c in index.codes])
    window = np.minimum(WINDOW, sizes)[item]
    need = window - Q + 1 - np.minimum(EDITS, np.maximum(0, (window - Q) // Q)) * Q
    shift = int(sizes.max())
    diagonal = p - place + shift
    band, over = diagonal // BAND, diagonal % BAND < EDITS
    p, item, place, band, window, need = (np.concatenate([x, x[over]]) for x in (p, item, place, band, window, need))
    band[len(over):] -= 1
    key = item * (int(band.max()) + 2) + band + 1
    _, counts = np.unique(key, return_counts=True)
    if counts.max() < need.min():
        return []
    order = np.lexsort((place, p, key))
    p, item, place, band, window, need, key = (x[order] for x in (p, item, place, band, window, need, key))
    fresh = np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1])]  # a place counts once in a band
    p, item, place, band, window, need, key = (x[fresh] for x in (p, item, place, band, window, need, key))
    end = np.arange(len(p)) + need - 1
    good = end < len(p)
    end = np.minimum(end, len(p) - 1)
    good &= (key[end] == key) & (p[end] - p <= window - Q + EDITS)
    out, whole, parts = set(), {}, {}
    starts, ends = np.flatnonzero(good), end[good]
    i = 0
    while i < len(starts):
        j = i
        last = ends[i]
        while j + 1 < len(starts) and key[starts[j + 1]] == key[starts[i]] and p[starts[j + 1]] <= p[last] + Q:
            j += 1
            last = max(last, ends[j])
        s = starts[i]
        i = j + 1
        k, own = int(item[s]), index.codes[int(item[s])]
        d0, d1, i0, i1 = int(p[s]), int(p[last]) + Q, int(place[s]), int(place[last]) + Q
        size, w = max(d1 - d0, i1 - i0), min(WINDOW, len(own))
        if i1 - i0 >= Q and size >= w - EDITS * 2:
            most = max(1, size * EDITS // WINDOW)
            edits = distance(own[i0:i1], codes[d0:d1], most)
            if edits <= most:
                out.add((k, int(at[d0]), int(at[d1 - 1]) + 1, i0, i1, edits))
                whole.setdefault(k, []).append((i0, i1, d0, d1))
                continue
        low = int(band[s]) * BAND - shift
        touched = place[s : last + 1]
        first, final = max(0, int(touched.min()) - w + 1), min(len(own) - w, int(touched.max()) + Q - 1)
        parts.setdefault(k, set()).add((first, final, low - EDITS, low + BAND + 2 * EDITS - 1))
    for k, zones in parts.items():
        own = index.codes[k]
        windows = {x for z in zones for x in near_windows(own, codes, *z)}
        for i0, i1, d0, d1 in joined(list(windows), whole.get(k, [])):
            most = 2 * EDITS
            while (edits := distance(own[i0:i1], codes[d0:d1], most)) > most:
                most *= 2
            out.add((k, int(at[d0]), int(at[d1 - 1]) + 1, i0, i1, edits))
    return sorted(out)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most about two million characters; one is held at a time."""
    rows, size = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if rows and size + len(r["text"]) > BLOCK_CHARS:
            yield rows
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if rows:
        yield rows


def index_of(name: str, sent) -> Index:
    """The index of one block of the benchmark, made once a process; the one before it goes."""
    return latest(("benchmark",), name, lambda: Index(sent.value))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per passage of `benchmark` (item_id, text) found in `docs` (doc_id, text): ids, places and edits.

    Documents are read whole and never shuffled: one pass per block of the benchmark. Letters are compared in lower case and
    anything else counts as one blank. doc_start and doc_end are code points of the text, end exclusive; item places count
    plain characters. Passages shorter than 12 plain characters cannot match. Null texts match nothing; repeated items and
    documents report each; null ids are passed on. No rows on either side: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    out = docs.sparkSession.createDataFrame([], FOUND)
    for block in blocks(benchmark):
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches, sent=sent, name=name):
            index = index_of(name, sent)
            for batch in batches:
                got = [
                    (d.as_py(), index.ids[r[0]], *r[1:])
                    for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True)
                    for r in regions(t.as_py(), index)
                ]
                names = [x.split()[0] for x in FOUND.split(", ")]
                yield pa.RecordBatch.from_pydict({n: pa.array([g[k] for g in got], pa.int64()) for k, n in enumerate(names)})

        out = out.unionByName(rows.mapInArrow(search, FOUND))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in whose text no passage of `benchmark` is found; null texts stay."""
    for block in blocks(benchmark):
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def clean(batches, sent=sent, name=name):
            index = index_of(name, sent)
            for batch in batches:
                yield batch.filter(pa.array([t.as_py() is None or not regions(t.as_py(), index) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
