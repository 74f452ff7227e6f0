"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss."""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1500  # documents that the model is fitted on, about
EPOCHS = 6
RATE = 0.2
PIECES = 14  # most pieces a span has

# fixed values: the base patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECE = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.DOTALL)
SIGN = re.compile(r"[0-9@]")
GAP = re.compile(r"[ \t]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def small_parts(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: the local part is what allowed characters stand before an @, back to the last match."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans: kind, start, end (code points)."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if SIGN.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m.group())]
        for m in CARD.finditer(text):
            d = digits_of(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches of neighbouring words that each hold a digit or an @; entities are sought nowhere else."""
    out: list[list[int]] = []
    m = SIGN.search(text)
    while m:
        start = m.start()
        low = out[-1][1] if out else 0
        while start > low and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        if out and GAP.fullmatch(text, out[-1][1], start):
            out[-1][1] = end
        else:
            out.append([start, end])
        m = SIGN.search(text, end)
    return [(a, b) for a, b in out]


def shape(s: str) -> str:
    s = re.sub(r"[A-Za-z]+", "a", s)
    return re.sub(r"[0-9]+", lambda m: "9" * min(len(m.group()), 6), s)


def possible(kind: str, s: str) -> bool:
    """What a span of the kind must at least be; the model judges the rest."""
    if kind == "email":
        return s.count("@") == 1 and re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) is not None and small_parts(s)
    d = digits_of(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and s[0].isdigit() and s[-1].isdigit() and re.fullmatch(r"[0-9 -]+", s) is not None and luhn(d)
    return 8 <= len(d) <= 15 and s[0] == "+" and s[-1].isdigit() and re.fullmatch(r"\+[0-9 ().-]+", s) is not None


def features(kind: str, text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span."""
    s = text[start:end]
    side = lambda c: "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c
    return [
        f"{kind} bias", f"{kind} shape {shape(s)[:40]}", f"{kind} digits {len(digits_of(s))}", f"{kind} before {side(text[start - 1 : start])}",
        f"{kind} after {side(text[end : end + 1])}", f"{kind} blanks {s.count(' ')}", f"{kind} points {s.count('.')}",
    ]


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[list[tuple[int, str, list[str]]]]]:
    """Borders of an island's pieces, and for each border the candidate spans that end there: (first border, kind, features)."""
    edges = [start, *(m.end() for m in PIECE.finditer(text, start, end))]
    spans: list[list[tuple[int, str, list[str]]]] = [[] for _ in edges]
    for j in range(1, len(edges)):
        last = text[edges[j] - 1]
        if not (last.isdigit() or last.isalpha() or last == "-"):
            continue
        for i in range(max(0, j - PIECES), j):
            s = text[edges[i] : edges[j]]
            if SIGN.search(s) and not s[0].isspace():
                spans[j] += [(i, k, features(k, text, edges[i], edges[j])) for k in KINDS if possible(k, s)]
    return edges, spans


def score(weights: dict[str, float], names: list[str]) -> float:
    return sum(weights.get(n, 0.0) for n in names)


def decode(weights: dict[str, float], edges: list[int], spans: list) -> list[tuple[str, int, int]]:
    """The best segmentation: pieces outside spans score 0, a span its features; ties go to fewer spans."""
    best, back = [0.0] * len(edges), [None] * len(edges)
    for j in range(1, len(edges)):
        best[j] = best[j - 1]
        for i, kind, names in spans[j]:
            v = best[i] + score(weights, names)
            if v > best[j] + 1e-12:
                best[j], back[j] = v, (i, kind)
    out, j = [], len(edges) - 1
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((kind, edges[i], edges[j]))
            j = i
        else:
            j -= 1
    return out[::-1]


def log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m)) if m > -math.inf else m


def gradient(weights: dict[str, float], edges: list[int], spans: list, true: set) -> dict[str, float]:
    """Of the log-likelihood of the true segmentation: observed minus expected features, by forward and backward sums."""
    n = len(edges)
    value = [[score(weights, names) for _, _, names in spans[j]] for j in range(n)]
    f = [0.0] * n
    for j in range(1, n):
        f[j] = f[j - 1]
        for (i, _, _), v in zip(spans[j], value[j], strict=True):
            f[j] = log_add(f[j], f[i] + v)
    b = [-math.inf] * n
    b[n - 1] = 0.0
    for j in range(n - 1, 0, -1):
        b[j - 1] = log_add(b[j - 1], b[j])
        for (i, _, _), v in zip(spans[j], value[j], strict=True):
            b[i] = log_add(b[i], b[j] + v)
    out: dict[str, float] = {}
    for j in range(1, n):
        for (i, kind, names), v in zip(spans[j], value[j], strict=True):
            g = ((kind, edges[i], edges[j]) in true) - math.exp(f[i] + v + b[j] - f[n - 1])
            for name in names:
                out[name] = out.get(name, 0.0) + g
    return out


def fit(texts: list[str]) -> dict[str, float]:
    """Weights that make the base spans of the texts likely, by steps along the gradient of each island; spans cut off by an
    island's border teach nothing."""
    cases = []
    for text in texts:
        true = set(base_spans(text))
        for a, b in islands(text):
            edges, spans = candidates(text, a, b)
            own = {(k, edges[i], edges[j]) for j in range(len(edges)) for i, k, _ in spans[j]} & true
            if any(spans):
                cases.append((edges, spans, own))
    weights: dict[str, float] = {}
    for epoch in range(EPOCHS):
        for edges, spans, own in cases:
            for name, g in gradient(weights, edges, spans, own).items():
                weights[name] = weights.get(name, 0.0) * (1 - 1e-4) + RATE / (1 + epoch) * g
    return weights


def fit_on(docs: DataFrame) -> dict[str, float]:
    """Fit on about SAMPLE documents that hold a digit or an @, chosen by a hash of their text; only islands leave the executors."""
    rows = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    total = max(1, rows.count())
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / total) * (1 << 20))).distinct()

    def cut(batches):
        for batch in batches:
            parts = [t[max(0, a - 1) : b + 1] for t in batch.column("text").to_pylist() for a, b in islands(t) if b - a <= 400]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["text"])

    parts = some.mapInArrow(cut, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(2 * SAMPLE)
    return fit([r["text"] for r in parts.collect()])


def spans_of(text: str, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and, beside them, the model's spans that touch none of them; each sorted by kind, then start."""
    base = base_spans(text)
    taken: list[list[int]] = []  # what base spans cover, in order, without overlaps
    for x, y in sorted(s[1:] for s in base):
        if taken and x <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], y)
        else:
            taken.append([x, y])
    starts = [x for x, _ in taken]

    def reached(start: int, end: int) -> bool:
        k = bisect.bisect_left(starts, end) - 1
        return k >= 0 and taken[k][1] > start

    added = []
    for a, b in islands(text):
        if base and all(reached(m.start(), m.end()) for m in SIGN.finditer(text, a, b)):
            continue  # every sign is taken
        edges, spans = candidates(text, a, b)
        if any(spans):
            added += [s for s in decode(weights, edges, spans) if not reached(s[1], s[2])]
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(added, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, counts of base spans (n_email, n_ip, n_card, n_phone), base_sha256 and all spans as `kind:start:end`, joined by commas.

    Base spans are what the fixed patterns match; matches that fail their check are dropped whole. The model looks at stretches
    around digits and @ and adds spans of the same kinds where no base span is. Places are code points, end exclusive. Texts are
    read whole, once; nothing is shuffled. Null text: empty. No spans: zero counts and empty text. Repeated rows report each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(docs) if weights is None else weights)

    def find(batches):
        for batch in batches:
            rows = [spans_of(t or "", shared.value) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows])
            every = pa.array([joined(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))) for base, more in rows])
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, every], names=names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)
