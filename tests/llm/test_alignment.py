"""Token alignment against whole-text encoding and a plain merge; units against whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from borelight.llm import alignment, units
from borelight.llm.queries import byte_bpe, piece_bpe

DDL = "doc_id long, text string, block long, kind int, uid string, key string, piece int, a string, total int"
ODD = [
    None, "", " ", "\n", "a", "  two  spaces  ", "\n\nlines\n\nand \n mixed\r\n\ttabs\t", "nbsp\xa0 here  em 　wide sep", "control <|endoftext|> <s> </s> <unk> <0x41>",
    "word mark ▁here", "ünïcödé ﬁ Ａ é 你好 мир 🙂🙂 end", "nul \0 x", "it's we'll I'd", "x" * 5000, "a\nb c\nd e", "trail ", " lead", "1 2 33 444,5.6",
]


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain(texts):
    """Each text's ids, groups and links, by whole-text calls and dictionaries."""
    pair = alignment.Pair(byte_bpe(), piece_bpe())
    docs = []
    for text in texts:
        a = b = []
        if text:
            a = pair.a.encode(" " + text, add_special_tokens=False).ids
            b = pair.b.encode(text)
            want = (" " + text).encode()
            if b"".join(pair.bytes_a[i] for i in a) != want or b"".join(pair.bytes_b[i] for i in b) != want:
                a = b = []
        ea, eb = ends([pair.bytes_a[i] for i in a]), ends([pair.bytes_b[i] for i in b])
        place = {e: i for i, e in enumerate(ea)}
        links = [(place[e], j) for j, e in enumerate(eb) if e in place]
        docs.append((a, b, links))
    count = Counter((a[i], b[j]) for a, b, links in docs for i, j in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for a, b, links in docs:
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        n = [count[a[i], b[j]] for i, j in links]
        best = sum(count[a[i], b[j]] == most[b[j]] for i, j in links)
        out.append((len(a), len(b), len(groups), len(links), best, sum(n), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return out


def words(seed, n):
    r = random.Random(seed)
    alphabet = "abcdeghinorstuüé"
    return "".join("".join(r.choices(alphabet, k=r.randint(1, 9))) + r.choice([" ", " ", " ", "\n", ", ", "  ", "\t"]) for _ in range(n))


def test_documents(spark):
    texts = [*ODD, "again and again", "again and again", words(1, 30), words(2, 9000), words(3, 400)]
    rows = [(i if i % 7 else None, t, 1, 2, "u", "k", 3, "a", 4) for i, t in enumerate(texts)]
    want = sorted((r[0] is not None, r[0] or 0, *p) for r, p in zip(rows, plain(texts), strict=True))
    for piece in (alignment.PIECE, 7):
        got = alignment.aligned(spark.createDataFrame(rows, DDL).repartition(3), byte_bpe(), piece_bpe(), piece=piece)
        assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in got.collect()) == want
    none = alignment.aligned(spark.createDataFrame([], DDL), byte_bpe(), piece_bpe())
    assert none.count() == 0


def test_groups_are_the_text_behind_the_digest(spark):
    df = spark.createDataFrame([(1, words(4, 3000)), (2, "")], "doc_id long, text string")
    got = alignment.aligned(df, byte_bpe(), piece_bpe(), with_groups=True, piece=100)
    again = got.select(F.array_join("groups", ";").alias("g"), "groups_sha256", "n_groups").collect()
    for r in again:
        assert r["groups_sha256"] == (hashlib.sha256(r["g"].encode()).hexdigest() if r["g"] else "")
        assert r["n_groups"] == (r["g"].count(";") + 1 if r["g"] else 0)


def test_common_pairs_and_others_take_the_same_counts(spark, monkeypatch):
    texts = [words(k % 5, 60) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(alignment, "BLOCK", 300)
    want = sorted((i, *p) for i, p in enumerate(plain(texts)))
    for common in (1, 200, 50_000):
        monkeypatch.setattr(alignment, "COMMON", common)
        assert sorted(map(tuple, alignment.aligned(df, byte_bpe(), piece_bpe()).collect())) == want


def test_crossings_are_those_of_a_plain_merge():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.cumsum(r.integers(1, 4, r.integers(0, 40))) for _ in range(2))
        path = sorted([(x, 0) for x in a] + [(y, 1) for y in b])
        for step in (1, 5, 16):
            want = [sum(side == 0 for _, side in path[:d]) for d in range(step, len(path), step)]
            if len(a) and len(b):
                assert alignment.crossings(a, b, step).tolist() == want


def test_units_give_the_ids_of_whole_texts():
    r = random.Random(5)
    pair = alignment.Pair(byte_bpe(), piece_bpe())
    parts = ["a", "word", " ", " ", " ", "\n", "\t", "\r", "\xa0", " ", "'s", "é", "你", "7", "!", "\x1c", "<|endoftext|>"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(2000)]
    a, at_a, b, at_b, ok = pair.encode(pa.array(texts))
    for k, t in enumerate(texts):
        if ok[k]:
            assert a[at_a[k] : at_a[k + 1]].tolist() == pair.a.encode(" " + t, add_special_tokens=False).ids
            assert b[at_b[k] : at_b[k + 1]].tolist() == pair.b.encode(t)
    assert ok.all()
    assert [x for lo, hi in units.slices(pa.array(texts)) for x in range(lo, hi)] == list(range(2000))
