"""The Merkle manifest against a plain tree, with null, empty and very long values, repeated rows, groups of one and of several blocks."""

import hashlib
import zlib

from pyspark.sql import functions as F

from borelight.llm import manifest, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
DDL = "doc_id long, source string, lang string, n_chars long, text string, rank int, hash string, grp string, part int, own string, uid long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if (i ^ 1) < len(level) else None, i % 2))
        i //= 2
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(top, k)
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for sib, right in path:
                now = H(now) if sib is None else H(sib, now) if right else H(now, sib)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*[s for s, _ in path if s]), now, now == top[-1][0]))
    return sorted(map(repr, out))


def found(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 7, "h", "g", 3, "o", 5) for r in rows], DDL)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r)) for r in got.collect())


def test_odd_values(spark, tmp_path):
    rows = [(1, "a", "en", 3, "abc"), (1, "a", "en", 3, "abc"), (1, "b", "en", None, None), (None, None, None, None, None), (None, "", "", 0, ""),
            (9, "ü", "de", 1, "ß"), (10, "x", "Z", 5, "w " * 100_000), (-4, "x", "zä", 5, "line\nline"), (7, "", "en", 3, "-")]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_one_large_group(spark, tmp_path):
    rows = [(int(i * 37 % 2600), "s", "en" if i % 40 else "fr", i, f"text {i}") for i in range(2600)]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_one_row_and_none(spark, tmp_path):
    assert found(spark, tmp_path / "one", [(14, "a", "en", 3, "abc")]) == plain([(14, "a", "en", 3, "abc")])
    assert found(spark, tmp_path / "none", []) == []


def test_a_changed_row_is_the_only_one_that_fails(spark):
    rows = [(i, "s", "en", i, str(i)) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.manifest(df, COLUMNS, "lang", "doc_id", F.col("doc_id") == 33, {"text": F.lit("other")})
    assert [r["key"] for r in got.where("not verified").collect()] == [33]
    assert manifest.manifest(df, COLUMNS, "lang", "doc_id").where("not verified").isEmpty()
