"""Threshold pairs of vectors against all pairs, with copies, dense and loose groups, broken vectors and repeated ids."""

import numpy as np
import pytest

from borelight.llm import covertree

DDL = "vec_id long, embedding array<float>, label int, leaf int, shell int, uid string, rep string, v int, id int, n int, d1 int"


def plain(rows, threshold=0.95):
    good, vectors = [], []
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(k)
            vectors.append(np.array(v, np.float32).astype(float))
    n, group = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(good):
        for j in range(i):
            x, y = vectors[i], vectors[j]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                b = good[j]
                n[a] += 1
                n[b] += 1
                group[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).extend([i] if i is not None else [])
    out = []
    for k, (i, _) in enumerate(rows):
        c = min(ids[root(k)], default=None)
        out.append((i, n[k], c, i == c))
    return sorted(map(repr, out))


def found(spark, rows, threshold=0.95):
    df = spark.createDataFrame([(*r, 1, 2, 3, "u", "r", 4, 5, 6, 7) for r in rows], DDL).repartition(3)
    got = covertree.similar_vectors(df, threshold=threshold).withColumnRenamed("id", "vec_id").select("vec_id", "n_links", "component_id", "kept")
    return sorted(repr(tuple(r)) for r in got.collect())


def cloud(seed, n, width, spread, middle=None):
    r = np.random.default_rng(seed)
    middle = r.normal(size=width) if middle is None else middle
    return [(middle / np.linalg.norm(middle) + spread * r.normal(size=width) / np.sqrt(width)).astype(np.float32).tolist() for _ in range(n)]


def test_broken_and_odd_vectors(spark):
    v = cloud(1, 1, 5, 0)[0]
    odd = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 1.0, 0.0, 0.0, 0.0], v, v, [-x for x in v], [2 * x for x in v], [x * 1e-30 for x in v],
           v[:4], [1.0], [3.0], [-1.0], [0.0, -0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, -0.0, 0.0]]
    rows = [(i + 1, x) for i, x in enumerate(odd)] + [(7, odd[6]), (None, v), (None, [0.0, 1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0, 0.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (None, None)]) == sorted(map(repr, [(1, 0, 1, True), (None, 0, None, True)]))


@pytest.mark.parametrize("bundle, sample", [(8192, 2048), (40, 30), (7, 400)])
def test_groups(spark, monkeypatch, bundle, sample):
    """Dense groups that a node covers whole, groups as wide as the threshold, chains, copies, and vectors at random."""
    monkeypatch.setattr(covertree, "BUNDLE", bundle)
    monkeypatch.setattr(covertree, "SAMPLE", sample)
    r = np.random.default_rng(7)
    vectors = [x for k in range(6) for x in cloud(k, 40, 16, [0.02, 0.1, 0.2, 0.3, 0.45, 0.9][k])]
    vectors += [r.normal(size=16).tolist() for _ in range(120)] + [vectors[0]] * 30 + [vectors[100]] * 5
    a = np.linspace(0, 3, 40)
    vectors += [[float(np.cos(x)), float(np.sin(x)), *[0.0] * 14] for x in a]
    ids = r.permutation(len(vectors))
    rows = [(int(i), [float(np.float32(z)) for z in x]) for i, x in zip(ids, vectors, strict=True)]
    assert found(spark, rows) == plain(rows)
    if bundle == 40:
        assert found(spark, rows, 0.5) == plain(rows, 0.5)


def test_copies_of_one_place_are_never_formed(spark, monkeypatch):
    """A group within the radius that bounds settle is counted by its weight: no row of it is compared with another."""
    seen = []
    monkeypatch.setattr(covertree, "compared", lambda rows, *a: seen.append(1) or rows.sparkSession.createDataFrame([], "a long, b long, n long"))
    rows = [(i, x) for i, x in enumerate(cloud(3, 300, 16, 0.05))]
    assert found(spark, rows) == plain(rows) and not seen


def test_expanded_pairs_are_all_pairs_of_children():
    parent = np.array([0, 0, 1, 1, 1, 3])
    u, v = covertree.expanded(parent, np.array([0, 0, 1, 2]), np.array([0, 1, 3, 3]))
    got = sorted(zip(u.tolist(), v.tolist(), strict=True))
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (4, 5)]
