import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from borelight.plans import alerts as A
from borelight.plans import risk as R
from borelight.plans import similarity as M


def fold(rows, cooldown=300, window=25.0):
    """Plain sequential reading of the rule, newest matching alert first."""
    out, alerts = {}, []
    for i, well, level, t, d in sorted(rows, key=lambda r: (r[3], r[0])):
        hit = None
        for a in reversed(alerts):
            if a["w"] == well and a["l"] == level and a["t"] >= t - cooldown and (d is None or a["d"] is None or abs(a["d"] - d) <= window):
                hit = a
                break
        if hit is None:
            hit = {"id": i, "w": well, "l": level, "t": t, "d": d}
            alerts.append(hit)
        out[i] = hit["id"]
    return out


def assessments(spark, rows):
    df = spark.createDataFrame(rows, "assessment_id long, well_id long, risk_level string, s long, depth_m double")
    return df.withColumn("assessed_at", F.timestamp_seconds("s")).drop("s")


def test_alert_fold(spark):
    rows = [(1, 1, "HIGH", 0, 100.0), (2, 1, "HIGH", 60, 110.0), (3, 1, "HIGH", 120, 200.0), (4, 1, "HIGH", 1200, 100.0), (5, 1, "LOW", 1201, 100.0)]
    got = {r["alert_id"]: (r["occurrence_count"], r["dedupe_key"]) for r in A.batch_alerts(assessments(spark, rows)).collect()}
    assert got == {1: (2, "1:HIGH:4"), 3: (1, "1:HIGH:8"), 4: (1, "1:HIGH:4")}


@pytest.mark.parametrize("max_rows", [5_000_000, 40])
def test_fold_equals_sequential(spark, max_rows):
    rng = random.Random(16)
    rows = [
        (i, rng.choice([1, 1, 1, 2]), rng.choice(["HIGH", "MEDIUM"]), rng.randint(0, 12000), rng.choice([None, 10.0, 30.0, 36.0, 60.0, 100.0]))
        for i in range(500)
    ]
    got = {r["assessment_id"]: r["alert_id"] for r in A.alert_decisions(assessments(spark, rows), max_rows=max_rows).collect()}
    assert got == fold(rows)


def test_actions(spark):
    al = spark.createDataFrame([(1, "open"), (2, "open"), (3, "open")], "alert_id int, status string")
    ac = spark.createDataFrame([(1, 1, "accepted"), (1, 2, "investigating"), (2, 1, "rejected"), (2, 5, "resolved")], "alert_id int, t long, decision string").withColumn("recorded_at", F.timestamp_seconds("t"))
    assert {r["alert_id"]: r["status"] for r in A.apply_actions(al, ac).collect()} == {1: "reviewed", 2: "closed", 3: "open"}
    with pytest.raises(ValueError):
        A.apply_actions(al, ac.withColumn("decision", F.lit("maybe")))


def world(spark):
    wells = spark.createDataFrame(
        [(1, "A", 58.0, 2.0, 3000.0), (2, "B", 58.1, 2.0, 3000.0), (3, "C", None, None, 2500.0), (4, "D", 58.0, 2.5, None)],
        "well_id long, well_name string, latitude double, longitude double, total_depth_m double",
    )
    seg = spark.createDataFrame(
        [(1, 900.0, 1000.0, [1.0, 0.0]), (1, 950.0, 1050.0, [0.0, 1.0]), (2, 980.0, 1080.0, [0.9, 0.1]), (2, 2000.0, 2100.0, [0.0, 1.0]), (3, 1000.0, 1100.0, [0.0, 0.0])],
        "well_id long, segment_top_m double, segment_base_m double, embedding array<float>",
    )
    iv = spark.createDataFrame(
        [(1, "G", "F1", 800.0, 1000.0), (2, "G", "F1", 900.0, 1100.0), (2, "G", "F2", 1100.0, 1200.0), (4, None, "", 0.0, 9999.0)],
        "well_id long, group_name string, formation_name string, depth_top_m double, depth_base_m double",
    )
    prof = spark.createDataFrame([(1, {"bit_rpm": 60.0}), (2, {"bit_rpm": 60.0, "hookload_kn": 5.0}), (3, {"hookload_kn": 5.0})], "well_id long, profile map<string,double>")
    tele = spark.createDataFrame(
        [(1, 10, 980.0, {"pit_gain_loss_m3": -500.0, "gone": None}), (1, 20, 980.0, {"pit_gain_loss_m3": 0.0}), (1, 30, 1500.0, {"pit_gain_loss_m3": 0.0})],
        "well_id long, s long, bit_depth_m double, channels map<string,double>",
    ).withColumn("recorded_at", F.timestamp_seconds("s"))
    sc = spark.createDataFrame([(1, 10, 975.0, 0.9)], "well_id long, s long, depth_m double, score double").withColumn("recorded_at", F.timestamp_seconds("s"))
    ev = spark.createDataFrame([(1, 2, "kick", 1000.0), (2, 2, None, 980.0), (3, 3, "kick", 980.0)], "event_id long, well_id long, category string, depth_start_m double")
    return wells, seg, iv, prof, tele, sc, ev


def test_analogues(spark):
    wells, seg, iv, prof, *_ = world(spark)
    q = spark.createDataFrame([(7, 1, 980.0), (8, 4, None)], "query_id long, well_id long, depth_m double")
    got = {(r["query_id"], r["well_name"]): r for r in M.rank_analogues(q, wells, seg, iv, prof).collect()}
    b = got[(7, "B")]
    # two segments hold 980 m; the one with the lower top is the query vector
    assert b["geology"] == pytest.approx((0.9 / np.hypot(0.9, 0.1) + 1) / 2, abs=1e-6) and b["segment_top_m"] == 980
    assert b["formation"] == 1.0 and b["drilling_behaviour"] == 1.0 and b["shared_stratigraphy"] == ["F1"]
    assert b["depth"] == pytest.approx(np.exp(-50 / 300)) and b["dimensions_unavailable"] == []
    parts = {"geology": 0.3, "formation": 0.2, "depth": 0.15, "drilling_behaviour": 0.2, "geography": 0.15}
    assert b["score"] == pytest.approx(sum(b[k] * w for k, w in parts.items()))
    c = got[(7, "C")]
    assert c["geology"] == 0.0 and c["dimensions_unavailable"] == ["formation", "drilling_behaviour", "geography"]
    d = got[(7, "D")]
    assert d["dimensions_used"] == ["geography"] and d["score"] == d["geography"]
    # a query without depth, total depth or vector: nearest segment by mid depth
    assert got[(8, "B")]["segment_top_m"] == 980 and got[(8, "B")]["geology"] is None
    assert all(0 <= r["score"] <= 1 and r["dimensions_used"] for r in got.values())
    assert (7, "A") not in got and len(M.rank_analogues(q, wells, seg, iv, prof, k=1).collect()) == 2


def test_risk(spark):
    wells, seg, iv, prof, tele, sc, ev = world(spark)
    q = spark.createDataFrame([(1, 1, 980.0), (2, 1, None), (3, 1, 9000.0), (4, 1, 1005.1)], "query_id long, well_id long, depth_m double")
    out = R.assess_risk(q, wells, tele, sc, seg, iv, prof, ev)
    got = {r["query_id"]: r for r in out.assessments.collect()}
    a = got[1]
    comp = {c["name"]: c["value"] for c in a["components"]}
    assert comp["anomaly"] == 0.9 and comp["rules"] == 0.0 and a["mode"] == "hybrid_indicator" and a["probability"] is None
    best = {r["well_name"]: r["score"] for r in out.analogues.where("query_id = 1").collect()}
    sim = [round(v, 4) for k, v in best.items() if v >= 0.5 and k in "BC"]
    gap = 0.0 if best["C"] >= 0.5 else 20.0
    assert comp["historical_evidence"] == pytest.approx((1 - gap / 150) * max(sim), abs=1e-6)
    assert a["score"] == pytest.approx(0.9 * 0.4 + comp["historical_evidence"] * 0.4) and a["narrative"].startswith(f"{a['risk_level']} at A, 980 m MD; strongest signs: ")
    assert got[2]["depth_m"] == 1500.0 and "rules" in {c["name"] for c in got[2]["components"]}
    deep = got[3]
    assert deep["components"] == [] and not deep["evaluated"] and deep["score"] == 0 and any("absence of signal" in n for n in deep["notes"])
    assert not any(c["name"] == "rules" for c in got[4]["components"]) and any("25 m away" in n for n in got[4]["notes"])
    assert out.evidence.where("category is null").count() == 0
    given = q.withColumn("anomaly_score", F.lit(0.3))
    assert {c["name"]: c["value"] for c in R.assess_risk(given, wells, tele, sc, seg, iv, prof, ev).assessments.where("query_id = 3").first()["components"]} == {"anomaly": 0.3}


def test_search_errors(spark):
    ch = spark.createDataFrame([(i, 1, 1, "t", None) for i in range(75)], "chunk_id long, document_id long, page_number int, text string, embedding array<float>")
    docs = spark.createDataFrame([(1, "d", 1)], "document_id long, title string, well_id long")
    wells = spark.createDataFrame([(1, "A")], "well_id long, well_name string")
    q = spark.createDataFrame([(1, "stuck", [1.0, 0.0])], "query_id long, text string, embedding array<float>")
    with pytest.raises(M.SearchUnavailable, match="no vector"):
        M.search_passages(q, ch, docs, wells)
    with pytest.raises(M.SearchUnavailable, match="no passage"):
        M.search_passages(q, ch.limit(0), docs, wells)
    with pytest.raises(ValueError):
        M.search_passages(q.withColumn("text", F.lit("   ")), ch, docs, wells)


def _segments(spark):
    rng = np.random.default_rng(4)
    rows = []
    for w in range(9):
        for k in range(int(rng.integers(0, 12)) if w else 40):
            v = [round(float(x), 1) for x in rng.normal(size=3)]
            rows.append((w, float(k * 10), float(k * 10 + 20), f"g{k % 3}", None if k % 7 == 6 else [0.0] * 3 if k % 7 == 5 else v))
    seg = spark.createDataFrame(rows + [(w, None, None, None, None) for w in (20, 21)], "well_id long, segment_top_m double, segment_base_m double, name string, embedding array<double>")
    asked = [(i, i % 9, float(7 * i), None if i % 5 == 4 else [round(float(x), 1) for x in rng.normal(size=3)]) for i in range(40)]
    return seg, rows, spark.createDataFrame(asked, "query_id long, well_id long, depth_m double, embedding array<double>"), asked


@pytest.mark.parametrize("pack, block, most", [(4096, 2048, 10_000), (3, 7, 10_000), (3, 7, 0)])
def test_best_segments_by_any_plan(spark, monkeypatch, pack, block, most):
    """Packs that cut a well, several blocks of queries, broadcast and shuffled, against a plain search."""
    seg, rows, q, asked = _segments(spark)
    monkeypatch.setattr(M, "QUERY_BLOCK", block)
    monkeypatch.setattr(M, "QUERY_ROWS", most)
    monkeypatch.setattr(M, "packed", lambda df, n=pack, f=M.packed: f(df, n))
    got = {(r["query_id"], r["well_id"]): (r["segment_top_m"], r["name"], r["geology"]) for r in M.best_segments(q, seg, len(asked), ["name"]).collect()}
    wells = {r[0] for r in rows} | {20, 21}
    assert set(got) == {(i, w) for i, own, _, _ in asked for w in wells - {own}}
    for i, own, depth, v in asked:
        for w in wells - {own}:
            best = None
            for _, top, base, name, e in (r for r in rows if r[0] == w):
                if v is None:
                    metric, geology = -abs((top + base) / 2 - depth), None
                elif e is None:
                    continue
                else:
                    size = np.linalg.norm(v) * np.linalg.norm(e)
                    metric = geology = (np.dot(v, e) / size + 1) / 2 if size else 0.0
                if best is None or metric > best[0] + 1e-12:
                    best = (metric, top, name, geology)
            if best is None:  # no segment that can be compared: the first one, or none
                assert got[i, w][2] is None
            else:
                assert got[i, w][:2] == best[1:3]
                assert got[i, w][2] == (None if best[3] is None else pytest.approx(best[3]))


@pytest.mark.parametrize("most", [0, 1000])
def test_search_keeps_ties_by_id(spark, monkeypatch, most):
    monkeypatch.setattr(M, "QUERY_ROWS", most)
    monkeypatch.setattr(M, "packed", lambda df, n=4, f=M.packed: f(df, n))
    items = spark.createDataFrame([(f"i{k:02d}", [1.0, float(k % 3)] if k % 5 else None) for k in range(40)], "chunk_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["chunk_id"]) for r in M.nearest_vectors(items, q, 4).orderBy("query_id", "rank").collect()]
    ids = [k for k in range(40) if k % 5]
    assert [c for i, c in got if i == 1] == [f"i{k:02d}" for k in ids[:4]]
    assert [c for i, c in got if i == 2] == [f"i{k:02d}" for k in [k for k in ids if k % 3 == 2][:4]]
    assert {i for i, _ in got} == {1, 2}
    assert M.nearest_vectors(items, q.limit(0), 4).count() == 0 and M.nearest_vectors(items.limit(0), q, 4).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(17)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<float>").repartition(5)
    q = items.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(M, "QUERY_BLOCK", 6)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["similarity"]) for r in M.nearest_vectors(items, q, 5).collect()}
    sims = v[:20].astype("float32").astype(float) @ v.astype("float32").astype(float).T
    for i in range(20):
        order = np.argsort(-sims[i], kind="stable")[:5]
        assert [got[(i, k + 1)][0] for k in range(5)] == order.tolist()
        assert got[(i, 1)][1] == pytest.approx(1.0, abs=1e-6)
