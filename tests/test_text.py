import re

import pytest
from pyspark.sql import functions as F

from borelight.functions import text as X
from borelight.params import NEGATION_TERMS, ROUTINE_TERMS
from borelight.plans import knowledge as K


def pages(spark, *texts, conf=0.95):
    return spark.createDataFrame([(1, i + 1, t, conf) for i, t in enumerate(texts)], "document_id long, page_number int, text string, confidence double")


def run(spark, *texts):
    k = K.extract_knowledge(pages(spark, *texts))
    return [r.asDict() for r in k.events.collect()], [r.asDict() for r in k.excluded.collect()]


def chunks(spark, text, size=1200, overlap=150):
    df = spark.createDataFrame([(text,)], "t string")
    return [c["text"] for c in df.select(X.chunk_text("t", size, overlap).alias("c")).first()["c"]]


def test_chunks(spark):
    text = "".join(f"sentence {i}. " for i in range(400))
    got = chunks(spark, text)
    assert text.startswith(got[0]) and text.endswith(got[-1])
    assert all(a[-150:] == b[:150] for a, b in zip(got, got[1:]) if len(a) == 1200 and len(b) >= 150)
    assert chunks(spark, "") == [] and chunks(spark, "  \n ") == []


@pytest.mark.parametrize("n", [1, 1049, 1050, 1051, 1199, 1200, 1201, 2100, 2101, 3301])
def test_chunk_edges(spark, n):
    text = "x" * n
    want = [text] if n <= 1200 else [text[s : s + 1200] for s in range(0, n, 1050)]
    assert chunks(spark, text) == want


def test_denied(spark):
    events, out = run(spark, "At 1842 m. No tight spot.")
    assert events == [] and [x["reason"] for x in out] == ["denied_by_report"]


def test_denied_and_real(spark):
    events, out = run(spark, "No tight spot. Reamed tight spot at 304 m.")
    assert len(events) == 1 and events[0]["category"] == "tight_hole" and events[0]["raw_text"] == "Reamed tight spot at 304 m."
    assert events[0]["depth_m"] == 304 and events[0]["actions"] == ["reamed"] and len(out) == 1


def test_routine(spark):
    events, out = run(spark, "Performed leak off test equivalent to 1.44 SG mudweight.")
    assert events == [] and out[0]["reason"].startswith("routine:")
    assert run(spark, "A casing leak was observed at 1200 m.")[0][0]["category"] == "equipment_failure"
    assert run(spark, "The kick drill was performed on tour.")[0] == []
    assert run(spark, "A kick was taken at 2100 m.")[0][0]["category"] == "well_control"


def test_routine_span(spark):
    s = "after the leak off test the string became stuck at 2100 m."
    df = spark.createDataFrame([(s,)], "s string")
    r = df.select(
        X.routine_span("s", F.lit(s.index("leak") + 1), F.lit(4)).alias("a"), X.routine_span("s", F.lit(s.index("stuck") + 1), F.lit(5)).alias("b")
    ).first()
    assert r["a"] == "leak off" and r["b"] is None


def test_second_occurrence_counts(spark):
    events, _ = run(spark, "No losses at 900 m but heavy losses at 1200 m.")
    assert [e["category"] for e in events] == ["lost_circulation"]
    first_only = K.mentions(pages(spark, "No losses at 900 m but heavy losses at 1200 m."), every_occurrence=False)
    assert first_only.first()["reason"] == "denied_by_report"


def test_whole_word_actions_and_outcomes(spark):
    events, _ = run(spark, "Stuck pipe at offset well, attempt unsuccessful.")
    assert events[0]["actions"] == [] and events[0]["outcome_status"] == "not_resolved"
    old = K.extract_knowledge(pages(spark, "Stuck pipe at offset well, attempt unsuccessful."), whole_words=False).events.first()
    assert old["actions"] == ["set"] and old["outcome_status"] == "resolved"


def test_confidence(spark):
    e = run(spark, "Pipe became stuck at 2100 m. Jarred and freed the string.")[0][0]
    assert e["actions"] == ["jarred"] and e["outcome_status"] == "resolved" and e["confidence"] == pytest.approx(0.87)


def test_numbers_and_depths(spark):
    df = spark.createDataFrame(
        [("at 11,053 m KB",), ("at 12,5 m",), ("@ 1000 ft",), ("at 13000 m then 500 m",), ("nothing",)], "s string"
    )
    assert [r["d"] for r in df.select(X.first_depth("s").alias("d")).collect()] == [11053.0, 12.5, 304.8, None, None]


def test_intervals(spark):
    text = "ite are seen. Utsira Formation (847 - 1,053 m KB). HORDALAND GROUP 1053-1600 m. Formation 10 - 20 m. Rogaland Group (500 - 400 m). Heimdal Fm. 1000 to 2000 ft."
    df = spark.createDataFrame([(text, 1.0)], "t string, c double")
    got = [(r["formation_name"], r["depth_top_m"], r["depth_base_m"], r["confidence"]) for r in df.select(X.find_formation_intervals("t", "c").alias("r")).first()["r"]]
    assert got == [("Utsira Formation", 847, 1053, 0.95), ("HORDALAND GROUP", 1053, 1600, 0.95), ("Heimdal Fm.", 304.8, 609.6, 0.95)]


def test_measurements(spark):
    df = spark.createDataFrame([('Drilled 12 1/4" hole, set 9 5/8 inch casing, mud weight of 1.35 sg, MW 1.2', None)], "t string, c double")
    got = [(r["record_type"], r["size_inches_text"], r["component"], r["value"], r["unit"]) for r in df.select(X.find_measurements("t", "c").alias("r")).first()["r"]]
    assert got == [
        ("equipment_dimension", "12 1/4", "hole", None, None), ("equipment_dimension", "9 5/8", "casing", None, None),
        ("mud_weight", None, None, 1.35, "sg"), ("mud_weight", None, None, 1.2, "sg"),
    ]


def test_mentions_match_brute_force(spark):
    words = ["no", "stuck", "pipe", "leak off", "losses", "the", "hole", "kick drill", "kick", "without", "any", "free of", "caving", "Ø", "never"]
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) + "." for _ in range(300)]
    terms = K.LEXICON.problems
    cues = "|".join(re.escape(c) for c in sorted(NEGATION_TERMS, key=len, reverse=True))
    denial = re.compile(rf"\b(?:{cues})\b(?:\W+\w+){{0,3}}\W*$", re.I)
    want = {}
    for i, t in enumerate(texts):
        low = t.lower()
        hits = [x for x in terms if x in low]
        if not hits:
            continue
        term = max(hits, key=len)
        reasons = []
        for m in re.finditer(re.escape(term), low):
            a, z = m.start(), m.end()
            if denial.search(low[:a]):
                reasons.append("denied_by_report")
                continue
            spans = [p for p in ROUTINE_TERMS if any(q.start() < z and a < q.end() for q in re.finditer(f"(?={re.escape(p)})", low)) or any(
                s < z and a < s + len(p) for s in [k for k in range(len(low)) if low.startswith(p, k)]
            )]
            reasons.append(f"routine:{spans[0]}" if spans else None)
        want[i + 1] = (terms[term], None if None in reasons else reasons[0])
    got = {r["page_number"]: (r["category"], r["reason"]) for r in K.mentions(pages(spark, *texts)).collect()}
    assert got == want and len({v[1] for v in want.values()}) > 3


def tables(spark):
    docs = spark.createDataFrame([(1, "Final report", 9)], "document_id long, title string, well_id long")
    p = spark.createDataFrame(
        [(1, 1, "Utsira Formation (847 - 1053 m). " + "x" * 1300, "ocr", 0.9), (1, 2, "Pipe became stuck at 2100 m. Jarred free.", "pdf_text_layer", 0.9), (1, 3, "   ", "ocr", 0.1)],
        "document_id long, page_number int, text string, method string, confidence double",
    )
    chunks_ = spark.createDataFrame([], "document_id long, page_number int, chunk_index int, text string")
    events = spark.createDataFrame([], "document_id long, raw_text string, event_type string")
    ivs = spark.createDataFrame([], "well_id long, formation_name string, depth_top_m double")
    return docs, p, chunks_, events, ivs


def test_ingest(spark):
    docs, p, ch, ev, iv = tables(spark)
    got = K.ingest_documents(p, docs, ch, ev, iv)
    rows = sorted((r["page_number"], r["chunk_index"]) for r in got.chunks.collect())
    assert rows == [(1, 0), (1, 1), (2, 2)]
    e = got.events.collect()
    assert len(e) == 1 and e[0]["provenance"] == "Final report p.2" and e[0]["depth_start_m"] == 2100 and e[0]["well_id"] == 9
    m = got.mitigations.collect()
    assert len(m) == 1 and m[0]["action_taken"] == "jarred" and m[0]["event_id"] == e[0]["event_id"]
    assert [r["formation_name"] for r in got.intervals.collect()] == ["Utsira Formation"]
    assert got.documents.first()["new_pages"] == 3 and got.documents.first()["ocr_applied"]
    again = K.ingest_documents(p, docs, got.chunks, got.events, got.intervals)
    assert again.chunks.where("page_number <= 2").count() == 0 and again.events.count() == 0 and again.intervals.count() == 0


def test_ingest_deals_pages_of_one_row_group(spark, tmp_path, monkeypatch):
    """The join with what is stored comes after the pages are dealt; the heavy work after it has tasks for all cores, and finds the same."""
    docs, p, _, ev, iv = tables(spark)
    path = str(tmp_path / "pages")
    many = p.where("page_number = 2").crossJoin(spark.range(1, 401)).selectExpr("id AS document_id", "page_number", "text", "method", "confidence")
    many.coalesce(1).write.parquet(path)
    stored = spark.createDataFrame([(1, 2, 0, "old")], "document_id long, page_number int, chunk_index int, text string")
    titles = spark.range(1, 401).selectExpr("id AS document_id", "'t' AS title", "1L AS well_id")
    seen, real = [], K.extract_knowledge
    monkeypatch.setattr(K, "extract_knowledge", lambda pages, *a: seen.append(pages) or real(pages, *a))
    got = K.ingest_documents(spark.read.parquet(path), titles, stored, ev, iv)
    tasks = [n for n in seen[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(tasks) <= 100 and sum(tasks) == 399
    assert got.events.count() == 399 and got.chunks.count() == 399


def test_mentions_of_terms_with_marks(spark):
    terms = {"h2s (gas)": "gas", "a.c": "letters", "Über": "never lower", "kick": "well_control"}
    p = spark.createDataFrame([(1, 1, "Saw H2S (GAS) here. abc only. A.C fault. Über all. No such.", 0.9)], "document_id long, page_number int, text string, confidence double")
    got = K.mentions(p, K.Lexicon(problems=terms)).select("sentence_no", "category", "reason").orderBy("sentence_no").collect()
    assert [tuple(r) for r in got][0] == (0, "gas", None) and {r["category"] for r in got} == {"gas", "letters"}


def test_batches_may_be_run_again(spark, tmp_path):
    """A batch that is repeated changes nothing, a later one goes on behind it, and a stream may call it batch by batch."""
    docs, p, _, _, _ = tables(spark)
    folder = str(tmp_path / "t")

    def state():
        return {n: sorted(map(repr, K.read_batches(spark, folder, n).collect())) for n in K.TABLES}

    one, two = p.where("page_number = 1"), p
    K.ingest_batch(folder, 0, one, docs)
    K.ingest_batch(folder, 1, two, docs)
    first = state()
    got = K.read_batches(spark, folder, "chunks")
    assert sorted((r["batch_id"], r["page_number"], r["chunk_index"]) for r in got.collect()) == [(0, 1, 0), (0, 1, 1), (1, 2, 2)]
    assert len(first["events"]) == 1 and len(first["mitigations"]) == 1
    K.ingest_batch(folder, 1, two, docs)
    assert state() == first
    K.ingest_batch(folder, 2, two.where("page_number <= 2"), docs)
    assert state() == first
    src = str(tmp_path / "src")
    for part in (one, p.where("page_number > 1")):
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(src)
    other = str(tmp_path / "u")

    def body(df, n):
        K.ingest_batch(other, n, df, docs)

    stream.writeStream.foreachBatch(body).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r["chunk_index"] for r in K.read_batches(spark, other, "chunks").collect()} == {0, 1, 2}


def test_index_continues_from_zero(spark):
    docs, p, _, ev, iv = tables(spark)
    stored = spark.createDataFrame([(1, 1, 0, "old")], "document_id long, page_number int, chunk_index int, text string")
    got = K.ingest_documents(p, docs, stored, ev, iv)
    assert [r["chunk_index"] for r in got.chunks.collect()] == [1]


def test_reextract_replaces_only_extracted(spark):
    docs, p, ch, ev, iv = tables(spark)
    first = K.ingest_documents(p, docs, ch, ev, iv)
    manual = spark.createDataFrame([(1, "typed in", "fishing", 77, 9, "manual")], "document_id long, raw_text string, event_type string, event_id long, well_id long, extraction_method string")
    stored = first.events.unionByName(manual, allowMissingColumns=True)
    changed = p.withColumn("text", F.replace("text", F.lit("stuck"), F.lit("parted, heavy losses")))
    events, acts = K.reextract(changed, docs, stored, first.mitigations)
    assert sorted(r["event_type"] for r in events.collect()) == ["fishing", "lost_circulation"]
    assert acts.count() == 1 and acts.first()["event_id"] != first.mitigations.first()["event_id"]


def test_embedding(spark):
    ch = spark.createDataFrame([(1, "ab"), (2, "abcd")], "chunk_id long, text string")

    def encoder(texts):
        return [[float(len(t)), 1.0, 0.0] for t in texts]

    out = K.embed_passages(ch, encoder, dims=3, model="lengths").collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 for r in out) and out[0]["embedding_model"] == "lengths"
    with pytest.raises(ValueError):
        K.embed_passages(ch, None)
    with pytest.raises(Exception, match="expected 384"):
        K.embed_passages(ch, encoder).collect()
    half = spark.createDataFrame([(1, "ab", [1.0, 0.0, 0.0]), (2, "abcd", None)], "chunk_id long, text string, embedding array<float>")
    kept = {r["chunk_id"]: r["embedding"] for r in K.embed_passages(half, encoder, dims=3).collect()}
    assert kept[1] == [1.0, 0.0, 0.0] and len(kept) == 2


def test_long_sentences_stay_whole(spark):
    long = "The string became stuck at 2100 m " + "and more " * 150
    events, _ = run(spark, f"{long}today.", f"{long}tomorrow.")
    assert len({e["raw_text"] for e in events}) == 2 and all(len(e["description"]) > 1000 for e in events)
