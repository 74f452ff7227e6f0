import json
import math

import pytest
from pyspark.sql import functions as F

from borelight.operators import clean as C
from borelight.plans import builds as B
from borelight.sources import readers as R
from borelight.sources import registry as G
from borelight.sources import writers as O

NS = 'xmlns="http://www.witsml.org/schemas/1series" version="1.4.1.1"'

LOG = f"""<logs {NS}><log uid="l1" uidWell="w"><nameWell> NO 15/9-F-4 </nameWell><nameWellbore>b</nameWellbore><name>GenTime</name>
<indexType>date time</indexType><indexCurve>Time</indexCurve><nullValue>-999.25</nullValue>
<logCurveInfo uid="a"><mnemonic>Time</mnemonic><unit>s</unit></logCurveInfo>
<logCurveInfo uid="b"><mnemonic>PUMP</mnemonic><unit>Pa</unit></logCurveInfo>
<logCurveInfo uid="c"><mnemonic>BITDEP</mnemonic></logCurveInfo>
<logData><mnemonicList>Time,PUMP,BITDEP,FLOWIN,WOB</mnemonicList><unitList>s,bar,m,m3/s,N</unitList>
<data>2024-01-01T00:00:01.000Z,100000,100,0.01,-999.25</data>
<data>2024-01-01T00:00:05.000Z,300000,100,0.01,2000</data>
<data>2024-01-01T00:01:11.000Z,9e9,103,,x</data>
<data>bad,1,1,1,1</data></logData></log></logs>"""

OTHER = LOG.replace("<name>GenTime</name>", "<name>Survey</name>").replace('uid="l1"', 'uid="l2"')

TRAJ = f"""<trajectorys {NS}><trajectory uid="t"><nameWell>W</nameWell><nameWellbore>b</nameWellbore><name>T1</name>
<trajectoryStation uid="s1"><typeTrajStation>actual</typeTrajStation><md uom="m">100</md><tvd uom="m">99</tvd><incl uom="rad">0.5</incl><azi uom="dega">30</azi><dls uom="rad/m">0.01</dls></trajectoryStation>
<trajectoryStation uid="s2"><md uom="m">100</md><incl uom="rad">0.7</incl></trajectoryStation>
<trajectoryStation uid="s3"><tvd uom="m">5</tvd></trajectoryStation></trajectory></trajectorys>"""

MSG = f"""<messages {NS}><message uid="m1"><nameWell>NO 15/9-F-4</nameWell><nameWellbore>b</nameWellbore><name>fallback</name><dTim>2024-01-01T00:01:15.000Z</dTim><typeMessage>remark</typeMessage><messageText>Stuck</messageText><commonData><sourceName>rig</sourceName></commonData></message>
<message uid="m2"><nameWell>NO 15/9-F-4</nameWell><nameWellbore>b</nameWellbore><name>only name</name><dTim>2024-01-03T00:00:00.000Z</dTim><md uom="m">77</md></message></messages>"""

WELL = f"""<wells {NS}><well uid="u1"><name>NO 15/9-F-4</name><field>F</field><country>NO</country><waterDepth uom="m">91</waterDepth>
<wellDatum uid="d1"><code>KB</code><elevation uom="m">54.9</elevation></wellDatum><wellDatum uid="d2"><name>SL</name><elevation uom="m">0</elevation></wellDatum>
<wellLocation uid="x"><latitude uom="dega">0</latitude><longitude uom="dega">0</longitude></wellLocation></well></wells>"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("xml")
    base = root / "NO 15_$47$_9-F-4"
    for kind, name, text in (
        ("log", "1.xml", LOG), ("log", "2.xml", OTHER), ("trajectory", "1.xml", TRAJ), ("message", "1.xml", MSG), ("_wellInfo", "w.xml", WELL),
    ):
        p = base / "1" / kind
        p.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(text)
    return root, base


def test_witsml_logs(spark, tree):
    rows = R.read_witsml_logs(spark, str(tree[1] / "1" / "log")).orderBy("log_name", "line").collect()
    assert len(rows) == 8
    r = rows[0]
    assert r["well_name"] == "NO 15/9-F-4" and r["index_type"] == "date time" and r["null_value"] == "-999.25"
    assert r["units"]["PUMP"] == "Pa" and r["units"]["BITDEP"] == "m" and r["units"]["FLOWIN"] == "m3/s"
    assert r["values"]["BITDEP"] == "100" and r["source_file"].endswith("1.xml")
    long = R.long_channels(R.read_witsml_logs(spark, str(tree[1] / "1" / "log")))
    parsed = C.parse_channels(long.where("mnemonic = 'WOB' and log_name = 'GenTime'")).orderBy("line").collect()
    assert [x["value"] for x in parsed] == [None, 2000.0, None]


def test_prepare_telemetry(spark, tree):
    logs = R.read_witsml_logs(spark, str(tree[1] / "1" / "log"))
    msgs = R.read_witsml_messages(spark, str(tree[1] / "1" / "message"))
    got = B.prepare_telemetry(logs, msgs)
    t = got.telemetry.orderBy("timestamp").collect()
    assert [r["standpipe_pressure_bar"] for r in t] == [pytest.approx(2.0), None]
    assert [r["standpipe_pressure_bar_implausible_count"] for r in t] == [0, 1]
    assert t[0]["flow_in_lpm"] == pytest.approx(600) and t[0]["weight_on_bit_kn"] == pytest.approx(2.0) and t[0]["circulating"]
    assert t[1]["trip_speed_m_per_min"] == pytest.approx(3 / (70 / 60)) and t[1]["tripping"] and not t[1]["circulating"]
    m = {r["message_uid"]: r for r in got.messages.collect()}
    assert m["m1"]["depth_m"] == 103 and m["m1"]["depth_source"] == "telemetry_time_join"
    assert m["m2"]["depth_m"] == 77 and m["m2"]["depth_source"] == "reported" and m["m2"]["text"] == "only name"


def test_trajectory(spark, tree):
    rows = R.read_witsml_trajectory(spark, str(tree[1] / "1" / "trajectory"))
    r = rows.orderBy("source_order").collect()
    assert r[0]["inclination_deg"] == pytest.approx(math.degrees(0.5)) and r[0]["azimuth_deg"] == 30
    assert r[0]["dogleg_severity_deg_per_m"] == pytest.approx(math.degrees(0.01)) and r[2]["md_m"] is None
    from borelight.operators.windows import first_station_per_md

    first = first_station_per_md(rows, "well_name").collect()
    assert [x["station_uid"] for x in first] == ["s1"]


def test_well_headers_and_inventory(spark, tree):
    found = R.find_objects(spark, str(tree[0]), "_wellInfo")
    assert len(found) == 1
    w = R.read_witsml_wells(spark, found).first()
    assert w["latitude"] is None and w["longitude"] is None and w["datums"] == {"KB": 54.9, "SL": 0.0} and w["water_depth_m"] == 91
    inv = {(r["well_name"], r["object_type"]): r["files"] for r in R.witsml_object_inventory(spark, str(tree[0])).collect()}
    assert inv == {("NO 15/9-F-4", k): n for k, n in (("log", 2), ("trajectory", 1), ("message", 1), ("_wellInfo", 1))}


def test_other_objects(spark, tmp_path):
    (tmp_path / "b.xml").write_text(f'<bhaRuns {NS}><bhaRun uid="r"><nameWell>W</nameWell><name>run</name><numStringRun>3</numStringRun><dTimStart>2024-01-01T00:00:00Z</dTimStart></bhaRun></bhaRuns>')
    r = R.read_witsml_bha_runs(spark, str(tmp_path)).first()
    assert r["run_number"] == "3" and r["started_at"] is not None and r["ended_at"] is None
    p = tmp_path / "wb"
    p.mkdir()
    (p / "w.xml").write_text(f'<wellbores {NS}><wellbore uid="a" uidWell="u"><nameWell>W</nameWell><name>N</name><mdPlanned uom="m">4000</mdPlanned></wellbore></wellbores>')
    assert R.read_witsml_wellbores(spark, str(p)).first()["md_planned_m"] == 4000


def test_log_csv(spark, tmp_path):
    from borelight.params import LOG_FILE_ORDER

    row = {c: "1.5" for c in LOG_FILE_ORDER} | {"WELL": "15/9-13", "GROUP": "G", "FORMATION": "", "GR": "", "RHOB": "NaN"}
    (tmp_path / "l.csv").write_text(";".join(LOG_FILE_ORDER) + "\n" + ";".join(row[c] for c in LOG_FILE_ORDER) + "\n")
    r = R.read_logs(spark, str(tmp_path / "l.csv")).first()
    assert r["WELL"] == "15/9-13" and r["FORMATION"] is None and r["GR"] is None and r["RHOB"] is None and r["CALI"] == 1.5


def test_positions(spark, tmp_path):
    head = "wlbWellboreName,wlbNsUtm,wlbEwUtm,wlbField,wlbKellyBushElevation\n"
    (tmp_path / "a.csv").write_text(head + " 15/9-F-4 ,6478550,435050,F,54.9\nX,,1,F,1\n")
    (tmp_path / "b.csv").write_text("wlbWellboreName,wlbNsUtm,wlbEwUtm\n15/9-F-4,1,1\n2/4-1,6260000,510000\n")
    got = {r["join_name"]: r for r in R.read_positions(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert set(got) == {"15/9-F-4", "2/4-1"}
    assert got["15/9-F-4"]["latitude"] == pytest.approx(58.44, abs=0.05) and got["15/9-F-4"]["field_name"] == "F"


def test_pages_and_index(spark, tmp_path):
    page = lambda n, t: {"page_number": n, "text": t, "method": "ocr", "confidence": 0.5, "line_count": 1, "warnings": []}
    (tmp_path / "doc__0_2.json").write_text(json.dumps([page(1, "one"), page(2, "two")]))
    (tmp_path / "doc__1_3.json").write_text(json.dumps([page(2, "late"), page(3, "three")]))
    got = sorted((r["document_name"], r["page_number"], r["text"]) for r in R.read_page_text(spark, str(tmp_path)).collect())
    assert got == [("doc", 1, "one"), ("doc", 2, "two"), ("doc", 3, "three")]
    (tmp_path / "i.csv").write_text("wlbName,wlbDocumentType,wlbDocumentName,wlbDocumentUrl,wlbDocumentSize\nA,REPORTED BY LICENSEE,d1,u,5\nA,REPORTED BY LICENSEE,d2,u,9\nB,REPORTED BY LICENSEE,d3,u,99\nA,OTHER,d4,u,7\n")
    wells = spark.createDataFrame([("A",)], "well_name string")
    assert [r["wlbDocumentName"] for r in R.read_document_index(spark, str(tmp_path / "i.csv"), wells=wells).collect()] == ["d2", "d1"]


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1.0, {"a": 1}), (2, 2.0, {"a": 2})], "well_id int, x double, m map<string,int>")
    O.write_table(df, p, "replace_partitions", "well_id")
    O.write_table(df.where("well_id = 2").withColumn("x", F.lit(9.0)), p, "replace_partitions", "well_id")
    assert sorted((r["well_id"], r["x"]) for r in spark.read.parquet(p).collect()) == [(1, 1.0), (2, 9.0)]
    q = str(tmp_path / "q")
    O.write_table(df, q)
    O.write_table(df, q, "append")
    assert spark.read.parquet(q).count() == 4
    with pytest.raises(ValueError):
        O.write_table(df, q, "replace_partitions")
    O.write_features(df, str(tmp_path / "f"), ["x", "well_id"])
    f = R.read_features(spark, str(tmp_path / "f"), ["x", "well_id", "x"])
    assert f.dtypes == [("x", "float"), ("well_id", "int")]
    assert "ReadSchema: struct<x:float>" in f.select("x")._jdf.queryExecution().toString()


def test_registry(spark, tmp_path):
    import datetime as dt

    p = str(tmp_path / "r")
    for v, day in (("v1", 1), ("v2", 3), ("v3", 2)):
        G.register(spark, p, {"name": "m", "version": v, "trained_at": dt.datetime(2024, 1, day), "metrics": {"f1": 0.5}})
    reg = G.read_registry(spark, p)
    assert G.latest(reg).first()["version"] == "v2" and [r["version"] for r in G.versions(reg, "m").collect()] == ["v1", "v3", "v2"]
    assert G.list_models(reg).first()["versions"] == 3 and len(G.new_version()) == 16


def test_holdout(spark):
    f = spark.createDataFrame([("A", 1.0, 5.0), ("A", 2.0, 6.0)], "WELL string, DEPTH_MD double, GR double")
    t = spark.createDataFrame([("A", 1.0, 30000), ("A", 2.0, None)], "WELL string, DEPTH_MD double, lithology int")
    r = R.read_holdout(f, t, ["GR", "RHOB"]).collect()
    assert len(r) == 1 and r[0]["GR"] == 5.0 and r[0]["RHOB"] is None


def test_build_wells(spark, tree):
    logs = spark.createDataFrame(
        [("L1", 5.01, 435050.0, 6478550.0, "G", "F", 1.23456), ("L1", 5.5, 435050.0, 6478550.0, "G", "F", None), ("L1", 10.02, 435052.0, 6478550.0, "G", "H", 2.0)],
        "WELL string, DEPTH_MD double, X_LOC double, Y_LOC double, GROUP string, FORMATION string, GR double",
    )
    heads = R.read_witsml_wells(spark, str(tree[1] / "1" / "_wellInfo"))
    tele = B.prepare_telemetry(R.read_witsml_logs(spark, str(tree[1] / "1" / "log"))).telemetry
    pos = spark.createDataFrame([("15/9-F-4", 58.44, 1.88)], "join_name string, latitude double, longitude double")
    got = B.build_wells(logs, pos, ["GR"], heads, tele)
    w = {r["well_name"]: r for r in got.wells.collect()}
    assert w["L1"]["has_logs"] and not w["L1"]["has_telemetry"] and w["L1"]["latitude"] == pytest.approx(58.44, abs=0.05)
    v = w["NO 15/9-F-4"]
    assert v["has_telemetry"] and not v["has_trajectory"] and v["latitude"] == 58.44 and v["location_source"] == "positions"
    assert sorted((r["formation_name"], r["depth_top_m"], r["depth_base_m"], r["sample_count"]) for r in got.intervals.collect()) == [("F", 5.01, 5.5, 2), ("H", 10.02, 10.02, 1)]
    s = sorted((r["depth_md_m"], r["curves"]["GR"]) for r in got.log_samples.collect())
    assert s == [(5.01, 1.2346), (10.02, 2.0)]
    ch = got.telemetry.orderBy("timestamp").collect()[1]["channels"]
    assert "standpipe_pressure_bar" not in ch and "trip_speed_m_per_min" in ch and got.unmapped.count() == 0


@pytest.mark.parametrize("size", ["128m", "700b", "90b"])
def test_large_log_objects_are_read_in_splits(spark, tmp_path, size):
    """Objects over several byte ranges, several in one range, one without lines, empty and escaped lines, a namespace prefix."""
    want, files = [], {"a": [("A", 60), ("none", 0), ("B", 3), ("C", 41)], "b": [("D", 1)], "c": [("E", 25)]}
    for f, objects in files.items():
        x = "w:" if f == "c" else ""
        parts = []
        for name, n in objects:
            lines = [f"{i},{name} &amp; {i * i}" for i in range(n)]
            data = "".join(f"<{x}data>{v}</data>" if not x else f"<{x}data>{v}</{x}data>" for v in lines) if not x else "".join(f"<data>{v}</data>" for v in lines)
            if name == "C":
                data = data.replace("<data>7,C &amp; 49</data>", "<data/>")
            want += [(name, i, None if name == "C" and i == 7 else f"{name} & {i * i}") for i in range(n)]
            parts.append(f"<{x}log uid='{name}'>\n<{x}nameWell>W &lt;1&gt;</{x}nameWell><{x}name>{name}</{x}name><{x}indexCurve>T</{x}indexCurve>"
                         f"<{x}logCurveInfo><{x}mnemonic>T</{x}mnemonic><{x}unit>s</{x}unit></{x}logCurveInfo><{x}logData><{x}mnemonicList>T,V</{x}mnemonicList>{data}</{x}logData></{x}log>")
        (tmp_path / f"{f}.xml").write_text(f"<{x}logs xmlns{':w' if x else ''}='http://www.witsml.org/schemas/1series'>{''.join(parts)}</{x}logs>")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = R.read_witsml_logs(spark, str(tmp_path)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r["log_name"], r["line"], (r["values"] or {}).get("V")) for r in got) == sorted(want, key=lambda w: w[:2])
    assert {(r["well_name"], r["units"]["T"]) for r in got} == {("W <1>", "s")}


def test_short_and_long_log_lines(spark, tmp_path):
    lines = "".join(f"<data>{x}</data>" for x in ("1,2,3", "4,5", "6,7,8,9"))
    (tmp_path / "a.xml").write_text(
        f"<logs {NS}><log uid='l'><nameWell>W</nameWell><name>n</name><indexCurve>T</indexCurve><logData><mnemonicList>T,A,B</mnemonicList>"
        f"<unitList>s,m,m</unitList>{lines}</logData></log></logs>"
    )
    got = R.read_witsml_logs(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["values"], r["extra_cells"]) for r in got] == [
        ({"T": "1", "A": "2", "B": "3"}, 0), ({"T": "4", "A": "5", "B": None}, 0), ({"T": "6", "A": "7", "B": "8"}, 1)
    ]


def test_objects_at_any_depth(spark, tmp_path):
    deep = tmp_path.joinpath(*"abcdef", "_wellInfo")
    deep.mkdir(parents=True)
    assert [x.endswith("/a/b/c/d/e/f/_wellInfo") for x in R.find_objects(spark, str(tmp_path), "_wellInfo")] == [True]
