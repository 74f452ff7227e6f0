"""Readers for logs, positions, drilling XML objects, page text and document indexes.

All readers declare their schema; nothing is inferred from the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelight.functions.scalars import decode_dir
from borelight.operators.clean import nan_as_null
from borelight.operators.joins import known_wells_only
from borelight.operators.materialise import materialised
from borelight.operators.positions import utm_to_wgs84
from borelight.operators.skew import broadcast_if_small
from borelight.params import LOG_FILE_ORDER, LOG_TEXT_COLUMNS


def _strings(names) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def read_logs(spark: SparkSession, path, sep: str = ";", columns=LOG_FILE_ORDER) -> DataFrame:
    """Depth-indexed curve file with a header; every column but the names is numeric."""
    kinds = {c: T.StringType() for c in LOG_TEXT_COLUMNS}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in columns])
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False, nanValue="NaN")
    return nan_as_null(df)


def read_positions(
    spark: SparkSession, paths: list[str], name: str = "wlbWellboreName", north: str = "wlbNsUtm",
    east: str = "wlbEwUtm", zone: int = 31, sep: str = ",",
) -> DataFrame:
    """Union of position tables: one row per trimmed name, the first table winning."""
    extra = {"wlbField": "field_name", "wlbDrillingOperator": "operator",
             "wlbKellyBushElevation": "kb_elevation_m", "wlbTotalDepth": "total_depth_md_m"}
    numbers = {north, east, "wlbKellyBushElevation", "wlbTotalDepth"}
    frames = []
    for i, p in enumerate(paths):
        header = spark.read.option("sep", sep).text(p).limit(1).first()[0].lstrip("﻿").split(sep)
        names = [h.strip().strip('"') for h in header]
        schema = T.StructType([T.StructField(h, T.StringType()) for h in names])
        df = spark.read.csv(p, header=True, schema=schema, sep=sep)
        keep = [c for c in (name, north, east, *extra) if c in names]
        df = df.select(
            *[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in keep],
            F.lit(i).alias("_table"), F.monotonically_increasing_id().alias("_line"),
        )
        frames.append(df)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    both = both.dropna(subset=[name, north, east]).withColumn("join_name", F.trim(name))
    rest = [c for c in both.columns if c != "join_name"]
    one = both.groupBy("join_name").agg(F.min_by(F.struct(*rest), F.struct("_table", "_line")).alias("_r"))
    one = one.select("join_name", "_r.*")
    one = utm_to_wgs84(one, east, north, zone)
    return one.select(
        "join_name", "latitude", "longitude",
        *[F.col(c).alias(a) for c, a in extra.items() if c in one.columns],
    )


def read_holdout(
    features: DataFrame, targets: DataFrame, feature_columns: list[str], well: str = "WELL",
    depth: str = "DEPTH_MD", target: str = "lithology",
) -> DataFrame:
    """Held-out features joined to their targets; training features it lacks become NULL columns."""
    joined = features.join(targets.select(well, depth, target), [well, depth])
    cols = [F.col(c) if c in joined.columns else F.lit(None).cast("double").alias(c) for c in feature_columns]
    return joined.where(F.col(target).isNotNull()).select(well, depth, target, *cols)


def _xml(spark: SparkSession, path, tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .options(rowTag=tag, ignoreNamespace="true", mode="PERMISSIVE", recursiveFileLookup="true",
                 pathGlobFilter="*.xml")
        .schema(schema)
        .load(path)
    )


def _known(c):
    return F.when(F.length(F.trim(c)) > 0, F.trim(c))


LOG = (
    "nameWell string, nameWellbore string, name string, indexType string, indexCurve string, nullValue string, "
    "logCurveInfo array<struct<mnemonic:string, unit:string>>, logData struct<mnemonicList:string, unitList:string>"
)
PREFIX = r"(?:[\w.-]+:)?"  # a namespace


def _data_lines(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Log headers (source_file, _object, header text) and their data lines (source_file, _object, line, _text) from splits of the files.

    Files are read as text that ends at each `</data>`, so a file of any size is cut at byte ranges and read by many tasks. The object and
    the line that a piece belongs to follow from counts per byte range and a running count inside the range.
    """
    text = (
        spark.read.option("lineSep", "</data>").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(path)
        .select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_at"))
    )
    head = F.regexp_extract("value", rf"(?s).*(<{PREFIX}log(?:\s[^>]*)?>.*)$", 1)  # the last object that begins in the piece
    starts = F.length(head) > 0
    body = F.when(starts, head).otherwise(F.col("value"))
    full = rf"(?s)^.*<{PREFIX}data(?:\s[^>]*[^/])?>(.*)$"
    lines = F.concat(
        F.array_repeat(F.lit(None).cast("string"), F.regexp_count(body, F.lit(rf"<{PREFIX}data(?:\s[^>]*)?/>"))),  # empty elements
        F.when(body.rlike(full), F.array(F.regexp_extract(body, full, 1))).otherwise(F.array().cast("array<string>")),
    )
    # written once: the order of pieces is that of this reading
    pieces = materialised(text.select("source_file", "_range", "_at", F.when(starts, head).alias("_head"), lines.alias("_lines")))
    within = Window.partitionBy("source_file", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counts = pieces.groupBy("source_file", "_range").agg(
        F.count("_head").alias("_heads"), F.sum(F.size("_lines")).alias("_n"),
        # lines from the last header of the range on
        F.max(F.when(F.col("_head").isNotNull(), F.col("_at"))).alias("_last"),
    )
    tail = pieces.join(counts, ["source_file", "_range"]).where(F.col("_last").isNull() | (F.col("_at") >= F.col("_last")))
    tail = tail.groupBy("source_file", "_range").agg(F.sum(F.size("_lines")).alias("_tail"))
    counts = counts.join(tail, ["source_file", "_range"])
    before = Window.partitionBy("source_file").orderBy("_range")  # a row for each byte range of a file
    group = F.sum("_heads").over(before.rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_group", group)
    open_ = Window.partitionBy("source_file", "_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialised(counts.select(
        "source_file", "_range", (F.col("_group") - F.col("_heads")).alias("_objects"),
        "_group", "_heads", "_tail"))
    # lines of the object that is open when a range begins, from the range of its header on
    counts = counts.withColumn("_of_last", F.sum("_tail").over(open_))
    carried = F.lag(F.coalesce(F.col("_of_last"), F.lit(0)) + F.col("_tail")).over(before)
    counts = counts.select("source_file", "_range", "_objects", F.coalesce(carried, F.lit(0)).alias("_carried"))
    rows = pieces.join(broadcast_if_small(counts), ["source_file", "_range"])
    rows = rows.withColumn("_seen", F.count("_head").over(within))
    same = Window.partitionBy("source_file", "_range", "_seen").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.size("_lines")).over(same), F.lit(0)) + F.when(F.col("_seen") == 0, F.col("_carried")).otherwise(0))
    rows = rows.withColumn("_object", F.col("_objects") + F.col("_seen")).where("_object > 0")
    headers = rows.where(F.col("_head").isNotNull()).select("source_file", "_object", "_head")
    data = rows.select("source_file", "_object", "_first", F.posexplode("_lines").alias("_p", "_text"))
    return headers, data.select("source_file", "_object", (F.col("_first") + F.col("_p")).cast("int").alias("line"), _plain("_text").alias("_text"))


def _plain(c: str):
    """Character data of an element, trimmed: sections unwrapped, the named references of XML decoded."""
    text = F.regexp_replace(F.trim(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.when(F.contains(text, F.lit("&")), F.replace(text, F.lit(f"&{name};"), F.lit(char))).otherwise(text)
    return text


def read_witsml_logs(spark: SparkSession, path) -> DataFrame:
    """One row per data line: log attributes, `values` (mnemonic -> text) and `units` (mnemonic -> unit).

    A unit listed with the data is used only where the curve header has none. A line with fewer cells than mnemonics has NULL for
    the rest; cells beyond the mnemonics have no name and are counted in `extra_cells`. One large log object is read by many tasks.
    """
    headers, data = _data_lines(spark, path)
    closed = F.concat(
        F.regexp_replace(F.regexp_replace("_head", rf"(?s)<{PREFIX}data[\s>/].*$", ""), rf"(</?){PREFIX}([A-Za-z])", "$1$2"), F.lit("</logData></log>")
    )
    raw = headers.select("source_file", "_object", F.from_xml(closed, LOG).alias("_x")).select("source_file", "_object", "_x.*")
    names = F.transform(F.split("logData.mnemonicList", ","), lambda x: F.trim(x))
    units = F.transform(F.split("logData.unitList", ","), lambda x: F.trim(x))
    inline = F.when(F.size(names) == F.size(units), F.map_from_arrays(names, units))
    header = F.map_from_entries(
        F.array_distinct(
            F.transform("logCurveInfo", lambda c: F.struct(F.trim(c["mnemonic"]), _known(c["unit"])))
        )
    )
    empty = F.create_map().cast("map<string,string>")
    inline, header = F.coalesce(inline, empty), F.coalesce(header, empty)
    every = F.array_union(F.map_keys(header), F.map_keys(inline))
    merged = F.map_from_arrays(
        every, F.transform(every, lambda m: F.coalesce(header[m], _known(inline[m])))
    )
    heads = raw.select(
        F.trim("nameWell").alias("well_name"),
        F.trim("name").alias("log_name"),
        F.trim("indexType").alias("index_type"),
        F.trim("indexCurve").alias("index_curve"),
        F.trim("nullValue").alias("null_value"),
        F.col("source_file").alias("_file"),
        F.col("_object").alias("_number"),
        merged.alias("units"),
        names.alias("_names"),
    )
    rows = data.join(broadcast_if_small(heads), (F.col("source_file") == F.col("_file")) & (F.col("_object") == F.col("_number")))
    cells = F.split("_text", ",")
    filled = F.transform("_names", lambda _, i: F.get(cells, i))
    return rows.select(
        "well_name", "log_name", "index_type", "index_curve", "null_value", "source_file", "units", "line", F.map_from_arrays("_names", filled).alias("values"),
        F.greatest(F.size(cells) - F.size("_names"), F.lit(0)).alias("extra_cells"),
    )


def long_channels(logs: DataFrame) -> DataFrame:
    """Log lines as one row per (line, mnemonic) with its unit and index text."""
    return logs.select(
        "well_name", "log_name", "index_type", "null_value", "source_file", "line",
        F.col("values")[F.col("index_curve")].alias("time_text"), "units", F.explode("values").alias("mnemonic", "value"),
    ).withColumn("unit", F.col("units")[F.col("mnemonic")]).drop("units")


_MEASURE = "struct<_VALUE:string, _uom:string>"


def _number(c: str):
    return F.trim(F.col(f"{c}._VALUE")).try_cast("double")


def read_witsml_trajectory(spark: SparkSession, path) -> DataFrame:
    """Directional stations; angles declared in radians become degrees."""
    fields = ("md", "tvd", "incl", "azi", "dls", "dispNs", "dispEw", "vertSect")
    station = ", ".join(f"{f}:{_MEASURE}" for f in fields)
    raw = _xml(
        spark, path, "trajectory",
        "nameWell string, nameWellbore string, name string, trajectoryStation array<struct<_uid:string, "
        f"typeTrajStation:string, dTimStn:string, {station}>>",
    ).select("*", F.col("_metadata.file_path").alias("source_file"))
    s = raw.select(
        F.trim("nameWell").alias("well_name"), F.trim("name").alias("trajectory_name"), "source_file",
        F.posexplode("trajectoryStation").alias("source_order", "s"),
    ).select("well_name", "trajectory_name", "source_file", "source_order", "s.*")

    def angle(c, unit):
        return F.when(F.col(f"{c}._uom") == unit, F.degrees(_number(c))).otherwise(_number(c))

    return s.select(
        "well_name", "trajectory_name", F.col("_uid").alias("station_uid"),
        F.trim("typeTrajStation").alias("station_type"),
        F.trim("dTimStn").try_cast("timestamp").alias("recorded_at"),
        _number("md").alias("md_m"), _number("tvd").alias("tvd_m"),
        angle("incl", "rad").alias("inclination_deg"), angle("azi", "rad").alias("azimuth_deg"),
        angle("dls", "rad/m").alias("dogleg_severity_deg_per_m"),
        _number("dispNs").alias("north_offset_m"), _number("dispEw").alias("east_offset_m"),
        _number("vertSect").alias("vertical_section_m"), "source_order", "source_file",
    )


def read_witsml_messages(spark: SparkSession, path) -> DataFrame:
    """Operational remarks; the text falls back to the name."""
    raw = _xml(
        spark, path, "message",
        f"_uid string, nameWell string, nameWellbore string, name string, dTim string, md {_MEASURE}, "
        f"tvd {_MEASURE}, typeMessage string, activityCode string, severity string, messageText string, "
        "commonData struct<sourceName:string>",
    ).select("*", F.col("_metadata.file_path").alias("source_file"))
    return raw.select(
        F.col("_uid").alias("message_uid"), F.trim("nameWell").alias("well_name"),
        F.trim("dTim").try_cast("timestamp").alias("recorded_at"), _number("md").alias("md_m"),
        _number("tvd").alias("tvd_m"), F.trim("typeMessage").alias("message_type"),
        F.trim("activityCode").alias("activity_code"), F.trim("severity").alias("severity"),
        F.coalesce(_known(F.col("messageText")), _known(F.col("name")), F.lit("")).alias("text"),
        F.trim("commonData.sourceName").alias("source_name"), "source_file",
    )


def read_witsml_wells(spark: SparkSession, path) -> DataFrame:
    """Well headers with a datum map; a position of 0/0 counts as absent."""
    raw = _xml(
        spark, path, "well",
        "_uid string, name string, field string, country string, region string, operator string, "
        f"waterDepth {_MEASURE}, wellDatum array<struct<_uid:string, code:string, name:string, elevation:{_MEASURE}>>, "
        f"wellLocation array<struct<latitude:{_MEASURE}, longitude:{_MEASURE}>>",
    ).select("*", F.col("_metadata.file_path").alias("source_file"))
    datums = F.filter(
        F.transform(
            "wellDatum",
            lambda d: F.struct(
                F.coalesce(_known(d["code"]), _known(d["name"]), d["_uid"], F.lit("?")).alias("code"),
                F.trim(d["elevation"]["_VALUE"]).try_cast("double").alias("elevation"),
            ),
        ),
        lambda d: d["elevation"].isNotNull(),
    )
    # a code given twice keeps its last elevation
    codes = F.array_distinct(F.transform(datums, lambda d: d["code"]))
    last = F.transform(
        codes, lambda k: F.element_at(F.filter(datums, lambda d: d["code"] == k), -1)["elevation"]
    )
    lat = F.trim(F.col("wellLocation")[0]["latitude"]["_VALUE"]).try_cast("double")
    lon = F.trim(F.col("wellLocation")[0]["longitude"]["_VALUE"]).try_cast("double")
    blank = (F.coalesce(lat, F.lit(0.0)) == 0) & (F.coalesce(lon, F.lit(0.0)) == 0)
    return raw.select(
        F.col("_uid").alias("uid"), F.trim("name").alias("well_name"), F.trim("field").alias("field_name"),
        F.trim("country").alias("country"), F.trim("region").alias("region"), F.trim("operator").alias("operator"),
        _number("waterDepth").alias("water_depth_m"), F.map_from_arrays(codes, last).alias("datums"),
        F.when(~blank, lat).alias("latitude"), F.when(~blank, lon).alias("longitude"), "source_file",
    )


def read_witsml_wellbores(spark: SparkSession, path) -> DataFrame:
    raw = _xml(
        spark, path, "wellbore",
        f"_uid string, _uidWell string, name string, nameWell string, statusWellbore string, mdPlanned {_MEASURE}, "
        "dTimKickoff string",
    ).select("*", F.col("_metadata.file_path").alias("source_file"))
    return raw.select(
        F.col("_uid").alias("uid"), F.col("_uidWell").alias("well_uid"), F.trim("name").alias("name"),
        F.trim("nameWell").alias("well_name"), F.trim("statusWellbore").alias("status"),
        _number("mdPlanned").alias("md_planned_m"), F.trim("dTimKickoff").try_cast("timestamp").alias("kickoff_at"),
        "source_file",
    )


def read_witsml_bha_runs(spark: SparkSession, path) -> DataFrame:
    raw = _xml(
        spark, path, "bhaRun",
        "_uid string, nameWell string, nameWellbore string, name string, numStringRun string, dTimStart string, "
        "dTimStop string",
    ).select("*", F.col("_metadata.file_path").alias("source_file"))
    return raw.select(
        F.col("_uid").alias("run_uid"), F.trim("nameWell").alias("well_name"), F.trim("name").alias("name"),
        F.trim("numStringRun").alias("run_number"), F.trim("dTimStart").try_cast("timestamp").alias("started_at"),
        F.trim("dTimStop").try_cast("timestamp").alias("ended_at"), "source_file",
    )


# Directory names that tell the object type.
OBJECT_TYPES = (
    "log", "trajectory", "message", "bhaRun", "wbGeometry", "tubular", "rig", "_wellInfo", "_wellboreInfo",
)


def find_objects(spark: SparkSession, root: str, object_type: str) -> list[str]:
    """Directories of one object type below `root`, however deep.

    Spark's own listing passes over names with a leading underscore, so those have to be named.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, above = [], []
    while True:
        hits = fs.globStatus(hadoop.Path(top, "/".join([*above, object_type])))
        found += [str(h.getPath()) for h in (hits or [])]
        above.append("*")
        if not fs.globStatus(hadoop.Path(top, "/".join(above))):
            break
    return sorted(set(found))


def witsml_object_inventory(spark: SparkSession, root: str) -> DataFrame:
    """XML files per well directory and object type, from the listing alone."""
    hidden = [p for t in OBJECT_TYPES if t.startswith("_") for p in find_objects(spark, root, t)]
    files = (
        spark.read.format("binaryFile")
        .options(pathGlobFilter="*.xml", recursiveFileLookup="true")
        .load([root, *hidden])
        .select("path", "length")
    )
    base = "/" + root.strip("/") + "/"
    rel = F.element_at(F.split("path", rf"\Q{base}\E", 2), 2)
    parts = F.split(F.replace(F.replace(rel, F.lit("%24"), F.lit("$")), F.lit("%20"), F.lit(" ")), "/")
    kind = F.filter(parts, lambda p: p.isin(*OBJECT_TYPES))[0]
    return (
        files.select(decode_dir(parts[0]).alias("well_name"), kind.alias("object_type"), "length")
        .where(F.col("object_type").isNotNull())
        .groupBy("well_name", "object_type")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def read_page_text(spark: SparkSession, path, document_pattern: str = r"([^/]+?)(?:__\d+_\d+)?\.json$") -> DataFrame:
    """Page records from JSON arrays; where files overlap the first file in name order keeps the page."""
    raw = spark.read.schema(
        "page_number int, text string, method string, confidence double, line_count int, warnings array<string>"
    ).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("source_file"))
    doc = F.regexp_extract("source_file", document_pattern, 1)
    rows = raw.withColumn("document_name", doc)
    rest = ["text", "method", "confidence", "line_count", "warnings", "source_file"]
    first = rows.groupBy("document_name", "page_number").agg(
        F.min_by(F.struct(*rest), "source_file").alias("_r")
    )
    return first.select("document_name", "page_number", "_r.*")


def read_document_index(
    spark: SparkSession, path, wanted_types=("REPORTED BY LICENSEE",), wells: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Document index rows of the wanted types for known wells, largest first."""
    df = spark.read.csv(
        path, header=True,
        schema=_strings(("wlbName", "wlbDocumentType", "wlbDocumentName", "wlbDocumentUrl")) + ", wlbDocumentSize double",
    )
    df = df.where(F.col("wlbDocumentType").isin(*wanted_types)).withColumn("well_name", F.trim("wlbName"))
    if wells is not None:
        df = known_wells_only(df, wells)
    df = df.orderBy(F.desc_nulls_last("wlbDocumentSize"), "wlbName", "wlbDocumentName")
    return df if limit is None else df.limit(limit)


def read_features(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """Only the needed columns, each once, in the given order."""
    return spark.read.parquet(path).select(*dict.fromkeys(columns))
