"""Readers and writers of captures, weight tables, graphs and layers.

Paths go to Spark's readers and writers as they are, so any store that Spark
reads will do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import clock, geo, traffic
from ..operators.history import union_first


def read_tiles(spark: SparkSession, path: str, zoom: int | None = None) -> DataFrame:
    """``tiles/z{z}_{x}_{y}.png`` files as ``(z, x, y, content)``; the zoom is
    tested on the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"z{zoom if zoom is not None else '*'}_*.png").load(path)
    part = lambda k: F.regexp_extract("path", r"z(\d+)_(\d+)_(\d+)\.png$", k).try_cast("int")
    return files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), "content").where("x IS NOT NULL")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Capture manifests (one JSON document each); a missing series is 'test'."""
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(path)
    return raw.withColumn("series", F.coalesce("series", F.lit("test"))).withColumn(
        "ts", F.coalesce(F.try_to_timestamp("captured_utc", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), clock.capture_time(F.col("name")))
    )


def newest_captures(manifests: DataFrame, keep: int) -> DataFrame:
    return manifests.where(F.col("status").isin("ok", "partial")).orderBy(F.desc("ts"), F.desc("name")).limit(keep)


def weight_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of edge weight tables (CSV, gzip or plain) with typed columns, those
    of an older model (without ``method`` and ``hops``) beside those of the current
    one, with their ``file`` and whether they are ``damaged``.

    A row is of the model whose number of fields it has; it is damaged if it has
    another number or a field that isn't of its type."""
    columns = [c.split() for c in schemas.COMPLETE.split(", ")]
    older = len(schemas.OBSERVED.split(", "))
    raw = spark.read.schema(", ".join(f"{n} STRING" for n, _ in columns) + ", _raw STRING").option("header", True)
    # all fields are read, or rows of the wrong number would not be seen
    raw = raw.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").option("columnPruning", False).csv(path)
    odd = F.col("_raw").isNotNull() & (F.size(F.split("_raw", ",")) != older)
    typed = {n: F.col(n).try_cast(t) for n, t in columns}
    wrong = [F.col(n).isNotNull() & (F.col(n) != "") & typed[n].isNull() for n, t in columns if t != "STRING"]
    return raw.select(*[typed[n].alias(n) for n, _ in columns], reduce(lambda x, y: x | y, wrong, odd).alias("damaged"), F.input_file_name().alias("file"))


def read_weights(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Edge weight tables with typed columns, of either model or of both; damaged rows
    are left out (``damaged_weights`` counts them)."""
    rows = weight_rows(spark, path).where("NOT damaged")
    if columns:
        return rows.select(*columns)
    return rows.drop("damaged", "file") if _complete(spark, path) else rows.select(*[c.split()[0] for c in schemas.OBSERVED.split(", ")])


def damaged_weights(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rows, damaged)`` of weight tables."""
    return weight_rows(spark, path).groupBy("file").agg(F.count("*").alias("rows"), F.count_if("damaged").alias("damaged"))


def weights_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def _complete(spark: SparkSession, path: str) -> bool:
    """A folder is of the current model if any of its tables has ``hops``."""
    return "hops" in weights_header(spark, path) or not weight_rows(spark, path).where("hops IS NOT NULL").isEmpty()


def read_history(spark: SparkSession, folders: list[str], prefix: str = "dhaka") -> DataFrame:
    """Readings of all captures in several folders; a capture in two folders
    counts once, from the first. ``(capture, ts, edge_id, level, painted)``."""
    parts = []
    for folder in folders:
        raw = spark.read.option("header", True).option("pathGlobFilter", f"{prefix}-*.csv*").csv(folder)
        w = F.col("weight").try_cast("double")
        parts.append(raw.select(
            F.regexp_extract(F.input_file_name(), rf"({prefix}-[^/]*?)\.csv(\.gz)?$", 1).alias("capture"), F.col("edge_id").try_cast("bigint").alias("edge_id"),
            traffic.level_of_weight(w).alias("level"), (F.col("source") == "observed").cast("int").alias("painted"),
        ))
    merged = parts[0]
    if len(parts) > 1:
        # the first folder wins a whole capture, not single roads
        named = [p.withColumn("_f", F.lit(i)) for i, p in enumerate(parts)]
        keep = union_first([p.select("capture", "_f").distinct() for p in named], ["capture"])
        every = named[0]
        for p in named[1:]:
            every = every.unionByName(p)
        merged = every.join(F.broadcast(keep), ["capture", "_f"], "left_semi").drop("_f")
    return merged.withColumn("ts", clock.capture_time(F.col("capture")))


def write_weights(table: DataFrame, path: str, compress: bool = True) -> None:
    table.write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_readings(readings: DataFrame, path: str) -> None:
    """Parquet by local day, so a range of days reads only its folders."""
    readings.withColumn("day", clock.local(F.col("ts")).cast("date")).repartition("day").sortWithinPartitions("ts", "edge_id").write.mode("overwrite").partitionBy("day").parquet(path)


def read_readings(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("day") <= F.lit(last).cast("date"))
    return df


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph's JSON document ``{graph_id, nodes, edges}``."""
    edge = (
        "STRUCT<id:BIGINT,u:BIGINT,v:BIGINT,length_m:DOUBLE,highway:STRING,lanes:INT,oneway:BOOLEAN,capacity_vph:DOUBLE,"
        "free_flow_kmph:DOUBLE,free_flow_s:DOUBLE,geometry:ARRAY<ARRAY<DOUBLE>>>"
    )
    doc = spark.read.schema(f"graph_id STRING, nodes MAP<STRING,ARRAY<DOUBLE>>, edges ARRAY<{edge}>").option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("k", "p")).select(F.col("k").cast("bigint").alias("node_id"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
    e = doc.select(F.explode("edges").alias("e")).select("e.*").withColumnRenamed("id", "edge_id")
    time = F.when(F.coalesce("free_flow_s", F.lit(0.0)) > 0, F.col("free_flow_s")).otherwise(traffic.free_flow_s(F.col("length_m"), F.col("free_flow_kmph")))
    return nodes, e.withColumns({"free_flow_s": time, "geometry": F.transform("geometry", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))})


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two Parquet tables under one path."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """OSM ``elements`` documents; of elements read twice the last file's stays."""
    doc = spark.read.schema(f"elements ARRAY<STRUCT<{schemas.ELEMENTS.replace(' BIGINT', ':BIGINT').replace(' STRING', ':STRING').replace(' DOUBLE', ':DOUBLE').replace(' ARRAY', ':ARRAY').replace(' MAP', ':MAP')}>>")
    rows = doc.option("multiLine", True).json(path).select(F.input_file_name().alias("_file"), F.explode("elements").alias("e")).select("_file", "e.*")
    names = [c for c in rows.columns if c != "_file"]
    return rows.groupBy("type", "id").agg(F.max_by(F.struct(*names), "_file").alias("e")).select("e.*")


def quadrants(box: dict) -> list[dict]:
    """A box cut at its middle, for smaller requests."""
    x, y = (box["west"] + box["east"]) / 2, (box["south"] + box["north"]) / 2
    return [
        {"south": s, "north": n, "west": w, "east": e}
        for s, n in ((box["south"], y), (y, box["north"])) for w, e in ((box["west"], x), (x, box["east"]))
    ]


def write_geojson(edges: DataFrame, path: str, *props: str) -> None:
    """One feature a line; a viewer wraps them in a collection."""
    from ..operators.lines import features

    features(edges, *props).select("feature").write.mode("overwrite").option("compression", "gzip").text(path)


def styled(table: DataFrame) -> DataFrame:
    """Colour and line width of weights."""
    w = F.col("weight")
    return table.withColumn("color", traffic.to_hex(w)).withColumn("width", F.round(2.0 + (w - 25.0) * (2.5 / 80.0), 2))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, sha256)`` of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", rf"^.*?{path.rstrip('/').split('/')[-1]}/", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files missing on the right, extra there, or changed."""
    both = left.select("file", F.col("sha256").alias("a")).join(right.select("file", F.col("sha256").alias("b")), "file", "full_outer")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return both.select("file", kind.alias("difference")).where("difference IS NOT NULL")


def may_go(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of the left folder that the right one holds byte for byte; only these
    may be deleted after a move to an archive."""
    return left.join(right.select("file", "sha256"), ["file", "sha256"], "left_semi")


def copy_listed(spark: SparkSession, source: str, target: str, files: list[str]) -> DataFrame:
    """Copy the listed files that exist, and check them: ``(file, copied, same)``.
    A file is whole at its place or not there: it is written aside and renamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for name in files:
        a, b = (jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}") for root in (source, target))
        x, y = a.getFileSystem(conf), b.getFileSystem(conf)
        if not x.exists(a):
            rows.append((name, False, False))
            continue
        aside = b.suffix(".part")
        jvm.org.apache.hadoop.fs.FileUtil.copy(x, a, y, aside, False, True, conf)
        y.delete(b, True)
        y.rename(aside, b)
        rows.append((name, True, y.getContentSummary(b).getLength() == x.getContentSummary(a).getLength()))
    return spark.createDataFrame(rows, "file string, copied boolean, same boolean")


def validate_config(config: dict) -> list[str]:
    """Every problem of a collector's configuration; none if it is fine."""
    rules: list[tuple[str, Callable[[object], bool]]] = [
        ("zoom", lambda v: isinstance(v, int) and 1 <= v <= 22), ("tile_px", lambda v: v in (256, 512)), ("bbox", lambda v: isinstance(v, dict) and v["north"] > v["south"] and v["east"] > v["west"]),
        ("rate", lambda v: v > 0), ("workers", lambda v: isinstance(v, int) and v >= 1), ("tolerance", lambda v: 0 < v <= 128), ("min_free_gb", lambda v: v >= 0),
    ]
    out = []
    for key, fits in rules:
        try:
            if key not in config:
                out.append(f"{key} is missing")
            elif not fits(config[key]):
                out.append(f"{key} is out of range")
        except (TypeError, KeyError):
            out.append(f"{key} is malformed")
    return out


def tile_url(base: str, z: str, x: str, y: str):
    """Address of a tile as a column."""
    return F.format_string(base, F.col(z), F.col(x), F.col(y))


def expected_from_manifest(manifests: DataFrame) -> DataFrame:
    """``(name, x, y)`` of all tiles that manifests announce."""
    r = "tile_range"
    return manifests.select("name", F.explode(F.sequence(F.col(f"{r}.x0"), F.col(f"{r}.x1"))).alias("x"), r).select("name", "x", F.explode(F.sequence(F.col(f"{r}.y0"), F.col(f"{r}.y1"))).alias("y"))


def georeferenced(tiles: DataFrame, zoom: int, box: dict) -> DataFrame:
    """Tiles whose bounds don't map back to themselves or miss the box."""
    b = geo.tile_bounds(F.col("x"), F.col("y"), zoom)
    back = (F.floor(geo.lon_to_tx((b["west"] + b["east"]) / 2, zoom)) == F.col("x")) & (F.floor(geo.lat_to_ty((b["north"] + b["south"]) / 2, zoom)) == F.col("y"))
    inside = (b["west"] <= box["east"]) & (b["east"] >= box["west"]) & (b["south"] <= box["north"]) & (b["north"] >= box["south"])
    return tiles.where(~(back & inside))
