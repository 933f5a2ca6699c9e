"""Night logs, manifest and conditions as files; the event table as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nocturne.functions.columns import serial_to_timestamp, text_to_timestamp, timestamp_to_text
from nocturne.operators.joins import lookup_join
from nocturne.session import stage

# Columns of a raw night log and of the metadata files, in order
RAW_COLUMNS = [
    "DateTime", "IdRFID", "IdLabel", "unitLabel", "eventDuration", "sense1duration",
    "sense1Events", "senseRFIDrecords", "reinforce1value", "reinforce1Total",
    "reinforce1Account", "outFuncLabel", "outLabel", "SystemMsg",
    "MsgValue1", "MsgValue2", "MsgValue3",
]
MANIFEST_SCHEMA = "night int, path string, comments string"
CONDITIONS_SCHEMA = (
    "night int, group_night int, IdLabel string, IdRFID string, weight double, "
    "sex string, `group` string, discard string, cond string"
)


def read_raw_logs(spark: SparkSession, root: str) -> DataFrame:
    """All night logs below ``root`` as text, with where each row came from.

    ``;``-separated UTF-16LE with a header.  Naming the line separator lets
    Spark split a file at line ends, so a night of any size is read by many
    tasks.  ``row`` restores the order of the file: the split's offset, then
    the order within the split.  Empty fields are empty strings.
    """
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    rows = (
        spark.read.schema(schema)
        .options(sep=";", header=True, encoding="UTF-16LE", lineSep="\n", recursiveFileLookup=True)
        .csv(root)
    )
    texts = [F.rtrim(F.coalesce(c, F.lit("")), F.lit("\r")).alias(c) for c in RAW_COLUMNS]
    return rows.select(
        *texts,
        relative_path(_decoded(F.col("_metadata.file_path")), root).alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("row"),
    )


def _decoded(uri: Column) -> Column:
    """Percent-decode an address; a plus sign stands for itself."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def relative_path(path: Column, root: str) -> Column:
    """The part of a file's address below ``root``, with a leading slash."""
    root = root.rstrip("/")
    return F.substring(path, F.instr(path, root) + len(root), F.length(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).options(sep=";", header=True, nullValue="NA").csv(path)


def read_conditions(spark: SparkSession, path: str) -> DataFrame:
    """Conditions under the names the other operators use."""
    raw = spark.read.schema(CONDITIONS_SCHEMA).options(sep=";", header=True, nullValue="NA").csv(path)
    return raw.withColumnsRenamed({"IdLabel": "id_label", "IdRFID": "tag", "group": "cohort"})


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative_path(F.col("path"), root).alias("path"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, "path", "left_anti")


def broken_entries(manifest: DataFrame) -> DataFrame:
    """Entries without a night or a path, and paths listed more than once."""
    twice = manifest.groupBy("path").count().where("count > 1").select("path")
    listed = manifest.join(twice, "path", "left_semi")
    return manifest.where(F.col("night").isNull() | F.col("path").isNull()).unionByName(listed).distinct()


def check_manifest(manifest: DataFrame, files: DataFrame) -> None:
    """Raise if an entry is broken or its file is missing; names at most five."""
    for rows, what in ((broken_entries(manifest), "broken manifest entries"),
                       (missing_files(manifest, files), "no file for")):
        some = [r["path"] for r in rows.select("path").limit(5).collect()]
        if some:
            raise FileNotFoundError(f"{what}: {some}")


def number(column: str) -> Column:
    """Text with a decimal comma as a number; null if it is none."""
    return F.replace(F.col(column), F.lit(","), F.lit(".")).try_cast("double")


def as_log(raw: DataFrame, manifest: DataFrame) -> DataFrame:
    """Raw rows of the files in the manifest, typed and tagged with their night.

    Marker lines (``#`` in the time) are dropped.  ``event_seq`` orders rows of
    the same millisecond: by the unrounded time, then as in the file.
    """
    # one night may be a third of the rows: a staged manifest is broadcast if small,
    # else its busy paths are split
    listed = stage(manifest.select("night", "path").where(F.col("night").isNotNull()), "manifest")
    lines = lookup_join(raw.where(~F.col("DateTime").contains("#")), listed, ["path"], ["row"])
    lines = lines.where(F.col("night").isNotNull())
    serial = number("DateTime")
    return lines.select(
        "night",
        F.struct(serial.alias("serial"), F.col("row.offset"), F.col("row.line")).alias("event_seq"),
        serial_to_timestamp("DateTime").alias("ts"),
        F.nullif("IdRFID", F.lit("")).alias("tag"),
        F.col("IdLabel").alias("raw_label"),
        F.col("unitLabel").alias("unit_label"),
        number("eventDuration").alias("event_duration"),
        number("sense1duration").alias("sense_duration"),
        number("reinforce1value").alias("reward_steps"),
        F.col("SystemMsg").alias("system_msg"),
    )


def load_logs(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """The logs of a checked manifest, ready for ``build_event_table``."""
    check_manifest(manifest, list_files(spark, root))
    return as_log(read_raw_logs(spark, root), manifest)


def write_raw_logs(log: DataFrame, root: str) -> None:
    """Write text columns named as in a raw log, one folder per night."""
    empty = F.lit("")
    columns = [
        F.coalesce(F.col(c), empty).alias(c) if c in log.columns else empty.alias(c)
        for c in RAW_COLUMNS
    ]
    (
        log.select("night", *columns).write.partitionBy("night")
        .options(sep=";", header=True, encoding="UTF-16LE", lineSep="\n", emptyValue="")
        .csv(root)
    )


def write_events(events: DataFrame, path: str) -> None:
    """The event table as Parquet, a folder per night.

    Rows arrive in time order, so a task holds few nights and a large night is
    written by many tasks.
    """
    events.write.partitionBy("night").parquet(path)


def replace_nights(events: DataFrame, path: str) -> None:
    """Write the nights of ``events`` anew and leave all others as they are.

    Every night is written beside the table first and takes its place when all
    of them are there, so a write that fails leaves the old nights; a night of
    which ``events`` has no row stays."""
    writer = events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("night").parquet(path)


def read_events(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A result table as ``;``-separated text with a header; times as text."""
    times = {c: timestamp_to_text(c) for c, kind in df.dtypes if kind == "timestamp_ntz"}
    df = df.withColumns(times) if times else df
    df.write.options(sep=";", header=True, nullValue="NA").csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that `write_table` wrote, typed by ``schema``; ``NA`` is null."""
    names = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema).fields}
    text = ", ".join(f"`{n}` {'string' if kind == 'timestamp_ntz' else kind}" for n, kind in names.items())
    rows = spark.read.schema(text).options(sep=";", header=True, nullValue="NA").csv(path)
    times = {n: text_to_timestamp(n) for n, kind in names.items() if kind == "timestamp_ntz"}
    return rows.withColumns(times) if times else rows
