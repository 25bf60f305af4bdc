"""Sources and sinks.

Paths are cluster paths (the shared folder named by ``spark.checkpoint.dir``
or one given by the caller); nothing is written to a machine-local folder
unless the session runs locally and no shared folder is configured.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NLI_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("premise", T.StringType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("explanation_1", T.StringType()),
    T.StructField("explanation_2", T.StringType()),
    T.StructField("explanation_3", T.StringType()),
    T.StructField("split", T.StringType()),
])

TEXT_PRED_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (
    "input_text", "generated_text", "reference_texts_0", "reference_texts_1", "reference_texts_2")])

LABEL_PRED_SCHEMA = T.StructType([T.StructField("reference_label", T.IntegerType()),
                                  T.StructField("predicted_label", T.IntegerType())])

# Fixed value: run-name timestamp suffix (Python %m%d-%H:%M:%S).
RUN_TS_FORMAT = "MMdd-HH:mm:ss"


def read_splits(spark: SparkSession, path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """A1: the NLI table partitioned by ``split``; a split filter prunes partitions."""
    df = spark.read.schema(NLI_SCHEMA).parquet(path)
    return df if splits is None else df.filter(F.col("split").isin(*splits))


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def _is_missing(e: AnalysisException) -> bool:
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    code = cond() if cond else None
    return code == "PATH_NOT_FOUND" or (code is None and "Path does not exist" in str(e))


_POINTER = "CURRENT"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the snapshot that a table written by ``cached`` shows now, None if there is none yet."""
    base = path.rstrip("/")
    try:
        found = spark.read.text(f"{base}/{_POINTER}").first()
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        return None
    return f"{base}/{found['value']}" if found else None


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Let the table show snapshot ``version``: the pointer file is written aside and renamed over the old one, which
    readers see entirely or not at all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    aside, pointer = fs_path(f"{path}/_pointer-{uuid.uuid4().hex}"), fs_path(f"{path}/{_POINTER}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf)
    out = aside.getFileSystem(conf).create(aside)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(aside, pointer, options)


def rebuild(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: str | None = "split") -> str:
    """Write a new snapshot beside the others and publish it. A builder that fails publishes nothing, one that is
    overtaken is replaced whole, and a reader of an older snapshot keeps its files."""
    version = f"snapshot-{uuid.uuid4().hex}"
    w = build().write
    (w.partitionBy(partition_by) if partition_by else w).parquet(f"{path.rstrip('/')}/{version}")
    publish(spark, path.rstrip("/"), version)
    return f"{path.rstrip('/')}/{version}"


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: str | None = "split",
           schema: T.StructType | None = None) -> DataFrame:
    """A2: read the table at ``path`` if a snapshot of it has been published, else build, publish and read it.
    Builders never write to each other's folders; an error other than "not found" propagates."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(current(spark, path) or rebuild(spark, path, build, partition_by))


FILE_ROWS = 20_000  # rows a CSV file: one with newlines in its texts can't be split, so it is read by one task


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: CSV with header, no index; quotes escaped by doubling so texts with newlines and quotes
    round-trip. Outer blanks are kept, and an empty text is written quoted, a null one unquoted."""
    df.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("escape", '"').option("emptyValue", '""') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_predictions(spark: SparkSession, glob: str, schema: T.StructType = TEXT_PRED_SCHEMA,
                     with_file: bool = True) -> DataFrame:
    """A3: read prediction CSVs by wildcard with an explicit schema; the source
    file is kept because glob order is undefined."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("emptyValue", "")
          # null is an unquoted nothing, an empty text a quoted one: null must not be spelt as the empty text
          .option("nullValue", "\u0001null\u0001").csv(glob))
    return df.withColumn("source_file", F.col("_metadata.file_path")) if with_file else df


def write_errors(df: DataFrame, path: str, key: str = "row_id", mode: str = "overwrite") -> None:
    """A5: wrong rows with their original row index as the first column."""
    write_predictions(df.select(key, *[c for c in df.columns if c != key]), path, mode)


def write_summary(df: DataFrame, path: str, run: str = "run", metric: str = "metric", value: str = "value",
                  headline: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One flat JSON object per run, ``{"<metric>": value, …, "summary": {headline…}}``,
    written under ``run=<name>/``. A run has tens of keys, so its map is bounded."""
    entry = F.struct(F.col(metric), F.col(value))
    agg = df.groupBy(run).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("_m"),
        F.to_json(F.map_from_entries(F.collect_list(F.when(F.col(metric).isin(*headline), entry)))).alias("_h"))
    body = F.concat(F.expr("substring(_m, 1, length(_m) - 1)"), F.lit(',"summary":'), F.col("_h"), F.lit("}"))
    agg.select(run, body.alias("value")).write.mode(mode).partitionBy(run).text(path)


def read_summaries(spark: SparkSession, glob: str) -> DataFrame:
    """Run-summary JSON files (flat ``/``-keys plus nested objects) → long
    ``(run, metric, value)``; nested objects are not numbers and are dropped.
    The run comes from a ``run=<name>`` folder, else from the file name."""
    raw = spark.read.text(glob, wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
    kv = raw.select("_file", F.explode(F.from_json("value", "map<string,string>")).alias("metric", "_v"))
    from_dir = F.regexp_extract("_file", r"/run=([^/]+)/", 1)
    run = F.when(from_dir != "", from_dir).otherwise(F.regexp_extract("_file", r"([^/]+?)(\.json)?$", 1))
    return kv.select(run.alias("run"), "metric", F.expr("try_cast(_v as double)").alias("value")) \
        .filter(F.col("value").isNotNull())


def run_name(base, ts) -> Column:
    """``{run_name}_{MMdd-HH:mm:ss}``."""
    b = F.col(base) if isinstance(base, str) else base
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.format_string("%s_%s", b, F.date_format(t, RUN_TS_FORMAT))
