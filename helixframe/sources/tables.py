"""Tab-separated result files and index folders (Parquet sections with a manifest)."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

FORMAT_VERSION = "1.1"


def write_tsv(df: DataFrame, path: str) -> None:
    """Header and tabs; null is NA."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.options(sep="\t", header=True, nullValue="NA")
    return (reader.schema(schema) if schema else reader).csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def content_checksum(df: DataFrame) -> dict:
    """Rows of a section and two sums of a hash over all its columns, whatever the row order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).alias("sum")).first().asDict()


def save_index(sections: dict[str, DataFrame], path: str, properties: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """Write the sections and a manifest beside ``path``, then put them there by a rename; what stood there goes last."""
    spark = next(iter(sections.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target) and not overwrite:
        raise EngineError("io_error", f"{path} exists")
    staged, aside = (f"{path.rstrip('/')}._{w}-{uuid.uuid4().hex}" for w in ("staged", "old"))
    checks = {}
    for name, df in sections.items():
        df.write.parquet(f"{staged}/{name}")
        checks[name] = content_checksum(spark.read.parquet(f"{staged}/{name}"))
    manifest = {"format_version": FORMAT_VERSION, "sections": checks, "properties": properties or {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staged}/manifest")
    old = fs.exists(target)
    if old and not fs.rename(target, _fs(spark, aside)[1]):
        raise EngineError("io_error", f"cannot move {path}")
    if not fs.rename(_fs(spark, staged)[1], target):
        if old:
            fs.rename(_fs(spark, aside)[1], target)
        raise EngineError("io_error", f"cannot publish {path}")
    if old:
        fs.delete(_fs(spark, aside)[1], True)


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        raise EngineError("io_error", f"{path} is no index")
    try:
        return json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    except (ValueError, TypeError) as e:
        raise EngineError("corrupt_index", f"{path}: {e}") from e


def load_index(spark: SparkSession, path: str, validate: bool = True) -> dict[str, DataFrame]:
    """The sections; ``validate``: each must have the rows and checksums of the manifest."""
    manifest = read_manifest(spark, path)
    if manifest.get("format_version") != FORMAT_VERSION:
        raise EngineError("corrupt_index", f"format version {manifest.get('format_version')}")
    out = {}
    for name, check in manifest["sections"].items():
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise EngineError("corrupt_index", f"section {name} is missing") from e
        if validate and content_checksum(out[name]) != check:
            raise EngineError("corrupt_index", f"section {name} is not what was saved")
    return out


def inspect_index(spark: SparkSession, path: str) -> DataFrame:
    """key, value rows from the manifest alone."""
    m = read_manifest(spark, path)
    rows = [("format_version", m["format_version"])] + [(f"rows.{k}", str(v["rows"])) for k, v in sorted(m["sections"].items())] + sorted((k, str(v)) for k, v in m["properties"].items())
    return spark.createDataFrame(rows, "key string, value string")


#: Names of the suffix-array and FM backends, whether they can be had, and whether they use threads.
BACKENDS = [
    ("sa", "auto", True, True),
    ("sa", "divsufsort", True, False),
    ("sa", "caps", True, True),
    ("fm", "sdsl-csa-wt-huff", True, False),
    ("fm", "sdsl-csa-wt-balanced", True, False),
    ("fm", "sdsl-csa-sada", False, False),
    ("fm", "sdsl-csa-wt-epr", True, False),
]


def available_backends(spark: SparkSession) -> DataFrame:
    """The names that callers may ask for; one distributed implementation answers to all that are available."""
    rows = spark.createDataFrame(BACKENDS, "kind string, name string, available boolean, supports_threads boolean")
    how = F.when(~F.col("available"), "reserved").when(F.col("kind") == "sa", "prefix doubling over ranked range partitions").otherwise("occurrence counts over the Burrows-Wheeler column")
    return rows.withColumn("implementation", how)
