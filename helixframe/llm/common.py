"""Helpers shared by the training-data operators: shared workspace, bounded joins, Arrow text access."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Words of the contracts: runs of bytes other than space and \\t..\\r (all ASCII, so UTF-8 bytes can be split).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back. Lost executors cost no more than their running tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``write_table`` on which nothing that is yet to run depends."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lookup_join(df: DataFrame, small: DataFrame, key: str, max_rows: int = 20_000, salts: int = 64) -> DataFrame:
    """Left join of ``df`` to a table with one row per ``key``.

    The lookup table is broadcast only after its rows have been counted and found to be at most
    ``max_rows``; beyond that both sides are joined by a salted key, so that one hot key is dealt to
    ``salts`` tasks. The salted table has ``salts`` rows for each one, of which Spark's estimate of its size
    knows nothing: a sort-merge join is asked for, or the driver would be sent all of them to broadcast.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(small), key, "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int"))
    return left.join(salted.hint("merge"), [key, "_salt"], "left").drop("_salt")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lane_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``max_bytes``; a longer text is a run of its own."""
    data, offs = lane_arrays(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), 0)


def fenced(df: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """``keep`` and ``made``, so that a later filter on what is made is not pushed below it.

    Pushed down, the condition would have every name replaced by its expression, and arrays that functions look
    into element by element would be built anew for each element. A generator over an array of one struct stops that.
    """
    return df.select(*keep, F.explode(F.array(F.struct(*made))).alias("made")).select(*keep, "made.*")


def arrow_columns(df: DataFrame, keep: list[Column], read: list[Column], made: str, compute: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]]) -> DataFrame:
    """``keep``, and the columns of the DDL ``made`` that a function computes from Arrow arrays of ``read``, batch by batch.

    ``compute`` gives the function and is called once in each task. What is kept travels as one struct, so that its names clash
    with none of ours; a kept column with the name of one that is made is refused (ValueError).
    """
    src = df.select(F.struct(*keep).alias("kept"), *[c.alias(f"read{i}") for i, c in enumerate(read)])
    fields, kept = T.StructType.fromDDL(made), src.schema["kept"]
    clash = {f.name.lower() for f in kept.dataType.fields} & {f.name.lower() for f in fields}
    if clash:
        raise ValueError(f"kept columns have names of made ones: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *function(batch.columns[1:])], names=["kept", *fields.names])

    return src.mapInArrow(run, T.StructType([kept, *fields])).select("kept.*", *fields.names)
