"""Delta-maintained token totals by source, language and tokenizer version.

Texts are counted where they are read (:func:`count_tokens`), and all further steps carry counts, never texts: a
join that says which documents go or change shuffles ids and counts. A batch of counted changes becomes signed rows: an
insert adds its document and tokens, a delete takes them away, a revision takes the old count away and adds the new
one. Signed rows are summed per key before the shuffle, so what is shuffled and stored is one row per task and key.

A batch's rows are written to a folder of their own and then committed by one small file, ``commits/<batch>``, that names
that folder. Totals read the folders that commit files name and nothing else, so whatever a writer that failed, or came
second, left behind is never counted, and a batch counts once however many writers send it and at whatever moment: there is one
name to point with. The file is written aside and renamed (a rename of folders, which object stores lack, is not needed), and
``apply`` reads it back: only a writer whose folder it names reports success. (Where a rename replaces a file, as on a local disk, a
writer that was overtaken right after that has reported success too; the batch counts once all the same.) A rollup may be opened again by its path at any
time, by other sessions too. ``compact`` folds the rows of many batches into one folder by the same step. Totals never need the
documents again.

Defined cases: null text, and a null count, has no tokens; null source or language is a key of its own; repeated rows
count once each; kept columns may have any names but those of the counts; keys whose documents and tokens have all been taken away vanish from the totals; an empty
batch is committed and changes nothing; other columns are not read. Unknown operations raise.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import arrow_columns
from .tokens import default_path, tokens

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def count_tokens(rows: DataFrame, keep: list[Column], texts: dict[str, Column], tokenizer_path: str | None = None) -> DataFrame:
    """``keep``, and for each of ``texts`` a column of its name with the tokens of that text (0 if null)."""
    path = tokenizer_path or default_path()

    def compute() -> Callable[[list[pa.Array]], list[pa.Array]]:
        coder = tokens(path)

        def counts(arrays: list[pa.Array]) -> list[pa.Array]:
            parts = [[a.slice(lo, 2000).to_pylist() for lo in range(0, len(a), 2000)] for a in arrays]
            return [pa.array([len(ids) // 4 for part in ps for ids in coder.encode(part)], pa.int64()) for ps in parts]

        return counts

    return arrow_columns(rows, keep, [t.cast("string") for t in texts.values()], ", ".join(f"`{n}` long" for n in texts), compute)


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, d_docs, d_tokens) of rows with ``op`` insert, delete or revise.

    ``n_tokens`` is the count of the new text, and for a delete of the text that goes. A revision has ``old_n_tokens``
    and may have ``old_source`` and ``old_lang`` where those change too.
    """
    have = set(changes.columns)
    old = [F.col(f"old_{c}") if f"old_{c}" in have else F.col(c) for c in ("source", "lang")]
    old_n = F.col("old_n_tokens") if "old_n_tokens" in have else F.lit(0)
    row = lambda s, g, n, sign: F.struct(s.cast("string").alias("source"), g.cast("string").alias("lang"), F.lit(sign).alias("d_docs"), (sign * F.coalesce(n.cast("long"), F.lit(0))).alias("d_tokens"))
    new = lambda sign: row(F.col("source"), F.col("lang"), F.col("n_tokens"), sign)
    parts = (
        F.when(F.col("op") == "insert", F.array(new(1)))
        .when(F.col("op") == "delete", F.array(new(-1)))
        .when(F.col("op") == "revise", F.array(row(*old, old_n, -1), new(1)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(F.col("op"), F.lit("null")))))
    )
    return changes.select(F.explode(parts).alias("r")).select("r.*")


def token_deltas(rows: DataFrame, version: str = "word_bpe_49k") -> DataFrame:
    """Signed documents and tokens of each key, from rows of :func:`signed`."""
    keyed = rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), "d_docs", "d_tokens")
    return keyed.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))


def count_changes(changes: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Changes that carry ``text`` (and ``old_text``) as changes that carry counts, for :func:`signed`."""
    texts = {n: F.col(t) for n, t in (("n_tokens", "text"), ("old_n_tokens", "old_text")) if t in changes.columns}
    keep = [F.col(c) for c in ("op", "source", "lang", "old_source", "old_lang") if c in changes.columns]
    return count_tokens(changes, keep, texts, tokenizer_path)


class TokenRollup:
    """Totals kept in a folder that all executors share; opened again by its path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}").rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, name: str) -> dict | None:
        """What a commit file says; None if there is none."""
        fs, p = self._fs(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> None:
        """A small file in one step: written aside, then renamed."""
        fs, aside = self._fs(f"aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(json.dumps(content).encode())
        out.close()
        target = self._fs(name)[1]
        fs.mkdirs(target.getParent())
        if not fs.rename(aside, target):  # another writer's file stands there, or the store has failed
            fs.delete(aside, False)

    def _commits(self) -> dict[str, str]:
        """Batch -> folder; one small file for each batch that no compaction has folded."""
        fs, p = self._fs("commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return {n: self._read(f"commits/{n}")["folder"] for n in sorted(names) if not n.startswith((".", "_"))}

    def _compacted(self) -> dict:
        return self._read("compacted/latest") or {"folder": None, "batches": []}

    def committed(self, batch_id: str) -> bool:
        return self._read(f"commits/{batch_id}") is not None

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commit a batch of deltas; False, and nothing counted, if it had been committed before or another writer was first."""
        if not re.fullmatch(r"[A-Za-z0-9-][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, -, and inside also _ and .")
        if self.committed(batch_id):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        deltas.select(*KEYS, "d_docs", "d_tokens").write.parquet(f"{self.path}/{folder}")
        if not self.committed(batch_id):
            self._put(f"commits/{batch_id}", {"folder": folder})
        if (self._read(f"commits/{batch_id}") or {}).get("folder") == folder:
            return True
        fs, p = self._fs(folder)
        fs.delete(p, True)
        return False

    def compact(self) -> int:
        """Fold the rows of all committed batches into one folder; how many batches it holds. One session at a time may do this.

        The commit files stay, as they are what a batch sent again is told by.
        """
        batches = self._commits()
        folder = f"data/{uuid.uuid4().hex}"
        rows = self._deltas().groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        rows.write.parquet(f"{self.path}/{folder}")
        fs, latest = self._fs("compacted/latest")
        fs.delete(latest, False)  # between this and the next step totals come from the batches themselves
        self._put("compacted/latest", {"folder": folder, "batches": sorted(batches)})
        return len(batches)

    def _deltas(self) -> DataFrame:
        folded, batches = self._compacted(), self._commits()
        folders = ([folded["folder"]] if folded["folder"] else []) + [f for b, f in batches.items() if b not in set(folded["batches"])]
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{f}" for f in folders])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens over all committed batches."""
        return self._deltas().groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")
