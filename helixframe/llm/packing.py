"""Cost-balanced packing of token streams into fixed-length training sequences.

Each document becomes its ids and an end id. Whole stretches of ``seq_len`` ids are sequences of
their own. What is left of each document is packed block by block: a block holds at most
``block_tokens`` ids (a fixed bound, so no task ever holds more), opens just as many sequences as its
ids need, and takes its pieces in descending order of estimated cost ``linear * n + quadratic * n**2``.
A piece goes to the sequence of the lowest cost so far that still has room for all of it. If none has,
it is cut over the sequences of the lowest cost with any room. So all sequences of a block but one are full; the
pieces of that one are carried into the task's next block.

What a task has left over at its end (less than a sequence) is written with its ids. A second, small stage packs the left-overs of
``tails`` tasks at a time by the same method, so one sequence of ``tails`` tasks is padded, however the input is cut
into partitions. Nothing else is shuffled: full sequences stay in the task that read their texts.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed once each;
an empty table gives an empty table; other columns of the input are not read. Ties in cost go to
the piece that was read first and to the sequence that was opened first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write_table
from .tokens import WordTokens, default_path, tokens

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType(), False) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
#: Pieces, and for left-overs their ids, the task they come from and no sequence yet.
STAGED = T.StructType([*[T.StructField(f.name, T.LongType()) for f in SCHEMA], T.StructField("ids", T.BinaryType()), T.StructField("part", T.LongType())])
#: Sequences of the second stage are numbered from here on; a first-stage task's begin at its number times 2**33.
TAILS = 1 << 62


def piece_cost(n, linear: float, quadratic: float):
    """Estimated attention cost of a piece of n tokens."""
    return linear * n + quadratic * n * n


def pack_lengths(lengths: np.ndarray, seq_len: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int]]:
    """(item, start in the item, length, sequence) for items of at most ``seq_len`` tokens; item order within a sequence is output order."""
    total = int(lengths.sum())
    if not total:
        return []
    n_seq = -(-total // seq_len)
    room = np.full(n_seq, seq_len, dtype=np.int64)
    room[-1] = total - seq_len * (n_seq - 1)  # the only sequence that may be padded
    cost, out = np.zeros(n_seq), []
    order = np.argsort(-piece_cost(lengths.astype(float), linear, quadratic), kind="stable")
    for item in order:
        n, start = int(lengths[item]), 0
        while n:
            fits = np.where(room >= n, cost, np.inf)
            k, take = int(fits.argmin()), n
            if fits[k] == np.inf:
                k = int(np.where(room > 0, cost, np.inf).argmin())
                take = int(room[k])
            out.append((int(item), start, take, k))
            room[k] -= take
            cost[k] += piece_cost(take, linear, quadratic)
            start, n = start + take, n - take
    return out


class _Packer:
    """Packs ids piece by piece, holding at most a block of them."""

    def __init__(self, first_sequence: int, seq_len: int, block_tokens: int, linear: float, quadratic: float):
        self.next_seq, self.seq_len, self.block_tokens, self.weights = first_sequence, seq_len, block_tokens, (linear, quadratic)
        self.rows: list[tuple] = []
        self.rest: list[tuple] = []
        self.held = 0

    def add(self, doc_id, ids: bytes) -> None:
        """A document's ids."""
        size, step = len(ids) // 4, self.seq_len
        full = size // step * step
        for start in range(0, full, step):
            self.rows.append((doc_id, start, step, zlib.crc32(ids[4 * start : 4 * (start + step)]), size, self.next_seq, 0))
            self.next_seq += 1
        if full < size:
            self.add_piece(doc_id, full, ids[4 * full :], size)

    def add_piece(self, doc_id, start: int, ids: bytes, size: int) -> None:
        """Less than a sequence of a document of ``size`` ids, from its id ``start`` on."""
        self.rest.append((doc_id, start, ids, size))
        self.held += len(ids) // 4
        if self.held >= self.block_tokens + self.seq_len:  # what was carried over comes on top of a block
            self.flush()

    def flush(self, last: bool = False) -> None:
        """Place what is held; the pieces of the sequence that is not full are held further, unless it is the ``last``."""
        lengths = np.array([len(r[2]) // 4 for r in self.rest], dtype=np.int64)
        placed = pack_lengths(lengths, self.seq_len, *self.weights)
        used: dict[int, int] = {}
        for _, _, n, k in placed:
            used[k] = used.get(k, 0) + n
        number = {k: self.next_seq + i for i, k in enumerate(k for k in sorted(used) if last or used[k] == self.seq_len)}
        rest, filled = [], dict.fromkeys(number, 0)
        for item, start, n, k in placed:
            doc_id, first, ids, size = self.rest[item]
            ids = ids[4 * start : 4 * (start + n)]
            if k in number:
                self.rows.append((doc_id, first + start, n, zlib.crc32(ids), size, number[k], filled[k]))
                filled[k] += n
            else:
                rest.append((doc_id, first + start, ids, size))
        self.next_seq += len(number)
        self.rest, self.held = rest, sum(len(r[2]) // 4 for r in rest)

    def take(self) -> list[list]:
        """Columns of the pieces placed since the last call."""
        columns = [list(c) for c in zip(*self.rows, strict=True)] if self.rows else [[] for _ in SCHEMA]
        self.rows = []
        return columns


def _staged(columns: list[list], rest: list[tuple] = (), part: int | None = None) -> pa.RecordBatch:
    n = len(columns[0])
    held = [[r[0] for r in rest], [r[1] for r in rest], [len(r[2]) // 4 for r in rest], [zlib.crc32(r[2]) for r in rest], [r[3] for r in rest], [None] * len(rest), [None] * len(rest)]
    arrays = [pa.array(c + h, type=pa.int64()) for c, h in zip(columns, held, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([None] * n + [r[2] for r in rest], pa.binary()), pa.array([None] * n + [part] * len(rest), pa.int64())], names=STAGED.names)


def pack(docs: DataFrame, seq_len: int = 4096, end_id: int = 2, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 2048, tails: int = 256) -> DataFrame:
    """Pieces of all documents and their place in sequences; see the module for the method and the cases."""
    path, end = tokenizer_path or default_path(), np.array([end_id], dtype="<u4").tobytes()
    options = (seq_len, block_tokens, linear, quadratic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder: WordTokens = tokens(path)
        part = TaskContext.get().partitionId()
        packer = _Packer(part << 33, *options)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                for doc_id, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1).to_pylist()), strict=True):
                    packer.add(doc_id, ids + end)
            yield _staged(packer.take())
        packer.flush()
        yield _staged(packer.take(), packer.rest, part)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Left-overs, sorted by group."""
        packer, group = None, None
        for batch in batches:
            for g, _, doc_id, start, ids, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if g != group:
                    if packer:
                        packer.flush(last=True)
                        yield _pieces(packer)
                    group, packer = g, _Packer(TAILS + (g << 33), *options)
                packer.add_piece(doc_id, start, ids, size)
            if packer:
                yield _pieces(packer)
        if packer:
            packer.flush(last=True)
            yield _pieces(packer)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged = write_table(src.mapInArrow(run, STAGED), "packed")
    left = staged.where("part IS NOT NULL").select(F.floor(F.col("part") / tails).alias("g"), "part", "doc_id", "start", "ids", "doc_tokens")
    # the rows of ``tails`` tasks: less than ``tails`` sequences
    packed = left.repartition("g").sortWithinPartitions("g", "part", "doc_id", "start", "ids").mapInArrow(combine, SCHEMA)
    return staged.where("part IS NULL").select(*SCHEMA.names).unionByName(packed)


def _pieces(packer: _Packer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in packer.take()], names=SCHEMA.names)
