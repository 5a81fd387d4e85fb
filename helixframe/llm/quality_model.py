"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Statistics are counted in numpy over the UTF-8 bytes of each text: the mean bytes of a word, shares of kinds of characters, and
shares of repeated words and 3-word windows. Length itself is no statistic. The mean goes in by its logarithm, shares by a power;
which of POWERS, one for characters and one for repetition, is decided by cross-validation over two halves of the rows that are learnt
from, and by nothing else. Halves are dealt by a hash of the statistics, so exact copies lie in one half.

Each class has a Gaussian whose covariance is shrunk towards the pooled covariance of both classes and towards a multiple of the
identity; a score is the logistic function of the difference of log densities plus log priors. The densities come from
Mahalanobis distances by forward substitution in Cholesky factors. Means, factors and log determinants are computed once, on the
driver, from counts, sums and sums of products that Spark adds up over all labelled rows: no sample is taken, and
the driver receives these few thousand numbers only, however many rows there are.

Defined cases: a null text is empty, and an empty text has all statistics 0 and is scored like any other;
null labels are not learnt from; without labels every score is 0.5, with labels of one class only it is
that class; repeated rows count and are scored once each; an empty table gives an empty table; ties between powers go to
the first of POWERS; other columns are not read, and kept ones may have any names but those of the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_columns, text_chunks, write_table
from .shingles import repeated_share, word_hashes

STATISTICS = ("word_bytes", "upper", "symbol", "bang", "digit", "comma_stop", "bar", "lines", "repeat1", "repeat3", "high", "capitalised")
COLUMNS = [f"s_{c}" for c in STATISTICS]
REPEATS = [STATISTICS.index(c) for c in ("repeat1", "repeat3")]
#: Powers of the shares of characters and of repetition that are tried, the plainest first.
POWERS = tuple((chars, repeats) for chars in (0.5, 1.0) for repeats in (0.5, 1.0, 2.0))

#: Byte classes, each a row of the table below.
_UPPER, _SYMBOL, _BANG, _DIGIT, _STOP, _BAR, _LINE, _SPACE, _HIGH, _LOWER, _OTHER = range(11)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
for _c, _bytes in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_SYMBOL, b"#*$%&<>@^~="), (_BANG, b"!?"), (_DIGIT, b"0123456789"), (_STOP, b",.;:"), (_BAR, b"|"), (_LINE, b"\n"), (_SPACE, b" \t\r\x0b\x0c"), (_HIGH, range(128, 256))):
    _CLASS[list(_bytes)] = _c


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n, sizes = len(offs) - 1, np.diff(offs)
    row = np.repeat(np.arange(n), sizes)
    counts = np.bincount(row * 11 + _CLASS[data], minlength=11 * n).reshape(n, 11).astype(float) if len(data) else np.zeros((n, 11))
    hashes, bounds, begins = word_hashes(data, offs)
    words = np.diff(bounds).astype(float)
    letters = counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH]
    total, some = np.maximum(1, sizes), np.maximum(1, words)
    capital = np.zeros(n)
    if len(begins):
        capital = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), weights=_CLASS[data[begins]] == _UPPER, minlength=n)
    share = np.stack(
        [counts[:, _UPPER] / np.maximum(1, letters), counts[:, _SYMBOL] / total, counts[:, _BANG] / total, counts[:, _DIGIT] / total, counts[:, _STOP] / total, counts[:, _BAR] / total, counts[:, _LINE] / some, repeated_share(hashes, bounds, 1), repeated_share(hashes, bounds, 3), counts[:, _HIGH] / total, capital / some],
        axis=1,
    )
    inside = total - counts[:, _LINE] - counts[:, _SPACE]
    return np.column_stack([np.where(words > 0, inside / some, 0), np.minimum(share, 1)])


def transformed(x: np.ndarray, powers: tuple[float, float]) -> np.ndarray:
    """Rows of STATISTICS as the Gaussians see them."""
    out = x ** powers[0]
    out[:, REPEATS] = x[:, REPEATS] ** powers[1]
    out[:, 0] = np.log1p(x[:, 0])
    return out


def document_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and one column s_* for each of STATISTICS, for every row of ``docs`` (column ``text``)."""

    def compute(arrays: list[pa.Array]) -> list[pa.Array]:
        x = np.zeros((len(arrays[0]), len(STATISTICS)))
        for lo, hi, data, offs in text_chunks(arrays[0]):
            x[lo:hi] = statistics(data, offs)
        return [pa.array(c) for c in x.T]

    return arrow_columns(docs, keep, [F.col("text").cast("string")], ", ".join(f"{c} double" for c in COLUMNS), lambda: compute)


@dataclass
class Moments:
    """Rows, sums and sums of products of one class."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        return Moments(len(z), z.sum(axis=0), z.T @ z)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def mean_and_covariance(self) -> tuple[np.ndarray, np.ndarray]:
        mean = self.sums / self.n
        return mean, self.products / self.n - np.outer(mean, mean)


@dataclass
class Discriminant:
    """Two Gaussians: means, Cholesky factors of the shrunk covariances, log priors less half log determinants."""

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    offset: list[float]
    powers: tuple[float, float] = POWERS[0]
    constant: float | None = None

    @staticmethod
    def from_moments(classes: dict[int, Moments], powers: tuple[float, float], pooled: float, ridge: float) -> Discriminant:
        if len(classes) < 2:
            return Discriminant([], [], [], powers, constant=float(next(iter(classes), 0.5)))
        got = [classes[y].mean_and_covariance() for y in (0, 1)]
        count, k = [classes[y].n for y in (0, 1)], len(got[0][0])
        both = (count[0] * got[0][1] + count[1] * got[1][1]) / sum(count)
        round_ = np.eye(k) * max(np.trace(both) / k, 1e-9)
        model = Discriminant([], [], [], powers)
        for (mean, cov), n in zip(got, count, strict=True):
            own = n / (n + 5 * k)  # few rows lean on the pooled covariance
            shrunk = (1 - pooled) * own * cov + (1 - (1 - pooled) * own) * both
            model.mean.append(mean)
            model.factor.append(np.linalg.cholesky((1 - ridge) * shrunk + ridge * round_))
            model.offset.append(float(np.log(n / sum(count)) - np.log(np.diag(model.factor[-1])).sum()))
        return model

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of rows of STATISTICS."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z, logs = transformed(x, self.powers), []
        for mean, factor, offset in zip(self.mean, self.factor, self.offset, strict=True):
            solved = forward_substitution(factor, (z - mean).T)
            logs.append(offset - 0.5 * (solved * solved).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def forward_substitution(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of ``factor @ z = right`` for a lower triangular factor, all columns at once."""
    z = np.empty_like(right)
    for i in range(len(factor)):
        z[i] = (right[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in COLUMNS]) if batch.num_rows else np.zeros((0, len(COLUMNS)))


def _class_moments(rows: DataFrame) -> dict[tuple[int, int, int], Moments]:
    """(powers, half, label) -> moments, over all rows (half, label, s_*); each task adds up its own first."""
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], Moments] = {}
        for batch in batches:
            x, half, label = _matrix(batch), batch.column("half").to_numpy(), batch.column("label").to_numpy()
            for p, powers in enumerate(POWERS):
                z = transformed(x, powers)
                for h, y in ((h, y) for h in (0, 1) for y in (0, 1)):
                    m = Moments.of(z[(half == h) & (label == y)])
                    held[p, h, y] = held[p, h, y] + m if (p, h, y) in held else m
        keys = list(held)
        values = [np.concatenate([[m.n], m.sums, m.products.ravel()]) for m in held.values()]
        yield pa.RecordBatch.from_arrays([*[pa.array([key[i] for key in keys], pa.int32()) for i in range(3)], pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], names=["p", "h", "y", "v"])

    parts = rows.select("half", "label", *COLUMNS).mapInArrow(run, "p int, h int, y int, v array<double>")
    sums = parts.select("p", "h", "y", F.posexplode("v")).groupBy("p", "h", "y", "pos").agg(F.sum("col").alias("v"))
    every: dict[tuple[int, int, int], np.ndarray] = {}
    for r in sums.collect():  # 24 times 157 numbers
        every.setdefault((r["p"], r["h"], r["y"]), np.zeros(1 + k + k * k))[r["pos"]] = r["v"]
    return {key: Moments(round(v[0]), v[1 : 1 + k], v[1 + k :].reshape(k, k)) for key, v in every.items() if v[0] > 0}


def _errors(rows: DataFrame, models: list[list[Discriminant]]) -> np.ndarray:
    """[powers][label] share of rows that the model of the other half gets wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = np.zeros((len(models), 2, 2), dtype=np.int64)
        for batch in batches:
            x, half, label = _matrix(batch), batch.column("half").to_numpy(), batch.column("label").to_numpy()
            for p, pair in enumerate(models):
                for h in (0, 1):
                    here = half == h
                    bad = (pair[1 - h].scores(x[here]) >= 0.5) != (label[here] == 1)
                    for y in (0, 1):
                        mine = label[here] == y
                        wrong[p, y] += (int(bad[mine].sum()), int(mine.sum()))
        at = [(p, y) for p in range(len(models)) for y in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()), *[pa.array([int(wrong[p, y, i]) for p, y in at], pa.int64()) for i in (0, 1)]], names=["p", "y", "bad", "n"])

    out = np.zeros((len(models), 2))
    counts = rows.select("half", "label", *COLUMNS).mapInArrow(run, "p int, y int, bad long, n long").groupBy("p", "y").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    for r in counts.collect():  # two rows for each of POWERS
        out[r["p"], r["y"]] = r["bad"] / max(1, r["n"])
    return out


def fit(rows: DataFrame, label: str = "label", pooled: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """The discriminant of rows with columns s_* and a label 0 or 1.

    ``pooled`` is the share of the pooled covariance, ``ridge`` that of the identity times the mean pooled variance. The
    powers are those with the least mean of both classes' shares of errors in cross-validation.
    """
    half = F.pmod(F.xxhash64(*COLUMNS), F.lit(2)).cast("int")
    known = rows.where(F.col(label).isin(0, 1)).select(half.alias("half"), F.col(label).cast("int").alias("label"), *COLUMNS)
    known = write_table(known, "known_statistics")
    got = _class_moments(known)
    whole = lambda p: {y: m for y in (0, 1) for m in [_added([got[p, h, y] for h in (0, 1) if (p, h, y) in got])] if m}
    if len(got) < 4 * len(POWERS):  # a class is missing, or in one half only: nothing to compare
        return Discriminant.from_moments(whole(0), POWERS[0], pooled, ridge)
    models = [[Discriminant.from_moments({y: got[p, h, y] for y in (0, 1)}, powers, pooled, ridge) for h in (0, 1)] for p, powers in enumerate(POWERS)]
    best = int(_errors(known, models).mean(axis=1).argmin())
    return Discriminant.from_moments(whole(best), POWERS[best], pooled, ridge)


def _added(moments: list[Moments]) -> Moments | None:
    return moments[0] + moments[1] if len(moments) == 2 else moments[0] if moments else None


def score_documents(docs: DataFrame, model: Discriminant, keep: list[Column]) -> DataFrame:
    """``keep`` and score for every row of ``docs`` (column ``text``), statistics and score in one pass of one worker."""

    def compute(arrays: list[pa.Array]) -> list[pa.Array]:
        z = np.zeros(len(arrays[0]))
        for lo, hi, data, offs in text_chunks(arrays[0]):
            z[lo:hi] = model.scores(statistics(data, offs))
        return [pa.array(z)]

    return arrow_columns(docs, keep, [F.col("text").cast("string")], "score double", lambda: compute)


def score(rows: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """``keep`` and score for every row that has columns s_*."""
    compute: Callable[[list[pa.Array]], list[pa.Array]] = lambda arrays: [pa.array(model.scores(np.column_stack([a.to_numpy() for a in arrays])) if len(arrays[0]) else [], pa.float64())]
    return arrow_columns(rows, [F.col(f"`{c}`") for c in keep], [F.col(c) for c in COLUMNS], "score double", lambda: compute)
