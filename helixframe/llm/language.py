"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built; it accepts exactly
the substrings of that sample. A text is parsed against it greedily: a phrase is the longest match from
where the last one ended. The fewer phrases a text needs, the better the sample explains it. Phrase counts
are normalised to bits a byte, ``phrases * log2(sample bytes) / text bytes``, and the language with the
lowest figure wins.

Texts are lower-cased, runs of ASCII other than letters become one space, and the UTF-8 bytes are parsed in lanes of ``lane_bytes`` (a phrase ends where a lane ends), so
that one very long text is parsed as many lanes side by side; no byte is left out. All lanes and languages
of a chunk take a step together in numpy.

The sample: ``docs_per_lang`` documents of different texts of each language, those with the lowest hash among documents of a
usual length first (300 to 6000 characters; texts of other lengths come only where those do not suffice), and at most ``bytes_per_lang`` bytes of their text. These are the only bounds, and
they concern training alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled text at all
every text is ``und``; ties go to the name that sorts first; repeated rows each get their row; other
columns are not read, and kept ones may have any names but those of the results; an empty table gives an empty table. The score is ``1 - best / (best + second)``, 1 if there is one language only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_columns, text_chunks

UNDETERMINED = "und"


def suffix_automaton(data: bytes) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the suffix automaton of ``data``; state 0 is the start."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for c in data:
        here = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = here
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[here] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return moves, link, longest


_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def letters_only(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts with each run of ASCII other than a-z as one space, and the offsets of the texts."""
    if not len(data):
        return data, offs
    gap = ~_LETTER[data]
    stay = np.ones(len(data), dtype=bool)
    stay[1:] = ~(gap[1:] & gap[:-1])
    stay[offs[:-1][np.diff(offs) > 0]] = True
    kept = np.concatenate(([0], np.cumsum(stay)))
    return np.where(gap, 32, data)[stay].astype(np.uint8), kept[offs]


def _letters(text: bytes) -> bytes:
    return letters_only(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[0].tobytes()


class CrossParser:
    """Greedy longest-match parsing of many texts against one automaton for each language; all through letters_only."""

    def __init__(self, samples: dict[str, bytes], lane_bytes: int = 2048):
        self.names, self.lane_bytes = sorted(samples), lane_bytes
        samples = {g: _letters(t) for g, t in samples.items()}
        self.bits = np.array([math.log2(max(2, len(samples[n]))) for n in self.names])
        seen = sorted({c for s in samples.values() for c in s})
        width = len(seen) + 1  # the last class is for bytes that no sample has
        self.classes = np.full(256, width - 1, dtype=np.int64)
        self.classes[seen] = np.arange(len(seen))
        tables, base, self.roots = [], 0, []
        for name in self.names:
            moves = suffix_automaton(samples[name])[0]
            start = np.full(width, -1, dtype=np.int64)
            for c, q in moves[0].items():
                start[self.classes[c]] = q
            # no way on: the phrase ends, and the byte begins the next one; a byte unknown to the sample is a phrase of
            # its own, after which the parse is at the start again. The low two bits count the phrases that end.
            fresh = np.where(start >= 0, ((start + base) * width) << 2 | 1, (base * width) << 2 | 2)
            t = np.tile(fresh, (len(moves), 1))
            t[0] = np.where(start >= 0, t[0], (base * width) << 2 | 1)
            at = np.array([(s, self.classes[c], q) for s, m in enumerate(moves) for c, q in m.items()], dtype=np.int64).reshape(-1, 3)
            t[at[:, 0], at[:, 1]] = ((at[:, 2] + base) * width) << 2
            tables.append(t)
            self.roots.append(base * width)
            base += len(moves)
        every = np.concatenate(tables) if tables else np.zeros((1, width))
        self.table = every.astype(np.int32 if base * width * 4 < 2**31 else np.int64).ravel()

    def bits_per_byte(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Normalised phrase counts of each text (row) for each language (column)."""
        data, offs = letters_only(data, offs)
        return self.phrases(data, offs) * self.bits / np.maximum(1, np.diff(offs))[:, None]

    def phrases(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) for each language (column); an empty text has none."""
        sizes, step = np.diff(offs), self.lane_bytes
        lanes = -(-sizes // step)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = offs[text] + nth * step
        size = np.minimum(step, offs[text + 1] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, text = begin[order], size[order], text[order]
        classes = self.classes[data]
        state = np.repeat(np.array(self.roots, dtype=self.table.dtype)[:, None], len(text), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        live = np.searchsorted(-size, -np.arange(step), "left")  # lanes longer than t
        for t in range(int(size[0]) if len(size) else 0):
            n = live[t]
            move = self.table[state[:, :n] + classes[begin[:n] + t]]
            count[:, :n] += move & 3
            state[:, :n] = move >> 2
        out = np.zeros((len(sizes), len(self.names)))
        for k in range(len(self.names)):
            cut = state[k] != self.roots[k]  # a phrase that the lane's end cuts
            out[:, k] = np.bincount(text, weights=count[k] + cut, minlength=len(sizes))
        return out


_OPEN: dict[str, CrossParser] = {}


def language_sample(docs: DataFrame, docs_per_lang: int = 64, bytes_per_lang: int = 32_000, usual: tuple[int, int] = (300, 6000)) -> dict[str, bytes]:
    """At most ``bytes_per_lang`` bytes of labelled text for each language, from the lowest hashes of texts."""
    rows = docs.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("lang", F.lower("text").alias("text"))
    rank = rows.select("lang", F.when(F.length("text").between(*usual), 0).otherwise(1).alias("odd"), F.xxhash64("text").alias("h"))
    rank = rank.groupBy("lang", "h").agg(F.min("odd").alias("odd"))  # exact copies take one place
    lowest = lambda d, *by: d.withColumn("r", F.row_number().over(Window.partitionBy("lang", *by).orderBy("odd", "h"))).where(F.col("r") <= docs_per_lang)
    part = lowest(rank.withColumn("part", F.pmod("h", F.lit(32))), "part")  # the lowest of each part first: no task has a language's texts
    keys = lowest(part).select("lang", "h", "r")
    share = max(1, bytes_per_lang // docs_per_lang)
    texts = (
        rows.withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(keys), ["lang", "h"])  # docs_per_lang rows a language
        .groupBy("lang", "h")
        .agg(F.min("r").alias("r"), F.min(F.substring("text", 1, bytes_per_lang)).alias("text"))
    )
    out: dict[str, list[bytes]] = {}
    for row in sorted(texts.collect(), key=lambda x: (x["lang"], x["r"])):
        out.setdefault(row["lang"], []).append(row["text"].encode())
    # an equal share of each document first, then what is left of the longer ones
    return {g: (b"\n".join([t[:share] for t in ts] + [t[share:] for t in ts]))[:bytes_per_lang] for g, ts in out.items()}


def predict_language(docs: DataFrame, samples: dict[str, bytes], keep: list[Column], lane_bytes: int = 2048) -> DataFrame:
    """``keep``, lang_pred, score and bits_per_byte for every row of ``docs`` (column ``text``)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((samples, lane_bytes))  # bytes_per_lang a language
    token = uuid.uuid4().hex

    def compute() -> Callable[[list[pa.Array]], list[pa.Array]]:
        if token not in _OPEN:  # built once in each worker process
            _OPEN.clear()
            _OPEN[token] = CrossParser(*held.value)
        parser = _OPEN[token]

        def verdicts(arrays: list[pa.Array]) -> list[pa.Array]:
            bits = np.full((len(arrays[0]), len(parser.names)), np.inf)
            for lo, hi, data, offs in text_chunks(arrays[0]):
                bits[lo:hi] = parser.bits_per_byte(data, offs)
            return _verdicts(parser.names, bits, arrays[1].to_numpy(zero_copy_only=False))

        return verdicts

    text = F.col("text").cast("string")
    read = [F.lower(text), F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))]
    return arrow_columns(docs, keep, read, "lang_pred string, score double, bits_per_byte double", compute)


def _verdicts(names: list[str], bits: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
    n = len(letters)
    if not names:
        return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n)), pa.array([None] * n, pa.float64())]
    best = bits.argmin(axis=1)
    low = bits[np.arange(n), best]
    if len(names) > 1:
        second = np.partition(bits, 1, axis=1)[:, 1]
        score = 1 - low / np.maximum(low + second, 1e-300)
    else:
        score = np.ones(n)
    pred = [names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return [pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(low, mask=~letters.astype(bool))]
