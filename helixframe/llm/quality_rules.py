"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule says when a text goes. ``order_rules`` estimates each rule's cost and selectivity on a sample: rows whose hash over
all their columns falls into one of as many classes as give about ``sample_rows`` rows of the whole table. The cost
is counted, not timed, so that the order is the same in every run: the steps that the rule's expression takes on the
sampled texts (characters scanned, words matched, windows hashed and sorted, each at the weight stated with the rule). Rules are put
in order of rejections per step, and one CASE applies them, so that it leaves off at the first that rejects. The order
changes the work only: a text is kept if no rule rejects it. Only one row of sums reaches the driver.

``apply_rules`` gives all measures of each text beside the verdict. There the rules over measures cost a comparison, and
those that look at the text again cost their scan. ``reject_rules`` gives the verdict alone: no measure is made before
the rule that needs it, so a text that a cheap rule rejects never has its windows hashed.

Defined cases: a null text has no words; an empty table gives an empty table (rules in their given order); repeated rows
each get their row; columns of the input are carried as given, whatever their names; ties in worth stay in the given order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_RUN, UPPER, fenced, let

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")


def _window_hashes(words: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words that lie in 3-word windows whose hash stands twice or more: windows by hash, equal ones side by side."""
    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def count(s: Column) -> Column:
        beside = lambda e, k, by: F.coalesce(F.get(s, k + by)["x"] == e["x"], F.lit(False))
        twice = F.filter(s, lambda e, k: beside(e, k, -1) | beside(e, k, 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    recurs = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(recurs, let(pairs, count)).otherwise(0)


@dataclass(frozen=True)
class Rule:
    """When a text goes, from its ``text`` and ``words`` alone; the same over the measures, if they tell; and its work.

    ``work`` is an SQL expression over text and words: steps at the weight of one character scanned.
    """

    alone: Callable[[Column, Column], Column]
    work: str
    given: str | None = None


def few_words(least: int) -> Rule:
    return Rule(lambda text, words: F.size(words) < least, "1", f"n_words < {least}")


#: Weights: a character scanned 1, a word matched 20, a window hashed, compared and, if one recurs, sorted 40.
REPEATED_WINDOWS = Rule(lambda text, words: let(_window_hashes(words), lambda h: 100 * _covered(h) > 50 * F.size(words)), "40 * size(words)", "100 * n_repeat_words > 50 * n_words")

RULES: dict[str, Rule] = {
    "symbols": Rule(lambda text, words: 10 * (F.length(text) - _without(text, SYMBOLS)) > F.size(words), "length(text)", "10 * n_symbols > n_words"),
    "repeated_lines": Rule(lambda text, words: let(_lines(text), lambda ls: 2 * (F.size(ls) - F.size(F.array_distinct(ls))) > F.size(ls)), "3 * length(text)", "2 * n_dup_lines > n_lines"),
    "word_length": Rule(lambda text, words: let(_without(text, BLANKS), lambda n: (n > 15 * F.size(words)) | (n < 2 * F.size(words))), "length(text)", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
    "exclamation": Rule(lambda text, words: 5 * (F.length(text) - _without(text, "!")) > F.size(words), "length(text)"),
    "capitals": Rule(lambda text, words: _without(text, LOWER) > _without(text, UPPER), "2 * length(text)"),  # more A-Z than a-z
    "no_letters": Rule(lambda text, words: 10 * F.size(F.filter(words, lambda w: ~F.rlike(w, F.lit(r"\p{L}")))) > 3 * F.size(words), "20 * size(words)"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _split(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text and words."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumn("words", _words(F.col("text")))


def base_measures(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text, words and MEASURES."""
    text, words = F.col("text"), F.col("words")
    d = _split(docs).withColumn("lines", _lines(text)).withColumn("hashed", _window_hashes(words))
    return d.select(
        "row",
        "text",
        "words",
        F.size(words).cast("long").alias("n_words"),
        _without(text, BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _covered(F.col("hashed")).cast("long").alias("n_repeat_words"),
    )


def _alone(rule: Rule) -> Column:
    return F.coalesce(rule.alone(F.col("text"), F.col("words")), F.lit(False))


def order_rules(docs: DataFrame, rules: dict[str, Rule], measured: bool, sample_rows: int = 1000) -> list[str]:
    """Names of the rules, the one with the most rejections per step first; ``measured``: measures are at hand."""
    rows = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(max(1, rows // sample_rows))) == 0)
    # the fence keeps each condition a column of its own row
    tried = fenced(_split(chosen), [], [e for name, r in rules.items() for e in (_alone(r).alias(f"{name}_gone"), F.expr("1" if measured and r.given else r.work).cast("long").alias(f"{name}_work"))])
    sums = tried.agg(*[F.sum(F.col(f"{n}_gone").cast("long")).alias(f"{n}_gone") for n in rules], *[F.sum(f"{n}_work").alias(f"{n}_work") for n in rules]).first()
    worth = {n: (sums[f"{n}_gone"] or 0) / max(1, sums[f"{n}_work"] or 0) for n in rules}
    return sorted(rules, key=lambda n: -worth[n])


def _cascade(conditions: list[Column]) -> Column:
    """Whether any condition holds, looked at one after another."""
    if not conditions:
        return F.lit(False)
    out = F.when(conditions[0], True)
    for c in conditions[1:]:
        out = out.when(c, True)
    return out.otherwise(False)


def apply_rules(docs: DataFrame, rules: dict[str, Rule] | None = None, least_words: int = 50, sample_rows: int = 1000) -> DataFrame:
    """row, MEASURES, base_failed (few words, or repeated windows) and kept for every row of ``docs``."""
    rules = RULES if rules is None else rules
    order = order_rules(docs, rules, True, sample_rows) if rules else []
    cascade = _cascade([F.expr(rules[n].given) if rules[n].given else _alone(rules[n]) for n in order])
    failed = F.expr(f"{few_words(least_words).given} OR {REPEATED_WINDOWS.given}")
    verdict = F.when(F.col("base_failed"), False).otherwise(~cascade).alias("kept")
    return fenced(base_measures(docs).withColumn("base_failed", failed), ["row"], [*[F.col(m) for m in MEASURES], F.col("base_failed"), verdict])


def reject_rules(docs: DataFrame, rules: dict[str, Rule] | None = None, least_words: int = 1, sample_rows: int = 1000) -> DataFrame:
    """``docs`` without the rows that a rule rejects; few words and repeated windows are rules of the cascade like the others."""
    rules = {"few_words": few_words(least_words), **(RULES if rules is None else rules), "repeated_windows": REPEATED_WINDOWS}
    order = order_rules(docs, rules, False, sample_rows)
    kept = fenced(_split(docs), ["row"], [(~_cascade([_alone(rules[n]) for n in order])).alias("kept")])
    return kept.where("kept").select("row.*")
