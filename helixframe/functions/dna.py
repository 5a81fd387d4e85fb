"""Column functions on nucleotide strings; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRANDS = {"forward": ("+",), "reverse": ("-",), "reverse-complement": ("-",), "both": ("+", "-")}


def normalize_bases(seq: Column) -> Column:
    """ACGT in upper case; every other character becomes N, a hard break for all searches."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """Of a normalised sequence; N stays N."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def is_palindrome(seq: Column) -> Column:
    return seq == reverse_complement(seq)


def pattern_valid(seq: Column) -> Column:
    """Whether an exact-search pattern has bases only, and one at least."""
    return F.coalesce(seq.rlike("^[ACGTacgt]+$"), F.lit(False))


def kmer_key(word: Column) -> Column:
    """Two bits a base, first base highest; words of 31 bases at most, without N."""
    return F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("long")


def symbol_digits(seq: Column) -> Column:
    """Bases as the digits of the logical text: 0 end < 1 separator < 2 A < 3 C < 4 G < 5 T < 6 N."""
    return F.translate(seq, "ACGTN", "23456")


def ambiguous_bases(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))).cast("long")
