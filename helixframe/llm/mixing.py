"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source of size s and weight w is to make up w of ``total``: its mean repetition rate is ``w * total / s``. Each
document draws a uniform value from a hash of the seed and its id and inverts the Poisson distribution of its source's
rate: its copies are the number of values of the distribution function that lie below the draw. High rates are cut
into parts of at most ``part`` with a draw each (sums of Poisson counts are Poisson), so no term underflows.
Documents are exploded by their counts; every copy gets a hash as its place, is dealt to a partition by
it and sorted by it there.

Defined cases: null source is a source of its own; a source without a weight, or with a null one, gets the weight
``default_weight`` (0: it goes); the weights of a source that ``weights`` names several times are added up; a negative,
infinite or NaN weight is refused, as are weights of which none is positive for a source that the input holds (ValueError);
rates that name a source several times are added up, and a null rate is 0; null text has size 0; a source of size 0 with a
weight has rate 1; a null id draws as the empty text;
repeated rows draw alike and give each its copies; an empty table gives an empty table; the columns ``copy`` and
``shuffle_key`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, write_table


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of md5 over the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _unfit(weight: Column) -> Column:
    return (weight < 0) | F.isnan(weight) | (weight == float("inf"))


def _unfit_number(weight: float) -> bool:
    return not 0 <= weight < float("inf")


def source_rates(docs: DataFrame, weights: DataFrame | None, total: float | None = None, default_weight: float = 0.0, size: Column | None = None) -> DataFrame:
    """(source, rate) from the sizes of all documents (characters unless ``size`` says otherwise).

    ``weights`` has (source, weight); None weighs all sources alike. Weights are normalised to 1. ``total`` is the size
    of the mixture, by default that of the input.
    """
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))) if size is None else size
    sizes = write_table(docs.groupBy("source").agg(F.sum(size.cast("double")).alias("size")), "source_sizes")
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        w = w.groupBy("_s").agg(F.sum("weight").alias("weight"), F.count_if(_unfit(F.col("weight"))).alias("unfit"))
        weighed = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(default_weight, ["weight"])
        seen = w.agg(F.sum("unfit").alias("unfit")).first()["unfit"]
        if seen:
            raise ValueError(f"{seen} of the weights are negative, infinite or NaN")
    if _unfit_number(default_weight):
        raise ValueError(f"default weight {default_weight}: negative, infinite or NaN")
    state = weighed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") > 0).alias("some")).first()
    if state["n"] and not state["some"]:
        raise ValueError("no source of the input has a weight above 0")
    whole = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))  # one row
    target = F.col("all_size") if total is None else F.lit(float(total))
    rate = F.when(F.col("weight") <= 0, 0.0).when(F.col("size") <= 0, 1.0).otherwise(F.col("weight") / F.col("all_weight") * target / F.col("size"))
    return weighed.crossJoin(F.broadcast(whole)).select("source", rate.alias("rate"))


def _distribution(rate: Column) -> Column:
    """The Poisson distribution function from 0 to where its tail is below the draws' resolution."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda acc, i: F.struct((acc["p"] * rate / i).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / i)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])


def mix(docs: DataFrame, rates: DataFrame, seed: int = 17, part: float = 32.0) -> DataFrame:
    """Copies of ``docs`` by the rates (source, rate), with ``copy`` from 0 and ``shuffle_key``, in shuffled order."""
    columns = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rates = rates.groupBy("source").agg(F.coalesce(F.sum("rate"), F.lit(0.0)).alias("rate"))
    plan = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / part)).cast("int"))
    plan = plan.withColumn("cdf", _distribution(F.col("rate") / F.col("parts"))).select(F.coalesce(F.hex("source"), F.lit("null")).alias("src"), "parts", "cdf")
    # the row travels as one struct, so that its columns clash with none of ours
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), F.coalesce(F.hex("source"), F.lit("null")).alias("src"))
    drawn = lookup_join(packed, write_table(plan, "rates"), "src")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: uniform(seed, F.col("row.doc_id"), i))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    copies = drawn.withColumn("n", count).where("n > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    place = F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    keyed = copies.select("row.*", F.col("copy").cast("long").alias("copy"), F.md5(place.cast("binary")).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
