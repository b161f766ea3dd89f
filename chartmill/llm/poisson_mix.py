"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every source has a mean repetition rate: its target share of the mix, times the
size of the mix, over its own size. A document is repeated a Poisson number of times with
that mean. The number is not drawn but looked up: a hash of seed and id gives a uniform
number, and the inverse of the source's distribution gives the count. So
the mix is the same in every run, for every partitioning, and each document
decides alone. Copies then move to a place that their own hash gives.

Rates are computed per source from sums that every task reduces first; a
source with a third of all rows costs no more than another. The table of
rates has one row per source and is broadcast only if a count proves it small. Copies
are made before the one shuffle of the texts, which spreads by a hash of the copy and so evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import col, fresh, sized_broadcast, text_of, without, written

SEED = "mix-1"
#: Target weights are the sources' sizes to this power, if none are given: large sources give way to small ones.
TEMPERATURE = 0.5
#: A higher rate is split into equal parts, each looked up with a hash of its own: terms would underflow
#: beyond 700, and the sum of independent Poisson numbers is one with the sum of their means.
PART_RATE = 500.0
ADDED = ("n_copies", "copy", "shuffle_key")
#: Counts up to here are looked up: rate + 12 standard deviations + 25 leaves out less than 2^-52.
_TAIL_DEVIATIONS, _TAIL_EXTRA = 12.0, 25


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of a digest of the parts, joined by colons."""
    digest = F.md5(F.encode(F.concat_ws(":", *parts), "UTF-8"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def poisson_steps(rate: Column) -> Column:
    """The cumulative probabilities of 0, 1, 2, ... under a mean, up to where nothing is left."""
    last = F.ceil(rate + _TAIL_DEVIATIONS * F.sqrt(rate) + _TAIL_EXTRA).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("steps"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["steps"], F.array(F.element_at(state["steps"], -1) + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add)["steps"]


def source_rates(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    size: float = 1.0,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """(source, rate) for every source, NULL being one. Sizes are numbers of characters; an empty text counts 1.

    ``weights`` are target shares in any unit; a source without one has weight 0.
    Without them, a source's weight is its size to the power ``temperature``. ``size`` is
    the mix's size in multiples of the input.
    """
    sizes = docs.groupBy(col(source_col).cast("string").alias("source")).agg(
        F.sum(F.greatest(F.length(text_of(text_col)), F.lit(1)).cast("long")).alias("chars")
    )
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weighted = sizes.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0))
    # weights as whole billionths: their sum is then the same in any order
    whole = weighted.withColumn("weight", F.round(F.col("weight") * 1e9 if weights is not None else F.col("weight") * 1e3).cast("decimal(38,0)"))
    whole = written(whole, "sizes")
    totals = whole.agg(F.sum("chars").cast("double"), F.sum("weight").cast("double")).first()
    if not totals[1]:
        return whole.select("source", F.lit(0.0).alias("rate"))
    return whole.select(
        "source",
        (F.col("weight").cast("double") / F.lit(totals[1]) * F.lit(float(size) * totals[0]) / F.col("chars").cast("double")).alias("rate"),
    )



def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    size: float = 1.0,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
) -> DataFrame:
    """The mix: all columns of ``docs`` for each copy, and n_copies, copy (from 1), shuffle_key.

    Rows are dealt out by a hash of their shuffle_key and sorted by it within each
    partition: a global shuffle that is the same for every run. Columns of ``docs`` named like the added
    ones give way to them. A NULL source is a source; a row with a NULL id is
    known by a digest of its text instead; repeated rows are mixed like any other row, but alike; a NULL text counts
    as one character. An empty table gives no rows.
    """
    rates = written(source_rates(docs, source_col, text_col, weights, size, temperature), "rates")
    kept = without(docs, *ADDED)
    u, origin, cumulated, parts = (fresh(name, kept) for name in ("_u", "_origin", "_cumulated", "_parts"))
    pieces = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    steps = rates.select(F.col("source").alias(origin), "rate", pieces.alias(parts)).select(
        origin, parts, poisson_steps(F.col("rate") / F.col(parts)).alias(cumulated)
    )
    name = F.coalesce(col(id_col).cast("string"), F.md5(F.encode(text_of(text_col), "UTF-8")))
    placed = kept.withColumn(u, uniform(F.lit(seed), name))

    def count(at: Column) -> Column:
        return F.size(F.filter(cumulated, lambda step: step <= at))

    more = F.aggregate(
        F.sequence(F.lit(1), F.col(parts) - 1),
        count(F.col(u)),
        lambda total, part: total + count(uniform(F.lit(seed), name, part.cast("string"))),
    )
    drawn = placed.join(
        sized_broadcast(written(steps, "steps")), col(source_col).cast("string").eqNullSafe(F.col(origin))
    ).withColumn("n_copies", F.when(F.col(parts) == 1, count(F.col(u))).otherwise(more))
    copies = drawn.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.encode(F.concat_ws(":", F.lit(seed), name, F.col("copy")), "UTF-8")))
    return keyed.drop(origin, cumulated, parts, u).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
