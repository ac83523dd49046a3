"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

The size of a document is its number of words (longest runs of other characters than space, tab, line and page breaks). Sources in
order of code points, null last, take ``weights`` in turn and share ``percent`` of all sizes. No target passes ``repeats`` times
its source's size; what is above goes to the others by weight until none is above.

1. One scan gives (source, size, key) of each document. The key is 60 bits of the MD5 of id and text, so it depends on no
   order or partitioning. The rows are written once; the texts are not read again.
2. Sizes are summed by source and bucket of the first 12 bits of the key, combined before the shuffle, so a source that holds
   a third of all rows is at most 4096 sums a task. The histogram gives the sizes of the sources and so the targets.
3. A target is some whole passes over its source and a rest. Running sums over a source's buckets give the bucket in which the rest
   is used up. Only rows of that bucket are summed again, by the next 12 bits, until one document is left.
4. A document with a key below its source's threshold is taken once more, the one at the threshold in part: its first words, so many
   that the source meets its target to the word. Nothing is sorted. With a larger budget the threshold only
   rises: smaller mixes are contained in larger ones.

Documents equal in id and text share a key; they are told apart by their row in the written table and taken one after
another like any others, so that it does not matter which of them is which. Null text: size 0. Null id: an id like
any other. A source without words gets the target 0. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_lookup
from .quality_rules import BLANKS, SPACE
from .shared import arrow_batches, partitions, stored

WEIGHTS = (5, 2, 1)
PERCENT = 150
REPEATS = 2
#: Bits of the key that a histogram looks at, and how often a 60-bit key holds them.
BITS, LEVELS = 12, 5


def n_words(text: Column) -> Column:
    """Words of a text that is not null; only the ends could give empty ones, so they are trimmed."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, SPACE))).cast("long")


def key_of(ids: Column, text: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(ids.cast("string"), F.lit("")), F.lit(":"), text))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A string that no two sources share, null included."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def digit(level: int) -> Column:
    """Bits of ``key``, then of ``row_key``, that the level looks at."""
    name, at = ("key", level) if level < LEVELS else ("row_key", level - LEVELS)
    return F.shiftright(name, BITS * (LEVELS - 1 - at)).bitwiseAND((1 << BITS) - 1).cast("int")


def sized(docs: DataFrame, text: str, source: str, ids: str, seed: str) -> DataFrame:
    """doc_id, src, size, key, row_key: every row once, written, so that row_key stays what it is."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(ids).cast("long").alias("doc_id"), source_key(F.col(source).cast("string")).alias("src"),
                       whole.alias("text"), F.monotonically_increasing_id().alias("row"))
    return stored(rows.select(
        "doc_id", "src", n_words(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text"), seed).alias("key"),
        F.shiftrightunsigned(F.xxhash64("row"), 4).alias("row_key")))


def histogram(rows: DataFrame, level: int) -> DataFrame:
    """Sums of a bucket; with one row, ``key`` and ``row_key`` are that row's."""
    return rows.groupBy("src", digit(level).alias("bucket")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.max("key").alias("high"),
        F.min("row_key").alias("row_key"))


def weighed(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``sources`` with the weight of each one's rank. Ranks are counted in ranges of names; only one number a range meets the others."""
    n = partitions(sources.sparkSession)
    ranged = stored(sources.repartitionByRange(n, (F.col("src") == "").cast("int"), "src").withColumn("range", F.spark_partition_id()))
    # ranges follow the order of names, so the rows of all ranges before come first; there are at most n of them
    before = (ranged.groupBy("range").agg(F.count(F.lit(1)).alias("here"))
              .withColumn("before", F.sum("here").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
              .select("range", F.coalesce("before", F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("range").orderBy((F.col("src") == "").cast("int"), "src"))
    rank = F.col("before") + within - 1
    return (join_lookup(ranged, before, ["range"])
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))).drop("range", "before"))


def level_of(sources: DataFrame, percent: int, repeats: int) -> float:
    """Words a unit of weight gets. Each pass sets the sources above their bound to it and shares the rest among the others."""
    level = 0.0
    while True:
        above = F.col("weight") * level >= F.col("source_size") * repeats
        total, bound, open_ = sources.agg(
            F.sum("source_size"), F.sum(F.when(above, F.col("source_size") * repeats)), F.sum(F.when(~above, F.col("weight")))).first()
        if not total or not open_:
            return level
        higher = (total * percent / 100 - (bound or 0)) / open_
        if higher <= level:
            return level
        level = higher


def targets(sizes: DataFrame, weights: Sequence[float], percent: int, repeats: int) -> DataFrame:
    """src, source_size, target, passes (whole ones over the source) and rest (words of one more)."""
    if min(weights) <= 0 or percent > 100 * repeats:
        raise ValueError("weights must be positive, and the mix may not pass the sources' bounds")
    ranked = stored(weighed(sizes, weights))
    level = level_of(ranked, percent, repeats)
    target = F.least(F.col("source_size") * float(repeats), F.col("weight") * F.lit(level))
    words = F.floor(F.col("target") + 0.5).cast("long")
    return stored(ranked.withColumn("target", target).withColumn("words", words).select(
        "src", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
        F.when(F.col("source_size") > 0, F.col("words") % F.col("source_size")).otherwise(0).cast("long").alias("rest")))


def boundaries(sums: DataFrame, rests: DataFrame) -> DataFrame:
    """The bucket of each source in which its rest is used up, and what is left of the rest there."""
    before = F.sum("size").over(Window.partitionBy("src").orderBy("bucket")) - F.col("size")  # at most 4096 buckets a source
    return (join_lookup(sums, rests, ["src"], "inner").withColumn("left", F.col("rest") - before)
            .where((F.col("left") > 0) & (F.col("left") <= F.col("size"))).drop("rest"))


def thresholds(rows: DataFrame, sums: DataFrame, rests: DataFrame) -> DataFrame:
    """src, at, row_at, left: the document of each source at which its rest ends, and the words taken of it."""
    found, level = None, 0
    while True:
        edge = stored(boundaries(sums, rests))
        done = edge.where("n = 1").select("src", F.col("key").alias("at"), F.col("row_key").alias("row_at"), "left")
        found = done if found is None else found.unionByName(done)
        open_ = edge.where("n > 1")
        if level + 1 == 2 * LEVELS:  # rows whose 120 bits are all alike: the first of them by size
            return found.unionByName(open_.select("src", F.col("key").alias("at"), F.col("row_key").alias("row_at"), "left"))
        many, several = open_.agg(F.count(F.lit(1)), F.count(F.when(F.col("key") < F.col("high"), 1))).first()
        if not many:
            return found
        rows = stored(join_lookup(rows.withColumn("bucket", digit(level)), stored(open_.select("src", "bucket")), ["src", "bucket"], "inner")
                      .select("doc_id", "src", "size", "key", "row_key"))
        rests = stored(open_.select("src", F.col("left").alias("rest")))
        level = level + 1 if several else max(level + 1, LEVELS)  # where only copies are left, their key tells nothing
        sums = stored(histogram(rows, level))


def mix(docs: DataFrame, text: str = "text", source: str = "source", ids: str = "doc_id", weights: Sequence[float] = WEIGHTS,
        percent: int = PERCENT, repeats: int = REPEATS, seed: str = "") -> DataFrame:
    """One row per row: doc_id, size, source_size, target, taken; further source, the name itself."""
    arrow_batches(docs.sparkSession)
    rows = sized(docs, text, source, ids, seed)
    sums = stored(histogram(rows, 0))
    asked = targets(sums.groupBy("src").agg(F.sum("size").alias("source_size")), weights, percent, repeats)
    edge = thresholds(rows, sums, stored(asked.where("rest > 0").select("src", "rest")))
    plan = stored(join_lookup(asked, stored(edge), ["src"]))
    order, at = F.struct("key", "row_key"), F.struct("at", "row_at")
    more = F.when(F.col("at").isNull() | (order > at), 0).when(order < at, F.col("size")).otherwise(F.least("left", "size"))
    return join_lookup(rows, plan, ["src"]).select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + more).cast("long").alias("taken"),
        F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"))
