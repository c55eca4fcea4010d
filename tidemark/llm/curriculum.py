"""Mixing sources to target weights over a time-varying curriculum.

Every source has a weight schedule over the run, time 0 to 1: straight lines between
knots. The integral of the schedule is its weight in the mix, and integrated up to a time it
says how much of the source's words the run has asked for by then. A source delivers
its documents in a fixed pseudo-random order, several times over if its target is
above its size, so each document begins at a known number of words of its source;
inverting the cumulative demand there gives its training position. Documents sorted by
position are the curriculum.

Targets share out all words by weight; a source gives at most `most` times its words, and
what it can't give is shared by weight among the rest, until no source is above. The
last document that a source delivers is taken in part, so that its words meet the target to
the word.

Only DataFrame functions. A source may hold a third of all rows: its documents are
dealt into buckets by the first digits of their order key, summed per bucket, and numbered
within a bucket by a window, from where the buckets before it end. A source has
between one and 16 times the root of the number of rows in buckets, so that neither its
buckets nor the rows of one are many for a task. One task holds a row per source.

Cases: a null text has no words; a document without words is taken zero words, and has
the position at which it would come. A null source is a source of its own, the last
one. Rows without an id, and rows that share an id, count each by itself; among such rows
those of equal source and size are interchangeable and travel as one row with a
count. Rows not taken have no position. If there are no words at all every target is 0.
An empty table gives no rows. Other columns are not read, whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that name a bucket, at most.
MOST_DIGITS = 8
#: Equal rows are unfolded in runs of this many.
RUN = 1 << 16


def size_of(text: Column) -> Column:
    """Number of words (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weight: Column, most: float) -> DataFrame:
    """Adds `rank`, `weight` and `target` to (source, source_size); `weight` may use `rank`, the place among the sources.

    Words left over and weight left over are kept as whole numbers as long as weights are, so that
    a target is one division and does not depend on the order of sums.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    limit = (F.col("source_size") * most).alias("limit")
    weighed = ranked.withColumn("weight", weight).select("*", limit)
    # In this order the sources that meet their limit come first.
    order = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    shared = weighed.withColumns(
        {
            "left_words": F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(onward),
        }
    )
    open_ = F.col("limit") * F.col("left_weight") > F.col("weight") * F.col("left_words")
    # What the first source below its limit finds left over, and all after it share.
    first = F.min_by(F.when(open_, F.struct("left_words", "left_weight")), F.when(open_, F.struct(F.col("limit") / F.col("weight"), "rank")))
    rest = shared.withColumns({"open": open_, "rest": first.over(W.partitionBy())})
    share = (F.col("rest.left_words") * F.col("weight")).cast("double") / F.col("rest.left_weight").cast("double")
    target = F.when(F.col("open"), share).otherwise(F.col("limit").cast("double"))
    return rest.select(*sizes.columns, "rank", "weight", target.alias("target"))


def ramp(weight: Column, slope: Column) -> Column:
    """A schedule of two knots whose integral is `weight`: from (1 - slope) to (1 + slope) times of it."""
    knots = ((0.0, -1.0), (1.0, 1.0))
    return F.array(*[F.struct(F.lit(t).alias("t"), (weight * (F.lit(1.0) + sign * slope)).alias("w")) for t, sign in knots])


def integrated(schedule: Column) -> Column:
    """Knots (t, w) with `done`, the integral up to each; straight lines between them."""
    head = F.element_at(schedule, 1)
    start = F.array(F.struct(head["t"].alias("t"), head["w"].alias("w"), F.lit(0.0).alias("done")))

    def add(knots, knot):
        last = F.element_at(knots, -1)
        area = (knot["t"] - last["t"]) * (knot["w"] + last["w"]) / F.lit(2.0)
        return F.concat(knots, F.array(F.struct(knot["t"].alias("t"), knot["w"].alias("w"), (last["done"] + area).alias("done"))))

    return F.aggregate(F.slice(schedule, F.lit(2), F.size(schedule)), start, add)


def position(done: Column, knots: Column) -> Column:
    """The time by which a schedule has asked for a share `done` (0 to 1) of all it asks for.

    Between two knots the demand is a quadratic in time; the root is written so that it
    also holds where the weight is constant, and where it starts from 0.
    """
    asked = done * F.element_at(knots, -1)["done"]
    at = F.greatest(F.size(F.filter(knots, lambda k: k["done"] <= asked)), F.lit(1))
    at = F.least(at, F.size(knots) - 1)
    low, high = F.element_at(knots, at), F.element_at(knots, at + 1)
    span = high["t"] - low["t"]
    slope = (high["w"] - low["w"]) / F.nullif(span, F.lit(0.0))
    more = asked - low["done"]
    root = F.sqrt(F.greatest(low["w"] * low["w"] + F.lit(2.0) * slope * more, F.lit(0.0)))
    step = F.lit(2.0) * more / F.nullif(low["w"] + root, F.lit(0.0))
    return low["t"] + F.coalesce(step, F.lit(0.0))


def _digits(rows: int) -> int:
    """Hex digits for about as many buckets as the root of the number of rows."""
    digits = 1
    while digits < MOST_DIGITS and 16 ** (2 * digits) < rows:
        digits += 1
    return digits


def mix(docs: DataFrame, weight: Column, schedule: Column, most: int = 3, source: str = "source") -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken and `positions`, one for each time it comes.

    `weight` and `schedule` are columns over `rank` (the source's place by code point, from 1)
    and `weight`; the schedule's integral over 0 to 1 has to be the weight.
    """
    # A key that is never null, so that grouping, window and join agree on where rows go.
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("from")
    rows = docs.select("doc_id", named, size_of(F.col("text")).alias("size"))
    alike = rows.groupBy("doc_id", "from", "size").agg(F.count("*").alias("copies"))
    # The same on every system, and spread evenly whatever the ids are.
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = alike.withColumn("key", key).withColumn("bucket", F.substring("key", 1, _digits(docs.count())))

    buckets = keyed.groupBy("from", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    sizes = buckets.groupBy("from").agg(F.sum("words").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("from") != "", F.substring("from", 2, 1 << 30)))
    asked = targets(sizes, weight, most).withColumn("knots", integrated(schedule))
    ahead = F.sum("words").over(W.partitionBy("from").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = buckets.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("words").join(asked, "from")

    order = W.partitionBy("from", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    placed = keyed.withColumn("within", within).join(starts, ["from", "bucket"])
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(RUN).cast("bigint"))).alias("run")
    run = placed.select("*", runs)
    nth = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("copies")) - 1)).alias("nth")
    single = run.select("*", nth).withColumn("start", F.col("ahead") + F.col("within") + F.col("nth") * F.col("size"))

    demand = F.round("target").cast("bigint")
    begins = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda turn: F.col("start") + turn * F.col("source_size"))
    reached = F.filter(begins, lambda begin: begin < F.col("demand"))
    taken = F.aggregate("reached", F.lit(0).cast("bigint"), lambda n, begin: n + F.least(F.col("size"), F.col("demand") - begin))
    times = F.transform("reached", lambda begin: position(begin.cast("double") / F.col("target"), F.col("knots")))
    return (
        single.withColumn("demand", demand)
        .withColumn("reached", reached)
        .select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), times.alias("positions"))
    )


def curriculum(mixed: DataFrame) -> DataFrame:
    """The run itself: a row each time a document comes, sorted by position over ranges of it."""
    comes = mixed.select("*", F.posexplode("positions").alias("turn", "position")).drop("positions")
    return comes.orderBy("position", "source", "doc_id")
