"""Filter interaction audit: what every order of a set of filters would remove.

Each row gets a bit per filter that it fails. The filters on a row's own text are
column expressions; the existential one (the text stands in a row of smaller id) is
a left-semi join on hash, exact text and smaller id. The ids that it marks are united
with the ids that fail otherwise, and rows shrink to combinations of bits: at most
two to the power of the filters for each part of the table. All orders, steps and
Shapley sums then follow from the combinations alone, however large the table is.

How it moves: the text goes through one exchange on each side of the semi-join and
nowhere else. The right side is the smallest id of each distinct text, combined before
the exchange, and joined where that put it. A hash that more than one row in `HOT_SHARE` carries (so there are at most
`HOT_SHARE` such hashes, which bounds the broadcast) has its rows spread over several
salts, and its one row repeated for each.

Cases: a null text is empty, a null part the empty string. A row without an id is
never marked by the semi-join and marks no other (its id is neither smaller nor
larger); equal rows of one id don't mark each other. Rows repeated in the table count
each time. An id is good or toxic if any of its labels says so; labels without an id
say nothing. An empty table gives no rows. Other columns are not read, whatever
their names.
"""

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: A hash is hot if more than one row in this many has it; hot rows are dealt out in shares of that size.
HOT_SHARE = 1000
#: With more filters the list of all orders would no longer be a small table.
MOST_FILTERS = 7

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The maximal runs without white space (ASCII)."""
    return F.array_remove(F.split(text, SPACES), "")


def repeated_texts(rows: DataFrame) -> DataFrame:
    """(id, hash, part) of the rows whose text is that of a row with a smaller id; rows: id, hash, part, text."""
    # Rows without an id can be neither side; a third of the table without ids stays where it is.
    named = rows.where(F.col("id").isNotNull())
    total = rows.agg(F.count("*")).scalar()
    counted = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > total)
    # At most HOT_SHARE rows, as each stands for more than that part of all.
    hot = F.broadcast(counted.select("hash", F.ceil(F.col("n") * HOT_SHARE / total).alias("shares")))

    def first_ids(some):
        return some.groupBy("hash", "text").agg(F.min("id").alias("first_id"))

    def semi(left, right, *keys):
        l, r = left.alias("l"), right.alias("r")
        same = F.col("r.first_id") < F.col("l.id")
        for key in keys:
            same = same & (F.col(f"l.{key}") == F.col(f"r.{key}"))
        return l.join(r, same, "left_semi").select("id", "hash", "part")

    # The right side stays where its aggregation put it.
    rare = named.join(hot, "hash", "left_anti")
    found = semi(rare, first_ids(rare), "hash", "text")
    often = named.join(hot, "hash")
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("salt")
    dealt = often.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("shares"))).drop("shares")
    repeated = first_ids(often).join(hot, "hash").select("hash", "text", "first_id", salts)
    return found.unionByName(semi(dealt, repeated, "hash", "salt", "text"))


def combinations(docs: DataFrame, labels: DataFrame, failures: list[Column], part: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): rows by the filters they fail; the bit after `failures` is the repeated text's."""
    marked = F.lit(0)
    for k, failure in enumerate(failures):
        marked = marked.bitwiseOR(F.when(failure, 1 << k).otherwise(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    ).withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    repeats = repeated_texts(rows).select("id", "hash", "part", F.lit(1 << len(failures)).alias("bits"), F.lit(0).alias("n"))
    others = rows.select("id", "hash", "part", marked.alias("bits"), F.lit(1).alias("n"))
    # A row is known by id and text: equal ones share every mark, so they travel as one.
    # Written, as it is read twice and its plan holds the semi-joins.
    by_row = stored(
        others.unionByName(repeats)
        .groupBy("id", "hash", "part")
        .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
        .drop("hash")
    )
    known = (
        labels.where((F.col("quality") == 1) | (F.col("toxic") == 1))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    )
    # An inner join for the labelled rows and a plain sum for all: no outer join that deals out null ids by their null.
    labelled = by_row.join(known, "id").groupBy("part", "bits").agg(
        F.lit(0).cast("bigint").alias("n"),
        F.sum(F.col("n") * F.coalesce("q", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic"),
    )
    plain = by_row.groupBy("part", "bits").agg(F.sum("n").alias("n")).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return plain.unionByName(labelled).groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(combos: DataFrame, names: str) -> DataFrame:
    """A row per part, order of the filters and step, from `combinations`.

    A step depends on its filter and the set of filters before it only, so sums are
    taken for those pairs and then handed to every order that has them.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; at most {MOST_FILTERS}")
    all_bits = range(len(names))
    pairs = [(f, before) for f in all_bits for before in range(1 << len(names)) if not before >> f & 1]
    named = [{"filter": f, "own": 1 << f, "before": before} for f, before in pairs]
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in pair.items()]) for pair in named])
    bits, own, before = F.col("bits"), F.col("own"), F.col("before")
    fails, earlier = bits.bitwiseAND(own) != 0, bits.bitwiseAND(before) != 0

    def total(condition, of="n"):
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("bigint")

    steps = (
        combos.select("*", F.explode(listed).alias("pair"))
        .select("*", "pair.*")
        .groupBy("part", "filter", "before")
        .agg(
            total(~fails & ~earlier).alias("kept"),
            total(fails & ~earlier).alias("removed"),
            total(fails & earlier).alias("redundant"),
            total(bits == own).alias("unique_fails"),
            total(fails & ~earlier, "good").alias("good_lost"),
            total(fails & ~earlier, "toxic").alias("toxic_lost"),
        )
    )
    # So many orders have exactly these filters, in any order, before this one.
    orders = {b: math.factorial(b.bit_count()) * math.factorial(len(names) - 1 - b.bit_count()) for _, b in pairs}
    weight = F.create_map(*[F.lit(x) for pair in orders.items() for x in pair])[before]
    shapley = steps.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).cast("bigint").alias("shapley"))

    placed = []
    for order in permutations(all_bits):
        seen = 0
        for step, f in enumerate(order, 1):
            placed.append(("".join(names[i] for i in order), step, f, seen))
            seen |= 1 << f
    spark = combos.sparkSession
    orders = F.broadcast(spark.createDataFrame(placed, "filter_order string, step int, filter int, before int"))
    found = steps.join(orders, ["filter", "before"]).join(shapley, ["part", "filter"])
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return found.select("part", "filter_order", "step", *measures)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeated: str, part: str = "source") -> DataFrame:
    """The interactions of named failure conditions and of the repeated-text filter, named `repeated`.

    `filters` maps a letter to a condition over the column `text` (never null there);
    a condition that is null counts as passed.
    """
    return interactions(combinations(docs, labels, list(filters.values()), part), "".join(filters) + repeated)
