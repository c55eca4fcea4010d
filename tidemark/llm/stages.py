"""Pipeline stages: operators applied to documents, keeping whole rows.

Every stage returns the columns it was given, whatever their names. Decisions hold for
rows, not for ids: a row is known by its id and its text, so rows that share an id, or
have none, are told apart by their texts, and of rows equal in both the deduplicating
stages keep one (any of them, if other columns differ). A null text counts as empty. An empty
table stays empty. Texts of any length are judged whole.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as decon
from tidemark.llm import exact_dedup as exact
from tidemark.llm import neardup, packing, quality
from tidemark.llm.common import shipped, stored, table

#: A document stays if its probability of good quality is at least this.
QUALITY_LEAST = 0.3


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def digest():
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of docs whose (id, text) is kept, one of each.

    pairs: (id, sha, kept, n), one row for each id and digest of docs; n rows have them, and
    are left alone if n is 1. Texts move once, to the join with what has to go.
    """
    special = stored(pairs.where(~F.col("kept") | (F.col("n") > 1)).select("id", "sha", "kept"))
    sha = free_name(docs, "sha_of_text")
    rows = docs.withColumn(sha, digest())
    same = F.col("doc_id").eqNullSafe(special["id"]) & (F.col(sha) == special["sha"])
    rest = rows.join(special.hint("merge"), same, "left_anti")
    # Pairs that stay and are repeated are few, so their own file is small enough to be broadcast.
    again = stored(special.where("kept"))
    same = F.col("doc_id").eqNullSafe(again["id"]) & (F.col(sha) == again["sha"])
    once = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", sha])
    return rest.unionByName(once).select(*docs.columns)


def quality_filter(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go; it learns from the rows given.

    Each row is judged by its text alone: equal texts share their fate, ids don't matter.
    """
    shipped(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels)
    score = free_name(docs, "score_of_text")
    scored = docs.withColumn(score, quality.score(spark, model, F.col("text")))
    return scored.where(F.col(score) >= QUALITY_LEAST).select(*docs.columns)


def exact_dedup(spark, docs, sf_dir):
    """Of documents with equal texts the one with the largest id stays, a single row.

    Texts that only rows without an id have keep one of those rows.
    """
    shipped(spark)
    found = exact.deduplicate(docs.select("doc_id", "text"))
    pairs = found.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(
        F.bool_or("kept").alias("kept"), F.count("*").alias("n")
    )
    return keep_rows(docs, pairs)


def near_dedup(spark, docs, sf_dir):
    """Of each class of near duplicates the document with the smallest id stays, a single row.

    If several texts of a class have that id, or none has an id, the one with the smallest
    digest stays. Texts without words are no duplicates of each other here and stay.
    """
    shipped(spark)
    found = neardup.classes(docs.select("doc_id", "text", digest().alias("sha")), carry=("sha",))
    pairs = stored(
        found.groupBy(F.col("doc_id").alias("id"), "sha").agg(
            F.max("part").alias("part"), F.bool_or("kept").alias("kept"), F.count("*").alias("n")
        )
    )
    # Of the few that carry their class's id, those that are not the one.
    named = pairs.where("kept AND part IS NOT NULL")
    chosen = named.groupBy("part").agg(F.min("sha").alias("chosen"))
    others = named.join(chosen, "part").select("id", "sha", (F.col("sha") == F.col("chosen")).alias("kept"), "n")
    rest = pairs.where("NOT kept OR part IS NULL").select("id", "sha", "kept", F.lit(1).cast("bigint").alias("n"))
    return keep_rows(docs, others.unionByName(rest))


def decontaminate(spark, docs, sf_dir):
    """Documents of which a twentieth or more is benchmark text go; each row is judged by its text alone."""
    into = free_name(docs, "benchmark_found")
    found = decon.find(docs, table(spark, sf_dir, "benchmark"), into=into)
    return found.where(~F.col(f"{into}.contaminated")).select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of all rows in sequences of 1024 tokens; a row repeated is packed as often, a null text as an empty one."""
    shipped(spark)
    return packing.pack(packing.pieces(docs))
