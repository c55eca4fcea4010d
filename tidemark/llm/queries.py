"""Registered queries: each operator over its whole table, and their SQL twins."""

from pyspark.sql import functions as F

from tidemark.llm import (
    curriculum,
    decontaminate,
    exact_dedup,
    filter_audit,
    hard_negatives,
    language,
    neardup,
    packing,
    quality,
    secret_scan,
    site_style,
    toxicity,
    url_rules,
)
from tidemark.llm.common import held_out, table

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_noisy_channel_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(spark, model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_site_style_tree(spark, sf_dir):
    found = site_style.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        "found.contaminated",
    )


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_nbsvm_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score(spark, model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op7_probminhash(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    found = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        language.predict(spark, model, F.col("text")).alias("p"),
    )
    return found.select(
        "doc_id",
        "held_out",
        F.col("p.lang").alias("lang_pred"),
        F.col("p.score").alias("score"),
        language.accepted(model, F.col("p.lang"), F.col("p.score")).alias("accepted"),
    )


def op9_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = secret_scan.train(docs)
    found = docs.select("doc_id", secret_scan.find(spark, network, F.col("text")).alias("f"))
    base = F.filter("f", lambda x: x["kind"] != "cnn")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
        )

    def count(kind):
        return F.size(F.filter("f", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("f")).alias("spans"),
        count("cnn"),
    )


def op10_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op11_filter_audit(spark, sf_dir):
    text, n_words = F.col("text"), F.size(filter_audit.words(F.col("text")))
    capitals = F.char_length("text") - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    filters = {
        "A": n_words < 50,
        "B": 100 * F.size(F.array_distinct(filter_audit.words(text))) < 65 * n_words,
        "C": 100 * capitals > 5 * F.char_length("text"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filters, "E")


def op12_curriculum_mix(spark, sf_dir):
    weight = (F.col("rank") - 1) % 3 + 1
    # Odd sources come mostly late in the run, even ones mostly early.
    slope = F.when(F.col("rank") % 2 == 1, F.lit(0.5)).otherwise(F.lit(-0.5))
    mixed = curriculum.mix(table(spark, sf_dir, "documents"), weight, curriculum.ramp(F.col("weight"), slope))
    found = mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").alias("times"), F.get("positions", F.lit(0)).alias("position")
    )
    return found.orderBy("position", "doc_id")


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, label, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_site_style_tree": op2_site_style_tree,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_nbsvm_quality": op5_nbsvm_quality,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_probminhash": op7_probminhash,
    "op8_language": op8_language,
    "op9_secrets": op9_secrets,
    "op10_url_rules": op10_url_rules,
    "op11_filter_audit": op11_filter_audit,
    "op12_curriculum_mix": op12_curriculum_mix,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents),
        g AS (SELECT sha, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY sha)
        SELECT d.doc_id, g.keep_id, g.group_size,
               d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.sha AS text_sha256
        FROM d JOIN g USING (sha)""",
    "op10_url_rules": """
        WITH r(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
            ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
              FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
        SELECT page_id, host, path,
            (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM r
             WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
            coalesce((SELECT max_by(action, length(rhost || rpath)) FROM r
             WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
        FROM s""",
    "op11_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        m AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first_id FROM documents GROUP BY 1),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS x FROM labels GROUP BY 1),
        f AS (SELECT w.doc_id, part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, [
                len(ws) < 50,
                100 * len(list_distinct(ws)) < 65 * len(ws),
                100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
                regexp_matches(t, '[#$%&*|]'),
                coalesce(m.first_id < w.doc_id, false)] AS fails
            FROM w JOIN m USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
        c AS (SELECT part, fails, count(*) AS n, sum(q) AS q, sum(x) AS x FROM f GROUP BY 1, 2),
        k(i) AS (VALUES (1), (2), (3), (4), (5)),
        p AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        s AS (SELECT o, i AS step, o[i] AS fi, o[1:i - 1] AS earlier FROM p, k),
        j AS (SELECT part, o, step, fi, n, q, x, fails[fi] AS own,
                len(list_filter(earlier, lambda y: fails[y])) > 0 AS gone,
                len(list_filter(fails, lambda y: y)) = 1 AS lonely FROM c, s),
        g AS (SELECT part, o, step, fi,
                sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed,
                sum(n) FILTER (own AND gone) AS redundant, sum(n) FILTER (own AND lonely) AS unique_fails,
                sum(q) FILTER (own AND NOT gone) AS good_lost, sum(x) FILTER (own AND NOT gone) AS toxic_lost
            FROM j GROUP BY 1, 2, 3, 4)
        SELECT part, array_to_string(list_transform(o, lambda y: 'ABCDE'[y]), '') AS filter_order, CAST(step AS INT) AS step,
            CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
            CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
            CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
            CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, fi) AS BIGINT) AS shapley
        FROM g""",
    "op12_curriculum_mix": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                CAST(row_number() OVER (ORDER BY source NULLS LAST) AS INT) AS rank FROM d GROUP BY source),
        w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
        -- Share by weight, close the sources that reach their limit, and share again.
        r(n, closed, words, weights) AS (
            SELECT 0, CAST([] AS INT[]), CAST(sum(source_size) AS BIGINT), CAST(sum(weight) AS BIGINT) FROM w
            UNION ALL
            SELECT n + 1, c.closed, c.words, c.weights FROM r, LATERAL (
                SELECT list(rank) FILTER (shut) AS closed,
                    CAST(sum(source_size) - coalesce(sum(most) FILTER (shut), 0) AS BIGINT) AS words,
                    CAST(coalesce(sum(weight) FILTER (NOT shut), 0) AS BIGINT) AS weights
                FROM (SELECT w.*, list_contains(r.closed, rank) OR most * r.weights <= weight * r.words AS shut FROM w)) c
            WHERE len(c.closed) > len(r.closed)),
        z AS (SELECT * FROM r ORDER BY n DESC LIMIT 1),
        t AS (SELECT w.*, CASE WHEN list_contains(z.closed, rank) THEN CAST(most AS DOUBLE)
                ELSE CAST(z.words * weight AS DOUBLE) / CAST(z.weights AS DOUBLE) END AS target FROM w, z),
        o AS (SELECT d.doc_id, d.size, t.*, CAST(round(target) AS BIGINT) AS demand,
                CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, list_filter([start, start + source_size, start + 2 * source_size], lambda b: b < demand) AS begins,
                weight * (1.0::DOUBLE - s * 0.5::DOUBLE) AS w0, weight * (1.0::DOUBLE + s * 0.5::DOUBLE) AS w1
            FROM (SELECT *, if(rank % 2 = 1, 1.0::DOUBLE, -1.0::DOUBLE) AS s FROM o)),
        a AS (SELECT *, CAST(begins[1] AS DOUBLE) / target * ((w0 + w1) / 2.0::DOUBLE) AS asked FROM e)
        SELECT doc_id, size, source_size, target, CAST(len(begins) AS INT) AS times,
            CAST(coalesce(list_sum(list_transform(begins, lambda b: least(size, demand - b))), 0) AS BIGINT) AS taken,
            CASE WHEN len(begins) > 0
                THEN 2.0::DOUBLE * asked / (w0 + sqrt(w0 * w0 + 2.0::DOUBLE * (w1 - w0) * asked)) END AS position
        FROM a""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
                CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT a, b AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
        n AS (SELECT a AS anchor_id, positive_id, positive_score, b AS negative_id, score AS negative_score,
                CAST(row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, b) AS INT) AS rank
            FROM p JOIN s USING (a)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
