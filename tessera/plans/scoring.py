"""Vectors and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import relational as ops
from tessera.operators import scoring, vectorindex
from tessera.plans.catalog import query
from tessera.sources.tables import table


@query(
    """
    WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS similarity FROM embeddings, q WHERE vec_id <> 0
    ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 10
    """
)
def cosine_topk(spark, sf_dir):
    """The ten nearest of one vector (a top-k report)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return scoring.nearest(e.where("vec_id != 0"), q, 10, unique="vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    """
    SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2
    """
)
def centroid(spark, sf_dir):
    """Mean vector of each label, by coordinate."""
    c = vectors.centroids(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x"), F.col("signal_count").alias("n")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"), "n")


@query(
    """
    SELECT id, peer, similarity_pct FROM (
      SELECT a.vec_id AS id, b.vec_id AS peer, greatest(0, least(100, round(100 * round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)))) AS similarity_pct,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS n
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    WHERE n <= 5
    """
)
def hybrid_lookalikes(spark, sf_dir):
    """For the query rows (ids divisible by 100) the five nearest of their label, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("_a"))
    b = e.select(F.col("vec_id").alias("peer"), "label", F.col("embedding").alias("_b"))
    scored = a.join(b, "label").where("id != peer").select("id", "peer", F.round(vectors.cosine(F.col("_a"), F.col("_b")), 6).alias("s"))
    return ops.first_per(scored, ["id"], [F.desc("s"), F.col("peer")], 5).select("id", "peer", vectors.percent(F.col("s")).alias("similarity_pct"))


@query(
    """
    SELECT a.vec_id AS id, c.label AS user_id, CASE WHEN c.n >= 3 THEN greatest(0, least(100, round(100 * round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), c.m), 9)))) END AS match_pct
    FROM embeddings a, (SELECT label, list(x ORDER BY pos) AS m, max(n) AS n FROM (
        SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1) c
    WHERE c.n >= 3
    """
)
def preference_match(spark, sf_dir):
    """Match of every vector with each user's centroid, for users with three signals or more: labels as users, their vectors as signals."""
    e = table(spark, sf_dir, "embeddings")
    users = vectors.centroids(e, ["label"], "embedding").withColumnRenamed("label", "user_id")
    return scoring.match_scores(e.select(F.col("vec_id").alias("id"), "embedding"), users)


@query()
def indexed_neighbours(spark, sf_dir):
    """For the query rows (ids divisible by 100) the ten nearest of all rows, through an index of all rows; its recall is measured in the tests."""
    e = table(spark, sf_dir, "embeddings")
    index = vectorindex.build(e, unique="vec_id")
    probes = vectorindex.calibrate(index, e, 10, unique="vec_id")
    found = vectorindex.search(index, e.where("vec_id % 100 = 0"), 10, probes=probes, unique="vec_id")
    return found.select("id", "peer", F.round("similarity", 6).alias("similarity"), "place")


_AS_OF = "DATE '2001-01-01'"


@query(
    f"""
    WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS last_date, avg(o_totalprice) AS mean FROM orders WHERE o_orderdate < {_AS_OF} GROUP BY 1),
    p AS (SELECT c_custkey AS k, CASE WHEN n > 0 THEN least(100, n * 8.0) END AS investors, CASE WHEN c_acctbal > 0 THEN least(100, c_acctbal / 100) END AS team,
                 CASE WHEN n >= 5 THEN greatest(0, least(100, 50 + (mean - 200000) / 4000)) END AS growth,
                 CASE WHEN last_date IS NULL THEN NULL WHEN date_diff('day', last_date, {_AS_OF}) <= 90 THEN 100.0 WHEN date_diff('day', last_date, {_AS_OF}) >= 180 THEN 0.0
                      ELSE 100.0 - (date_diff('day', last_date, {_AS_OF}) - 90) / 90.0 * 100.0 END AS recency,
                 least(100.0, 25.0 * (c_custkey % 5)) AS media, (c_nationkey - 12) / 20.0 AS momentum
          FROM customer LEFT JOIN o ON o.k = c_custkey),
    b AS (SELECT *, (coalesce(investors, 0) * 0.25 * (investors IS NOT NULL)::INT + coalesce(team, 0) * 0.25 * (team IS NOT NULL)::INT + coalesce(growth, 0) * 0.2 * (growth IS NOT NULL)::INT
               + coalesce(recency, 0) * 0.15 * (recency IS NOT NULL)::INT + media * 0.15)
             / (0.25 * (investors IS NOT NULL)::INT + 0.25 * (team IS NOT NULL)::INT + 0.2 * (growth IS NOT NULL)::INT + 0.15 * (recency IS NOT NULL)::INT + 0.15) AS base FROM p),
    s AS (SELECT *, least(100, greatest(1, round(round(base * (1 + greatest(-0.3, least(0.3, momentum))), 6), 1))) AS moved FROM b),
    f AS (SELECT *, CASE WHEN investors >= 85 AND team >= 85 AND moved < 70 THEN 70 ELSE moved END AS score FROM s)
    SELECT k AS company_id, round(base, 1) AS base, round(score, 1) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' ELSE 'C' END AS tier,
           CASE (investors IS NOT NULL)::INT + (team IS NOT NULL)::INT + (growth IS NOT NULL)::INT + (recency IS NOT NULL)::INT + 1 WHEN 5 THEN 'high' WHEN 4 THEN 'medium' WHEN 3 THEN 'medium' ELSE 'low' END AS confidence
    FROM f
    """
)
def weighted_score(spark, sf_dir):
    """A five-part score: parts without evidence drop out and their weight goes to the others."""
    as_of = F.lit("2001-01-01").cast("date")
    o = table(spark, sf_dir, "orders").where("o_orderdate < DATE '2001-01-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.max(F.col("o_orderdate").cast("date")).alias("last_date"), F.avg("o_totalprice").alias("mean")
    )
    from tessera.functions import dates

    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    parts = {
        "investors": F.when(F.col("n") > 0, F.least(F.lit(100.0), F.col("n") * 8.0)),
        "team": F.when(F.col("c_acctbal") > 0, F.least(F.lit(100.0), F.col("c_acctbal") / 100)),
        "growth": F.when(F.col("n") >= 5, scoring.clamp(50 + (F.col("mean") - 200000) / 4000, 0.0, 100.0)),
        "recency": dates.recency_points(F.datediff(as_of, "last_date")),
        "media": F.least(F.lit(100.0), 25.0 * (F.col("c_custkey") % 5)),
    }
    s = c.select(F.col("c_custkey").alias("company_id"), ((F.col("c_nationkey") - 12) / 20.0).alias("momentum"), *[v.alias(k) for k, v in parts.items()])
    s = s.withColumn("base", scoring.weighted({k: F.col(k) for k in parts}))
    moved = scoring.clamp(F.round(F.round(F.col("base") * (1 + scoring.clamp(F.col("momentum"), -0.30, 0.30)), 6), 1), 1.0, 100.0)
    score = F.when(F.coalesce((F.col("investors") >= 85) & (F.col("team") >= 85) & (moved < 70), F.lit(False)), 70.0).otherwise(moved)
    known = sum((F.col(k).isNotNull().cast("int") for k in parts), F.lit(0))
    s = s.withColumn("score", F.round(score, 1))
    return s.select("company_id", F.round("base", 1).alias("base"), "score", scoring.tier(F.col("score")).alias("tier"), scoring.confidence(known).alias("confidence"))


@query(
    """
    WITH j AS (SELECT l_suppkey AS k, count(*) FILTER (WHERE l_linestatus = 'O') % 60 AS active_jobs, max(CAST(l_shipdate AS DATE)) AS seen, avg(l_quantity) AS fill, count(DISTINCT l_returnflag) AS scaled,
                      count(*) FILTER (WHERE l_returnflag = 'R') % 7 AS founding, count(*) FILTER (WHERE l_discount > 0.09) % 5 AS stealth FROM lineitem GROUP BY 1),
    p AS (SELECT s_suppkey AS company_id, least(founding, 5) * 10 AS pts_founding, least(stealth, 3) * 10 AS pts_stealth,
                 CASE WHEN active_jobs = 0 THEN 0 WHEN active_jobs <= 10 THEN 20 WHEN active_jobs <= 25 THEN 10 WHEN active_jobs <= 50 THEN 0 ELSE -30 END AS pts_size,
                 CASE WHEN date_diff('day', seen, DATE '2001-12-01') <= 30 THEN 10 WHEN date_diff('day', seen, DATE '2001-12-01') <= 90 THEN 5 ELSE 0 END AS pts_recency,
                 CASE WHEN fill <= 21 THEN 10 WHEN fill <= 45 THEN 5 ELSE 0 END AS pts_velocity,
                 CASE WHEN scaled >= 4 THEN -30 WHEN scaled = 3 THEN -20 WHEN scaled = 2 THEN -10 ELSE 0 END AS pts_scaled,
                 CASE WHEN 2001 - (1990 + s_suppkey % 12) <= 2 THEN 20 WHEN 2001 - (1990 + s_suppkey % 12) <= 4 THEN 10 WHEN 2001 - (1990 + s_suppkey % 12) <= 7 THEN 0 ELSE -10 END AS pts_age
          FROM supplier JOIN j ON j.k = s_suppkey)
    SELECT *, greatest(0, least(100, pts_founding + pts_stealth + pts_size + pts_recency + pts_velocity + pts_scaled + pts_age)) AS early_score FROM p
    """
)
def points_score(spark, sf_dir):
    """Points for being early, every part exposed."""
    facts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_id")).agg(
        (F.count(F.when(F.col("l_linestatus") == "O", 1)) % 60).alias("active_jobs"), F.max(F.col("l_shipdate").cast("date")).alias("latest_job_seen"), F.avg("l_quantity").alias("avg_days_to_fill"),
        F.countDistinct("l_returnflag").alias("scaled_functions"), (F.count(F.when(F.col("l_returnflag") == "R", 1)) % 7).alias("founding_signals"), (F.count(F.when(F.col("l_discount") > 0.09, 1)) % 5).alias("stealth_signals"),
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), (1990 + F.col("s_suppkey") % 12).alias("founded_year"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first_filing", "date"), ("latest_patent", "date"), ("patent_classes", "int"))]
    scored = scoring.early_points(facts.join(s, "company_id").select("*", *none), as_of=F.lit("2001-12-01").cast("date"))
    return scored.select("company_id", *[f"pts_{x}" for x in ("founding", "stealth", "size", "recency", "velocity", "scaled", "age")], "early_score")
