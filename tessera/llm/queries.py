"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import filter_audit, media, mixing, neardup, packing, pii, quality, spelling, spotsigs, tokenfile, tokens, url_filter, warc
from tessera.llm.shared import table

#: (host, path, verdict) of the URL rules.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.roundtrip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_mixing,
        op3_warc,
        op4_spotsigs,
        op5_packing,
        op6_media,
        op7_token_counts,
        op8_token_file,
        op9_quality,
        op10_near_duplicates,
        op11_filter_audit,
        op12_spelling_variants,
        op13_personal_data,
    )
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op1_url_filter": f"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
        cut AS (
            SELECT page_id, row_number() OVER () AS row_no,
                   CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
            FROM pages
        ),
        parts AS (
            SELECT page_id, row_no,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ),
        fits AS (
            SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_host || rule_path DESC) AS pick
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
        )
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE pick = 1
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op11_filter_audit": r"""
        WITH letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        f AS (
            SELECT part,
                   CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
                   + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS failed,
                   CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
                   CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic
            FROM w
        ),
        h AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
        orders AS (
            SELECT a.l || b.l || c.l || x.l || e.l AS filter_order
            FROM letters a, letters b, letters c, letters x, letters e
            WHERE a.bit + b.bit + c.bit + x.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, x.l, e.l])) = 5
        ),
        steps AS (
            SELECT filter_order, s.step, l.l, l.bit AS own,
                   (SELECT coalesce(sum(p.bit), 0) FROM letters p WHERE instr(filter_order, p.l) < s.step)::INT AS before
            FROM orders, range(1, 6) s(step), letters l
            WHERE substr(filter_order, s.step, 1) = l.l
        ),
        counted AS (
            SELECT part, filter_order, step, l,
                   sum(CASE WHEN failed & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN failed & own > 0 AND failed & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN failed & own > 0 AND failed & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN failed & own > 0 AND failed & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN failed & own > 0 AND failed & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM h, steps GROUP BY part, filter_order, step, l
        )
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
        FROM counted
    """,
}
