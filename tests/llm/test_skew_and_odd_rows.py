"""Hot keys, nested records, estimates, priors and the pipeline on odd rows, each against a plain version."""

import gzip
import io
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import media, mixing, neardup, packing, quality, shared, spotsigs, url_filter, warc


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = [(1, i) for i in range(40)] + [(2, 0)] * 30 + [(3, i) for i in range(5)] + [(None, 1)]
    left = spark.createDataFrame(rows, "k int, v int").repartition(4)
    facts = spark.createDataFrame([(k, n, f"f{k}") for k, n in Counter(k for k, _ in rows).items()], "k int, n long, fact string")
    assert {r.k for r in shared.hot_keys(facts, "k").collect()} == {1, 2}
    got = Counter(map(tuple, shared.spread_join(left, facts, "k", "v").select("k", "v", "fact").collect()))
    assert got == Counter((k, v, f"f{k}") for k, v in rows if k is not None)


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.shared_root(Session())


def test_whole_numbers(spark):
    good = spark.createDataFrame([("7",), (None,)], "x string")
    assert [r[0] for r in good.select(shared.whole_number(F.col("x"))).collect()] == [7, None]
    with pytest.raises(Exception, match="not a whole number"):
        spark.createDataFrame([("seven",)], "x string").select(shared.whole_number(F.col("x"))).collect()


# half of all rows equal ---------------------------------------------------------------------------------------------
def half_equal(spark):
    same = (1, "one two three four five six seven", "en", "a", 3, None, None)
    rows = [same] * 900 + [(i, f"w{i} x{i} y{i} z{i} v{i} u{i}", "en", "ab"[i % 2], i, None, None) for i in range(2, 900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, row string").repartition(4)


def test_half_of_all_rows_equal(spark):
    rows, docs = half_equal(spark)
    mixed = mixing.mixed_documents(docs)
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    taken = defaultdict(int)
    for r in mixing.mix(docs, same=list(docs.columns)).collect():
        taken[r.doc_id] += r.copies
    assert {k[0]: v for k, v in times.items()} == {k: v for k, v in taken.items() if v}
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == Counter((d, d, 900 if d == 1 else 1) for d, *_ in rows)
    assert neardup.deduplicated(docs).count() == 899
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/en/").alias("url"), F.repeat("text", F.lit(9)).alias("html"))
    assert warc.with_record_types(pages).where("record_type = 'response'").count() == 900 + 898  # equal rows of the least page_id are all responses
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    assert url_filter.judge_urls(pages.withColumn("url", F.when(F.col("page_id") > 1, F.col("url"))), rules).groupBy("verdict").count().collect() is not None


def test_null_and_its_mark_are_told_apart(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "\x01", "a"), (1, "a\x00b", "c"), (1, "a", "b\x00c"), (1, None, None)], "doc_id long, text string, source string")
    assert docs.select(mixing.content_key(docs)).distinct().count() == 5


# archives -----------------------------------------------------------------------------------------------------------
class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        Counted.taken += len(got)
        return got


def test_nested_records_and_bytes_read():
    rng = random.Random(4)

    def noise(n):
        return bytes(rng.randrange(256) for _ in range(n))

    inner = b"".join(warc.record_bytes(i, "http://inner", noise(300), "d", "response", None) for i in range(5))
    records = []
    for i in range(400):
        payload = inner + noise(100) if i % 20 == 7 else noise(rng.randrange(50, 4000))
        raw = gzip.decompress(warc.record_bytes(i, "http://outer", payload, "d", "response", None))
        records.append(gzip.compress(raw, 0 if i % 20 == 7 else 4, mtime=0))  # level 0 stores, so inner records lie in the open
    archive = b"".join(records)
    offsets = np.cumsum([0, *map(len, records)])[:-1].tolist()
    longest = max(map(len, records))
    for step in (4 * longest, 100_000, 5_000, len(archive)):
        Counted.taken, found = 0, []
        for start in range(0, len(archive), step):
            found += [(at, r["fields"]["warc-target-uri"]) for at, r in warc.records_in(Counted(archive), start, min(start + step, len(archive)), len(archive), longest)]
        assert found == [(at, "http://outer") for at in offsets]
    Counted.taken = 0
    list(warc.records_in(Counted(archive), 0, len(archive), len(archive), longest))
    assert Counted.taken <= 1.2 * len(archive)


def test_damaged_record_raises():
    good = warc.record_bytes(1, "http://a", b"x" * 5000, "d", "response", None)
    flipped = good[:60] + b"\xff\xff\xff" + good[63:]
    for broken in (good[:-20], flipped, good + flipped, good + b"rest"):
        with pytest.raises(ValueError):
            list(warc.records_in(io.BytesIO(broken), 0, len(broken), len(broken), len(good)))


# fingerprints -------------------------------------------------------------------------------------------------------
def test_pruned_comparison_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        universe = rng.choice(2**32, 600, replace=False).astype(np.uint32)
        n = int(rng.integers(0, 400))
        base = rng.choice(universe, n, replace=False)
        a = np.sort(base)
        b = np.sort(np.unique(np.append(base[: int(n * rng.uniform(0.6, 1))], rng.choice(universe, int(rng.integers(0, 60)), replace=False))))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if len(a) or len(b) else 1.0
        assert spotsigs.is_near(a, b) == (exact >= 0.8 - 1e-12)
        assert spotsigs.likeness(a, b) == pytest.approx(exact)
        if exact >= 0.8 and len(a) and len(b):
            assert abs(spotsigs.length_band(len(a)) - spotsigs.length_band(len(b))) <= 1


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(8)
    items = neardup._mix(np.arange(1, 61, dtype=np.uint64))
    for _ in range(3):
        x, y = rng.exponential(1, 60) * (rng.random(60) < 0.8), rng.exponential(1, 60) * (rng.random(60) < 0.8)
        want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(60)) for i in range(60) if x[i] and y[i])
        row, keep = np.repeat([0, 1], [np.count_nonzero(x), np.count_nonzero(y)]), [np.flatnonzero(x), np.flatnonzero(y)]
        sig = neardup.prob_minhash(row, np.concatenate([items[k] for k in keep]), np.concatenate([x[keep[0]], y[keep[1]]]), 2, 4096)
        assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)


def test_large_buckets_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(150)] + [(200 + i, " ".join(f"v{i}{k}" for k in range(100))) for i in range(5)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 200 else i for i, _ in rows}


# media --------------------------------------------------------------------------------------------------------------
def test_feature_of_a_payload():
    rng = random.Random(1)
    for payload in (b"\xff" * 576, bytes(rng.randrange(256) for _ in range(1152)), b"plain words " * 48):
        n = len(payload)
        mean = sum(payload) / n
        spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values()) + 0.0
        got = media.feature(payload).split(" ")
        assert float(got[0]) == pytest.approx(mean, abs=1e-3) and float(got[1]) == pytest.approx(spread, abs=1e-3) and float(got[2]) == pytest.approx(entropy, abs=1e-4)
        assert [float(x) for x in got[3].split(",")] == pytest.approx([sum(32 * k <= x < 32 * k + 32 for x in payload) / n for k in range(8)], abs=1e-4)


# quality ------------------------------------------------------------------------------------------------------------
def logit(p):
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def strength(groups):
    """Pseudo-documents from (n, bad, rate above) of each group."""
    total = sum(n for n, _, _ in groups)
    m = min(max(sum(b for _, b, _ in groups) / total, 1e-6), 1 - 1e-6)
    spread = sum(n * (b / n - a) ** 2 for n, b, a in groups) / total - m * (1 - m) * len(groups) / total
    return min(1e6, max(2.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6


def test_posteriors_against_plain_python(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", None, "sparse"]) if i % 50 else "rare", rng.choice(["en", "de", None]), rng.gauss(-2, 2), rng.gauss(-3, 2)) for i in range(700)]
    scored = spark.createDataFrame([((i,), h, p, lo, to) for i, h, p, lo, to in rows], "row struct<doc_id:long>, host string, path string, low double, toxic double")
    model = quality.Model(low_rate=0.2, toxic_rate=0.1)
    want = {}
    for kind, at, prior in (("low", 3, 0.2), ("toxic", 4, 0.1)):
        n, bad = Counter(), Counter()
        for r in rows:
            n[r[1], r[2]] += 1
            bad[r[1], r[2]] += 1 / (1 + math.exp(-(logit(prior) + r[at])))
        hosts = {h for h, _ in n}
        hn = {h: sum(v for k, v in n.items() if k[0] == h) for h in hosts}
        hb = {h: sum(v for k, v in bad.items() if k[0] == h) for h in hosts}
        whole = sum(hb.values()) / len(rows)
        k = strength([(hn[h], hb[h], whole) for h in hosts])
        host = {h: (hb[h] + k * whole) / (hn[h] + k) for h in hosts}
        k = strength([(n[s], bad[s], host[s[0]]) for s in n])
        for s in n:
            want[s, kind] = (bad[s] + k * host[s[0]]) / (n[s] + k)
    got = quality.site_rates(scored, model).collect()
    assert len(got) == len({(r[1], r[2]) for r in rows})
    for r in got:
        assert r.low_prior == pytest.approx(want[(r.host, r.path), "low"]) and r.toxic_prior == pytest.approx(want[(r.host, r.path), "toxic"])


def test_toxic_documents_are_found(spark):
    """On held-out labels; about a sixth of the texts labelled toxic hold nothing toxic."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    docs = docs.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    model = quality.fit(docs, train)
    scored = quality.classify(docs, model, keep_columns=["doc_id"]).select("row.doc_id", "p_toxic", "p_low_quality", "keep")
    rows = scored.join(held, "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert toxic and sum(r.p_toxic >= 0.5 for r in toxic) / len(toxic) > 0.8
    fine = [r for r in rows if r.toxic == 0]
    assert sum(r.p_toxic >= 0.5 for r in fine) / len(fine) < 0.01
    low = [r for r in rows if r.quality == 0]
    assert low and sum(r.p_low_quality >= 0.5 for r in low) / len(low) > 0.9
    assert all(r.keep == (r.p_toxic < 0.5 and r.p_low_quality < 0.5) for r in rows)


def test_classifier_scores_are_evidence_and_site(spark):
    """p = expit(logit(site prior) + evidence), with evidence from the whole text of each document."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = [(r.doc_id, r.source, r.lang, *model.evidence(r.text or "")) for r in docs.collect()]
    scored = spark.createDataFrame([((i,), h, p, lo, to) for i, h, p, lo, to in rows], "row struct<doc_id:long>, host string, path string, low double, toxic double")
    rate = {(r.host, r.path): r for r in quality.site_rates(scored, model).collect()}
    want = {i: (1 / (1 + math.exp(-(logit(rate[h, p].low_prior) + lo))), 1 / (1 + math.exp(-(logit(rate[h, p].toxic_prior) + to)))) for i, h, p, lo, to in rows}
    for r in quality.scores(docs, labels).collect():
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(want[r.doc_id], abs=1e-9)


def test_repeated_ids_are_fitted_once(spark):
    docs = spark.createDataFrame([(1, f"text number {i % 3}") for i in range(50)] + [(2, "another fine text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels).toxic_rate == quality._rate(1, 2)


# the pipeline -------------------------------------------------------------------------------------------------------
def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_on_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(5, 1, 0), (8, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for name, run in corpus_pipeline.STAGES[:-1]:
            docs = shared.settle(run(spark, docs, str(tmp_path)), "test-stage")
            assert docs.columns == odd.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (packed.count() > 0) == (docs.count() > 0)


def test_pipeline_against_its_parts(spark):
    """The pipeline's rows from plain versions of its four stages, on the smallest tables."""
    from test_operators import WORD, brute_classes, ids_of

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    scores = {r.doc_id: r.keep for r in quality.scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = [r for r in rows if scores[r.doc_id]]
    first = {}
    for r, (_, c) in zip(kept, brute_classes([(r.doc_id, r.text) for r in kept])):
        first.setdefault(c, r)
    single = [r for c, r in first.items() if r.doc_id == c]
    assert len(single) == len(first)
    docs = spark.createDataFrame(single, spark.read.parquet(f"{folder}/documents.parquet").schema)
    times = {r.doc_id: r.copies for r in mixing.mix(docs, same=list(docs.columns)).collect()}
    want = Counter()
    for r, ids in zip(single, ids_of(WORD, [r.text for r in single])):
        for at in range(0, len(ids) + 1, 2048):
            want[r.doc_id, at // 2048, at, min(2048, len(ids) + 1 - at)] += times[r.doc_id]
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == +want
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(ends) <= 1.02 * math.ceil(sum(r.length for r in got) / 2048) + 1


def test_packing_uses_no_more_than_first_fit(spark):
    rng = np.random.default_rng(5)
    counts = dict(Counter(np.minimum(2048, rng.lognormal(6, 1, 3000)).astype(int).tolist()))
    bins = sum(n for _, n in packing.plan_bins(counts, 2048))
    rooms = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= length), None)
        if at is None:
            rooms.append(2048 - length)
        else:
            rooms[at] -= length
    assert bins <= len(rooms)


# rows that are equal, names that clash, long pieces --------------------------------------------------------------------
def test_numbered_copies(spark, monkeypatch):
    monkeypatch.setattr(shared, "COPIES_IN_TASK", 7)
    rows = [(1, "a")] * 40 + [(2, None)] * 7 + [(None, "b")] + [(3, "c")] * 8
    got = Counter(map(tuple, shared.numbered_copies(spark.createDataFrame(rows, "x int, y string").repartition(3), "k").collect()))
    assert got == Counter((*row, i) for row, n in Counter(rows).items() for i in range(n))


def test_no_group_holds_the_equal_rows(spark):
    """Half of 20,000 rows are equal; they are dealt over the groups of mixing and the slots of packing like any others."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("source"), F.lit(7).alias("size"))
    for n in (len(docs.columns),):
        dealt = shared.numbered_copies(docs, "copy").withColumn("slot", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(100)))
        assert dealt.groupBy("slot").count().agg(F.max("count")).first()[0] < 20_000 * 0.02 and n == 3
    same = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") + 10_000).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(700).cast("long").alias("length"))
    placed = packing.place(same, capacity=2048).collect()
    assert Counter(r.doc_id for r in placed)[1] == 2_000 and len({(r.sequence_id, r.offset) for r in placed}) == 4_000
    fill = Counter(r.sequence_id for r in placed)
    assert len(fill) == 2_000 and set(fill.values()) == {2}


def test_url_filter_keeps_columns_of_any_name(spark):
    rows = [(1, "https://a.example.com/en/1", "s", "p", "ps", "rv", 5, "r"), (2, None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, site string, _part string, _parts string, rule_verdict string, n int, row string")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    for given in (rules, rules.limit(0)):
        got = url_filter.judge_urls(pages, given).orderBy("page_id")
        assert [tuple(r)[:8] for r in got.collect()] == rows and got.columns[8:] == ["url_host", "url_path", "rule", "verdict"]
    assert [r.verdict for r in url_filter.judge_urls(pages, rules).orderBy("page_id").collect()] == ["block", "allow"]


def test_cache_of_texts_without_blanks(monkeypatch):
    """Long stretches aren't kept, the cache stays below its bytes, and ids stay the library's."""
    import public_tokenizers

    from tessera.llm import tokens

    rng = random.Random(6)
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "CACHE_BYTES", 60_000)
    enc, most = tokens.PieceEncoder(path, by_rank=tokens.merges_by_rank(path)), 0
    for _ in range(60):
        text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3_000)) + " short words too " + "".join(rng.choice("abcdef0123456789") for _ in range(rng.choice([50, 5_000])))
        before = sum(x.held for x in (enc.head, enc.tail))
        ids = np.frombuffer(enc.ids(text), np.uint32)
        most = max(most, before, sum(x.held for x in (enc.head, enc.tail)))
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert most < 250_000 and all(len(k) <= tokens.LONGEST_KEPT for x in (enc.head, enc.tail) for k in x.cache)
