"""Order-dependent operators against plain folds."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import newsevents, writeplan

FOLDER = "/root/testdata/sf0.001"
ROUND = "round_type string, amount double, valuation double, announced date, lead string, source_url string, investors array<string>"


def plain_plan(on_file, found):
    """One company's plan, every round compared with every other."""

    def closest(rows, r):
        fits = [(writeplan._gap(x["announced"], r["announced"]) if writeplan._gap(x["announced"], r["announced"]) is not None else 10**9, i) for i, x in enumerate(rows) if writeplan.same(x, r)]
        return rows[min(fits)[1]] if fits else None

    held, planned, patches, out = [dict(r) for r in on_file], [], {}, []
    for r in found:
        for rows in (held, planned):
            hit = closest(rows, r)
            if hit is None:
                continue
            if (why := writeplan.contradiction(hit, r)) is not None:
                out.append((r["company"], "conflict", hit.get("id"), r["seq"], r["round_type"], None, None, None, None, None, None, why))
            elif patch := writeplan.fill(hit, r):
                hit.update(patch)
                if rows is held:
                    patches.setdefault(hit["id"], (hit, {}))[1].update(patch)
            break
        else:
            planned.append(dict(r))
    fields = ("amount", "valuation", "announced", "lead", "source_url")
    for key, (hit, patch) in patches.items():
        out.append((hit["company"], "update", key, None, hit["round_type"], *(patch.get(f) for f in fields), tuple(patch.get("investors") or ()) or None, None))
    for r in planned:
        out.append((r["company"], "insert", None, r["seq"], r["round_type"], *(r[f] for f in fields), tuple(r["investors"] or ()) or None, None))
    return out


def drawn(rng, company, key, place, spread):
    amount = rng.choice([None, 1e6, 1.05e6, 1.12e6, 5e6, 5.2e6, 2e7, 0.0, -1.0])
    day = rng.choice([None, dt.date(2015, 1, 1) + dt.timedelta(days=rng.randrange(spread))])
    stage = rng.choice(["Seed", "Series A", "Series F+", "Other", "Growth", "Debt"])
    return {"company": company, place: key, "round_type": stage, "amount": amount, "valuation": rng.choice([None, 9e6]), "announced": day, "lead": rng.choice([None, "", "Acme", "Acme Capital", "Zeta"]), "source_url": rng.choice([None, "https://a.com/1"]), "investors": rng.choice([None, [], ["Acme"], ["Beta", "Beta Fund", "Fund"], ["Zeta Partners", "Gamma"]])}


@pytest.mark.parametrize("spread", [900, 4000])
def test_plan_against_a_plain_fold(spark, spread):
    rng = random.Random(spread)
    on_file = [drawn(rng, c, 1000 * c + i, "id", spread) for c in range(40) for i in range(rng.randint(0, 6))]
    found = [drawn(rng, c, 1000 * c + i, "seq", spread) for c in range(45) for i in range(rng.randint(0, 12))]
    want = Counter()
    for c in range(45):
        want.update(plain_plan([r for r in on_file if r["company"] == c], [r for r in found if r["company"] == c]))
    a = spark.createDataFrame([tuple(r.values()) for r in on_file], f"company long, id long, {ROUND}").repartition(3)
    b = spark.createDataFrame([tuple(r.values()) for r in found], f"company long, seq long, {ROUND}").withColumn("component", F.lit("x")).repartition(3)
    got = Counter((*x[:10], tuple(x[10] or ()) or None, x[11]) for x in map(tuple, writeplan.plan_round_writes(a, b).collect()))
    assert got == want
    assert {x[1] for x in want} == {"insert", "update", "conflict"}
    assert writeplan.plan_round_writes(a.limit(0), b.limit(0)).count() == 0


def test_late_stages_of_one_company(spark):
    """Letters from F on are rounds of their own by amount and time; one reported twice is one."""
    rows = [(1, 1, "Series F", 2e8, None, dt.date(2021, 10, 1), None, None, None), (1, 2, "Series G", 2.38e8, None, None, None, None, None), (1, 3, "Series G", 3.59e8, None, dt.date(2025, 6, 10), None, None, None), (1, 4, "Series G", 3.59e8, None, None, "Vitruvian Partners", None, None), (1, 5, "IPO", 1e9, None, None, None, None, None)]
    found = spark.createDataFrame(rows, f"company long, seq long, {ROUND}")
    got = writeplan.plan_round_writes(spark.createDataFrame([], f"company long, id long, {ROUND}"), found).collect()
    assert sorted((r.action, r.seq, r.amount, r.lead) for r in got) == [("insert", 1, 2e8, None), ("insert", 2, 2.38e8, None), ("insert", 3, 3.59e8, "Vitruvian Partners")]


def test_a_company_with_very_many_rounds_is_split(spark):
    """Stretches of dates and amounts part a company into components, each folded on its own."""
    rows = spark.range(20_000).select(
        F.lit(7).cast("long").alias("company"), F.lit(None).cast("long").alias("id"), F.col("id").alias("seq"), F.lit("Seed").alias("round_type"), F.pow(F.lit(1.5), F.col("id") % 40).alias("amount"), F.lit(None).cast("double").alias("valuation"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 40 * 400).cast("int")).alias("announced"), F.lit(None).cast("string").alias("lead"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("array<string>").alias("investors"),
    )
    sizes = [r["count"] for r in writeplan._components(rows).groupBy("component").count().collect()]
    assert len(sizes) == 40 and max(sizes) == 500


def test_round_writes(spark):
    from tessera.plans.catalog import load
    from tessera.plans.folds import order_rounds
    got = Counter(map(tuple, load()[0]["round_writes"](spark, FOLDER).collect()))
    rows = order_rounds(spark.read.parquet(f"{FOLDER}/orders.parquet")).withColumn("round_type", writeplan.round_label(F.col("round_type"))).orderBy("o_orderkey").collect()
    by, want = {}, Counter()
    for r in map(lambda x: x.asDict(), rows):
        key, done = r.pop("o_orderkey"), r.pop("o_orderstatus") == "F"
        by.setdefault(r["company"], ([], []))[0 if done else 1].append(r | ({"id": key} if done else {"seq": key}))
    for on_file, found in by.values():
        for x in plain_plan(on_file, found):
            want[(*x[:10], ", ".join(x[10]) if x[10] is not None else None, x[11])] += 1
    assert got == want


def test_rounds_are_read_once(spark):
    """Stretches, bands and rounds come from one reading of what was given."""
    read = spark.sparkContext.accumulator(0)

    def counted(day):
        read.add(1)
        return day

    rng = random.Random(5)
    rows = [tuple(drawn(rng, i % 30, i, "seq", 2000).values()) for i in range(200)]
    found = spark.createDataFrame(rows, f"company long, seq long, {ROUND}").withColumn("announced", F.udf(counted, "date")("announced"))
    writeplan.plan_round_writes(spark.createDataFrame([], f"company long, id long, {ROUND}"), found).collect()
    assert read.value == 200


def test_lone_rounds_and_edges_of_batches(spark):
    """Components of one row go on as they are, also where a batch begins or ends; components over two batches are folded whole."""
    import pyarrow as pa

    rng = random.Random(8)
    sizes = [rng.choice([1, 1, 1, 2, 3]) for _ in range(120)]
    rows = [{"component": c, "id": None, **drawn(rng, 1, 10 * c + i, "seq", 90)} for c, n in enumerate(sizes) for i in range(n)]
    rows = [r | ({"id": r["seq"], "seq": None} if r["component"] % 5 == 0 else {}) for r in rows]
    fields = [pa.field("component", pa.int64()), *[f for f in writeplan._OUT if f.name not in ("action", "message")]]
    schema = pa.schema(fields)

    def planned(step):
        out = writeplan._plan(iter([pa.RecordBatch.from_pylist(rows[i : i + step], schema=schema) for i in range(0, len(rows), step)]))
        return Counter(repr(r) for batch in out for r in batch.to_pylist())

    want = Counter()
    for c in range(len(sizes)):
        want.update(repr({f.name: None for f in writeplan._OUT} | r) for r in writeplan.fold(iter([dict(r) for r in rows if r["component"] == c])))
    assert all(planned(step) == want for step in (1, 2, 3, 7, 1000))
    assert list(writeplan._plan(iter([]))) == []


def test_few_open_rounds_match_as_many_do(monkeypatch):
    rng = random.Random(9)
    for spread in (60, 400, 3000):
        rows = [drawn(rng, 1, i, "seq", spread) for i in range(60)]
        rows = [dict(r, id=r["seq"], seq=None) if i < 12 else dict(r, id=None) for i, r in enumerate(rows)]
        plans = []
        for few in (0, 8, 100):
            monkeypatch.setattr(writeplan, "FEW", few)
            plans.append(list(writeplan.fold(iter([dict(r) for r in rows]))))
        assert plans[0] == plans[1] == plans[2]


# news ---------------------------------------------------------------------------------------------------------------
NEWS = "company string, seq long, title string, url string, published date, lead string"


def plain_events(rows):
    """Items (with keys, words, own_site, preferred) in order, each held against every kept one."""

    def same(a, b):
        x, y = a["words"], b["words"]
        if a["day"] and a["day"] == b["day"] and min(len(x), len(y)) >= 4 and len(set(x) & set(y)) / min(len(x), len(y)) >= 0.6:
            return True
        return bool(set(a["keys"]) & set(b["keys"])) and (not a["day"] or not b["day"] or abs((a["day"] - b["day"]).days) <= 7)

    kept = []
    for r in rows:
        hit = next((k for k in kept if k[0]["company"] == r["company"] and same(r, k[0])), None)
        if hit is None:
            kept.append([r, r["seq"], 1])
            continue
        hit[2] += 1
        if newsevents.better(r, hit[0]):
            hit[0] = r
    return Counter((r["company"], place, r["seq"], r["title"], r["url"], r["day"], n) for r, place, n in kept)


def with_marks(df, own, preferred):
    text = F.concat_ws(" ", "title", "lead")
    rows = df.select("company", "seq", "title", "url", F.col("published").alias("day"), own.alias("own_site"), preferred.alias("preferred"), newsevents.event_keys(text).alias("keys"), newsevents.headline_words(F.col("title"), F.col("url")).alias("words"))
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["seq"], r["url"] or "", r["title"] or ""))


@pytest.mark.parametrize("companies", [3, 30])
def test_news_against_a_plain_pass(spark, companies):
    rng = random.Random(companies)
    pool = "northwind acquires contoso cloud platform raises series round funding europe growth market partner appoints chief officer launches product".split()
    rows = []
    for i in range(400):
        title = " ".join(rng.sample(pool, rng.randint(2, 7))) + rng.choice(["", " $5M", " 5 million", " $60m", " 1.5bn", ""])
        day = rng.choice([None, *[dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(120)) for _ in range(4)]])
        rows.append((rng.choice([None, *map(str, range(companies))]), i // 2, rng.choice([title, title, None]), rng.choice(["https://m.a.com/x", "https://b.com/contoso-cloud-platform.html", None, "not a url"]), day, rng.choice([None, "It raised $7M", ""])))
    df = spark.createDataFrame(rows, NEWS).repartition(4)
    own, preferred = F.coalesce(F.col("url").contains("://m."), F.lit(False)), F.coalesce(F.col("title").contains("acquires"), F.lit(False))
    got = Counter(map(tuple, newsevents.dedupe_news(df, own_site=own, preferred=preferred).collect()))
    assert got == plain_events(with_marks(df, own, preferred))
    assert newsevents.dedupe_news(df.limit(0)).count() == 0


def test_news_of_a_packed_file_meet_in_merged_joins(spark, tmp_path):
    spark.createDataFrame([(i, 7, i % 9, ["5m"]) for i in range(40)], "row long, firm long, at int, keys array<string>").write.parquet(f"file://{tmp_path}/news")
    placed = newsevents._by_events(spark.read.parquet(f"file://{tmp_path}/news"))
    assert "BroadcastHashJoin" not in placed._jdf.queryExecution().sparkPlan().toString()
    assert placed.count() == 40 and placed.select("node").distinct().count() == 1


@pytest.mark.parametrize(
    ("items", "kept"),
    [
        ([("CrowdStrike acquires cloud security provider Adaptive Shield", "https://siliconangle.com/a", "2024-11-06"), ("CrowdStrike acquires Adaptive Shield in $300M deal to boost identity protection", "https://calcalistech.com/b", None)], ["https://siliconangle.com/a"]),
        ([("Appcharge Raises $58 Million in Series B Round Led by IVP", "https://businesswire.com/a", "2025-08-13"), ("Appcharge raises $58M Series B as mobile games break from app stores", "https://glilotcapital.com/b", "2025-08-13")], ["https://businesswire.com/a"]),
        ([("HeyGen Surpasses $200M ARR as AI Video Adoption Accelerates", "https://www.heygen.com/blog/x", "2026-06-25"), ("HeyGen Doubles to $200M ARR in Eight Months", "https://www.businesswire.com/y", "2026-06-25")], ["https://www.businesswire.com/y"]),
        ([("Appcharge raises $26M", "https://a.com/1", "2024-11-25"), ("Appcharge raises $58M", "https://a.com/2", "2025-08-13")], ["https://a.com/1", "https://a.com/2"]),
    ],
)
def test_reports_of_one_event(spark, items, kept):
    rows = [("c", i, t, u, d and dt.date.fromisoformat(d), None) for i, (t, u, d) in enumerate(items)]
    got = newsevents.dedupe_news(spark.createDataFrame(rows, NEWS), own_site=F.col("url").contains("heygen.com")).orderBy("place").collect()
    assert [r.url for r in got] == kept


def test_news_events(spark):
    from tessera.plans.catalog import load
    from tessera.plans.folds import page_news

    url = F.col("url")
    df = page_news(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    want = plain_events(with_marks(df, url.contains("://m."), url.startswith("https")))
    got = Counter(map(tuple, load()[0]["news_events"](spark, FOLDER).collect()))
    assert got == want and any(r[-1] > 1 for r in want)


def test_rounds_without_an_amount(spark):
    from tessera.operators import rounds

    rows = [(1, 1, "Other", 41e6, dt.date(2023, 12, 7), None), (1, 2, "Series A", None, dt.date(2023, 12, 7), "Lightspeed"), (1, 3, "Series B", None, dt.date(2025, 3, 1), "Nvidia"), (1, 4, "Seed", None, None, "X"), (2, 5, "Seed", None, dt.date(2023, 12, 7), "Y"), (None, 6, "Seed", None, dt.date(2023, 12, 7), "Z")]
    df = spark.createDataFrame(rows, "company long, seq long, round_type string, amount double, day date, lead string")
    got = {r.seq: (r.round_type, r.lead) for r in rounds.absorb_amountless(df).collect()}
    assert got == {1: ("Series A", "Lightspeed"), 3: ("Series B", "Nvidia"), 4: ("Seed", "X"), 5: ("Seed", "Y"), 6: ("Seed", "Z")}
