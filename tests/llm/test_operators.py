"""Each operator against a brute-force version, on odd rows and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import media, mixing, neardup, packing, quality, shared, spotsigs, tokenfile, tokens, url_filter, warc
from tessera.llm.queries import URL_RULES

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1 ------------------------------------------------------------------------------------------------------------------
URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?q=1", "https://a.example.com/en/8#x", "ftp://x.net/de/8/9", "http://b.example.net/de/8", "http://net", "http://org/es/", "http://notexample.com/en/7", "http://example.com:80/en/7", "http://a.b.c.org/es/1", "http://a.b.c.org/es/1", "x://://com/en/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_filter(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, prefix string")
    for limit in (url_filter.BROADCAST_RULES, 0):
        old, url_filter.BROADCAST_RULES = url_filter.BROADCAST_RULES, limit
        got = {r.page_id: (r.url_host, r.url_path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
        url_filter.BROADCAST_RULES = old
        assert got == {i: judged(u) for i, u in enumerate(URLS)}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# 2 ------------------------------------------------------------------------------------------------------------------
def wanted_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing(odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in odd_rows)
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    aims = wanted_targets(dict(sizes))
    taken, most = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= 2 * most[s]
    again = mixing.mix(odd.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mix(none).count() == 0
    rows = mixing.mixed_documents(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r.copies for r in got)


def test_flight_balances():
    rng = np.random.default_rng(1)
    size, pi = rng.integers(1, 1000, 3000), np.full(3000, 0.37)
    out = mixing.flight(pi, size, rng, False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())


# 3 ------------------------------------------------------------------------------------------------------------------
def test_warc(spark):
    gz = b"\x1f\x8b\x08".decode("latin-1")
    html = [None, "", "short", "short", "x" * 100, "x" * 100, "x" * 100, gz * 50 + "é", gz * 50 + "é", "WARC/1.1\r\na: b\r\n\r\n" * 20, "y" * 3_000_000]
    rows = [(10 - i, f"http://a/{i}\r\nx: y" if i % 2 else None, h, "z") for i, h in enumerate(html)] + [(None, "http://n", "n" * 200, "z"), (5, "again", "x" * 100, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    least = {}
    for p, _, h, _ in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        first = least.get(h or "", p)
        again = len(raw) >= 100 and p != first
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert Counter(map(tuple, warc.roundtrip(pages).collect())) == Counter(want)
    assert warc.roundtrip(pages.limit(0)).count() == 0
    archives = warc.write_warc(warc.with_record_types(pages))
    for split in (1000, 10_001):  # records are owned once whatever the ranges
        read = warc.read_warc(archives, split_bytes=split)
        assert read.count() == len(rows)
        payloads = {r.record_id: bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
        assert payloads["urn:page:0"] == html[10].encode()


# 4 ------------------------------------------------------------------------------------------------------------------
def test_spotsigs(odd, odd_rows, none):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = spotsigs.compare_with_next(odd, parts=3)
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert sum(map(len, by.values())) == len(rows)
    for i, (doc, text, *_) in enumerate(rows):
        if len(by[doc]) > 1:
            continue  # ties: their order depends on the texts
        after = rows[(i + 1) % len(rows)]
        if len(by[after[0]]) > 1:
            continue
        text, nxt, r = text or "", after[1] or "", by[doc][0]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(spotsigs.signature_hashes(x).tolist()) for x in (text, edited, nxt))
        assert set(spotsigs.from_string(r.fingerprint).tolist()) == a and set(spotsigs.from_string(r.edited_fingerprint).tolist()) == b
        j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(j(a, b)) and r.near_next == pytest.approx(j(a, c))
        assert r.edited_is_near == (j(a, b) >= 0.8) and r.next_is_near == (j(a, c) >= 0.8)
    assert by[5][0].fingerprint == by[6][0].fingerprint
    assert spotsigs.compare_with_next(none).count() == 0


def test_spotsigs_classes(odd, odd_rows):
    got = {r.id: r.class_id for r in spotsigs.near_classes(odd).collect() if r.id is not None and r.id not in (9, 10)}
    sets = {r[0]: set(spotsigs.signature_hashes(r[1] or "").tolist()) for r in odd_rows if r[0] not in (None, 9, 10)}
    for a in sets:
        for b in sets:
            alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
            if alike >= spotsigs.NEAR:
                assert got[a] == got[b]
    assert got[8] == 8 and got[5] == got[6]


# 5, 7, 8 ------------------------------------------------------------------------------------------------------------
def test_piece_encoder_is_exact(odd_rows):
    texts = [r[1] or "" for r in odd_rows] + ["\x1c a\x1cb", " lead", "trail ", "a\n b", "ΑΣ İ ǅ don't X'S 12½²", "é é", " x　y", "!!", "'s", " 's"]
    rng = random.Random(2)
    signs = [*map(chr, range(0x20, 0x250)), "ing", "tion", "'s", "中", "😀", "\u0301", "İ", "ẞ", "\x85", "\xa0", "\x1c", "  ", "\n"]
    texts += ["".join(rng.choice(signs) for _ in range(60)) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(40)) for _ in range(4000)]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "\t", "'s", "1", "!", "é", "中"]) for _ in range(80)) for _ in range(2000)] + ["a" * 30_000, "ab " * 30_000, " " * 5000 + "x"]
    for path in (BYTE, WORD):
        assert tokens.merges_by_rank(path)
        want = ids_of(path, texts)
        for by_rank in (False, True):
            enc, counts = tokens.PieceEncoder(path, by_rank=by_rank), tokens.PieceEncoder(path, lengths_only=True, by_rank=by_rank, entries=3000)
            counts.fix([(True, "tion", 1), (False, "ing", 1)] if path == BYTE else [(False, "ing", 1)])
            for text, ids in zip(texts, want):
                assert np.frombuffer(enc.ids(text), "<u4").tolist() == ids and counts.count(text) == len(ids)
            assert len(counts.head) <= 2  # the first tier stays what it was


def test_ranks_that_are_not_merges(tmp_path):
    import json

    spec = json.loads(open(BYTE, encoding="utf-8").read())
    model = spec["model"]
    kept = [m for m in model["merges"] if (m if isinstance(m, str) else " ".join(m)) != "t h"]
    for name, changed in (("dropped", model | {"merges": kept}), ("unordered", model | {"merges": model["merges"][::-1]}), ("dropout", model | {"dropout": 0.1})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | {"model": changed}), encoding="utf-8")
        assert not tokens.merges_by_rank(str(path))


def test_token_counts(odd, odd_rows, none):
    want = Counter((r[0], len((r[1] or "").encode()), len(i), len(i) > 1024) for r, i in zip(odd_rows, ids_of(BYTE, [r[1] for r in odd_rows])))
    assert Counter(map(tuple, tokens.token_counts(odd, BYTE).collect())) == want
    assert tokens.token_counts(none, BYTE).count() == 0


def test_packing(odd, odd_rows, none):
    got = packing.pack(odd, WORD).collect()
    want = Counter()
    for r, ids in zip(odd_rows, ids_of(WORD, [r[1] for r in odd_rows])):
        ids = ids + [0]
        for k in range(0, len(ids), 2048):
            want[r[0], k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= math.ceil(total / 2048) + 1
    assert packing.pack(none, WORD).count() == 0


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(0)
    for low in (1, 300, 700):
        counts = dict(Counter(rng.integers(low, 2049, 4000).tolist()))
        plan = packing.plan_bins(counts, 2048)
        used = Counter()
        for pattern, n in plan:
            assert sum(a * b for a, b in pattern) <= 2048
            for a, b in pattern:
                used[a] += b * n
        assert used == Counter(counts)
        lower = max(math.ceil(sum(k * v for k, v in counts.items()) / 2048), sum(v for k, v in counts.items() if k > 1024))
        assert sum(n for _, n in plan) <= 1.02 * lower + 1


def test_token_file(odd, odd_rows, none):
    rows = sorted(zip(odd_rows, ids_of(BYTE, [r[1] for r in odd_rows])), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    got = sorted(tokenfile.roundtrip(odd, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r, _ in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(i) + 1, crc(i + [2])) for r, i in rows)
    assert tokenfile.roundtrip(none, BYTE).count() == 0


def test_long_documents_fill_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 64)
    sizes = [10, 50, 60, 63, 64, 65, 500, 3, 3]
    folder = shared.scratch(spark, "runs")
    writer = tokenfile._FileWriter(f"{folder}/a.tid", 0)
    want, at = [], 0
    for doc, n in enumerate(sizes):
        ids = np.arange(at, at + n).astype("<u4").tobytes()
        writer.add(doc, ids)
        want.append((doc, at, n, zlib.crc32(ids)))
        at += n
    manifest = spark.createDataFrame(writer.close().to_pandas(), "part int, path string, offset long, n_bytes long, first long, n_ids long, n_docs long")
    assert manifest.count() == 6  # one for each block of whole documents, and one for a longer document and what fits after it
    assert sorted(map(tuple, tokenfile.read_token_files(manifest).collect())) == want


def test_range_coder():
    rng = np.random.default_rng(0)
    cases = [np.zeros(1), np.arange(255), rng.integers(0, 2**32, 3000), np.arange(70_000), rng.zipf(1.3, 20_000) % 50_000, np.zeros(5000)]
    for x in cases:
        x = x.astype(np.uint64).astype("<u4")
        assert (tokenfile.decode_block(tokenfile.encode_block(x), len(x)) == x).all()
    text = np.tile(rng.integers(0, 3000, 500), 100).astype("<u4")
    assert len(tokenfile.encode_block(text)) < len(text)


def test_damaged_block_is_noticed(tmp_path):
    path = tmp_path / "x.tid"
    with path.open("wb") as f:
        tokenfile.write_block(f, [(1, 300, False)], np.arange(300).astype("<u4").tobytes())
    raw = bytearray(path.read_bytes())
    raw[-1] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError), path.open("rb") as f:
        list(tokenfile.read_blocks(f))


# 6 ------------------------------------------------------------------------------------------------------------------
def test_media(odd, odd_rows, none):
    got = media.media_columns(odd).collect()
    want = Counter()
    for r in odd_rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in same.values())
    assert media.media_columns(none).count() == 0


def test_media_ranges_and_retries(odd, monkeypatch):
    folder, archives = media.write_archives(odd)
    n = odd.count()
    for split in (200, 5000):
        reader = media.ArchiveReader({"path": folder, "splitBytes": str(split)})
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == n
    tried, real = Counter(), media.read_member

    def flaky(source, offset):
        tried[offset] += 1
        if tried[offset] < 2:
            raise OSError("lost")
        return real(source, offset)

    monkeypatch.setattr(media, "read_member", flaky)
    reader = media.ArchiveReader({"path": folder})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == n


# 9 ------------------------------------------------------------------------------------------------------------------
def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    scored = quality.classify(docs, quality.fit(docs, train), keep_columns=["doc_id"]).select("row.doc_id", "keep", "p_low_quality", "p_toxic")
    rows = scored.join(held, "doc_id").collect()
    low = [(r.p_low_quality >= 0.5) == (r.quality == 0) for r in rows]
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(low) / len(low) > 0.95
    assert sum(r.keep for r in clean) / len(clean) > 0.95
    labelled = spark.createDataFrame([(5, 1, 0), (8, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.scores(odd, labelled).count() == odd.count()
    assert quality.scores(odd, labelled.limit(0)).where("keep").count() > 0
    assert quality.scores(none, labelled).count() == 0
    kept = quality.kept_documents(odd, labelled)
    assert kept.columns == odd.columns


@pytest.mark.parametrize("n", [100, 6000])
def test_top_share_is_of_all_words(n):
    words = [f"w{i}" for i in range(n)] + ["most"] * n
    assert quality.style(" ".join(words))[quality.STYLE.index("top_share")] == 0.5
    assert quality.style(" ".join(words[::-1]))[quality.STYLE.index("top_share")] == 0.5


@pytest.mark.parametrize("text", ["春の朝、子どもたちは川の近くで遊んでいた。空は青く、風はまだ少し冷たい。", "아침에 아이들은 강가에서 놀았다. 하늘은 파랗고 바람은 아직 차갑다.", "春天的早晨，孩子们在河边玩耍。天空很蓝，风还有点冷。", "𠀀𠀁𠀂 𠀃𠀄"])
def test_letters_past_the_latin_scripts(text):
    got = dict(zip(quality.STYLE, quality.style(text)))
    assert got["symbols"] == got["upper"] == 0.0
    assert got["top_share"] < 0.5 and got["word_length"] < 0.5
    assert quality.style("Ｓｐａｍ ＮＯＷ ７")[quality.STYLE.index("upper")] == 4 / 7
    assert quality.style("春 😀 ★")[quality.STYLE.index("symbols")] == 2 / 3


def test_clean_texts_past_the_latin_scripts_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    for text in ("春の朝、子どもたちは川の近くで遊んでいた。空は青く、風はまだ少し冷たい。", "春天的早晨，孩子们在河边玩耍。天空很蓝，风还有点冷。", "아침에 아이들은 강가에서 놀았다. 하늘은 파랗고 바람은 아직 차갑다."):
        assert model.evidence(text)[0] < 0
    assert model.evidence("★☆" * 40)[0] > 0


# 10 -----------------------------------------------------------------------------------------------------------------
def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Least id of each row's class over all pairs; equal texts are one class."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    pairs = {(a, b) for v in index.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for i, (_, t) in enumerate(rows):
        j = first.setdefault(t or "", i)
        root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    brute_classes.number = len({find(i) for i in range(len(rows))})
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(odd, odd_rows, none):
    got = neardup.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(brute_classes([(r[0], r[1]) for r in odd_rows]))
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == brute_classes.number


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_near_duplicates_of_documents(spark, block, monkeypatch):
    monkeypatch.setattr(neardup.linked_classes, "__kwdefaults__", {"similar": 0.8, "block": block})
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()) == Counter(want)


def test_near_duplicates_with_repeated_lines(spark):
    rng, rows = random.Random(3), []
    for i in range(24):
        n, times = ((70, 100), (70, 1000), (96, 1000))[i % 3]
        base, line = ([f"w{rng.randrange(10**9)}" for _ in range(k)] for k in (n + 4, 12))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + line * times))]
    want = brute_classes(rows)
    assert all(c == i - i % 2 for i, c in want)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(want)


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = corpus_pipeline.run(spark, folder)
    assert out.select(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
