"""Filter audit, spelling variants and personal data, each against a plain version."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, pii, shared, spelling
from tessera.llm.queries import op13_personal_data

LABELS = "doc_id long, quality int, toxic int, part string"


# filter audit -------------------------------------------------------------------------------------------------------
def plain_audit(rows, labels):
    good, toxic = {i for i, q, _, _ in labels if q == 1} - {None}, {i for i, _, t, _ in labels if t == 1} - {None}
    docs = []
    for doc_id, text, _, source, *_ in rows:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in rows),
        }
        docs.append((source or "", {f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, through = [d for d in docs if d[0] == part], Counter()
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in mine if f in d[1]]
                through[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*x, through[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


def test_audit_against_a_walk_through_all_orders(spark, odd, odd_rows, none):
    rng = random.Random(3)
    rows = odd_rows + [(500 + i, " ".join(rng.choice(["a", "b", "Cc", "#d", "e"]) for _ in range(rng.choice([20, 60, 200]))), "en", rng.choice(["a", "", None]), 1, "x", "y") for i in range(40)]
    rows += [(600 + i, rows[20 + i % 7][1], "en", "copies", 1, "x", "y") for i in range(30)]
    labels = [(i, i % 2, int(i % 5 == 0), "p") for i in range(0, 700, 3)] + [(6, 0, 0, "p"), (6, 1, 0, "p"), (None, 1, 1, "p")]
    docs, known = spark.createDataFrame(rows, odd.schema).repartition(4), spark.createDataFrame(labels, LABELS)
    got = sorted(map(tuple, filter_audit.filter_interactions(docs, known).collect()))
    assert got == plain_audit(rows, labels)
    assert filter_audit.filter_interactions(none, known).count() == 0
    no_labels = filter_audit.filter_interactions(odd, known.limit(0))
    assert no_labels.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_a_text_that_a_third_of_all_rows_share(spark, odd, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en", "ab"[i % 2], 1, None, None) for i in range(90)]
    got = filter_audit.filter_interactions(spark.createDataFrame(rows, odd.schema).repartition(4), spark.createDataFrame([], LABELS))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, [])


def test_paths_through_the_lattice():
    lat = filter_audit.lattice("ABCD")
    assert len(lat.orders) == 24 and lat.through.sum() == 24 * 4
    used = np.bincount(lat.steps.ravel(), minlength=len(lat.through))
    assert (used == lat.through).all()  # an edge is in as many orders as paths lead through it
    with pytest.raises(ValueError):
        filter_audit.lattice("ABCDEFGH")


# spelling variants --------------------------------------------------------------------------------------------------
def plain_words(rows):
    low, counts = str.maketrans(spelling.UPPER, spelling.LOWER), Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    near, patterns = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            patterns[w[:i] + "*" + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    for group in patterns.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("hot", [200, 3])
def test_variants_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    rng, words = random.Random(5), {}
    while len(words) < 700:  # few letters, so that many words are near and bigrams repeat
        words["".join(rng.choice("aabbé") for _ in range(rng.randint(6, 9)))] = 5 * 6 ** rng.randint(0, 6) + rng.randint(0, 3)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = sorted(map(tuple, spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key)
    want = sorted(plain_variants(words), key=key)
    assert got == want
    assert any(w != f and f != r for w, f, r, *_ in want if f)  # some chain has two steps


def test_words_of_whole_texts(spark, odd, odd_rows, none):
    rng = random.Random(8)
    pool = ["Running", "runing", "ÉTUDES", "études", "straße", "a÷bcdefg", "shorty", "five5letters", "x" * 3000]
    rows = odd_rows + [(700 + i, " ".join(rng.choices(pool, k=80)), "en", "a", 1, "x", "y") for i in range(30)] + [(None, "Running " * 9, "en", None, 1, "x", "y")]
    docs = spark.createDataFrame(rows, odd.schema).repartition(3)
    assert dict(map(tuple, spelling.word_counts(docs).collect())) == plain_words(rows)
    got = sorted(map(tuple, spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key)
    assert got == sorted(plain_variants(plain_words(rows)), key=key)
    assert spelling.spelling_variants(none).count() == 0


def test_pivots_are_the_lightest_that_do_not_overlap():
    rng = random.Random(1)
    for _ in range(300):
        at = sorted(rng.sample(range(9), rng.randint(3, 6)))
        prefix = [(i, rng.randint(0, 9)) for i in at]
        pairs = [(a, b) for a, b in itertools.combinations(prefix, 2) if b[0] - a[0] >= 2]
        weight = dict(prefix)
        got = spelling.pivots(prefix)
        assert got[1] - got[0] >= 2 and sum(weight[i] for i in got) == min(a[1] + b[1] for a, b in pairs)


# personal data ------------------------------------------------------------------------------------------------------
def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
    for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            if (14 <= len(digits) <= 19 and sum(doubled) % 10 == 0) if kind == 2 else 10 <= len(digits) <= 15:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def odd_strings(n):
    rng = random.Random(11)
    for _ in range(n):
        yield "".join(rng.choice(["1", "22", "333", "4111111111111111", ".", ".", "-", " ", " ", "+", "(", ")", "@", "a", "b.c", "é", "@x.de", "255", "256", "007", ":", "[.]"]) for _ in range(rng.randint(0, 40)))
    yield from ("a@b.c@d.e", "1.2.3.4.5.6.7.8", "٣.1.2.3", "+1 (269) 555-3296 4524132264652876", "x" * 4_000 + "@", "1" * 4_000, "1.2.3." + "0" * 5_000 + "4", "@" * 3_000)


def test_rules_against_the_plain_patterns():
    for text in odd_strings(4_000):
        assert pii.base_spans(text) == plain_base(text), text[:200]


def test_the_field_keeps_rules_and_adds_apart_from_them():
    field = pii.trained()
    for text in odd_strings(1_500):
        found = pii.find_spans(text, field)
        base, added = [x[:3] for x in found if x[3]], [x[:3] for x in found if not x[3]]
        assert base == plain_base(text)
        assert not any(s < e2 and s2 < e for s, _, e in added for s2, _, e2 in base)
        assert all(a[2] <= b[0] for a, b in itertools.pairwise(added))


def test_held_out_sentences():
    """Of entities that the rules can't have, most are found; of what the field adds, most is right."""
    field, right, wrong, missed = pii.trained(), 0, 0, 0
    for text, gold in pii.examples(600, 77):
        base = plain_base(text)
        added = {x[:3] for x in pii.find_spans(text, field) if not x[3]}
        open_ = {(s, k, e) for s, k, e in gold if not any(s < e2 and s2 < e for s2, _, e2 in base)}
        right, wrong, missed = right + len(added & open_), wrong + len(added - open_), missed + len(open_ - added)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95, (right, wrong, missed)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("+1 (269) 555-3296 4524132264652876 x", ["phone +1 (269) 555-3296", "card 4524132264652876"]),
        ("4980160719944918 4366089147969128", ["card 4980160719944918", "card 4366089147969128"]),
        ("call (269) 555-3296 now", ["phone (269) 555-3296"]),
        ("write to john at example dot com", ["email john at example dot com"]),
        ("from 192[.]168[.]0[.]1 again", ["ip 192[.]168[.]0[.]1"]),
        ("look at home. Then 2024-01-02 12:30:45", []),
        ("ISBN 978-3-16-148410-0, order 123456789, password=7602ad27cf5550de1c", []),
    ],
)
def test_what_the_field_adds(text, want):
    assert [f"{pii.KINDS[k]} {text[s:e]}" for s, k, e, _ in pii.find_spans(text, pii.trained())] == want


def test_best_path_is_the_likeliest_of_all_paths():
    """The dynamic programming against all sets of segments that don't overlap, and its sums against probabilities."""
    rng = random.Random(2)
    for _ in range(60):
        places = 6
        segs = sorted({(s, s + rng.randint(1, 2), rng.randrange(4)) for s in (rng.randrange(places - 2) for _ in range(5))})
        after = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)]
        scores = [rng.uniform(-2, 2) for _ in segs]
        field = pii.Field({str(i): x for i, x in enumerate(scores)}, after)
        top = max(e for _, e, _ in segs)
        paths = {}
        for r in range(len(segs) + 1):
            for chosen in itertools.combinations(range(len(segs)), r):
                parts = sorted(segs[i] for i in chosen)
                if all(a[1] <= b[0] for a, b in itertools.pairwise(parts)):
                    last = [0] + [k + 1 for *_, k in parts]
                    paths[chosen] = sum(scores[i] for i in chosen) + sum(after[x][k] for x, (*_, k) in zip(last, parts, strict=False))
        best = max(paths, key=paths.get)
        got = field.best([(s, e, k, [str(i)]) for i, (s, e, k) in enumerate(segs)])
        assert sorted((s, e, k) for s, k, e in got) == sorted(segs[i] for i in best)
        total = sum(map(np.exp, paths.values()))
        odds, _ = pii._expected(top + 1, segs, np.array(scores), np.array(after))
        assert np.allclose(odds, [sum(np.exp(v) for c, v in paths.items() if i in c) / total for i in range(len(segs))])


def test_personal_data_of_odd_rows(spark, odd, odd_rows, none, tmp_path):
    rows = odd_rows + [(800 + i, t[:500], "en", "a", 1, "x", "y") for i, t in enumerate(odd_strings(200))]
    spark.createDataFrame(rows, odd.schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in op13_personal_data(spark, str(tmp_path)).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        base = plain_base(text or "")
        write = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        every = [x[:3] for x in pii.find_spans(text or "", pii.trained())]
        want[(doc_id, *(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(write(base).encode()).hexdigest(), write(every))] += 1
    assert got == want
    assert pii.personal_data(none).count() == 0


def test_masked():
    assert pii.masked("mail a@b.de or 1.2.3.4", [("email", 5, 11), ("ip", 15, 22)]) == "mail <email> or <ip>"
    assert pii.masked("12 34", [("card", 0, 5), ("ip", 3, 5)]) == "<card>"
