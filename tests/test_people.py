"""Founders in prose, with the answers of the rule's own source, and whole texts against one text at a time."""

import pytest

from tessera.functions import people


@pytest.mark.parametrize(
    ("text", "company", "url", "want"),
    [
        ("Insightec was founded in 1999 by GE Healthcare and Elbit Medical Imaging.", "Insightec", None, []),
        ("GoCo.io, Inc. was founded in 2015 by Jason J. Wang, Michael Gugel, and Nir Leibovich.", "GoCo", None, ["Jason J. Wang", "Michael Gugel", "Nir Leibovich"]),
        ("Glints was founded in August 2013 by Oswald Yeo, Looi Qin En, and Seah Ying Cong.", "Glints", None, ["Oswald Yeo", "Looi Qin En", "Seah Ying Cong"]),
        ("HighLevel was co-founded by Shaun Clark (CEO), Varun Vairavan, and Robin Alex in 2018.", "HighLevel", None, ["Shaun Clark", "Varun Vairavan", "Robin Alex"]),
        ("Rival Acme, founded by John Doe, competes with Gladia.", "Gladia", None, []),
        ("Unlike Gladia, Speechmatics was founded by Tony Robinson.", "Gladia", None, []),
        ("Acme was founded by former Google engineers.", "Acme", None, []),
        ("Apex was founded by Ian Cinnamon and Max Benassi, Los Angeles, Calif.", "Apex", None, ["Ian Cinnamon", "Max Benassi"]),
        ("Thinking Machines Lab was founded by former OpenAI CTO Mira Murati, San Francisco.", "Thinking Machines Lab", None, ["Mira Murati"]),
        ("Cyera was founded by Cyberstarts' Gili Raanan and Tamar Bar-Ilan.", "Cyera", None, ["Tamar Bar-Ilan"]),
        ("Houzz was founded in 2009 by CEO Adi Tatarko and her husband Alon Cohen.", "Houzz", None, ["Adi Tatarko", "Alon Cohen"]),
        ("Griffin was founded by David Jarvis, Allen Rohner and Virgin Money.", "Griffin", None, ["David Jarvis", "Allen Rohner"]),
        ("Huskeys, founded in 2025 by Itai Gafni and Roy Weisfeld, raised an $8 million seed round led by 10D. The round included angel investors Ofer Ben-Noon, co-founder of Talon.", "Huskeys", None, ["Itai Gafni", "Roy Weisfeld"]),
        ("Dropbox is a file hosting service. It was founded by Drew Houston.", "Honeycomb Credit", "https://example.com/honeycomb-credit-alternatives", []),
        ("Gladia makes speech tools. The company was founded by Jane Roe and John Doe.", "Gladia", "https://example.com/gladia-series-a", ["Jane Roe", "John Doe"]),
        ("Gladia makes speech tools. The company was founded by Jane Roe and John Doe.", "Gladia", "https://example.com/speech-apis", []),
        ("", "Gladia", None, []),
    ],
)
def test_founders(text, company, url, want):
    assert [name for name, _, _ in people.founders_in(text, company, url)] == want


@pytest.mark.parametrize(
    ("raw", "name"),
    [("Yonatan Boguslavsky‏", "Yonatan Boguslavsky"), ("‎Zohar​ Einy", "Zohar Einy"), ("CEO Adi Tatarko", "Adi Tatarko"), ("⚡ Roland Ligtenberg", "Roland Ligtenberg"), ("Dr. Reece Akhtar", "Reece Akhtar"), ("Jean-Louis Quéguiner", "Jean-Louis Quéguiner"), ("As Karim Nour", "Karim Nour"), ("Karim Nour Co", "Karim Nour"), ("Jakub Krzych CEO", "Jakub Krzych"), ("Co Lee", "Co Lee")],
)
def test_clean_names(raw, name):
    assert people.clean_name(raw) == name


def test_same_person_in_a_task_and_in_a_column(spark):
    from pyspark.sql import functions as F

    from tessera.functions import names

    given = ["Jean-Louis Queguiner", "Jean-Louis Quéguiner", "John A. Smith", "John Smith", "Jane Smith", "Mitch Stewart", "Mitchell Stewart", "Albert Sebag", "Albert Sebago", "Dan Cohen", "Dan Cohn", "Dr. Jane Smith", "Smith", "Jane Smyth", "Šimon Novák", "Simon Novak", ""]
    pairs = [(a, b) for a in given for b in given]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", names.same_person(F.col("a"), F.col("b"))).collect()
    assert all(r[2] == people.same_person(r[0], r[1]) for r in got)


def test_pages(spark):
    rows = [(1, "Acme", None, None, "Acme was founded by Jane Roe and J. Doe Smith. " * 3), (2, None, None, None, "Acme was founded by Jane Roe."), (3, "Acme", None, None, None), (4, "Acme", None, "Acme: about", "It was founded by Jane Roe. " + "Word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, company string, url string, title string, text string")
    got = sorted((r.page_id, r.name) for r in people.founders(df).collect())
    assert got == sorted((i, n) for i, c, u, t, x in rows if c and x for n, _, _ in people.founders_in(x, c, u, t)) and len(got) == 3
    assert people.founders(df.limit(0)).count() == 0
