"""Near-duplicates: repeated ids, and components of large stars."""

import random

from pyspark.sql import functions as F

from rowloom.llm import hyperminhash
from rowloom.llm.common import words

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, size, percent):
    """Ids as vertices, linked through each of their texts that have words."""

    def shingles(t):
        ws = words(t)
        n = min(size, len(ws))
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()

    sets = [(i, shingles(t)) for i, t in rows]
    at = {i: i for i, _ in rows}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                at[b] = a
    # A row without words is linked with nothing, whatever its id.
    return sorted((i, len(x), find(i) if x else i, find(i) == i or not x) for i, x in sets)


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rnd = random.Random(4)
    text = lambda n=60: " ".join(rnd.choices(WORDS, k=n))
    u, v, x, y = text(), text(), text(), text()
    rows = [(1, u), (1, v), (3, v + " tail"), (5, x), (5, y), (2, x + " end"), (9, y), (9, ""), (7, text()), (8, u + " more"), (4, text(1)), (6, "")]
    rows += [(20 + i, f"{x} {i}") for i in range(12)]
    got = hyperminhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=2, percent=80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(rows, 2, 80)


def test_components_of_heavy_stars(spark, monkeypatch):
    """Two stars of many members that a chain joins, with keys heavy from 100 rows on: dealt out, and the same as without."""
    links = [(1, 10 + i) for i in range(3000)] + [(5000, 6000 + i) for i in range(2000)] + [(10, 4000), (4000, 4001), (4001, 6000), (9000, 9001)]
    df = spark.createDataFrame(links, "a long, b long")
    plain = {r["id"]: r["component"] for r in hyperminhash.components(df).collect()}
    monkeypatch.setattr(hyperminhash, "HEAVY", 100)
    dealt = {r["id"]: r["component"] for r in hyperminhash.components(df).collect()}
    assert plain == dealt and plain[9001] == 9000 and {c for i, c in plain.items() if i < 9000} == {1}
    left = df.select(F.col("a").alias("k"), F.col("b").alias("seat"))
    joined = hyperminhash.dealt_join(left, "k", "seat", df.groupBy("a").agg(F.max("b").alias("m")), "a", len(links))
    assert joined.count() == len(links) and "_salt" not in joined.columns


def test_few_rows_without_partners_need_few_jobs(spark):
    rows = spark.createDataFrame([(i, f"text number {i} of its own {i * i} kind {i + 7}") for i in range(9)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in hyperminhash.near_groups(rows, size=2).collect()) == list(range(9))
