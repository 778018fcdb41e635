"""Operators against brute force, and on rows that are null, empty, long, tied, repeated or misnamed."""

import hashlib
import html
import io
import itertools
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import chunk_dedup, feistel, fm_quality, hyperminhash, line_blocks, lm_interpolation, mixing, pu_toxicity, queries, raster, sentencepiece_table
from rowloom.llm.common import split_of, words

LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(20_000))
BASE = " ".join(f"tok{i}" for i in range(60))
EDGE = [
    (0, None, "en", "a"), (1, "", "en", None), (2, "  \t\n ", None, "a"), (3, "one", "en", "b"), (4, "ONE", "en", "b"), (5, "one  two\n three", "en", "b"), (6, "one two three", None, None),
    (6, "one two three", None, None), (7, LONG, "en", "a"), (8, LONG + " tail", "en", "a"), (9, BASE, "de", "c"), (10, BASE + " more", "de", "c"), (11, BASE.replace("tok3 ", "other "), "de", "c"),
    (None, "no id here", "en", "c"), (12, "▁mark　 é\u0000 \U0001f600  end ", "en", "c"), (13, "x" * 70_000, "en", "d"), (14, "the same", "en", "d"), (15, "the same", "fr", "e"), (16, "the same ", "fr", "e"),
]
CLASHING = ["n_chars", "kept", "ids", "size", "block", "row", "component", "score", "n_pseudonyms", "rank", "key", "salt", "recipe", "mix_shard"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, *(None if i % 3 == 0 else i for _ in CLASHING)) for i, r in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in CLASHING))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- toxicity and quality


def labelled(spark):
    texts = [(i, ("vile rotten filth " if i % 4 == 0 else "") + f"plain words number {i % 13} and more {i % 7} of them", i % 4 == 0) for i in range(200)]
    return spark.createDataFrame([(i, t, 40) for i, t, _ in texts], "doc_id long, text string, n_chars long"), spark.createDataFrame([(i, int(y), int(not y)) for i, _, y in texts if i % 3], "doc_id long, toxic int, quality int")


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs, labels = labelled(spark)
    model = pu_toxicity.fit(docs, labels, split_of("doc_id", 5) != 0)
    got = by_id(pu_toxicity.score(docs, model))
    assert all((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(200))
    kept = {r["doc_id"] for r in pu_toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i in range(200) if i % 4}


def test_toxicity_risk_gradient_is_bounded_below():
    # Far more positives than the prior says: the corrected part may not go negative for long.
    same = [np.array([4, 8], dtype=np.int32)] * 30
    weights, bias = pu_toxicity.train(same, same + [np.array([12], dtype=np.int32)] * 30, 0.3)
    assert np.isfinite(bias) and all(np.isfinite(list(weights.values())))


@pytest.mark.parametrize("case", ["none", "no_positive"])
def test_toxicity_without_positives(spark, edge, case):
    labels = spark.createDataFrame([] if case == "none" else [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = pu_toxicity.fit(edge, labels, split_of("doc_id", 5) != 0)
    got = pu_toxicity.score(edge, model).collect()
    assert len(got) == len(EDGE) and all(r["score"] < 1e-9 for r in got)


def test_quality_machine_identity():
    m = fm_quality.Machine()
    rng = np.random.default_rng(1)
    m.w = rng.normal(size=len(m.w))
    ids, x = np.array([3, 77, 900, 16390]), np.array([0.5, 0.5, 1.0, 1.0])
    plain = m.bias + m.w[ids] @ x + sum(m.v[a] @ m.v[b] * x[i] * x[j] for (i, a), (j, b) in itertools.combinations(enumerate(ids), 2))
    assert m.margin(ids, x) == pytest.approx(plain)


def test_quality_learns_and_takes_edge_rows(spark, edge):
    docs, labels = labelled(spark)
    model = fm_quality.fit(docs, labels, split_of("doc_id", 4) != 2)
    got = by_id(fm_quality.score(docs, model))
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 4 != 0) for i in range(200)]) > 0.95
    rows = fm_quality.score(edge, model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    none = fm_quality.fit(edge, spark.createDataFrame([], "doc_id long, quality int"), split_of("doc_id", 4) != 2)
    assert {r["score"] for r in fm_quality.score(edge, none).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op5_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["quality"] for r in got]) > 0.9
    tox = [r for r in queries.op1_toxicity(spark, sf).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in tox)
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["toxic"] for r in tox if r["held_out"]]) > 0.9


# --- pseudonyms


@pytest.mark.parametrize(
    "value,shape",
    [
        ("2021-02-28", r"\d{4}-\d\d-\d\d"), ("28.02.2021", r"\d\d\.\d\d\.\d{4}"), ("02/28/2021", r"\d\d/\d\d/\d{4}"), ("10.20.30.40", r"(\d{1,3}\.){3}\d{1,3}"), ("123-45-6789", r"\d{3}-\d\d-\d{4}"),
        ("DE89370400440532013000", r"DE\d{20}"), ("4111111111111111", r"\d{16}"), ("4111 1111 1111 1112", r"(\d{4} ){3}\d{4}"), ("+1 (499) 555-6503", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("ann.b7@mail.example.com", r"[a-z]{3}\.[a-z]\d@mail\.example\.com"),
    ],
)
def test_pseudonyms_keep_format_and_link(spark, value, shape):
    rows = [(1, f"a {value} b"), (2, f"{value}, and {value}"), (3, "nothing 3.0 here")]
    got = by_id(feistel.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")))
    new = got[1]["text"][2:-2]
    assert re.fullmatch(shape, new) and new != value
    assert got[2]["text"] == f"{new}, and {new}" and got[2]["n_pseudonyms"] == 2
    assert got[3]["text"] == rows[2][1]
    luhn = lambda s: sum(d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", s))))) % 10
    if len(re.sub(r"\D", "", value)) == 16 and "@" not in value:
        assert luhn(new) == luhn(value)
    if value.startswith("DE"):
        assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1


def test_pseudonyms_are_permutations(spark):
    n = spark.range(898 * 4).select(feistel.numeric(F.lit("k"), "t", F.col("id"), 898, 4).alias("y"))
    assert sorted(r["y"] for r in n.collect()) == list(range(898 * 4))
    s = spark.range(1000).select(feistel.string(F.lit("k"), "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("y"))
    assert sorted(r["y"] for r in s.collect()) == [f"{i:03d}" for i in range(1000)]


def test_pseudonyms_leave_the_rest(spark, edge):
    invalid = "300.1.2.3 2021-13-45 000-12-3456 DE00370400440532013000 12345 v1.2.3.4.5 3.0"
    rows = spark.createDataFrame([(1, invalid), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in feistel.pseudonymise(rows).orderBy("doc_id").collect()] == [invalid, None, ""]
    got = feistel.pseudonymise(edge)
    assert Counter(r["text"] for r in got.collect()) == Counter(t for _, t, *_ in EDGE) and set(got.columns) == set(edge.columns)


def test_pseudonyms_validate_cards_and_know_grouped_ibans_and_day_first_dates(spark):
    same = "1735689600001 9807915762804490 order 12345678901234567 31/02/2020 00/13/2020 DE89 3704 0044 0532 0130 01 25/12/1699"
    texts = {
        1: same, 2: "DE89 3704 0044 0532 0130 00", 3: "DE89370400440532013000", 4: "pay AT61 1904 3002 3457 3201 EUR 25", 5: "AT611904300234573201", 6: "25/12/2020", 7: "12/25/2020",
        8: "4111111111111111", 9: "4111 1111 1111 1111", 10: "NO93-8601-1117-947",
    }
    got = {i: r["text"] for i, r in by_id(feistel.pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).items()}
    assert got[1] == same and all(got[i] != texts[i] for i in texts if i > 1)
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", got[2]) and got[2].replace(" ", "") == got[3]
    assert re.fullmatch(r"pay AT\d\d( \d{4}){4} EUR 25", got[4]) and got[4][4:-7].replace(" ", "") == got[5]
    for iban in (got[3], got[5], got[10].replace("-", "")):
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    day, month, year = map(int, got[6].split("/"))
    assert 12 < day <= 31 and 1 <= month <= 12 and 1700 <= year < 2100 and int(got[7][:2]) <= 12
    assert got[9].replace(" ", "") == got[8]


def test_day_first_pseudonyms_are_a_permutation(spark):
    days = spark.sql("select explode(sequence(date'1700-01-01', date'2099-12-31')) d").where("day(d) > 12").select(F.date_format("d", "dd/MM/yyyy").alias("v"))
    rows = days.select("v", feistel.pseudonym(F.col("v"), F.lit("k")).alias("w")).toPandas()
    assert len(rows) == 88497 and set(rows["v"]) == set(rows["w"]) and (rows["v"] != rows["w"]).mean() > 0.99


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href="/">Site</a><h2>Brand</h2></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><div class="cookie-notice">We use cookies &amp; more.</div>
<!-- <p>hidden</p> --><div class="ad-slot ad">Buy now! Great offers on everything you ever wanted to have.</div>{main}
<aside>Related things to read</aside><section id="comments"><p>A reader wrote a fairly long comment on this article, full of opinion.</p></section>
<form><label>Mail</label><input name=x></form><footer>&copy; site &middot; all rights</footer></body></html>"""
BODY = "<h1>Head &lt;line&gt;</h1><p>First <b>bold</b>er paragraph &eacute;&#33; with\n  enough words to be the main text of the page.<p>Second &amp; last, which is long enough to count for the distribution.<br>Short."
WANT = "Head <line> First bolder paragraph é! with enough words to be the main text of the page. Second & last, which is long enough to count for the distribution. Short."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div>{}</div></main>", "<div id='page'>{}</div>"])
def test_main_text(wrap):
    assert line_blocks.main_text(PAGE.replace("{main}", wrap.format(BODY))) == WANT


def test_main_text_edges(spark):
    assert [line_blocks.main_text(x) for x in (None, "", "<nav>x</nav>", "plain", "<p", "<<>>", "<!-- open")] == ["", "", "", "plain", "<p", "<<>>", ""]
    big = "<article>" + "<p>para &amp; text</p>" * 30_000 + "</article>"
    assert line_blocks.main_text(big) == " ".join(["para & text"] * 30_000)
    deep = "<div>" * 3000 + "text in the deep" + "</div>" * 3000
    assert line_blocks.main_text(deep) == "text in the deep"
    rows = spark.createDataFrame([(1, None, None, 5), (2, "u", PAGE.replace("{main}", BODY), 6)], "page_id long, url string, html string, n_chars long")
    got = {r["page_id"]: r for r in line_blocks.extract(rows).collect()}
    assert got[1]["text"] == "" and got[1]["n_chars"] == 0 and got[2]["text"] == WANT and got[2]["n_chars"] == len(WANT)


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<p>{}</p>", "<article><p>{}</p><aside>Related things</aside></article>", "<main>{}<form>Mail</form></main>"])
@pytest.mark.parametrize("text", ["Alone.", "One block of text that stands alone between furniture. " * 20])
def test_main_text_of_one_block(wrap, text):
    page = f"<body><nav>Menu</nav>{wrap.format(text)}<footer>All rights</footer></body>"
    assert line_blocks.main_text(page) == text.strip()
    advert = '<div class="ad">Buy now! Great offers on everything you ever wanted.</div>'
    assert line_blocks.main_text(f"<body>{advert}<p>{LONG[:300]}</p>{advert}<p>{LONG[:280]}</p>{advert}</body>") == f"{LONG[:300].strip()} {LONG[:280].strip()}"


def test_main_text_is_found_by_the_windows_not_by_the_tag():
    card = "<article><a href='/x'>Other story</a></article>"
    long, short = LONG[:900].strip(), LONG[:400].strip()
    assert line_blocks.main_text(f"<body>{card}<aside>x</aside><div><p>{long}</p></div>{card}</body>") == long
    # An article is taken where its own text is near to the longest, and within its bounds only.
    assert line_blocks.main_text(f"<body><div><p>{long}</p></div><aside>x</aside><article><p>{short}</p></article><p>by</p></body>") == short
    cut = f"<p>{short}</p><aside>x</aside>" * 4
    assert line_blocks.main_text(f"<article>{cut}</article><article><p>{long}</p></article>") == " ".join([short] * 4)
    page = PAGE.replace("{main}", f"<article>{BODY}</article>")
    assert line_blocks.main_text(page, tags=False) == WANT == line_blocks.main_text(page)


@pytest.mark.parametrize(
    "attribute",
    ['id="discussion"', 'id="related-work"', 'id="side-effects"', 'class="legal-history"', 'id="follow-up"', 'id="market-share"', 'class="forms"', 'class="popular"', 'id="search"', 'class="tags"', 'class="notice"', 'id="alert"', 'id="hidden-costs"', 'id="social-impact"'],
)
def test_main_text_keeps_named_sections_of_an_article(attribute):
    body = f"<h1>Head</h1><p>One.</p><section {attribute}><h2>Part</h2><p>We found <a href='/x'>it</a> so.</p></section><p>Two <span {attribute}>words</span>.</p>"
    assert line_blocks.main_text(PAGE.replace("{main}", f"<article>{body}</article>")) == "Head One. Part We found it so. Two words."


@pytest.mark.parametrize(
    "furniture",
    ['<div class="ad">Buy now, it is great.</div>', '<div id="google_ads_iframe_1">Buy now, it is great.</div>', '<div class="related"><h3>Related</h3><ul><li><a href="/a">Another story.</a><li><a href="/b">One more.</a></ul></div>', '<p class="tags">Tags: <a href="/t">tag</a></p>',
     '<section id="comments"><p>A reader wrote a fairly long comment on this.</p></section>', '<div class="share-buttons">Tell your friends about it.</div>', '<div class="post-tags"><a href="/t">t</a></div>', '<div class="legal">All rights reserved</div>'],
)
def test_main_text_drops_furniture_of_an_article(furniture):
    for end in ("<p>Two.</p></article>", ""):
        page = f"<body><nav>Menu</nav><article><h1>Head</h1><p>One.</p>{furniture}{end}"
        assert line_blocks.main_text(page) == ("Head One. Two." if end else "Head One.")


@pytest.mark.parametrize("cut", ['<div class="ad">Buy now! It is great.</div>', "<aside>Related</aside>", '<div class="share"><a href="/s">Share</a></div>'])
@pytest.mark.parametrize(
    "wrap",
    [("<div id='page'>", "</div>"), ("<div id='page'><div>", "</div></div>"), ("<table><tr><td>", "</table>"), ("", ""), ("<section class='part'>", "</section>")],
)
def test_main_text_joins_what_furniture_separates(cut, wrap):
    parts = [f"<h1>Head</h1>{cut}", f"<p>{LONG[:200]}</p>" * 8 + cut, f"<h2>Short</h2>{cut}", f"<div class='box'><p>{LONG[:60]}</p></div>{cut}", f"<p>{LONG[:100]}</p><p>{LONG[:80]}</p>{cut}<p>The end.</p>"]
    inside = (wrap[1] + wrap[0]).join(parts) if "part" in wrap[0] else "".join(parts)
    page = f"<body><nav>Menu</nav>{wrap[0]}{inside}{wrap[1]}<footer>All rights</footer></body>"
    want = ["Head", *[LONG[:200]] * 8, "Short", LONG[:60], LONG[:100], LONG[:80], "The end."]
    assert line_blocks.main_text(page) == " ".join(" ".join(want).split())
    other = "<aside>x</aside><div><p>A text of another column, long enough to be a surge.</p></div><footer>"
    assert line_blocks.main_text(page.replace("<footer>", other)) == line_blocks.main_text(page)


def test_main_text_of_the_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op3_main_text(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


# --- near duplicates


def brute_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if w else set()
    at = {i: i for i in sets}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            at[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_equal_brute_force(spark, docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = np.random.default_rng(3)
    for i in range(60):  # a chain: each text is near to the one before it, not to all
        w = [f"c{i + j}" for j in range(40)]
        rows.append((10_000 + i, " ".join(w)))
    for i in range(150):  # one group of near copies
        w = [f"g{j}" for j in range(80)]
        w[rng.integers(80)] = f"r{i}"
        rows.append((20_000 + i, " ".join(w)))
    rows += [(30_000 + i, " ".join(f"s{j}" for j in range(i % 9))) for i in range(30)]
    got = by_id(hyperminhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=size))
    want = brute_near(rows, size, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_groups_compare_all_blocks(spark, monkeypatch):
    # Two components in every bucket, larger than a block: stars leave them apart, blocks compare them.
    monkeypatch.setattr(hyperminhash, "BLOCK", 4)
    rows = [(i, " ".join([f"k{j}" for j in range(50)] + [f"m{i % 3}_{j}" for j in range(6 + i % 5)])) for i in range(40)]
    got = by_id(hyperminhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=1))
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in brute_near(rows, 1, 80).items()}


def test_register_estimate():
    order = hyperminhash.borrow_order()
    rng = np.random.default_rng(5)
    errors = []
    for n, share in ((20, 0.8), (200, 0.8), (5000, 0.5), (50_000, 0.9)):
        for _ in range(10):
            x = rng.integers(0, 2**63, size=2 * n, dtype=np.uint64)
            both = round(2 * n * share / (1 + share))
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:both], x[n : 2 * n - both]]))
            j = both / (2 * n - both)
            agree = (hyperminhash.registers(a, order) == hyperminhash.registers(b, order)).mean()
            errors.append(float(hyperminhash.estimate(np.array([agree]), n, np.array([n]))[0]) - j)
    assert np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.03


def test_near_groups_of_short_texts_with_a_low_estimate(spark):
    # Eight of ten words are shared, but only 0.625 of the registers agree, which mostly are borrowed.
    a, b = (" ".join(f"w4391x{i}" for i in range(k, 10)) for k in (0, 2))
    got = by_id(hyperminhash.near_groups(spark.createDataFrame([(1, a), (2, b), (3, "other words")], "doc_id long, text string"), size=1))
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[3]["component_id"] == 3


def test_near_groups_edges(spark, edge):
    got = hyperminhash.near_groups(edge, size=2).collect()
    assert len(got) == len(EDGE)
    r = {x["doc_id"]: x for x in got}
    assert all(r[i]["n_shingles"] == 0 and r[i]["component_id"] == i and r[i]["kept"] for i in (0, 1, 2))
    assert r[4]["component_id"] == 3 and r[10]["component_id"] == 9 and r[11]["component_id"] == 9 and r[8]["component_id"] == 7 and r[16]["component_id"] == 14
    assert r[None]["kept"] and r[None]["component_id"] is None
    assert hyperminhash.near_groups(edge.limit(0), size=2).count() == 0


# --- exact duplicates


def brute_exact(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    least = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    return sorted(((i, least(ids), len(ids), i == least(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=str)


def same_rows(got):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()), key=str)


def test_exact_groups_edges(edge):
    assert same_rows(chunk_dedup.exact_groups(edge)) == brute_exact([(i, t) for i, t, *_ in EDGE])
    assert chunk_dedup.exact_groups(edge.limit(0)).count() == 0


def test_exact_groups_verify_fingerprints(spark, docs):
    """With a fingerprint of three values, contents collide everywhere; results must not change."""
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 60").collect()] + [(1000 + i, t) for i, (_, t, *_) in enumerate(EDGE)]
    bad = lambda c: F.pmod(F.length(c), F.lit(3)).cast("long")
    got = chunk_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), fingerprint=bad)
    assert same_rows(got) == brute_exact(rows)


def test_chunks_restore_text_and_realign(spark, docs):
    text = " ".join(re.sub(r"\s+", " ", r["text"]) for r in docs.orderBy("doc_id").limit(20).collect())
    rows = spark.createDataFrame([(text,), ("inserted here " + text,)], "t string").select(chunk_dedup.chunks(F.col("t")).alias("c")).collect()
    assert "".join(rows[0]["c"]) == text
    assert len(set(rows[0]["c"]) & set(rows[1]["c"])) > 0.8 * len(rows[0]["c"])


# --- media


def test_images_round_trip():
    rng = np.random.default_rng(2)
    for shape in ((1, 64, 3), (7, 5, 3), (33, 10, 3)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (raster.decode(raster.encode_ppm(x)) == x).all() and (raster.decode(raster.encode_bmp(x)) == x).all()
    grey = rng.integers(0, 256, (9, 11), dtype=np.uint8)
    assert (raster.decode(raster.encode_ppm(grey)) == grey).all()
    assert raster.decode(b"P2 # note\n2 1 15\n0 15\n").tolist() == [[0, 255]]
    assert raster.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]] and raster.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert raster.decode(b"P6\n1 1\n65535\n" + struct.pack(">HHH", 0, 32768, 65535)).tolist() == [[[0, 128, 255]]]
    palette = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 8) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 8, 0, 0, 0, 0, 2, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + bytes([1, 0, 0, 0])
    assert raster.decode(palette).tolist() == [[[6, 5, 4], [3, 2, 1]]]


def test_area_resize_equals_brute_force(monkeypatch):
    monkeypatch.setattr(raster, "STRIP", 5)
    rng = np.random.default_rng(4)
    for h, w in ((13, 7), (3, 20), (1, 64), (16, 9)):
        x = rng.integers(0, 256, (h, w)).astype(np.uint8)
        rows, cols = 8, 9
        big = np.kron(x, np.ones((rows, cols)))  # every source pixel as rows x cols equal ones
        want = big.reshape(rows, h, cols, w).mean(axis=(1, 3))
        assert np.allclose(raster.area_resize(x, rows, cols), want)


def test_media_of_texts(spark, edge):
    for form in ("ppm", "bmp"):
        stored = raster.text_images(edge, form=form)
        got = by_id(raster.decode_column(stored, ["doc_id", "n_bytes"]))
        for i, t, *_ in EDGE:
            raw = (t or "").encode()
            pad = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
            r = got[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
            assert len(r["feature"]) == 16 and np.load(io.BytesIO(r["tile"])).shape == (16, 16, 3)
    bad = spark.createDataFrame([(1, bytearray(b"P6 9 9 255\n")), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(b""))], "doc_id long, media binary")
    assert all(r["problem"] and r["feature"] is None for r in raster.decode_column(bad, ["doc_id"]).collect())


# --- language model


def brute_base(rows, parts=7):
    tokens = {i: [*words(t), b""] for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode() if i is not None else b"") % parts != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    return {i: (len(ws), sum(w in train for w in ws), n, sum(np.log10((train[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def test_model_counts_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = by_id(lm_interpolation.score(docs, split_of("doc_id", 7) != 2))
    for i, (n, known, total, base) in brute_base(rows).items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_mixture_equals_brute_force(spark, order, monkeypatch):
    texts = [(i, " ".join(f"v{(i * 7 + j * j) % 11}" for j in range(i % 12))) for i in range(80)] + [(80, None), (None, "v1 v2")]
    learned = [np.full(lm_interpolation.FREQUENCIES, x) for x in (0.9, 0.6, 0.3)[:order]]
    for w in learned[1:]:
        w[0] = 0
    monkeypatch.setattr(lm_interpolation, "weights", lambda *a: learned)
    got = by_id(lm_interpolation.score(spark.createDataFrame(texts, "doc_id long, text string"), split_of("doc_id", 7) != 2, order=order))
    grams, contexts = Counter(), Counter()
    pad = [b""] * 2
    train = [pad + words(t) + [b""] for i, t in texts if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2]
    for s in train:
        for j in range(2, len(s)):
            for k in range(1, order + 1):
                grams[tuple(s[j - k + 1 : j + 1])] += 1
                contexts[(k, *s[j - k + 1 : j])] += 1
    v, n = len({g for g in grams if len(g) == 1}), sum(len(s) - 2 for s in train)
    for i, t in texts:
        s, want = pad + words(t) + [b""], 0.0
        for j in range(2, len(s)):
            p = 1 / (v + 1)
            for k in range(1, order + 1):
                c = n if k == 1 else contexts[(k, *s[j - k + 1 : j])]
                share = learned[k - 1][1] if c else 0.0
                p = share * (grams[tuple(s[j - k + 1 : j + 1])] / c if c else 0) + (1 - share) * p
            want += np.log10(p)
        assert got[i]["score"] == pytest.approx(want)


def test_model_of_many_blocks_equals_that_of_few(spark, docs, monkeypatch):
    """Two levels of ranges, with many small blocks, tell the same counts as one."""
    once = by_id(lm_interpolation.score(docs, split_of("doc_id", 7) != 2))
    monkeypatch.setattr(lm_interpolation, "KEYS_OF_RANGE", 400)
    monkeypatch.setattr(lm_interpolation, "RANGES", 3)
    monkeypatch.setattr(lm_interpolation, "GROUP_BLOCKS", 5)
    monkeypatch.setattr(lm_interpolation, "BLOCK_BYTES", 20_000)
    made = lm_interpolation.materialise(lm_interpolation.blocks(docs, F.when(split_of("doc_id", 7) != 2, 1).otherwise(0)), "many")
    assert made.count() > 20 and made.agg(F.sum("tokens")).first()[0] > 16 * 400
    got = by_id(lm_interpolation.score(docs, split_of("doc_id", 7) != 2))
    assert got.keys() == once.keys()
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (once[i]["n_tokens"], once[i]["n_known"], once[i]["train_tokens"])
        assert r["base_score"] == pytest.approx(once[i]["base_score"]) and r["score"] == pytest.approx(once[i]["score"])


def test_fine_ranges_lie_within_coarse_ones():
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    coarse = lm_interpolation._bounds(keys, 7)
    for a, b in itertools.pairwise(coarse):
        cut = lm_interpolation._bounds_within(keys[a:b], 7, 5)
        assert cut[0] == 0 and cut[-1] == b - a and (np.diff(cut) >= 0).all() and (np.diff(cut) > 50).all()


def test_model_is_a_distribution_and_em_rises():
    ratio, weight = np.array([0.0, 0.5, 4.0]), np.array([3.0, 2.0, 5.0])
    best = lm_interpolation._em(ratio, weight)
    like = lambda s: (weight * np.log(s * ratio + 1 - s)).sum()
    assert like(best) >= max(like(s) for s in np.linspace(0.01, 0.99, 99)) - 1e-6


def test_model_edges(spark, edge):
    got = lm_interpolation.score(edge, split_of("doc_id", 7) != 2).collect()
    assert len(got) == len(EDGE) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    none = lm_interpolation.score(edge, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["score"] == 0 for r in none)  # one unknown word is all there is
    assert lm_interpolation.score(edge.limit(0), split_of("doc_id", 7) != 2).count() == 0


# --- encoding


def test_encoding_equals_the_library(spark, docs, edge):
    encoder = sentencepiece_table.ChunkEncoder(sentencepiece_table.model_bytes(), table_size=50)
    assert encoder.separable
    rng = np.random.default_rng(9)
    alphabet = [*"ab  ▁\n\t é中　\xa0​\u0000ﬁ½<s>/0x\r…—'", "\U0001f600", "the", "<unk>", "</s>", "   "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 16))) for _ in range(4000)] + [t for _, t, *_ in EDGE if t] + [r["text"] for r in docs.limit(50).collect()]
    for t in texts:
        assert encoder.encode(t) == encoder.sp.encode(t)
    got = by_id(sentencepiece_table.digests(edge))
    for i, t, *_ in EDGE:
        ids = encoder.sp.encode(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoder.sp.decode(ids).encode() if ids else b"").hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
    full = sentencepiece_table.encode(edge)
    assert full.columns.count("ids") == 1 and full.count() == len(EDGE)


# --- mixing


def test_targets_fill_up():
    got = mixing.targets([("b", 10), ("a", 100), (None, 1000)])
    assert got["b"] == 20 and got["a"] == 200 and got[None] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_split_tree_deals_exact_quotas():
    quota = np.array([17, 0, 64, 5])
    dealt = mixing.split_tree(quota, 8, 1)
    assert (dealt.sum(axis=0) == quota).all() and (dealt >= 0).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 1
    assert (dealt == mixing.split_tree(quota, 8, 1)).all()


def test_mix_meets_targets(spark, docs, edge):
    plan = mixing.plan(docs).collect()
    assert plan and len(plan) == docs.count()
    again = sorted(mixing.plan(docs.repartition(3)).collect())
    assert again == sorted(plan)
    by = defaultdict(list)
    for r in plan:
        by[r["source"]].append(r)
        assert r["copies"] in (0, 1, 2)
    sizes = [(s, sum(r["size"] for r in rs)) for s, rs in by.items()]
    goal = mixing.targets(sizes)
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(goal[s]) and rs[0]["source_size"] == dict(sizes)[s]
        assert abs(sum(r["size"] * r["copies"] for r in rs) - goal[s]) <= max(r["size"] for r in rs)
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})


def test_mix_edges(edge):
    plan = mixing.plan(edge).collect()
    assert len(plan) == len(EDGE)
    assert {r["doc_id"]: r["size"] for r in plan}[0] == 0 and all(r["copies"] <= 2 for r in plan)
    mixed = mixing.mix(edge)
    assert mixed.columns == [*edge.columns[:-1], "mix_shard", "mix_order"]
    assert Counter(r["text"] for r in mixed.collect()) == Counter(t for r in {x["doc_id"]: x for x in plan}.values() for i, t, *_ in EDGE if i == r["doc_id"] for _ in range(r["copies"]))
    assert mixing.plan(edge.limit(0)).count() == 0 and mixing.mix(edge.limit(0)).count() == 0
