"""Operators against plain versions of their methods, and what only many rows or odd inputs show."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import chunk_dedup, feistel, fm_quality, hyperminhash, line_blocks, mixing, pu_toxicity, queries, raster
from rowloom.llm.common import split_of

from .test_llm import EDGE, by_id, edge, labelled, same_rows, brute_exact  # noqa: F401

# --- toxicity


def test_toxicity_with_positives_only(spark):
    docs, labels = labelled(spark)
    only = labels.where("toxic = 1")
    model = pu_toxicity.fit(docs, only, split_of("doc_id", 5) != 0)
    kept = {r["doc_id"] for r in pu_toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i in range(200) if i % 4}
    # Labels of clean documents change nothing.
    assert pu_toxicity.fit(docs, labels, split_of("doc_id", 5) != 0) == model


def test_toxicity_bounds_are_parameters(spark):
    docs, labels = labelled(spark)
    is_train = split_of("doc_id", 5) != 0
    whole = pu_toxicity.fit(docs, labels, is_train, prior=0.25, max_positive=None, max_unlabelled=None, max_features=None)
    assert whole == pu_toxicity.fit(docs, labels, is_train, prior=0.25)
    small = pu_toxicity.fit(docs, labels, is_train, prior=0.25, max_unlabelled=40, max_features=5)
    assert len(small[0]) == 5
    with pytest.raises(ValueError):
        pu_toxicity.fit(docs, labels, is_train, prior=1.0)


def test_toxicity_calls_no_text_toxic_where_nothing_tells(spark):
    docs = spark.createDataFrame([(i, "the same words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, toxic int")
    got = pu_toxicity.score(docs, pu_toxicity.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == 60 and all(r["score"] < 0.5 for r in got)
    assert pu_toxicity.keep_clean(docs, pu_toxicity.fit(docs, labels, F.lit(True))).count() == 60


def test_toxicity_equals_brute_force(spark):
    docs, labels = labelled(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    in_train = {r["doc_id"] for r in docs.where(split_of("doc_id", 5) != 0).collect()}
    positive = [i for i in sorted(in_train) if i % 4 == 0 and i % 3]
    weights, bias = pu_toxicity.fit(docs, labels, split_of("doc_id", 5) != 0, prior=0.25)
    # Features by their definition, and the selection.
    of = {i: set(pu_toxicity.text_features(t)) for i, t in texts.items()}
    p = {f: sum(f in of[i] for i in positive) for f in set().union(*(of[i] for i in positive))}
    u = {f: sum(f in of[i] for i in in_train) for f in p}
    n_p, n_u, z = len(positive), len(in_train), {}
    for f in p:
        a, b, both = (p[f] + 0.5) / (n_p + 1), (u[f] + 0.5) / (n_u + 1), (p[f] + u[f] + 1) / (n_p + n_u + 2)
        score = (a - b) / math.sqrt(both * (1 - min(both, 0.999)) * (1 / n_p + 1 / n_u))
        if p[f] >= pu_toxicity.LEAST_IN and score >= pu_toxicity.LEAST_Z and a >= 2 * b:
            z[f] = score
    chosen = sorted(z)
    assert chosen and set(weights) == set(chosen)
    # The risk by its formula, over dense rows, and Adam as it is defined.
    x_p, x_u = (np.array([[f in of[i] for f in chosen] + [True] for i in some], dtype=float) for some in (positive, sorted(in_train)))
    w, m, v, prior = np.zeros(len(chosen) + 1), 0, 0, 0.25
    w[-1] = math.log(prior / (1 - prior))
    sigmoid = lambda t: 1 / (1 + np.exp(-t))
    for step in range(1, 401):
        loss = np.log1p(np.exp(x_u @ w)).mean() - prior * np.log1p(np.exp(x_p @ w)).mean()
        down = x_u.T @ sigmoid(x_u @ w) / n_u - prior * x_p.T @ sigmoid(x_p @ w) / n_p
        g = prior * x_p.T @ (sigmoid(x_p @ w) - 1) / n_p + down if loss >= 0 else -down
        g = g + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert bias == pytest.approx(w[-1], abs=1e-6) and [weights[f] for f in chosen] == pytest.approx(w[:-1], abs=1e-6)
    got = by_id(pu_toxicity.score(docs, (weights, bias)))
    for i, t in texts.items():
        assert got[i]["score"] == pytest.approx(sigmoid(bias + sum(weights.get(f, 0) for f in of[i])))


def test_what_a_sample_rules_out_is_never_chosen():
    rng = np.random.default_rng(8)
    n_p, n_u, n_some, f = 400, 50_000, 4000, 3000
    of_p, of_u = rng.beta(0.3, 3, f), rng.beta(0.2, 6, f)
    in_p, in_u = rng.binomial(n_p, of_p), rng.binomial(n_u, of_u)
    in_some = rng.hypergeometric(in_u, n_u - in_u, n_some)
    ids = np.arange(f)
    for most in (50, 400, None):
        left = pu_toxicity.possible(in_p, in_some, n_p, n_some, n_u, most)
        whole = pu_toxicity.strongest(ids, in_p, in_u, n_p, n_u, most)
        assert left[whole].all() and left.sum() < f
        assert pu_toxicity.strongest(ids[left], in_p[left], in_u[left], n_p, n_u, most).tolist() == whole.tolist()


def test_prior_estimate_is_near_and_inside():
    rng = np.random.default_rng(1)
    row = lambda toxic: np.flatnonzero(rng.random(6) < (0.8 if toxic else 0.01)).astype(np.int32)
    got = pu_toxicity.estimate_prior([row(True) for _ in range(400)], [row(rng.random() < 0.2) for _ in range(4000)], 6)
    assert 0.17 < got < 0.24
    same = [np.array([0], dtype=np.int32)] * 5
    assert 0 < pu_toxicity.estimate_prior(same, same, 1) <= 0.95 and 0 < pu_toxicity.estimate_prior(same[:1], same, 1) <= 0.95


# --- quality


def test_quality_equals_brute_force(spark):
    docs, labels = labelled(spark)
    machine, _ = model = fm_quality.fit(docs, labels, split_of("doc_id", 4) != 2)
    got = by_id(fm_quality.score(docs, model))
    known = {r["doc_id"]: r["quality"] for r in labels.where(split_of("doc_id", 4) != 2).collect()}
    for r in docs.where("doc_id < 40").collect():
        ws = r["text"].encode().split()
        ids, x = machine.inputs(sorted(fm_quality.word_inputs(ws, {})), fm_quality.statistics(r["text"], r["n_chars"], ws))
        margin = machine.bias + sum(machine.w[a] * b for a, b in zip(ids, x, strict=True))
        for k in range(len(ids)):
            for j in range(k):
                margin += machine.v[ids[k]] @ machine.v[ids[j]] * x[k] * x[j]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-margin)))
    # One Adagrad step over all rows, by numeric slopes of the loss.
    small = fm_quality.Machine()
    rows = [(np.array([3, 5]), np.arange(15) / 7), (np.array([5, 9, 12]), np.arange(15) / 5), (np.array([3]), np.arange(15) / 3)]
    y = np.array([1.0, 0.0, 1.0])
    before = fm_quality.Machine()
    before.edges = np.quantile(np.array([s for _, s in rows]), np.arange(1, fm_quality.BINS) / fm_quality.BINS, axis=0).T
    before.bias = float(np.log(y.mean() / (1 - y.mean())))
    small.fit([w for w, _ in rows], np.array([s for _, s in rows]), y, epochs=1, batch=8)
    loss = lambda m: np.mean([np.logaddexp(0, m.margin(*m.inputs(w, s))) - t * m.margin(*m.inputs(w, s)) for (w, s), t in zip(rows, y, strict=True)])
    for at in (3, 5, 9, (1 << fm_quality.WORD_BITS) + 9):
        for array, rate in ((before.w, 0.1), (before.v, 0.03)):
            place = at if array is before.w else (at, 2)
            old, decay = array[place], 2e-4 * array[place]
            array[place] = old + 1e-5
            up = loss(before)
            array[place] = old - 1e-5
            slope = (up - loss(before)) / 2e-5 + decay
            array[place] = old
            moved = (small.w if array is before.w else small.v)[place]
            assert moved == pytest.approx(old - rate * slope / math.sqrt(1e-2 + slope * slope), abs=1e-6)
    assert len(known) > 50


# --- pseudonyms, by an independent version of the method

LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def plain_numeric(key, kind, value, a, b):
    left, right = value % a, value // a
    for i in range(8):
        size = a if i % 2 == 0 else b
        left, right = right, (left + int(digest(key, kind, i, right)[:15], 16) % size) % size
    return left + right * a


def plain_string(key, kind, value, hex_=False):
    half = len(value) // 2
    left, right = value[:half], value[half:]
    classes = [LETTERS[0], "abcdef", "ABCDEF"] if hex_ else LETTERS
    for i in range(8):
        d, out = digest(key, kind, i, len(value), right), ""
        for j, c in enumerate(left):
            n = int(d[2 * j % 62 : 2 * j % 62 + 2], 16)
            of = next((k for k in classes if c in k), None)
            out += of[(of.index(c) + n) % len(of)] if of else c
        left, right = right, out
    return left + right


def luhn(payload):
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(payload))))
    return -total % 10


def plain_pseudonym(v, key="k"):
    import datetime as dt

    if "@" in v:
        local, domain = v.split("@")
        moved = plain_string(key, "email", local.lower())
        return "".join(m.upper() if c.isupper() else m for c, m in zip(local, moved, strict=True)) + "@" + domain
    if m := re.fullmatch(r"(.*?[=:]\s{0,2}[\"']?)([0-9A-Fa-f]{16,})", v):
        return m[1] + plain_string(key, "secret", m[2], True)
    if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
        first = dt.date(1700, 1, 1)
        try:
            n = (dt.date.fromisoformat(v) - first).days
        except ValueError:
            return v
        return str(first + dt.timedelta(plain_numeric(key, "date", n, 189, 773))) if 0 <= n < 146097 else v
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", v):
        a, b, c, d = map(int, v.split("."))
        n = plain_numeric(key, "ipv4", ((a * 256 + b) * 256 + c) * 256 + d, 65536, 65536)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    digits = re.sub(r"\D", "", v)
    if v.startswith("+1"):
        rest = digits[1:]
        n = plain_numeric(key, "american", ((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10000 + int(rest[6:]), 80000, 80000)
        new = iter(f"1{n // 8000000 + 200:03d}{n // 10000 % 800 + 200:03d}{n % 10000:04d}")
    else:
        offset = (int(digits[-1]) - luhn(digits[:-1])) % 10
        if offset and v == digits:
            return v
        moved = plain_string(key, "card", digits[:-1])
        new = iter(moved + str((luhn(moved) + offset) % 10))
    return "".join(next(new) if c.isdigit() else c for c in v)


def test_pseudonyms_equal_brute_force(spark, sf):
    values = ["ann.B7-x@mail.example.com", "token=" + "0aF" * 30, "2021-02-28", "1700-01-01", "2021-02-30", "10.20.30.40", "4111111111111111", "4111111111111112", "4111 1111 1111 1112", "+1 (499) 555-6503", "+14995556503"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = r"\+1[ (-]{0,2}[2-9]\d\d[) -]{0,2}[2-9]\d\d-?\d{4}(?!\d)|(?<![0-9.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9]|\.[0-9])|(?<![A-Za-z0-9._%+-])[a-z]+(?:\.[a-z]+)?@[a-z]+\.[a-z]{2,8}|(?<![0-9A-Za-z.-])\d{16}(?![0-9A-Za-z-]|\.[0-9])"
    found = [m[0] for r in docs.collect() for m in re.finditer(kinds, r["text"] or "")]
    values += [v for v in dict.fromkeys(found) if re.fullmatch(r"[^.]*|.*@.*|(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}", v)]
    assert len(values) > 15
    got = feistel.pseudonymise(spark.createDataFrame(list(enumerate(f"x {v} y" for v in values)), "doc_id long, text string"), key="k")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: f"x {plain_pseudonym(v)} y" for i, v in enumerate(values)}


def test_pseudonyms_link_forms(spark):
    forms = [["+14155551234", "+1 415 555 1234", "(415) 555-1234", "415-555-1234"], ["+49 30 901820", "+4930901820"], ["00:1B:44:11:3A:B7", "00-1B-44-11-3A-B7"], ["Bob@x.org", "bob@x.org"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]]
    flat = [(i, k, v) for i, row in enumerate(forms) for k, v in enumerate(row)]
    got = feistel.pseudonymise(spark.createDataFrame(flat, "i int, k int, text string"), key="k").collect()
    seen = defaultdict(set)
    for r in got:
        plain = re.sub(r"[^0-9a-z@]", "", r["text"].lower())
        seen[r["i"]].add(plain[-10:] if r["i"] == 0 else plain)
        assert r["n_pseudonyms"] == 1 and r["text"] != forms[r["i"]][r["k"]]
    assert all(len(s) == 1 for s in seen.values())


def test_pseudonyms_search_all_texts_and_have_no_caps(spark):
    long = "ab12" * 2000
    texts = ["token: abcdefabcdefabcdef", f"secret={long}", "5 March 2021 and March 5, 2021 and 2021-03-05", "31 February 2021", "1700000000000 1234567890123456"]
    got = [r["text"] for r in feistel.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").orderBy("doc_id").collect()]
    assert re.fullmatch("token: [a-f]{18}", got[0]) and got[0] != texts[0]
    assert len(got[1]) == len(texts[1]) and got[1] != texts[1] and got[1][-64:] != long[-64:]
    import datetime as dt

    dates = re.fullmatch(r"(\d+ [A-Z][a-z]+ \d{4}) and ([A-Z][a-z]+ \d+, \d{4}) and ([\d-]+)", got[2])
    assert dt.datetime.strptime(dates[1], "%d %B %Y") == dt.datetime.strptime(dates[2], "%B %d, %Y") == dt.datetime.strptime(dates[3], "%Y-%m-%d")
    assert got[3:] == texts[3:]


def test_pseudonyms_take_the_session_key(spark):
    df = spark.createDataFrame([("10.20.30.40",)], "text string")
    text = lambda key=None: feistel.pseudonymise(df, key=key).first()["text"]
    before = spark.conf.get(feistel.KEY_CONF, None)
    try:
        spark.conf.set(feistel.KEY_CONF, "mine")
        assert text() == text("mine") != text("other")
        spark.conf.unset(feistel.KEY_CONF)
        drawn = text()
        assert drawn == text() and len(spark.conf.get(feistel.KEY_CONF)) == 64
    finally:
        spark.conf.set(feistel.KEY_CONF, before) if before else spark.conf.unset(feistel.KEY_CONF)


# --- main text


def test_surge_and_dive_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        weights = [int(x) for x in rng.choice([0, 0, 0, 5, 30, 60], rng.integers(0, 20))]
        surge, window = int(rng.choice([0, 20, 40])), int(rng.integers(1, 5))
        total = lambda i: sum(weights[i : i + window])  # noqa: E731, B023
        inside, want, begun = False, [], 0
        for i in range(len(weights)):
            if not inside and weights[i] and total(i) > surge:
                inside, begun = True, i
            elif inside and not total(i):
                inside = False
                want.append((begun, i))
        if inside:
            want.append((begun, len(weights)))
        assert line_blocks.between(weights, surge, window) == want


def test_the_distribution_decides(monkeypatch):
    """Small texts apart from the main one are left out by the windows, and by nothing else."""
    body = "".join(f"<p>{'A sentence of the article that is long enough to count. ' * 3}</p>" for _ in range(6))
    page = f"<html><body><div>Tiny note</div><nav>menu</nav><div>{body}</div><footer>f</footer><div>Tail</div></body></html>"
    whole = line_blocks.main_text(page)
    assert whole.startswith("A sentence") and "Tiny" not in whole and "Tail" not in whole
    monkeypatch.setattr(line_blocks, "between", lambda weights, surge, window=3: [(0, len(weights))])
    assert "Tiny note" in line_blocks.main_text(page)


@pytest.mark.parametrize("page", ["<article><p>{}</p><aside>x</aside></article>", "<main>{}<form>a</form></main>", "<nav>m</nav><p>{}</p><footer>f</footer>", "<div>{}</div>"])
def test_one_long_paragraph(page):
    text = "One long paragraph that goes on for a while and says a lot of things. " * 5
    assert line_blocks.main_text(page.format(text)) == text.strip()


def test_pages_that_are_empty_or_misnamed(spark):
    shape = "page_id long, url string, html string, text long, n_chars string, weight int"
    rows = [(1, "u", "<p>" + "words of a page " * 9 + "</p>", 5, "z", 1), (1, "u", "<p>" + "words of a page " * 9 + "</p>", 5, "z", 1), (2, None, None, None, None, None), (3, "", "", 0, "", 0)]
    got = line_blocks.extract(spark.createDataFrame(rows, shape))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r["page_id"], r["n_chars"]) for r in got.collect()) == Counter({(1, 143): 2, (2, 0): 1, (3, 0): 1})
    assert line_blocks.extract(spark.createDataFrame([], shape)).count() == 0


# --- near duplicates


def test_a_centre_with_many_members(spark):
    """100 000 members of one centre are spread over cells; the centre is in each cell once."""
    n = 100_000
    classes = spark.range(n + 1).select(F.col("id").alias("rep"), F.lit(40).cast("long").alias("n"), F.lit(bytes(320)).alias("regs"))
    pairs = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    rows = hyperminhash.stars(pairs, classes.select(F.col("rep").alias("id"), "n", F.col("regs").alias("data")))
    cells = rows.groupBy("cell").agg(F.sum("role").alias("members"), F.count_if(F.col("role") == 0).alias("centres")).collect()
    assert len(cells) == 64 and all(r["centres"] == 1 for r in cells) and max(r["members"] for r in cells) < 1.2 * n / 64
    got = hyperminhash.plausible(pairs, classes, 80)
    assert got.count() == n and got.distinct().count() == n


def test_stars_cut_by_batches(spark):
    import pandas as pd

    rows = [(a, 0, r, b, 10 * a, bytes([a])) for a in (1, 2, 3) for r, b in [(0, a), *((1, 100 * a + k) for k in range(a + 1))]]
    for size in (1, 2, 3, 5, 50):
        batches = [pd.DataFrame(rows[i : i + size], columns=["a", "cell", "role", "b", "n", "data"]) for i in range(0, len(rows), size)]
        got = [(b["a"].iat[i], n, data, b["b"].iat[i]) for b, runs in hyperminhash.centred(iter(batches)) for n, data, s, e in runs for i in range(s, e)]
        assert got == [(a, 10 * a, bytes([a]), 100 * a + k) for a in (1, 2, 3) for k in range(a + 1)]


def test_near_groups_of_large_ids(spark):
    base = " ".join(f"w{i}" for i in range(50))
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big + i, base + f" end{i % 3}") for i in range(9)], "doc_id long, text string")
    got = hyperminhash.near_groups(docs, size=2).collect()
    assert {r["component_id"] for r in got} == {big} and {r["doc_id"] for r in got} == {big + i for i in range(9)}


# --- exact duplicates


def test_only_texts_with_shared_fingerprints_are_looked_at_again(spark):
    """Two contents share a fingerprint; hundreds of copies of one of them meet its list."""
    one, two = "a" * 200, "b" * 200
    clash = lambda c: F.when(F.col(c).isin(one, two) if isinstance(c, str) else c.isin(one, two), F.lit(5).cast("long")).otherwise(F.xxhash64(c))
    rows = [(i, one) for i in range(300)] + [(1000, two), (1001, two), (2000, "other"), (2001, "other"), (3000, None), (3001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunk_dedup.colliding_chunks(df, fingerprint=clash).collect()
    assert sorted((r["chunk"][0], r["rank"]) for r in found) == [("a", 0), ("b", 1)]
    assert same_rows(chunk_dedup.exact_groups(df, fingerprint=clash)) == brute_exact(rows)


# --- media


@pytest.mark.parametrize("data", [b"P1\n2 1\n! x", b"P2\n1 1 255\n99999\n", b"P2\n1 1 255\n-1\n", b"P5\n0 3\n255\n", b"P2\n1 1 9\n12\n", b"P6\n99999999 99999999\n255\nx", b"P5\n1 1\n0\nx", b"P3\n1 1 255\n1 2", b"BM", b"BM" + bytes(60), b"P7\n", b""])
def test_bad_images_give_a_reason(spark, data):
    with pytest.raises(ValueError):
        raster.decode(data)
    got = raster.decode_column(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"P5\n1 1\n255\n\x07"))], "doc_id long, media binary"), ["doc_id"])
    rows = by_id(got)
    assert rows[1]["problem"] and rows[1]["feature"] is None and rows[2]["problem"] is None


def bmp(bits, packed, masks, rows):
    body = b"".join(r + b"\0" * (-len(r) % 4) for r in rows)
    width = len(rows[0]) * 8 // bits
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(masks)) + struct.pack("<IiiHHIIiiII", 40, width, -len(rows), 1, bits, packed, len(body), 0, 0, 0, 0) + masks + body


def test_bitmaps_with_masks():
    swapped = struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)  # red in the lowest byte
    assert raster.decode(bmp(32, 3, swapped, [bytes([1, 2, 3, 0, 4, 5, 6, 0])])).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert raster.decode(bmp(32, 0, b"", [bytes([1, 2, 3, 0])])).tolist() == [[[3, 2, 1]]]
    assert raster.decode(bmp(16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F), [struct.pack("<HH", 0xF800, 0x07FF)])).tolist() == [[[255, 0, 0], [0, 255, 255]]]
    assert raster.decode(bmp(16, 0, b"", [struct.pack("<HH", 0x7C00, 0x03E0)])).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    with pytest.raises(ValueError):
        raster.decode(bmp(32, 3, struct.pack("<III", 0, 0xFF00, 0xFF), [bytes(4)]))


def test_media_features_equal_brute_force(spark):
    texts = [(i, " ".join(f"w{(i * 7 + j) % 31}" for j in range(40 * i + 1))) for i in range(6)] + [(6, None), (7, "é" * 500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got, one = by_id(raster.text_features(docs)), by_id(raster.decode_column(raster.text_images(docs), ["doc_id", "n_bytes"]))
    for i, t in texts:
        raw = (t or "").encode()
        pixels = np.frombuffer(raw + b" " * (-len(raw) % 192 if raw else 192), dtype=np.uint8).reshape(-1, 64, 3).astype(float)
        big = np.repeat(np.repeat(pixels, 8, axis=0), 9, axis=1).reshape(8, len(pixels), 9, 64, 3).mean(axis=(1, 3))
        grey = big @ np.array([0.299, 0.587, 0.114])
        bits = "".join("1" if b - a > 1e-6 else "0" for row in grey for a, b in zip(row, row[1:], strict=False))
        assert got[i]["feature"] == f"{int(bits, 2):016x}"
        assert got[i] == one[i]
    assert raster.text_features(docs.limit(0)).count() == 0 and raster.decode_column(raster.text_images(docs).limit(0), ["doc_id"]).count() == 0


# --- mixing


def brute_plan(rows, seed=mixing.SEED):
    """Copies of each document, from the keyed hashes (given) and the targets."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal, out = mixing.targets(list(sizes.items())), {}
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        words, ids, ranges = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in own:
            words[r["block"]] += r["size"]
            ranges[r["block"], r["range"]] += r["size"]
            ids[r["doc_id"]] += r["size"]
        left, taken = goal[s], Counter()
        for _ in range(2):
            for b in sorted(words, key=lambda b: next((r["order"], b) for r in own if r["block"] == b)):
                if not words[b] or left <= 0:
                    continue
                if words[b] <= left:
                    for i in {r["doc_id"] for r in own if r["block"] == b}:
                        taken[i] += 1
                else:
                    room = left
                    for c in sorted({r["range"] for r in own if r["block"] == b}):
                        here = sorted({(r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["doc_id"]) for r in own if (r["block"], r["range"]) == (b, c)})
                        reached = 0
                        for _, _, _, i in here:
                            reached += ids[i]
                            if ids[i] and room > 0 and (ranges[b, c] <= room or reached - ids[i] / 2 <= room):
                                taken[i] += 1
                        room -= ranges[b, c]
                left -= words[b]
        for r in own:
            out[r["doc_id"], s] = taken[r["doc_id"]]
    return goal, out


def test_mix_equals_brute_force(spark, sf, edge):  # noqa: F811
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), edge):
        key = F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"))
        size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        seen = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.pmod(key, F.lit(64)).alias("block"), F.pmod(F.shiftright(key, 16), F.lit(64)).alias("range"))
        seen = seen.withColumn("order", F.xxhash64(F.lit(mixing.SEED), F.lit("blocks"), "source", F.col("block").cast("int")))
        goal, want = brute_plan([r.asDict() for r in seen.collect()])
        for r in mixing.plan(docs).collect():
            assert r["target"] == pytest.approx(goal[r["source"]])
            if r["size"]:
                assert r["copies"] == want[r["doc_id"], r["source"]]


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNKS", 7)
    n = 300
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 7 % 90)), f"site{i % n}" if i % n else None) for i in range(4 * n)], "doc_id long, text string, source string")
    plan = mixing.plan(docs).collect()
    sizes = Counter()
    for r in plan:
        sizes[r["source"]] += r["size"]
    goal = mixing.targets(list(sizes.items()))
    assert len(plan) == 4 * n and all(r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]] for r in plan)
    shards = Counter(r[c] for r in plan for c in ("first_shard", "second_shard") if r[c] is not None)
    assert set(shards) == set(range(mixing.SHARDS))
    quotas = spark.createDataFrame([(i, 3 + i % 11) for i in range(60)], "place long, slots long")
    dealt = {r["place"]: np.diff(r["upto"], prepend=0) for r in mixing.dealt_slots(quotas, 4, 1).collect()}
    assert all(dealt[i].sum() == 3 + i % 11 and (dealt[i] >= 0).all() for i in range(60))
    total = sum(dealt.values())
    assert total.sum() == sum(3 + i % 11 for i in range(60)) and total.max() - total.min() <= 1


# --- empty tables, all queries of the kind


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert feistel.pseudonymise(docs, key="k").count() == 0
    model = pu_toxicity.fit(docs, labels, split_of("doc_id", 5) != 0)
    assert pu_toxicity.score(docs, model).count() == 0 and pu_toxicity.keep_clean(docs, model).count() == 0
    assert fm_quality.score(docs, fm_quality.fit(docs, labels, split_of("doc_id", 4) != 2)).count() == 0
    assert set(queries.oracle_sql()) < set(queries.queries()) and len(EDGE) > 10
