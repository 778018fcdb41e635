"""Packing, alignment and whitening against plain versions, and their defined cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rowloom.llm import alignment, byte_bpe, jacobi_whitening, packing, queries, sentencepiece_table

DOCS = "doc_id long, text string, sequence_id long, rank int, a string"  # names that clash with those made


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, 7, 7, "x") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.file_bytes())


ODD = [
    None, "", " ", "  ", "a", "<|endoftext|>", "x<|endoftext|> <s></s><unk>", "it's IT'S ’s", "tab\tand\r\n\r\n lines \n", "ünï© ①②③ ٣٤ Ⅷ 漢字 한글 🙂👩‍👩‍👧 ﻿​ 　 ", "\x00\x01\x1c\x85", "a ▁ b", "▁", "ﬁ  ﬁ",
    "word " * 3000, "é" * 5000, " " * 9000, "\n" * 6000 + "x", "𐐷𞤀\U00031350\U0001E4F0", "trailing ", " leading", "a  b   c",
]


def test_byte_ids_equal_the_library(library, bpe):
    for t in ODD[1:]:
        assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids, t[:20]
    assert bpe.encode(None) == []
    for c in range(0x80, 0x30000, 97):
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}1 {chr(c)}{chr(c)}!"
            assert bpe.encode(t) == library.encode(t, add_special_tokens=False).ids
    assert b"".join(bpe.tokens[i] for i in bpe.encode(ODD[9])) == ODD[9].encode()


def test_byte_ids_without_the_fast_way(library):
    """A file that the fast way can't serve, and characters it doesn't know alike, go to the library."""
    file = byte_bpe.file_bytes()
    for never in (byte_bpe.ByteBpe(file, (False, frozenset())), byte_bpe.ByteBpe(file, (True, frozenset("é")))):
        never.fast = lambda t: [] if "é" in t or not never.alike else library.encode(t, add_special_tokens=False).ids
        assert never.encode("café 1") == library.encode("café 1", add_special_tokens=False).ids


# --- packing


def check_packed(got, texts, library):
    """Each id of each document lies in one piece, each sequence is gapless and not too long."""
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            piece = ids[i][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, sum(map(len, ids.values())), sorted(by_sequence)


def test_packing_holds_every_id_once(spark, sf, library):
    got = queries.op11_packing(spark, sf).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    padding, total, ids = check_packed(got, texts, library)
    assert padding < 0.01 * total
    assert ids == list(range(len(ids)))


def test_packing_of_odd_texts(spark, library):
    texts = list(enumerate(ODD))
    parts = packing.pieces(rows_of(spark, texts)).withColumn("ids_crc32", F.crc32("ids"))
    packed = packing.pack(parts)
    check_packed(packed.collect(), texts, library)
    # Sequences give the ids back, piece by piece, and are padded but at powers of two.
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    for s in packing.sequences(packed, pad=9).collect():
        n = sum(p["length"] for p in s["parts"])
        assert len(s["ids"]) == (n if n & (n - 1) == 0 else 1024) and set(s["ids"][n:]) <= {9}
        for p in s["parts"]:
            assert s["ids"][p["offset"] : p["offset"] + p["length"]] == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]


def test_packing_of_no_and_repeated_rows(spark):
    assert packing.pack(packing.pieces(rows_of(spark, []))).collect() == []
    same = [(i % 3 or None, "the same text") for i in range(900)]
    got = packing.pack(packing.pieces(rows_of(spark, same))).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert sum(r["length"] for r in got) == 900 * got[0]["doc_tokens"]
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert sum(1024 - n for n in used.values()) < 1024  # all but the last are full or nearly so


def shortest_first(lengths, capacity):
    """One piece at a time: to the pack that is filled least of those with room, else to a new one."""
    packs = []
    for n in sorted(lengths, reverse=True):
        room = [p for p in packs if sum(p) + n <= capacity]
        if room:
            min(room, key=sum).append(n)
        else:
            packs.append([n])
    return packs


def test_patterns_hold_all_pieces_and_pack_like_single_ones():
    rng = np.random.default_rng(3)
    for capacity in (8, 16, 64):
        for _ in range(40):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 120)).tolist()
            made = packing.patterns(Counter(lengths), capacity)
            held = Counter()
            for packs, runs in made:
                assert packs > 0 and sum(n * k for n, k in runs) <= capacity
                assert [n for n, _ in runs] == sorted({n for n, _ in runs}, reverse=True)
                for n, k in runs:
                    held[n] += packs * k
            assert held == Counter(lengths)
            assert sum(p for p, _ in made) <= len(shortest_first(lengths, capacity)) + 1
            table = packing.places(made)
            assert (np.diff(table["key"]) > 0).all()


def test_patterns_are_few_however_many_pieces():
    counts = {n: 10**9 + 7 * n for n in range(1, 1025)}
    made = packing.patterns(counts)
    assert len(made) <= 2048 and max(len(runs) for _, runs in made) <= 45
    assert sum(p * sum(n * k for n, k in runs) for p, runs in made) == sum(n * c for n, c in counts.items())
    total = sum(n * c for n, c in counts.items())
    assert sum(p for p, _ in made) * 1024 < 1.001 * total


def test_ranks_are_dense_in_each_length(spark):
    rows = [(1024 if i % 3 else 5, i) for i in range(5000)]
    got = packing.ranked(spark.createDataFrame(rows, "length long, row long"), 16).collect()
    for n in (5, 1024):
        assert sorted(r["rank"] for r in got if r["length"] == n) == list(range(sum(x == n for x, _ in rows)))


# --- alignment


def brute_alignment(texts, library):
    """Ends as sets, groups by walking them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = byte_bpe.byte_alphabet()
    out, count = {}, Counter()
    for i, t in texts:
        a = library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        bytes_a = [bytes(alphabet[c] for c in library.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, sp.id_to_piece(x)) for x in b)]
        groups = []
        if t and b"".join(bytes_a) == (" " + t).encode() == b"".join(bytes_b):
            ends_a, ends_b, at = {}, {}, 0
            for k, x in enumerate(bytes_a):
                at += len(x)
                ends_a[at] = k
            at = 0
            for k, x in enumerate(bytes_b):
                at += len(x)
                ends_b[at] = k
            last_a = last_b = -1
            for end in sorted(set(ends_a) & set(ends_b)):
                groups.append((a[last_a + 1 : ends_a[end] + 1], b[last_b + 1 : ends_b[end] + 1]))
                last_a, last_b = ends_a[end], ends_b[end]
        out[i] = groups
        count.update((x[-1], y[-1]) for x, y in groups)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    rows = {}
    for i, groups in out.items():
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        rows[i] = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest)
    return rows, out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark, sf, library):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected, _ = brute_alignment(texts, library)
    assert {r["doc_id"]: tuple(r[c] for c in NAMES) for r in queries.op12_alignment(spark, sf).collect()} == expected


def test_alignment_of_odd_texts_in_many_blocks(spark, library, monkeypatch):
    texts = list(enumerate(ODD)) + [(100 + i, f"copy {i % 2} of a text") for i in range(9)]
    expected, groups = brute_alignment(texts, library)
    docs = rows_of(spark, texts).repartition(3)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 30)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in alignment.align(docs).collect()}
    assert got == expected
    for i in (0, 1, 11, 12):  # null, empty, and the marker itself in the text
        assert got[i] == (0, 0, 0, 0, 0, 0, "")
    listed = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in alignment.groups(docs).collect()}
    assert listed == groups


def test_alignment_of_no_and_repeated_rows(spark):
    assert alignment.align(rows_of(spark, [])).collect() == []
    got = alignment.align(rows_of(spark, [(None, "twice"), (None, "twice"), (5, "twice"), (5, None)])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "5", "None", "None"]
    assert sorted(r["count_sum"] == 3 * r["n_links"] > 0 for r in got) == [False, True, True, True]


def test_chunks_by_words_equal_the_library():
    encoder = sentencepiece_table.ChunkEncoder(sentencepiece_table.model_bytes(), table_size=40)
    for t in [*ODD[1:], " ".join(f"w{i} {'long' * 30}{i}" for i in range(200))]:
        assert encoder.encode(t) == encoder.sp.encode(t), t[:20]
    assert len(encoder.table) <= 40


# --- whitening


def brute_whitening(vectors, components=32):
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(width)]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(width)) for r in x]
    d = np.array([[(n * r[i] - sums[i]) / n for i in range(width)] for r in x])
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, width)
    return deviation, d @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitened(got, vectors):
    deviation, white, explained = brute_whitening(vectors)
    rows = defaultdict(dict)
    for r in got:
        rows[r["vec_id"]][r["component"]] = r
    k = white.shape[1]
    assert len(got) == len(vectors) * k
    found = np.array([[rows[i][c + 1]["whitened"] for c in range(k)] for i in range(len(vectors))])
    signs = np.sign((found * white).sum(axis=0))
    assert np.allclose(found * signs, white, rtol=1e-6, atol=1e-6)
    for i, own in rows.items():
        assert {r["deviation"] for r in own.values()} == {deviation[i]}
        assert np.allclose([own[c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    assert {r["n"] for r in got} == {len(vectors)} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9


def test_whitening_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    place = {r["vec_id"]: k for k, r in enumerate(rows)}
    got = [r.asDict() | {"vec_id": place[r["vec_id"]]} for r in queries.op13_whitening(spark, sf).collect()]
    check_whitened(got, [r["embedding"] for r in rows])


def test_whitening_of_near_and_far_values(spark):
    """Eigenvalues that span many orders, around a mean far from zero; the same from any partitioning."""
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(400, 6)) * [3000, 500, 90, 20, 6, 2] @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 1e5).tolist()
    table = spark.createDataFrame([(i, x, "n") for i, x in enumerate(v)], "vec_id long, embedding array<double>, n string")
    got = jacobi_whitening.components(table, jacobi_whitening.fit(table)).collect()
    check_whitened([r.asDict() for r in got], v)
    again = jacobi_whitening.fit(table.repartition(7))
    one = jacobi_whitening.fit(table.coalesce(1))
    assert (again.values == one.values).all() and (again.axes == one.axes).all()


def test_whitening_drops_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [-inf, 1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    good = [(10, [0.1, 1.0]), (10, [0.5, -2.0]), (None, [0.9, 0.3]), (11, [0.9, 0.3])]
    table = spark.createDataFrame(odd + good, "vec_id long, embedding array<float>")
    got = jacobi_whitening.components(table, jacobi_whitening.fit(table)).collect()
    assert Counter(r["vec_id"] for r in got) == {10: 4, None: 2, 11: 2}
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-9


def test_whitening_without_variance_or_rows(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        table = spark.createDataFrame(rows, shape)
        assert jacobi_whitening.components(table, jacobi_whitening.fit(table)).collect() == []
    table = spark.createDataFrame([(i, [1.0, float(i % 2), float(i % 2)]) for i in range(6)], shape)
    got = jacobi_whitening.components(table, jacobi_whitening.fit(table)).collect()
    assert {r["component"]: r["whitened"] is None for r in got} == {1: True, 2: True, 3: True} | {1: False}
    assert {r["deviation"] for r in got} == {2 * (6 * 32) ** 2}
    one = spark.createDataFrame([(1, [1.0, 2.0])], shape)
    got = jacobi_whitening.components(one, jacobi_whitening.fit(one)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"]) for r in got] == [(0, None, 0.0)] * 2


def test_whitening_of_huge_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e30, -1.0]), (4, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fitted = jacobi_whitening.fit(table)
    got = jacobi_whitening.transform(table, fitted).collect()
    x = [[min(max(math.floor(64 * c) + 10**6, -(2**63)), 2**63 - 1) for c in r[1]] for r in rows]
    n, sums = 4, [sum(c) for c in zip(*x)]
    assert fitted.sums == sums
    for r, own in zip(sorted(got, key=lambda r: r["vec_id"]), x, strict=True):
        exact = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        assert r["deviation"] == (exact if exact < 10**38 else None)


def test_jacobi_keeps_small_eigenvalues():
    for width in (1, 2, 3, 8, 33):
        rng = np.random.default_rng(width)
        m = rng.normal(size=(width, width))
        v = m @ m.T
        values, axes = jacobi_whitening.jacobi(v)
        assert np.allclose(axes.T @ axes, np.eye(width), atol=1e-12) and np.allclose(v @ axes, axes * values, atol=1e-10)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-8, atol=1e-12)
        assert sorted((int(p), int(q)) for a, b in jacobi_whitening.rounds(width) for p, q in zip(a, b)) == [(p, q) for p in range(width) for q in range(p + 1, width)]
    scale = np.diag([1.0, 1e-6, 1e-12])
    values, _ = jacobi_whitening.jacobi(scale @ (np.ones((3, 3)) * 0.5 + np.eye(3) * 0.5) @ scale)
    # The least eigenvalue is that of the last entry's Schur complement, to many digits.
    assert abs(values[2] / (1e-24 * 2 / 3) - 1) < 1e-9
