"""BPE by pair positions, vector codes and token alignment: the libraries, brute force, edge cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazelark.llm import alignment, pair_index, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


# --- 11 ---


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_query_against_the_library(spark, docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in pair_index.query(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for i, text in zip(docs.doc_id, docs.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


ALPHABET = ["a", "b", "A", "é", "é", "'", " ", "\n", "1", "中", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "the", "՘", "ing", "'s", "_", "\x00", "\x1c", "\x85", "Ᲊ", "ʼ", "‍", " ", "İ", "ß", "͸"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET) | st.text(max_size=4), max_size=30).map("".join))
def test_any_text_against_the_library(library, text):
    text = text.encode("utf-8", "replace").decode()
    own = pair_index.encoder()
    expected = library.encode(text, add_special_tokens=False).ids
    assert list(own([text])[0]) == expected
    assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_every_character_against_the_library(library):
    own = pair_index.encoder()
    characters = [c for c in range(0x3500) if not 0xD800 <= c < 0xE000] + list(range(0x1F600, 0x1F700))
    texts = [f"x{chr(c)}y {chr(c)}{chr(c)}" for c in characters]
    assert [list(i) for i in own(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(docs, monkeypatch):
    texts = docs.text.tolist()
    own = pair_index.encoder()
    whole = own(texts)
    monkeypatch.setattr(pair_index, "REMEMBERED_CHARS", 100)
    assert [own([t])[0] for t in texts] == whole


def test_long_words_take_linear_time(library):
    own = pair_index.encoder()
    for unit in ("a", "ab", "abcé"):
        word = unit * (60_000 // len(unit))
        assert list(own([word])[0]) == library.encode(word, add_special_tokens=False).ids


def test_merges_without_order_are_refused():
    pair_index.Merges([(0, 1), (2, 1)], [2, 3])
    with pytest.raises(ValueError):
        pair_index.Merges([(2, 1), (0, 1)], [3, 2])


def plain_merges(word, pairs, made):
    """The lowest rank first, from the left, one merge at a time."""
    word, rank = list(word), {p: r for r, p in enumerate(pairs)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank), default=None)
        if best is None:
            return tuple(word)
        word[best[1] : best[1] + 2] = [made[best[0]]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=6), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12))
def test_index_against_one_merge_at_a_time(words, drawn):
    pairs, size = [], 4
    for a, b in drawn:
        if (a % size, b % size) not in pairs:
            pairs.append((a % size, b % size))
            size += 1
    made = list(range(4, size))
    assert pair_index.Merges(pairs, made).apply(words) == [plain_merges(w, pairs, made) for w in words]


def test_encode_then_decode_frames(spark):
    texts = spark.createDataFrame([(1, "Hello, world"), (None, None), (2, "")], "doc_id long, text string")
    ids = pair_index.encode(texts)
    assert {r["doc_id"]: r["text"] for r in pair_index.decode(ids).collect()} == {1: "hello</w> ,</w> world</w>", None: "", 2: ""}


# --- 12 ---


def plain_codes(rows, entries=64, rounds=2):
    """vec_id -> (code, error) and all codebooks' numbers, by full comparison."""
    ids = sorted(rows)
    whole = np.array([[int(np.floor(256 * x)) for x in rows[i]] for i in ids], np.int64).reshape(len(ids), 16, -1)
    books = whole[:entries].transpose(1, 0, 2).copy()

    def assign():
        return np.array([((whole[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(16)]).T

    for _ in range(rounds):
        own = assign()
        for p in range(16):
            for k in set(own[:, p].tolist()):
                part = whole[own[:, p] == k, p]
                books[p, k] = part.sum(0) // len(part)
    own = assign()
    errors = ((whole - books[np.arange(16), own]) ** 2).sum((1, 2))
    return {i: ("".join(f"{k:02x}" for k in own[n]), int(errors[n])) for n, i in enumerate(ids)}, ",".join(map(str, books.ravel().tolist()))


@pytest.mark.parametrize("source", ["given", "ties"])
def test_codes_against_full_comparison(spark, tmp_path, source):
    if source == "given":
        df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    else:  # few values a component, so that distances are often equal; whole groups of equal vectors; a hot label and nulls
        rng = np.random.default_rng(3)
        x = rng.integers(-2, 3, (700, 32)) / 256
        x[300:500] = x[300]
        df = spark.createDataFrame([(int(i), v.tolist(), None if i % 3 == 0 else int(i % 7 == 0) if i % 2 else int(i)) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = df.collect()
    codes, books = plain_codes({r["vec_id"]: r["embedding"] for r in rows})
    by_label = Counter()
    for r in rows:
        by_label[r["label"]] += codes[r["vec_id"]][1]
    digest = hashlib.sha256(books.encode()).hexdigest()
    expected = {r["vec_id"]: (*codes[r["vec_id"]], by_label[r["label"]], digest) for r in rows}
    got = vector_codes.query(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == expected and len(got) == len(rows)


def test_unusable_vectors_and_repeated_ids(spark, tmp_path):
    fine, other = [0.5] * 16, [-0.25] * 16
    rows = [(1, fine), (1, other), (2, None), (3, [None] + fine[1:]), (4, [float("nan")] + fine[1:]), (5, [float("inf")] + fine[1:]), (6, []), (7, [1.0] * 17), (None, fine), (8, fine * 2), (9, [3e38] + fine[1:]), (9, [3e38] + fine[1:])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(None).cast("int"), "dim": F.lit("x"), "own": F.lit("y"), "code": F.lit("z")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.query(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"] for r in got), key=str) == sorted([1, 1, None, 8, 9, 9], key=str)
    assert len({r["codebooks_sha256"] for r in got}) == 2 and len({r["label_error"] for r in got}) == 1
    assert next(r for r in got if r["vec_id"] == 8)["error"] == 0


def test_bounds_spare_comparisons_and_change_nothing():
    rng = np.random.default_rng(5)
    parts = np.concatenate([rng.normal(c, 3, (300, 4)) for c in rng.normal(0, 200, (12, 4))]).astype(np.int64)
    book = parts[::300][:12].copy()
    entry, upper, lower = vector_codes.scan(parts, book)
    for _ in range(4):
        sums = np.array([parts[entry == k].sum(0) // max(1, (entry == k).sum()) if (entry == k).any() else book[k] for k in range(len(book))])
        shift = vector_codes.moved(book[None], sums[None])[0]
        book = sums
        scans = vector_codes.reassign(parts, book, shift, entry, upper, lower)
        full = vector_codes.distances(parts, book)
        assert (entry == full.argmin(1)).all() and scans < len(parts) / 2
        assert (upper.astype(float) ** 2 >= full[np.arange(len(parts)), entry]).all()
        rest = full.copy()
        rest[np.arange(len(parts)), entry] = np.iinfo(np.int64).max
        assert (lower.astype(float) ** 2 <= rest.min(1)).all()


def test_codes_decode_near_the_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    coded = vector_codes.compress(rows)
    errors = {r["own"]["vec_id"]: r["error"] for r in coded.rows.collect()}
    back = {r["own"]["vec_id"]: np.array(r["vec"]) for r in vector_codes.decode(coded).collect()}
    for r in rows.collect():
        away = np.linalg.norm(back[r["vec_id"]] - np.array(r["embedding"]))
        assert away <= np.sqrt(errors[r["vec_id"]]) / 256 + np.sqrt(64) / 512 + 1e-9


# --- 13 ---


def plain_groups(text):
    """[(left ids, right ids)] of a text, cut at the common ends."""
    left, right = alignment.encoder(alignment.LEFT), alignment.encoder(alignment.RIGHT)
    whole = (" " + (text or "")).encode()
    a, b = left.tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, right.model.encode(text or "")
    if not text or b"".join(left.pieces[i] for i in a) != whole or b"".join(right.pieces[i] for i in b) != whole:
        return []
    ends = lambda own, ids: np.cumsum([len(own.pieces[i]) for i in ids]).tolist()
    ends_a, ends_b = ends(left, a), ends(right, b)
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def plain_linked(rows):
    groups = [(i, plain_groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in groups]
    held = Counter(p for own in links for p in own)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for (i, g), own in zip(groups, links):
        string = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        n_best = sum(n for p, n in own.items() if held[p] == highest[p[0]])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), n_best, sum(n * held[p] for p, n in own.items()), hashlib.sha256(string.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


ODD = ["<s> a</s>", "<|endoftext|> x", "▁x", "a\x00b", "  two", "\n\n", "中文字é😀", "a" * 3000, "é" * 50, "﻿x", " ", "Ａ", "", None, "same", "same", "<0x41>"]


@pytest.mark.parametrize("block", [8_000_000, 1])
def test_alignment_against_plain_python(spark, docs, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)  # a dictionary for all documents, and one for each slice
    monkeypatch.setattr(alignment, "SLICE_CHARS", 20_000)
    monkeypatch.setattr(alignment, "DICTIONARY_ROW", 100)
    short = [(int(i), t) for i, t in zip(docs.doc_id, docs.text) if len(t or "") < 4000]
    rows = short + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), short[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("x"), "pairs": F.lit("y"), "doc": F.lit("z")})
    got = alignment.linked(df.repartition(3)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_linked(rows)


def test_large_groups_are_counted_not_expanded(monkeypatch):
    texts = [t for t in ODD if t] * 2
    whole = alignment.Aligned(texts, alignment.LEFT, alignment.RIGHT).links()
    monkeypatch.setattr(alignment, "EXPANDED", 1)
    again = alignment.Aligned(texts, alignment.LEFT, alignment.RIGHT).links()
    for (p, n), (q, m) in zip(whole, again):
        assert p.tolist() == q.tolist() and n.tolist() == m.tolist()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 39)), max_size=60))
def test_components_against_plain_search(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def least(x):
        seen, left = {x}, [x]
        while left:
            for y in near[left.pop()] - seen:
                seen.add(y)
                left.append(y)
        return min(seen)

    own = np.array(edges, np.int64).reshape(-1, 2)
    assert alignment.components(n, own[:, 0], own[:, 1]).tolist() == [least(x) for x in range(n)]


def test_align_gives_groups(spark):
    row = alignment.align(spark.createDataFrame([(1, "unbelievable tokens"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    groups = plain_groups("unbelievable tokens")
    assert row[0]["left_ids"] == [x for a, _ in groups for x in a] and row[0]["right_ids"] == [x for _, b in groups for x in b]
    assert row[0]["left_groups"] == [k for k, (a, _) in enumerate(groups) for _ in a] and row[1]["right_ids"] == []


# --- 4: vectors around one centre ---


def test_neighbours_of_vectors_around_one_centre(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from gazelark.llm import neighbours

    rng = np.random.default_rng(1)
    centre = rng.standard_normal(64)
    x = (centre / np.linalg.norm(centre) + rng.standard_normal((20_000, 64)) * 0.02).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (unit @ unit.mean(axis=0)).mean() > 0.96
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    df = spark.read.parquet(str(tmp_path))
    rows = neighbours.usable(df, "vec_id", "embedding")
    posted = neighbours.coded(rows, "id", {64: len(x)}, neighbours.TABLES, {64: 1}, neighbours.centres(rows))
    assert posted.groupBy("table", "code").count().agg(F.max("count")).first()[0] < len(x) / 100
    found = defaultdict(set)
    for r in neighbours.search(df, lambda key: key % 200 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in found:
        score = unit @ unit[q]
        score[q] = -9
        hits += len(found[q] & set(np.argsort(-score)[:5].tolist()))
    assert len(found) == 100 and hits >= 0.9 * 500


def test_codes_that_most_vectors_have_are_dealt_out(spark):
    from gazelark.llm import neighbours

    posted = spark.range(1_000).select(F.col("id"), F.lit(2).alias("dim"), F.lit(0).alias("table"), F.when(F.col("id") < 600, 7).otherwise(F.col("id")).cast("long").alias("code"))
    probed = spark.createDataFrame([(1, 2, 0, 7), (2, 2, 0, 700), (3, 2, 0, 9999)], "asked long, dim int, table int, code long")
    dealt, asked = neighbours.chunked(posted, probed, {2: 1_000})
    assert dealt.groupBy("code", "chunk").count().agg(F.max("count")).first()[0] < 30
    met = dealt.join(asked, ["dim", "table", "code", "chunk"]).groupBy("asked").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).orderBy("asked").collect()
    assert [tuple(r) for r in met] == [(1, 600, 600), (2, 1, 1)]


# --- 7: pseudonyms stay in their format ---


def test_pseudonyms_are_of_the_same_kind_form_and_code(spark):
    import random
    import re

    from gazelark.llm import personal

    rng, n = random.Random(4), 2_000
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    area = lambda: f"{rng.randrange(200, 1000)}"

    def card():
        own = rng.choice("3456") + digits(14)
        total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(map(int, own)))
        return own + str(-total % 10)

    makers = {
        "american": lambda: f"({area()}) {area()}-{digits(4)}",
        "dotted": lambda: f"{area()}.{area()}.{digits(4)}",
        "plus one": lambda: f"+1 {area()} {area()} {digits(4)}",
        "two digits": lambda: f"+{rng.choice(personal.MIDDLE_CODES)} {rng.randrange(10, 9999)} {digits(3)}{digits(3)}",
        "three digits": lambda: f"+{rng.choice(['353', '420', '971', '212'])} {rng.randrange(1, 10)} {digits(3)} {digits(4)}",
        "ssn": lambda: f"{rng.choice(['001', '123', '665', '899'])}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}",
        "date": lambda: f"{rng.randrange(1950, 2020)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card,
    }
    rows = [(f"{name}|{make()}",) for name, make in makers.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "row string").selectExpr("substring_index(row, '|', 1) AS made", "substring_index(row, '|', -1) AS text").repartition(8)
    out = personal.pseudonymise(df, "key").select("made", "text", F.col("pseudonymised.text").alias("new"), F.col("pseudonymised.kinds").alias("kinds"))
    kind_of = {"american": "phone", "dotted": "phone", "plus one": "phone", "two digits": "phone", "three digits": "phone"}
    code_of = lambda text: (lambda d: d[:1] if d[:1] in personal.SHORT_CODES else d[:2] if d[:2] in personal.MIDDLE_CODES else d[:3])(re.sub("[^0-9]", "", text))
    same = 0
    for r in out.collect():
        kind = kind_of.get(r["made"], r["made"])
        assert r["kinds"] == [kind], r
        pattern = personal.PATTERNS[kind].replace(r"\2", r"\1").replace(r"\3", r"\2")
        assert re.fullmatch(pattern, r["new"]), r
        if kind != "ip":
            assert re.sub("[0-9]", "0", r["new"]) == re.sub("[0-9]", "0", r["text"]), r
        if r["text"].startswith("+"):
            assert code_of(r["new"]) == code_of(r["text"]), r
        same += r["new"] == r["text"]
    assert same < n / 100


def test_both_spellings_of_a_number_stay_linked(spark):
    from gazelark.llm import personal

    rows = [("(212) 555-0100",), ("+1 212-555-0100",), ("212.555.0100",), ("+353 1 234 5678",), ("+49 30 123456",)]
    got = [r["pseudonymised"]["text"] for r in personal.pseudonymise(spark.createDataFrame(rows, "text string").coalesce(1), "key").collect()]
    tail = lambda s: "".join(c for c in s if c.isdigit())[-10:]
    assert tail(got[0]) == tail(got[1]) == tail(got[2]) != "2125550100"
    assert got[3].startswith("+353 ") and got[3] != rows[3][0] and got[4].startswith("+49 ")
