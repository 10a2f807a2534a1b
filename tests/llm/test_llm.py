"""Each operator against brute force or SQL, and on nulls, empty and long texts, ties, repeated rows, empty tables and
clashing column names."""

import base64
import hashlib
import os
import re
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import SMALL, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lithoscope.llm import bpe, chat, components, language, merkle, packing, registry, similar, simhash, substring, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Score string, spans int, LANG_PRED int, fp int, kept int, n_words int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, "The cat.\n\nsat  down\t."), (4, LONG), (5, "The cat.\n\nsat  down\t."), (5, "other row of five"), (6, "  \n "), (None, "no id " * 20), (7, "é" * 300), (8, LONG + " tail"), (9, "12 %% !!")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i and i % 2 else None, "s", 0, "x", 1, 1, 1, 1, 1) for i, t in TEXTS]
    return spark.createDataFrame(rows + rows[:1], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# 1


def test_toxicity_learns_words_and_leaves_clean_texts(spark):
    filler = [f"word{i}" for i in range(60)]
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(filler, 40))
        bad = i % 4 == 0
        if bad:
            for k in rng.integers(0, 40, 4):
                w[k] = rng.choice(["rotter", "blighter", "scoundrel"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs.where("doc_id % 5 > 0"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.score_documents(docs, model).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored)
    for r in scored:
        for s in r["spans"]:
            assert r["text"][s["start"] : s["end"]].split()[0] in ("rotter", "blighter", "scoundrel")


def test_forward_backward_is_exact_over_runs():
    model = toxicity.SpanModel({"=bad": 0}, 0.0)
    model.weights, model.bias, model.moves = np.array([4.0]), -2.0, np.array([[1.0, -1.0], [-0.5, 0.5]])
    text = "a b bad c d e bad bad f"
    words = text.split()
    e = np.array([[0.0, -2.0 + 4.0 * (w == "bad")] for w in words])
    total, mass = 0.0, np.zeros(len(words))
    for code in range(1 << len(words)):
        y = [code >> i & 1 for i in range(len(words))]
        p = np.exp(sum(e[i, v] for i, v in enumerate(y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
        total += p
        mass += p * np.array(y)
    hits, marginals, n = model.tag(text)
    assert hits == [2, 6, 7] and n == 9 and np.allclose(marginals, (mass / total)[hits])


def test_toxicity_on_odd_rows(spark, odd, empty):
    model = toxicity.SpanModel({}, 0.25)
    out = toxicity.score_documents(odd, model)
    assert out.count() == len(TEXTS) + 1 and {r["score"] for r in out.collect()} == {0.25} and out.columns.count("score") == 1 and "Score" not in out.columns
    assert toxicity.score_documents(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, none).base == 0.0


# 2


def removed_by_force(rows):
    first, split = {}, [(i if i is not None else float("inf"), words_of(t)) for i, t in rows]
    for i, w in sorted(split, key=lambda x: x[0]):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = []
    for (i, w), (doc, _) in zip(split, rows):
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def kept_rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def test_substrings_against_brute_force(spark, documents, odd, empty, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert kept_rows(substring.deduplicate(documents)) == removed_by_force(rows)
    monkeypatch.setattr(substring, "TABLE_WORDS", 2_000)
    assert kept_rows(substring.deduplicate(documents)) == removed_by_force(rows)
    assert kept_rows(substring.deduplicate(odd)) == removed_by_force(TEXTS + TEXTS[:1])
    assert substring.deduplicate(empty).count() == 0


def test_incremental_index_gives_what_one_batch_gives(spark, documents, tmp_path):
    index, found = substring.FingerprintIndex(spark, f"file://{tmp_path}/index"), []
    for lo, hi in ((0, 60), (60, 120), (120, 10**9)):
        found += kept_rows(index.add(documents.where(f"doc_id >= {lo} and doc_id < {hi}")))
        if lo:
            index.compact()
            assert len(index.runs()) == 1
    assert sorted(found, key=str) == kept_rows(substring.deduplicate(documents))


def test_windows_of_one_anchor_with_hashes_alike_in_40_bits_stay(spark, monkeypatch):
    fixed = [f"f8n{i}" for i in range(12)]
    pairs = [(1964406, 3478916), (2531179, 832127), (68933, 989222)]
    for pair in pairs:
        hashes = [int(substring._hashes(np.array([xxhash.xxh64_intdigest(w) for w in [*fixed, f"x{i}"]], np.uint64), 13)[0]) for i in pair]
        assert (hashes[0] ^ hashes[1]) % (1 << 40) == 0 and hashes[0] != hashes[1]
    rows = [(k, " ".join([*fixed, f"x{i}"])) for k, i in enumerate(i for pair in pairs for i in pair)]
    rows.append((len(rows), rows[0][1]))
    monkeypatch.setattr(substring, "TABLE_WORDS", 1)  # windows meet in the merge join only
    assert kept_rows(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))) == removed_by_force(rows)


# 3, 8, 9 and 10 agree with SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    assert same_rows(registry.QUERIES[name](spark, SMALL), duck.sql(registry.ORACLE_SQL[name]))


def test_url_rules(spark):
    rules = spark.createDataFrame(urls.RULES + [("a.b.org", "/", "block")], "host string, path string, verdict string")
    rows = [(1, "http://X.Example.NET/en/1?q"), (2, "http://example.net/fr/"), (3, None), (4, "net/"), (5, "s://net"), (6, "http://notexample.com/de/"), (7, "http://a.b.org/fr/x"), (1, "http://X.Example.NET/en/1?q"), (8, "http://[::1]/#://net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    out = sorted(tuple(r) for r in urls.filter_urls(pages, rules).select("page_id", "rule", "verdict").na.fill("-").collect())
    assert out == sorted([(1, "example.net/en/", "allow"), (1, "example.net/en/", "allow"), (2, "net/", "block"), (3, "-", "allow"), (4, "-", "allow"), (5, "-", "allow"), (6, "-", "allow"), (7, "a.b.org/", "block"), (8, "-", "allow")])
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


# 4


def test_language_held_out_and_odd_rows(spark, documents, odd, empty):
    profiles = language.fit(language.training_rows(documents))
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [r for r in language.op4_language_id(spark, SMALL).collect() if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    out = language.identify(odd, profiles).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language.identify(empty, profiles).count() == 0
    nobody = language.fit(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language.identify(odd, nobody).collect()} == {"und"}


# 5


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_encoder():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_on_any_text(encoder, reference_encoder):
    encode, decode = encoder.ready()

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.text(alphabet=" \n\t\x1c\x85\u00a0ab'sé1!", max_size=30))
    def check(text):
        ids = np.frombuffer(encode(text), "<u4").tolist()
        assert ids == reference_encoder.encode_ordinary(text) and decode(encode(text)) == text.encode()

    check()
    assert np.frombuffer(encode("x" * 5000), "<u4").tolist() == reference_encoder.encode_ordinary("x" * 5000)
    assert sorted(encoder.table.find(t) for t in encoder.tokens) == list(range(len(encoder.tokens))) and encoder.table.find(b"not one\x00") == -1


def test_bpe_query(spark, documents, odd, empty, encoder, reference_encoder):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in bpe.op5_byte_bpe(spark, SMALL).collect():
        ids = np.array(reference_encoder.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_documents(odd, encoder).count() == len(TEXTS) + 1 and bpe.encode_documents(empty, encoder).count() == 0


# 6


def test_masks_cover_every_pair():
    rng = np.random.default_rng(0)
    for radius in (1, 2, 4):
        for family in range(3):
            found = [m % (1 << 64) for m in simhash.masks(radius, family)]
            for _ in range(500):
                differ = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
                assert any(m & differ == 0 for m in found)


def groups_by_force(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def fingerprint_by_force(text, n=4):
    w = [x.translate(simhash.LOWER) for x in words_of(text)]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_simhash_against_brute_force(spark, documents, odd, empty, hot, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (hot,))
    for docs in (documents, odd):
        rows = docs.select("doc_id", "text").collect()
        fps = [fingerprint_by_force(r["text"]) for r in rows]
        want = sorted(zip([r["doc_id"] for r in rows], fps, groups_by_force([r["doc_id"] for r in rows], fps)), key=str)
        got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
        assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def groups_by_similarity(rows):
    """Components of the rows ``(id, text)`` whose sets of five-word shingles have a Jaccard index of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = [x.translate(simhash.LOWER) for x in words_of(t)]
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def near_copies():
    """Texts, and copies of them in which more and more words are others; a passage that all texts share."""
    rng, rows = np.random.default_rng(6), []
    for base in range(12):
        words = [f"b{base}x{i}" for i in range(int(rng.integers(4, 90)))] + [f"common{i}" for i in range(13)]
        for copy in range(9):
            mine = list(words)
            for k in rng.integers(0, len(mine), copy // 2):
                mine[k] = f"new{base}x{copy}x{k}"
            rows.append((len(rows), " ".join(mine)))
    return rows


@pytest.mark.parametrize("sample", [similar.SAMPLE, 0])
def test_similar_documents_against_brute_force(spark, documents, odd, empty, sample, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    for docs in (documents, odd, spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = sorted(((r["doc_id"], r["component_id"]) for r in similar.near_duplicates(docs).collect()), key=str)
        assert got == sorted(zip([i for i, _ in rows], groups_by_similarity(rows)), key=str)
    assert similar.near_duplicates(empty).count() == 0


def test_near_dedup_stage_keeps_one_of_similar_documents(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SMALL).collect())
    assert kept == sorted(set(groups_by_similarity(rows)))


def test_components_of_a_long_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(100, 160)] + [(7, 7)]
    found = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {i: 100 for i in [*range(101, 160), 1000]}


# 7


def check_packing(pieces, texts):
    """Every id of every row in one piece, sequences gapless; rows of one id are told apart by what they hold."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = {}
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = want.get(i, 0) + len(ids)
    got, sequences = {}, {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes), sum(sizes)


def test_packing(spark, documents, odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    pieces = packing.packed_pieces(documents.coalesce(1)).collect()
    padding, total = check_packing(pieces, list(texts.items()))
    assert padding <= 4096 + 0.005 * total
    ids = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    for p in pieces:
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    check_packing(packing.packed_pieces(odd).collect(), TEXTS + TEXTS[:1])
    assert packing.packed_pieces(empty).count() == 0


def test_words_alone_are_encoded_as_in_a_text():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    encode, kind = packing.WordTokenizer.load(public_tokenizers.path("word_bpe_49k.json")).ready()

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=40) | st.text(alphabet="abÉΣσİı. ,'s!?1\n\x1c\u00a0%é\u0301", max_size=25))
    def check(text):
        assert np.frombuffer(encode([text])[0], kind).tolist() == whole.encode(text, add_special_tokens=False).ids

    check()


def test_added_tokens_are_encoded_as_the_library_does(spark):
    usual = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode, kind = packing.WordTokenizer.load(public_tokenizers.path("word_bpe_49k.json")).ready()
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "É<|startoftext|>'s x\n<|EndOfText|>", "plain", "<|endoftext|>" * 3, "<|endoftext |> <|", ""]
    want = [usual.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, kind).tolist() for x in encode(texts)] == want
    whole, _ = packing.WordTokenizer.load(public_tokenizers.path("word_bpe_49k.json"), alone=False).ready()
    assert [np.frombuffer(x, kind).tolist() for x in whole(texts)] == want

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "a", "É", "'s", "\u0301", "\n"]), max_size=8).map("".join))
    def check(text):
        assert np.frombuffer(encode([text])[0], kind).tolist() == usual.encode(text, add_special_tokens=False).ids

    check()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.packed_pieces(docs).collect()} == {i: len(x) + 1 for i, x in enumerate(want)}


def test_words_that_repeat_cost_no_python_objects():
    """Of 400,000 words, only the 200 that differ become Python's: 21 MB at once, where each of them took 55 MB."""
    encode, kind = packing.WordTokenizer.load(public_tokenizers.path("word_bpe_49k.json")).ready()
    text = " ".join("abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] + ",."[i // 100 % 2] for i in range(400_000))
    encode([text])
    tracemalloc.start()
    try:
        ids = np.frombuffer(encode([text])[0], kind)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 90 * text.count(" ")
    assert ids.tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("cached", [0, 3, packing.CACHED])
def test_words_in_a_cache_that_is_emptied(cached):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode, kind = packing.WordTokenizer.load(public_tokenizers.path("word_bpe_49k.json")).ready(cached)
    words = ["a", "Éé", "ßẞ", "ÿ÷", "ΣΑΣ", "İı", "日本", "\u212b", "e\u0301", "x's", "12", "!?", "a!", "éé.", "é-é.", "e\u0301,", "\u00a0", "\x1c", "\0", ""]

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(words), max_size=6).map(" ".join) | st.lists(st.sampled_from(words), max_size=6).map("".join), max_size=5))
    def check(texts):
        assert [np.frombuffer(x, kind).tolist() for x in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]

    check()


def test_rows_encoded_together():
    batches = [pd.DataFrame({"doc_id": [1, 2, 3], "text": ["a" * 900, None, "b" * 300]}), pd.DataFrame({"doc_id": [], "text": []}), pd.DataFrame({"doc_id": [4, 5], "text": ["c" * 2000, ""]})]
    found = [(ids, [len(t) for t in texts]) for ids, texts in packing.together(iter(batches), 1200)]
    assert found == [([1, 2], [900, 0]), ([3], [300]), ([4], [2000]), ([5], [0])]


def test_a_worker_gives_back_what_packing_took():
    """15 MB stay with the worker; 96 and more did where Arrow kept what it had freed."""
    code = (
        "import gc, sys, public_tokenizers\n"
        "from lithoscope.llm import common, packing\n"
        "held = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096 / 1e6\n"
        "common.tidy()\n"
        "before = held()\n"
        "encode, _ = packing.WordTokenizer.load(public_tokenizers.path('word_bpe_49k.json')).ready()\n"
        "for k in range(3):\n"
        "    encode([' '.join(f'{chr(97 + i % 26)}b{i * 7919 % 90001}' for i in range(n, n + 1000)) for n in range(0, 600000, 1000)])\n"
        "del encode, _\n"
        "common.tidy()\n"
        "print(held() - before)\n"
    )
    left = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__)).stdout)
    assert left < 60


# 8


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet="\\#<>/turn: \nA", max_size=30), st.text(alphabet="\\#<:a\n", max_size=8))
def test_turns_read_back(text, role):
    formatted, lo, hi = chat.format_turn(role, text)
    assert chat.read_turn(formatted) == (role, text, lo, hi) and chat.unescape(formatted[lo:hi]) == text


def test_chat_trees(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x"), (2, 0, "user", "hi"), (2, 1, "assistant", "y"), (3, 0, None, None), (4, None, "user", "hi"), (4, None, "user", "hi"), (None, 0, "assistant", "</turn>\n### ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    trees = chat.conversation_trees(turns).collect()
    for t in trees:
        covered = sorted((n["start"], n["start"] + n["length"]) for n in t["nodes"])
        assert covered[0][0] == 0 and covered[-1][1] == len(t["text"]) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
        for n in t["nodes"]:
            assert n["position"] == sum(a["end"] - a["start"] for a in n["attends"])
    back = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.conversation_trees(turns)).collect()}
    assert back == {1: (2, 1), 2: (2, 1), 3: (1, 0), 4: (2, 0), None: (1, 12)}
    assert chat.conversation_trees(turns.limit(0)).count() == 0


# 9


def test_fingerprints_of_odd_rows(spark, odd, empty):
    rows = merkle.with_next(odd).collect()
    order = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = sorted([(*order[i], order[(i + 1) % len(order)][1]) for i in range(len(order))], key=str)
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in rows), key=str) == want
    assert merkle.with_next(empty).count() == 0
    prints = {(r["text"] or ""): r["fingerprint"] for r in merkle.fingerprint(odd).collect()}
    assert len(set(prints.values())) == len(prints)


def test_next_rows_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 3)
    docs = spark.createDataFrame([(i * 7 % 101, f"t{i}") for i in range(101)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(docs).collect()}
    text = {i * 7 % 101: f"t{i}" for i in range(101)}
    assert got == {i: text[(i + 1) % 101] for i in range(101)}


# 10


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(0, rng.choice([0.1, 1, 5]), 8)]) for i in range(700)]
    data += [(700, None), (701, [1.0, float("nan")]), (702, [None, 1.0]), (703, []), (50, data[50][1]), (3, data[3][1]), (704, [0.0] * 8), (750, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    q = topk.quantised(df, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(q, F.col("vec_id") % 50 == 0, 5, head=3, block=64).collect())
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i in sorted({i for i, _ in ok if i % 50 == 0}):
        own = next(v for j, v in ok if j == i)
        best = sorted(((-int(own @ v), j) for j, v in ok if j != i))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(q.limit(0), F.lit(True)).count() == 0


# The pipeline


def test_pipeline_stages(spark, documents):
    docs = documents
    columns = documents.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs.count(), corpus_pipeline.written(stage(spark, docs, SMALL), "test")[0]
        assert docs.columns == columns and 0 < docs.count() <= before, name
    rows = docs.collect()
    fps = [fingerprint_by_force(r["text"]) for r in documents.collect()]
    by_id = dict(zip([r["doc_id"] for r in documents.collect()], groups_by_force([r["doc_id"] for r in documents.collect()], fps)))
    assert len({by_id[r["doc_id"]] for r in rows}) == len(rows)
    pieces = corpus_pipeline.pack(spark, docs, SMALL).collect()
    check_packing(pieces, [(r["doc_id"], r["text"]) for r in rows])


def test_pipeline_decisions_take_effect(spark, documents):
    kept = corpus_pipeline.keep_one_of_each_group(spark, documents, SMALL)
    found = simhash.near_duplicates(documents)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in found.where("doc_id = component_id").collect())
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeated_passages(spark, documents, SMALL).collect()}
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for doc, n, gone, text in removed_by_force(texts):
        assert (gone == n > 0) == (doc not in cut)
        if doc in cut:
            assert cut[doc] == (text if gone else dict(texts)[doc])
