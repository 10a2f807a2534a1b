"""Operators at parameters that make small tables take the ways of large ones, and the cases that contracts leave open."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import groups_by_similarity, near_copies

from lithoscope.llm import language, similar, simhash, topk


def by_force(data, k=5):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i in sorted({i for i, _ in ok if i % 50 == 0}):
        scores = [(-sum(int(a) * int(b) for a, b in zip(q, v)), j) for n, q in ok if n == i for j, v in ok if j != i]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return want


def found(spark, data, **how):
    q = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    return sorted(tuple(r) for r in topk.top_k(q, F.col("vec_id") % 50 == 0, 5, **how).collect())


def test_topk_with_a_block_for_each_vector(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(0, 1 + i % 3, 4)]) for i in range(2_000)]
    assert found(spark, data, head=2, block=1, query_block=3) == sorted(by_force(data))


def test_topk_of_empty_equal_and_repeated_vectors(spark):
    assert found(spark, [(0, [-1.0]), (1, []), (2, [1.0])]) == [(0, 1, 1, 0), (0, 2, 2, -65536)]
    assert found(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]
    assert found(spark, [(1, [1.0])]) == []
    equal = [(i, [1.0, -1.0]) for i in range(120)]
    assert found(spark, equal, block=7) == sorted(by_force(equal))
    repeated = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [i * 0.1, -i * 0.2]) for i in range(1, 30)]
    assert found(spark, repeated, block=4) == sorted(by_force(repeated))


@pytest.mark.parametrize("block", [2, 5])
def test_similar_documents_of_hot_buckets_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "PAIRS", 7)
    rows = near_copies() + [(500 + i, f"same words here and there but number {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, words=5, similarity=0.8).collect())
    assert got == sorted(zip([i for i, _ in rows], groups_by_similarity(rows)))


def test_fingerprints_of_a_text_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (0, 1, 3, 4, 5, 900)] + [None, "  ", "x" * 300 + "  " + "y " * 40]
    whole, sets = simhash.fingerprints(texts, 4), [simhash.shingle_hashes(t, 4).tolist() for t in texts]
    monkeypatch.setattr(simhash, "HELD", 11)
    monkeypatch.setattr(simhash, "PART_BYTES", 13)
    assert [simhash.shingle_hashes(t, 4).tolist() for t in texts] == sets
    assert simhash.fingerprints(texts, 4).tolist() == whole.tolist()


def test_bitmaps_never_rule_out_what_is_alike():
    rng, like = np.random.default_rng(2), similar.Likeness(0.8)
    for n in (1, 5, 40, 300, 2_000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for swapped in (0, n // 20, n // 9):
            t = np.unique(np.concatenate([s[swapped:], rng.integers(0, 1 << 63, swapped).astype(np.uint64)]))
            both = len(np.intersect1d(s, t))
            assert like.alike(len(s), len(t), both) == (5 * both >= 4 * (len(s) + len(t) - both))
            x, y = (np.frombuffer(similar.parity(z), np.uint8) for z in (s, t))
            size = min(len(x), len(y))
            bits = int(np.bitwise_count(similar.halved(x, size) ^ similar.halved(y, size)).sum())
            assert bits <= len(s) + len(t) - 2 * both and (not like.alike(len(s), len(t), both) or like.may_differ(bits, len(s), len(t)))
            empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if like.alike(len(s), len(t), both):
                assert np.intersect1d(similar.prefix(s, like.prefix(len(s)), empty), similar.prefix(t, like.prefix(len(t)), empty)).size


def test_language_vectors_against_plain_bundling(monkeypatch):
    texts = ["Ab ça!! ab", "x", "12 %%", None, "", "Größe größe der, die", "!a", "a!", " 12 ab  cd. " * 40, "日本語 日本"]

    def plainly(space, text):
        letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not letters.strip():
            return np.zeros(space.dimensions)
        padded = " " + " ".join(letters.split()) + " "
        total = np.zeros(space.dimensions)
        for i in range(len(padded) - 2):
            v = np.ones(space.dimensions)
            for k, c in enumerate(reversed(padded[i : i + 3])):
                v = v * np.roll(space.letter(ord(c)), k)
            total += v
        return total

    space = language.Space(256)
    got, letters = space.vectors(texts)
    want = np.array([plainly(space, t) for t in texts])
    assert (got == want).all() and letters.tolist() == [bool(t) and any(c.isalpha() for c in t) for t in texts]
    for name, value in (("SLICE", 3), ("TABLE", 5), ("PART_CHARS", 4), ("LETTER_TABLE", 2)):
        monkeypatch.setattr(language, name, value)
        assert (language.Space(256).vectors(texts)[0] == want).all()
    prototypes = language.Profiles(space, ["one", "two"], np.array([want[0], want[5]]) / np.sqrt((want[[0, 5]] ** 2).sum(1))[:, None])
    lang, score = prototypes.predict(texts)
    for i, t in enumerate(texts):
        cosine = [float(want[i] @ want[j]) / (np.linalg.norm(want[i]) * np.linalg.norm(want[j]) or 1) for j in (0, 5)]
        assert lang[i] == ("und" if not want[i].any() else ["one", "two"][int(np.argmax(cosine))]) and np.isclose(score[i], max(0, *cosine) if want[i].any() else 0)


def test_language_memory_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1_000))) for _ in range(60)]
    space = language.Space()
    space.vectors(["a"])
    tracemalloc.start()
    space.vectors(texts)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i // 3) * 5} word", f"l{i // 3:03}") for i in range(900)]
    profiles = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert profiles.languages == [f"l{i:03}" for i in range(300)]
