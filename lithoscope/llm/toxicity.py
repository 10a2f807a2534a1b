"""Operator 1, toxicity: a linear-chain conditional random field tags toxic words; marginals give scores and offsets.

Token labels come from document labels: a feature of a word (the word, its first three to six letters, its last three or
four) counts as toxic if its documents are toxic far more often than others, by a likelihood ratio; in toxic documents,
words with such a feature are labelled 1, all other words 0. A CRF with two states is fitted to segments around such words
and to segments without them. Scoring runs the exact forward-backward recursion over a whole text: runs of words without
a known feature have equal potentials, so a run of g words is one power of a 2 x 2 matrix. A document's score joins the
marginals of its words by noisy-or and calibrates this by a logistic fitted to the sample; words with a marginal of 0.5
or more make spans with character offsets.

The fit uses a bounded sample: about ``PER_CLASS`` labelled documents of each label (chosen by hash, whole texts), at most
``MAX_FEATURES`` features, the strongest, and ``MAX_SEGMENTS`` segments. The calibration weighs each label's documents by the
share of them that was taken, so that a score doesn't shift once a label has more than ``PER_CLASS``. Scoring covers every row and whole texts.

Edge cases: null and empty texts have no spans and the lowest score; labels that are null or of unknown documents are not
used, repeated labels of a document count as toxic if one is; without rows of both labels every score is the share of
toxic rows (0 if there are none); repeated rows score alike; added columns replace those of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lithoscope.llm.common import Memo, appended, bounded_sample, checkpoint, crc_mod, plain, read, received, sent, small_batches, tidy, without

PER_CLASS, MAX_SEGMENTS, MAX_FEATURES, HALF_SEGMENT, ROUNDS = 4_000, 6_000, 100_000, 6, 80
#: Least likelihood ratio and odds of a feature that counts as toxic, and documents that it must occur in.
LEAST_RATIO, LEAST_ODDS, LEAST_DOCUMENTS = 18.0, 6.0, 3
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *(f"{n}<{w[:n]}" for n in range(3, min(6, len(w)) + 1)), *(f"{n}>{w[-n:]}" for n in (3, 4) if len(w) >= n)]


def toxic_features(sample: DataFrame) -> list[str]:
    """Features that mark the toxic ones of ``sample(text, toxic)``, from counts of documents that tasks add up."""
    size = sample.agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")).first()
    n1, n0 = size["n1"], size["n0"]

    def count(batches):
        tidy()
        held = Memo(features, 200_000, 64)
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found[y].update({f for w in set(WORD.findall(t)) for f in held[w]})
                if len(found[0]) + len(found[1]) > 500_000:
                    yield from tables(found)
                    found = (Counter(), Counter())
        yield from tables(found)

    def tables(found):
        for y in (0, 1):
            n = np.array(list(found[y].values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found[y]), pa.string()), pa.array(n * y), pa.array(n * (1 - y))], names=["f", "n1", "n0"])

    rows = sample.select("text", "toxic").mapInArrow(count, "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b"))
    a, b = F.col("a"), F.col("b")
    odds = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    ratio = 2 * (a * F.log(a / e1) + F.when(b > 0, b * F.log(b / e0)).otherwise(0.0))
    marking = rows.where((a >= LEAST_DOCUMENTS) & (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO))
    return sorted(r["f"] for r in marking.orderBy(ratio.desc(), "f").limit(MAX_FEATURES).select("f").collect())


class SpanModel:
    """A fitted CRF with its calibration. ``base`` is the score of all texts if nothing could be fitted."""

    def __init__(self, vocabulary: dict[str, int], base: float):
        self.vocabulary, self.base = vocabulary, base
        self.weights, self.bias, self.moves = np.zeros(len(vocabulary)), 0.0, np.zeros((2, 2))
        self.calibration: list[float] = []

    def known(self, word: str) -> list[int]:
        v = self.vocabulary
        return [v[f] for f in features(word) if f in v]

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """A logistic of the evidence by weighted Newton steps, shortened where they are long."""
        x, y, w = evidence, toxic.astype(float), weight / weight.mean()
        c, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (w * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(h, x.T @ (w * (p - y)) + ridge * c)
            c = c - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        self.calibration = c.tolist()

    def segments_of(self, text: str) -> list[tuple[bool, list[list[int]]]]:
        """Stretches around the words with known features, or one stretch of a text that has none, as features by word."""
        row = list(map(self.ids.__getitem__, WORD.findall(text)))
        size, out, last = 2 * HALF_SEGMENT + 1, [], -2 * HALF_SEGMENT
        for i, f in enumerate(row):
            if f and i - last > HALF_SEGMENT:
                lo = max(0, i - HALF_SEGMENT)
                out.append((True, row[lo : lo + size]))
                last = i
        if not out and row:
            lo = (len(row) * 7919) % max(1, len(row) - size + 1)
            out.append((False, row[lo : lo + size]))
        return out

    @property
    def ids(self) -> Memo:
        if not hasattr(self, "_ids"):
            self._ids = Memo(self.known, 200_000, 64)
        return self._ids

    def tensors(self, chosen: list[tuple[list[list[int]], int]]):
        """Features, labels and mask of segments and their documents' labels."""
        size = 2 * HALF_SEGMENT + 1
        most = max([1, *(len(f) for s, _ in chosen for f in s)])
        f = np.full((len(chosen), size, most), len(self.vocabulary))
        y, mask = np.zeros((len(chosen), size)), np.zeros((len(chosen), size), bool)
        for i, (s, label) in enumerate(chosen):
            mask[i, : len(s)] = True
            for j, own in enumerate(s):
                f[i, j, : len(own)] = own
                y[i, j] = float(bool(own) and label)
        return f, y, mask

    def _descend(self, f, y, mask) -> None:
        """Adam on the penalised log-likelihood; expectations from forward and backward passes over all segments."""
        n, size = mask.shape
        k = len(self.vocabulary)
        theta = np.zeros(k + 1 + 1 + 4)  # features, a slot for padding, the bias, the moves
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        gold = np.zeros((2, 2))
        pairs = mask[:, 1:] & mask[:, :-1]
        for a in (0, 1):
            for b in (0, 1):
                gold[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum()
        for step in range(1, ROUNDS + 1):
            theta[k] = 0
            moves = theta[k + 2 :].reshape(2, 2)
            e = np.zeros((n, size, 2))
            e[:, :, 1] = (theta[f].sum(2) + theta[k + 1]) * mask
            alpha, beta = np.zeros((n, size, 2)), np.zeros((n, size, 2))
            alpha[:, 0] = e[:, 0]
            for t in range(1, size):
                into = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], into, alpha[:, t - 1])
            for t in range(size - 2, -1, -1):
                on = e[:, t + 1] + beta[:, t + 1]
                beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(moves[:, 0] + on[:, :1], moves[:, 1] + on[:, 1:]), beta[:, t + 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
            grad = np.zeros_like(theta)
            off = (p1 - y) * mask
            grad[: k + 1] = np.bincount(f.ravel(), np.repeat(off.ravel(), f.shape[2]), k + 1)
            grad[k + 1] = off.sum()
            for a in (0, 1):
                for b in (0, 1):
                    joint = np.exp(alpha[:, :-1, a] + moves[a, b] + (e + beta)[:, 1:, b] - z[:, None]) * pairs
                    grad[k + 2 + 2 * a + b] = joint.sum() - gold[a, b]
            grad = grad / n + 2e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.bias, self.moves = theta[:k].copy(), float(theta[k + 1]), theta[k + 2 :].reshape(2, 2).copy()

    def _begin(self) -> None:
        self.emission = Memo(lambda w: math.exp(min(60.0, self.bias + float(self.weights[ids].sum()))) if (ids := self.known(w)) else 0.0, 150_000)
        self.move = np.exp(self.moves)
        self.plain = self.move * np.array([1.0, math.exp(self.bias)])

        def power(g: int) -> np.ndarray:
            out, base = np.eye(2), self.plain / self.plain.max()
            while g:
                if g & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base /= base.max()
                g >>= 1
            return out

        self.power = Memo(power, 50_000)

    def tag(self, text: str) -> tuple[list[int], list[float], int]:
        """Places (by word) of the words with a known feature, the marginals of their being toxic, and the number of words."""
        if not hasattr(self, "power"):
            self._begin()
        potentials = list(map(self.emission.__getitem__, WORD.findall(text)))
        hits = [i for i, e in enumerate(potentials) if e] if any(potentials) else []
        if not hits:
            return [], [], len(potentials)
        first, forward = np.array([1.0, math.exp(self.bias)]), []
        a, at = None, -1
        for i in hits:
            gap = i - at - 1
            if a is None:
                a = np.ones(2) if gap == 0 else (first @ self.power[gap - 1]) @ self.move
            else:
                a = (a @ self.power[gap]) @ self.move
            a = a * (1.0, potentials[i])
            a = a / a.sum()
            forward.append(a)
            at = i
        b = np.ones(2)
        b = self.power[len(potentials) - 1 - hits[-1]] @ b
        marginals = [0.0] * len(hits)
        for j in range(len(hits) - 1, -1, -1):
            both = forward[j] * b
            marginals[j] = float(both[1] / both.sum())
            if j:
                b = self.move @ (b * (1.0, potentials[hits[j]]))
                b = self.power[hits[j] - hits[j - 1] - 1] @ (b / b.sum())
        return hits, marginals, len(potentials)

    @staticmethod
    def evidence(places: list[int], marginals: list[float], words: int) -> tuple[float, ...]:
        """What the calibration sees: one, the log-odds of the marginals' noisy-or, their sum, and the sum by length."""
        clean = sum(math.log1p(-min(p, 1 - 1e-12)) for p in marginals)
        either = max(-4.0, min(8.0, math.log(max(-math.expm1(clean), 1e-12)) - clean))
        total = sum(marginals)
        return 1.0, either, math.log1p(total), math.log((total + 0.2) / (words + 20.0)) + 4.0

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's score and its toxic spans (start and end in characters, largest marginal)."""
        if not self.calibration:
            return self.base, []
        hits, marginals, words = self.tag(text or "")
        x = sum(a * b for a, b in zip(self.calibration, self.evidence(hits, marginals, words)))
        score = 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))
        toxic = {i: p for i, p in zip(hits, marginals) if p >= 0.5}
        spans = []
        if toxic:
            last = -2
            for i, m in enumerate(WORD.finditer(text)):
                if i in toxic:
                    if i == last + 1:
                        spans[-1]["end"], spans[-1]["marginal"] = m.end(), max(spans[-1]["marginal"], toxic[i])
                    else:
                        spans.append({"start": m.start(), "end": m.end(), "marginal": toxic[i]})
                    last = i
        return score, spans


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> SpanModel:
    """A model from ``labels`` of ``docs``. The sampled ids are broadcast; their texts stay in tasks, which send counts,
    at most ``MAX_SEGMENTS`` segments, and four numbers for each sampled document."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) >= 1).cast("int").alias("toxic"))
    chosen = bounded_sample(known, [id_col], "toxic", per_class).select(id_col, "toxic", "rate")
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    sample = checkpoint(small_batches(texts).join(F.broadcast(chosen), id_col).select("text", "toxic", "rate"))
    seen = sample.groupBy("toxic").agg(F.sum(1 / F.col("rate")).alias("n")).collect()
    share = sum(r["toxic"] * r["n"] for r in seen) / sum(r["n"] for r in seen) if seen else 0.0
    if len(seen) < 2:
        return SpanModel({}, share)
    model = SpanModel({f: i for i, f in enumerate(toxic_features(sample))}, share)
    begun = sent(sample, model)

    def cut(batches):
        own = received(begun)
        for b in batches:
            rows = [(hit, y, s) for t, y in zip(b["text"], b["toxic"]) for hit, s in own.segments_of(t)]
            yield pd.DataFrame(rows, columns=["hit", "toxic", "words"])

    kinds = sample.mapInPandas(cut, "hit boolean, toxic int, words array<array<int>>")
    order = F.xxhash64("words", "toxic")
    segments = [
        (r["words"], r["toxic"])
        for hit in (True, False) for r in kinds.where(F.col("hit") == hit).orderBy(order, "toxic").limit(MAX_SEGMENTS // 2).collect()
    ]
    if not segments:
        return model
    model._descend(*model.tensors(segments))
    fitted = sent(sample, model)

    def tagged(batches):
        own = received(fitted)
        for b in batches:
            rows = [own.evidence(*own.tag(t)) for t in b["text"]]
            yield pd.DataFrame({"x": rows, "toxic": b["toxic"], "weight": 1 / b["rate"]})

    found = sample.mapInPandas(tagged, "x array<double>, toxic int, weight double").toPandas()
    rows = np.column_stack([found["weight"], found["toxic"], np.array(found["x"].tolist())])
    rows = rows[np.lexsort(rows.T)]  # sums don't depend on the order of tasks
    model.calibrate(rows[:, 2:], rows[:, 1], rows[:, 0])
    return model


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("marginal", DoubleType())]))


def score_documents(docs: DataFrame, model: SpanModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` and ``spans``."""
    docs = plain(docs)
    kept, held = without(docs, ["score", "spans"] + ([] if keep_text else [text_col])), sent(docs, model)
    text = text_col if text_col in kept.columns else "__text"

    def run(batches):
        own = received(held)
        for b in batches:
            found = [own.score(t) for t in b[text]]
            b = b if text == text_col else b.drop(columns=text)
            yield b.assign(score=np.array([x[0] for x in found], float), spans=pd.Series([x[1] for x in found], b.index, object))

    schema = appended(kept.schema, [StructField("score", DoubleType()), StructField("spans", SPANS)])
    extra = [] if text == text_col else [F.col(f"`{text_col}`").alias(text)]
    return docs.select(*[F.col(f"`{c}`") for c in kept.columns], *extra).mapInPandas(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text of ``documents``, learnt from labels of rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    return score_documents(docs, model, keep_text=False).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.to_json("spans").alias("spans"),
    )
