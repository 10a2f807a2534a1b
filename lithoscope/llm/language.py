"""Operator 4, language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds its letters' vectors,
each rotated by its distance from the end, by multiplying them; a text's vector bundles (sums) those of its n-grams;
so does a language's prototype over its training texts. A text gets the language of the largest cosine. Texts are
lower-cased, what is no letter counts as one space, and every text is used whole.

The prototypes are fitted on a bounded sample: about ``per_class`` documents of each language, chosen by a hash of the document
at a rate set from the size of the language. All else covers all rows.

Edge cases: ``und`` and score 0 for a null text, one without letters, or no training rows; equal cosines go to the
language that sorts first; negative cosines score 0; rows without lang are predicted but not learned from; repeated rows
get equal results; added columns replace those of the same name, other columns stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from lithoscope.llm.common import appended, bounded_sample, checkpoint, crc_mod, parts, plain, read, received, sent, small_batches, without

#: Components of a vector, letters in an n-gram, training documents of a language.
DIMENSIONS, LETTERS, PER_CLASS = 1024, 3, 800
#: N-grams and letters whose vectors are held, n-grams whose vectors are summed at once, characters that are read at once.
TABLE, LETTER_TABLE, SLICE, PART_CHARS = 40_000, 20_000, 4_096, 2_000_000


#: Most sampled ids that go to all executors; with more languages than that, texts are shuffled to meet them.
BROADCAST_IDS = 1_000_000


class Space:
    """The hyperdimensional space: n-gram vectors, and sums of them over texts.

    Memory is bounded: vectors of n-grams are made from their letters' in slices of ``SLICE``, at most ``TABLE`` of them
    and ``LETTER_TABLE`` letters are held (a byte a component), and texts are read in parts of bounded length.
    """

    def __init__(self, dimensions: int = DIMENSIONS, letters: int = LETTERS):
        self.dimensions, self.letters = dimensions, letters

    def _begin(self) -> None:
        every = np.arange(0x110000, dtype=np.uint32)
        self.is_letter = np.array([chr(c).isalpha() for c in every.tolist()])
        self.letter_vectors: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((TABLE, self.dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        """A letter's vector, drawn from its code point."""
        if code not in self.letter_vectors:
            if len(self.letter_vectors) >= LETTER_TABLE:
                self.letter_vectors.clear()
            bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letter_vectors[code] = bits * 2 - 1
        return self.letter_vectors[code]

    def _made(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams: those of their letters, each rotated by its distance from the end, multiplied."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for k in range(self.letters):
            codes, place = np.unique(grams >> 21 * k & 0x1FFFFF, return_inverse=True)
            out *= np.array([np.roll(self.letter(c), k) for c in codes.tolist()], np.int8).reshape(len(codes), self.dimensions)[place]
        return out

    def _slice(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, from the table where they are in it."""
        place = np.array([self.rows.get(g, -1) for g in grams.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        made = self._made(grams[new])
        kept = max(0, min(len(new), TABLE - len(self.rows)))
        at = len(self.rows) + np.arange(kept)
        self.table[at] = made[:kept]
        self.rows.update(zip(grams[new[:kept]].tolist(), at.tolist()))
        place[new[:kept]] = at
        out = self.table[place].astype(np.float32)
        out[new[kept:]] = made[kept:]
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes of the text's n-grams, 21 bits for each letter, and their counts; none if it has no letter."""
        found, carry, after_letter, any_letter, lo = [], np.array([32], np.int64), False, False, 0
        while lo < len(text):
            hi = lo + PART_CHARS
            while hi < len(text) and text[hi - 1].isalpha():  # a cut comes after no letter, for lower-casing
                hi += 1
            codes = np.frombuffer(text[lo:hi].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            known = self.is_letter[codes]
            keep = known | np.concatenate([[after_letter], known[:-1]])  # of a run without letters one space stays
            carry = np.concatenate([carry, np.where(known, codes, 32)[keep].astype(np.int64)])
            after_letter, any_letter, lo = bool(known[-1]), any_letter or bool(known.any()), hi
            if lo >= len(text) and after_letter:
                carry = np.concatenate([carry, [32]])
            n = self.letters
            if len(carry) >= n:
                own = carry[n - 1 :].copy()
                for k in range(1, n):
                    own |= carry[n - 1 - k : len(carry) - k] << 21 * k
                found.append(np.unique(own, return_counts=True))
                carry = carry[len(carry) - n + 1 :]
        if not any_letter or not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(found) == 1:
            return found[0]
        every, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        return every, np.bincount(place, np.concatenate([c for _, c in found])).astype(np.int64)

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A bundle for each text, and whether it has letters."""
        if not hasattr(self, "rows"):
            self._begin()
        out, letters = np.zeros((len(texts), self.dimensions)), np.zeros(len(texts), bool)
        for lo, hi in parts(texts, 500, PART_CHARS):
            own = [self.grams(t) if t else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in texts[lo:hi]]
            letters[lo:hi] = [len(g) > 0 for g, _ in own]
            row = np.repeat(np.arange(hi - lo), [len(g) for g, _ in own])
            every, place = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
            counts, order = np.concatenate([c for _, c in own]), np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(0, len(every) + SLICE, SLICE))
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                part, first = order[a:b], k * SLICE
                own_vectors = self._slice(every[first : first + SLICE])
                if len(part) <= 4 * SLICE and 40 * len(part) < len(own_vectors) * (hi - lo):  # few n-grams are shared
                    part = part[np.argsort(row[part], kind="stable")]
                    at = np.flatnonzero(np.concatenate([[True], row[part][1:] != row[part][:-1]]))
                    each = own_vectors[place[part] - first] * counts[part, None].astype(np.float32)
                    out[lo + row[part][at]] += np.add.reduceat(each, at, axis=0)
                    continue
                some = np.zeros((hi - lo, len(own_vectors)), np.float32)
                some[row[part], place[part] - first] = counts[part]
                out[lo:hi] += some @ own_vectors
        return out, letters


class Profiles:
    """Prototypes of languages."""

    def __init__(self, space: Space, languages: list[str], prototypes: np.ndarray):
        self.space, self.languages, self.prototypes = space, languages, prototypes

    def predict(self, texts) -> tuple[list[str], list[float]]:
        v, letters = self.space.vectors([t if isinstance(t, str) else None for t in texts])
        if not self.languages:
            return ["und"] * len(v), [0.0] * len(v)
        length = np.sqrt((v**2).sum(1))
        cosine = (v @ self.prototypes.T) / np.where(length > 0, length, 1)[:, None]
        best = cosine.argmax(1)
        score = np.where(letters, np.clip(cosine[np.arange(len(v)), best], 0, 1), 0)
        return [self.languages[i] if ok else "und" for i, ok in zip(best, letters)], score.tolist()


def fit(labelled: DataFrame, id_col: str = "doc_id", per_class: int = PER_CLASS, space: Space | None = None) -> Profiles:
    """Prototypes from ``labelled(id, text, lang)``; a sum of vectors for each language and task comes to the driver."""
    space = space or Space()
    d = space.dimensions
    small_batches(labelled)
    sample = bounded_sample(labelled.where(F.col("text").isNotNull()).select(id_col, "lang"), [id_col], "lang", per_class)
    ids = checkpoint(sample.select(id_col).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = labelled.join(ids, id_col, "left_semi").where(F.col("lang").isNotNull()).select("text", "lang")

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            v, _ = space.vectors(b["text"].tolist())
            for lang, rows in b.reset_index(drop=True).groupby("lang").groups.items():
                total[lang] = total.get(lang, np.zeros(d)) + v[list(rows)].sum(0)
            if len(total) > 1_000:  # each sum is 8 KB
                yield pd.DataFrame({"lang": list(total), "v": list(total.values())})
                total = {}
        if total:
            yield pd.DataFrame({"lang": list(total), "v": list(total.values())})

    summed = chosen.mapInPandas(bundle, "lang string, v array<double>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    sums = {r["lang"]: np.array(r["v"]) for r in summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v")).collect()}
    sums = {k: v for k, v in sums.items() if v.any()}
    languages = sorted(sums)
    prototypes = np.array([sums[k] / np.sqrt((sums[k] ** 2).sum()) for k in languages]).reshape(len(languages), d)
    return Profiles(Space(space.dimensions, space.letters), languages, prototypes)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = plain(docs)
    kept, held = without(docs, ["lang_pred", "score"]), sent(docs, profiles)
    text = text_col if text_col in kept.columns else "__text"

    def run(batches):
        own = received(held)
        for b in batches:
            lang, score = own.predict(b[text])
            b = b if text == text_col else b.drop(columns=text)
            yield b.assign(lang_pred=lang, score=score)

    schema = appended(kept.schema, [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    extra = [] if text == text_col else [F.col(f"`{text_col}`").alias(text)]
    return docs.select(*[F.col(f"`{c}`") for c in kept.columns], *extra).mapInPandas(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that the contract lets the prototypes learn from."""
    return docs.where(F.col("lang").isNotNull() & F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False))).select("doc_id", "text", "lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit(training_rows(docs))
    return identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
