"""Operator 5, byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes.

The vocabulary (a public rank file; its path is a parameter) becomes a minimal perfect hash on the driver: keys fall into
small buckets, and each bucket gets the first displacement that sends its keys to free slots, so that n keys fill n slots.
A pre-token is looked up by one hash and one comparison of bytes. A pre-token that isn't in the vocabulary is split into
bytes, linked in both directions; a heap of (rank, place) gives the next merge, stale entries are skipped. A bounded cache
of spans stands before both tiers; it never changes a result.

Before the pattern is applied, a text is cut at single spaces that follow a character which is no white space. No match
of the pattern can reach across such a place, since white space stands in a match only at its start or fills it; texts
with other white space before a space are matched whole.

Edge cases: a null text is encoded as an empty one (no ids); any Unicode text round-trips; a pre-token of any length takes
n log n steps; repeated rows and ids are encoded each; other columns stay, those with names of added ones give way.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from lithoscope.llm.common import Memo, appended, plain, read, received, sent, without

#: White space before a space: such texts are matched whole.
UNSAFE = re.compile(r"\s ")


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: ``find(key)`` is the key's index in ``keys``, or -1."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.m = m = max(1, n // 3)
        self.slots = [-1] * n
        self.shift = [0] * m
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            buckets.setdefault(h % m, []).append((h >> 20, i))
        for b in sorted(buckets, key=lambda b: -len(buckets[b])):
            own = buckets[b]
            d = 0
            while True:
                places = {self._slot(h, d) for h, _ in own}
                if len(places) == len(own) and all(self.slots[p] < 0 for p in places):
                    break
                d += 1
            self.shift[b] = d
            for h, i in own:
                self.slots[self._slot(h, d)] = i
        self.keys = [keys[i] for i in self.slots]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 >> 17 & 0xFFFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        p = self._slot(h >> 20, self.shift[h % self.m])
        return self.slots[p] if self.keys[p] == key else -1


class Encoder:
    """Encoding and decoding by one vocabulary; made on the driver, sent to the executors (bounded by the vocabulary)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = [ranks[t] for t in self.tokens]
        self.table = PerfectHash(self.tokens)
        self.pattern = pattern

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def ready(self) -> tuple:
        """``encode(text) -> uint32 ids as bytes`` and ``decode(bytes) -> bytes``, with caches of their own."""
        find, ids, tokens = self.table.find, self.ids, self.tokens
        packed, heapify, pop, push, replace = [i.to_bytes(4, "little") for i in ids], heapq.heapify, heapq.heappop, heapq.heappush, heapq.heapreplace
        bits = len(tokens).bit_length()
        mask = (1 << bits) - 1
        single = [find(bytes([b])) for b in range(256)]
        if min(single) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        # A pair of tokens to the token they make, or -1. Tokens are numbered by rank, so the least number merges first.
        pairs = Memo(lambda p: find(tokens[p >> bits] + tokens[p & mask]), 1_000_000)

        first_makes = [pairs[a << bits | b] for a in single for b in single]  # by two bytes

        def merged(piece: bytes) -> list[int]:
            n = len(piece)
            shift = n.bit_length()
            low = (1 << shift) - 1
            at = [single[b] for b in piece]
            makes = [first_makes[a << 8 | b] for a, b in zip(piece, piece[1:])]  # what each place and the next now make
            heap = [t << shift | i for i, t in enumerate(makes) if t >= 0]
            if not heap:
                return at
            makes.append(-1)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapify(heap)
            while heap:
                e = heap[0]
                i, t = e & low, e >> shift
                if makes[i] != t:
                    pop(heap)  # stale: one of the pair has been merged
                    continue
                j = after[i]
                at[i], at[j], makes[j] = t, -1, -1
                after[i] = k = after[j]
                u = -1
                if k < n:
                    before[k] = i
                    u = pairs[t << bits | at[k]]
                makes[i] = u
                if u >= 0:
                    replace(heap, u << shift | i)
                else:
                    pop(heap)
                h = before[i]
                if h >= 0:
                    makes[h] = u = pairs[at[h] << bits | t]
                    if u >= 0:
                        push(heap, u << shift | h)
            return [x for x in at if x >= 0]

        def pre_token(p: str) -> bytes:
            key = p.encode()
            i = find(key)
            return packed[i] if i >= 0 else b"".join([packed[x] for x in merged(key)])

        match = regex.compile(self.pattern).findall
        piece = Memo(pre_token, 300_000, 64).__getitem__

        def matched(s: str) -> bytes:
            return b"".join(map(piece, match(s)))

        def spaced(s: str) -> bytes:
            """The encoding of a space and ``s``, which has no space; such ASCII letters are one pre-token."""
            return pre_token(" " + s) if letters_alone and s.isalpha() and s.isascii() else matched(" " + s)

        letters_alone = match(" az ZA\u00e9") == [" az", " ZA\u00e9"] and " ?\\p{L}+" in self.pattern
        span = Memo(matched, 100_000, 64).__getitem__
        after_space = Memo(spaced, 600_000, 64).__getitem__

        def encode(text: str) -> bytes:
            if UNSAFE.search(text):
                return matched(text)
            first, *rest = text.split(" ")
            return span(first) + b"".join(map(after_space, rest))

        place = {x: t for x, t in zip(ids, tokens)}

        def decode(encoded: bytes) -> bytes:
            return b"".join(map(place.__getitem__, np.frombuffer(encoded, "<u4").tolist()))

        return encode, decode


def encode_documents(docs: DataFrame, encoder: Encoder, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens``."""
    docs = plain(docs)
    held = sent(docs, encoder)
    kept = without(docs, ["ids", "n_tokens", text_col])

    def run(batches):
        encode, _ = received(held).ready()
        for b in batches:
            ids = [encode(t) if t is not None else b"" for t in b.pop("__text")]
            yield b.assign(ids=ids, n_tokens=[len(x) // 4 for x in ids])

    schema = appended(kept.schema, [StructField("ids", BinaryType()), StructField("n_tokens", LongType())])
    return docs.select(*kept.columns, F.col(f"`{text_col}`").alias("__text")).mapInPandas(run, schema)


def decode_documents(encoded: DataFrame, encoder: Encoder) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` in place of them, as ``decoded``."""
    held = sent(encoded, encoder)

    def run(batches):
        _, decode = received(held).ready()
        for b in batches:
            yield b.assign(decoded=[decode(x) for x in b["ids"]])

    return encoded.mapInPandas(run, appended(encoded.schema, [StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, encoder: Encoder, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and the SHA-256 of the ids and of the bytes decoded from them again.

    The ids are made and read in one pass and go no further than the task; a null text is an empty one.
    """
    docs = plain(docs)
    held = sent(docs, encoder)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = without(docs, [*added, text_col])

    def run(batches):
        encode, decode = received(held).ready()
        for b in batches:
            rows = []
            for t in b.pop("__text"):
                ids = encode(t) if t is not None else b""
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids)).hexdigest()))
            yield b.assign(**{c: [r[i] for r in rows] for i, c in enumerate(added)})

    kinds = zip(added, (LongType(), StringType(), StringType()))
    return docs.select(*kept.columns, F.col(f"`{text_col}`").alias("__text")).mapInPandas(run, appended(kept.schema, [StructField(n, k) for n, k in kinds]))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded again; digests of both."""
    import public_tokenizers

    encoder = Encoder.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), encoder)
