"""Operator 6, SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit where over half of the text's shingle hashes have it. For a radius r each of the 64 bits gets a
non-zero vector of r + 1 bits, and each non-zero vector of r + 1 bits a mask: the places whose vectors have an odd product
with it. At most r differing places span at most r dimensions, so some mask avoids them all: every pair within the radius
agrees under one of the 2^(r+1) - 1 masks, and none is lost. Masks hold about half of the places.

Only distinct fingerprints are masked. Those that agree under a mask make a bucket; within it a breadth-first search over
the unvisited gives a spanning forest of the links, never all pairs. A bucket of more than ``HOT`` fingerprints is split by
a second family of masks over its members, which covers every pair again, and so on: after three levels the places left
open allow no more members. Components of the forests give each document the smallest id that it reaches.

Edge cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle are one
shingle; repeats of a shingle count; rows of one id keep their fingerprints each and share the smallest component; a null
id gets a component but never names one unless it is alone there; other columns stay, added ones replace those of the
same name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from lithoscope.llm.common import appended, checkpoint, plain, read, tidy, without
from lithoscope.llm.components import named_by_least

#: Distinct fingerprints of a bucket beyond which it is split.
HOT, LEVELS = 4_096, 3
#: Hashes that are held as bits at once (64 bytes each), and bytes of a text that are split into words at once.
HELD, PART_BYTES = 100_000, 4_000_000
WHITE = re.compile(rb"[\x20\x09-\x0D]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def masks(radius: int, family: int = 0) -> list[int]:
    """The covering masks of 64-bit fingerprints, as signed numbers; families differ in their bit vectors."""
    full = (1 << radius + 1) - 1
    vectors = [((i * (2 * family + 1) + 5 * family + i // full) % full) + 1 for i in range(64)]
    out = []
    for v in range(1, full + 1):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _hashes(w: list[bytes], words: int) -> np.ndarray:
    line = b" ".join(w)
    ends, at = [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def shingle_parts(text: str | None, words: int):
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased, in arrays of bounded size; words are runs without ASCII
    white space."""
    data = text.encode().translate(LOWER) if text else b""
    carry: list[bytes] = []
    lo, any_yet = 0, False
    while lo < len(data):
        hi = len(data)
        if hi - lo > PART_BYTES:
            gap = WHITE.search(data, lo + PART_BYTES)
            hi = gap.start() if gap else hi
        w = carry + (data[lo:hi] if lo or hi < len(data) else data).split()
        if len(w) >= words:
            any_yet = True
            yield _hashes(w, words)
        carry, lo = w[max(0, len(w) - words + 1) :] if words > 1 else [], hi
    if carry and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), 42)], np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """All of ``shingle_parts`` in one array."""
    found = list(shingle_parts(text, words))
    return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint64), *found])


def set_bits(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each array of hashes how many have each of the 64 bits, and how many there are."""
    sizes = np.array([len(h) for h in hashes])
    bits = np.unpackbits(np.concatenate(hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int64), sizes


def fingerprints(texts, words: int) -> np.ndarray:
    """A signed 64-bit fingerprint for each text; at most ``HELD`` hashes are unfolded into bits at once."""
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, rows, total = [], [], 0

    def flush():
        if rows:
            c, n = set_bits(held)
            np.add.at(counts, rows, c)
            np.add.at(sizes, rows, n)
        held.clear(), rows.clear()

    for i, t in enumerate(texts):
        for h in shingle_parts(t if isinstance(t, str) else None, words):
            for lo in range(0, len(h), HELD):
                held.append(h[lo : lo + HELD])
                rows.append(i)
                total += len(held[-1])
                if total > HELD:
                    flush()
                    total = 0
    flush()
    return folded(counts, sizes)


def folded(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is 1 if over half of the hashes have it."""
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def with_fingerprint(docs: DataFrame, words: int = 4, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``fp``, a long."""
    docs = plain(docs)
    kept = without(docs, ["fp"] + ([] if keep_text else [text_col]))

    def run(batches):
        tidy()
        for b in batches:
            fp = fingerprints(b.pop("__text").tolist(), words)
            yield b.assign(fp=fp)

    return docs.select(*kept.columns, F.col(f"`{text_col}`").alias("__text")).mapInPandas(run, appended(kept.schema, [StructField("fp", LongType())]))


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket of distinct fingerprints, by search over the unvisited."""
    out, unseen = [], fps.view(np.uint64)
    while len(unseen) > 1:
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            x = queue.pop()
            near = np.bitwise_count(unseen ^ x) <= radius
            if near.any():
                found = unseen[near]
                out.extend((int(x.view(np.int64)), y) for y in found.view(np.int64).tolist())
                queue.extend(found)
                unseen = unseen[~near]
    return out


def links(fps: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """``u, v``: links of distinct fingerprints ``fps(fp)`` at up to ``radius`` differing bits that connect what all do."""

    def search(batches):
        """Rows come sorted by bucket, and a bucket has at most ``hot`` of them."""
        rest = None
        def pairs(path, key, fp):
            edge = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            many = np.flatnonzero(ends - starts > 1)
            two = many[ends[many] - starts[many] == 2]
            a, b = fp[starts[two]], fp[starts[two] + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            us, vs = a[near].tolist(), b[near].tolist()
            for i in many[ends[many] - starts[many] > 2]:
                for u, v in bucket_links(fp[starts[i] : ends[i]], radius):
                    us.append(u), vs.append(v)
            return pd.DataFrame({"u": us, "v": vs}, dtype="int64").drop_duplicates()

        for b in batches:
            now = (b["path"].to_numpy(), b["key"].to_numpy(), b["fp"].to_numpy())
            if rest is not None:
                now = tuple(np.concatenate(x) for x in zip(rest, now))
            path, key, _ = now
            last = len(path) - 1
            cut = 0 if (same := np.flatnonzero((path != path[last]) | (key != key[last]))).size == 0 else int(same[-1]) + 1
            rest = tuple(x[cut:] for x in now)
            if cut:
                yield pairs(*(x[:cut] for x in now))
        if rest is not None and len(rest[0]):
            yield pairs(*rest)

    found = None
    level, rows = 0, fps.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        family = masks(radius, level)
        choice = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(family)])
        rows = rows.withColumn("c", F.explode(choice)).select(
            (F.col("path") * (len(family) + 1) + F.col("c.i")).alias("path"), F.col("mask").bitwiseOR(F.col("c.m")).alias("mask"), "fp"
        ).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        level += 1
        if level < LEVELS:
            over = checkpoint(rows.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("path", "key"))
            any_over = not over.isEmpty()
        else:
            any_over = False
        fit = rows.join(over, ["path", "key"], "left_anti") if any_over else rows
        got = fit.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInPandas(search, "u long, v long")
        found = got if found is None else found.unionByName(got)
        if not any_over:
            return found
        rows = checkpoint(rows.join(over, ["path", "key"], "left_semi").select("path", "mask", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = 4, words: int = 4, text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``id, fp, component_id`` for each row of ``docs``.

    With ``similarity``, groups are of texts whose sets of shingles have a Jaccard index of that or more, not of
    fingerprints within ``radius``: see ``similar``, which checks the links found here and finds those beyond the radius.
    """
    if similarity is not None:
        from lithoscope.llm import similar

        return similar.near_duplicates(docs, id_col, words, text_col, similarity, radius)
    marked = checkpoint(with_fingerprint(docs.select(F.col(id_col), F.col(text_col).alias("text")), words, keep_text=False))
    distinct = checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    named = checkpoint(named_by_least(distinct, "fp", links(distinct.select("fp"), radius)))  # so that the join's hot keys can be split
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", words: int = 5, text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates`` by similarity."""
    from lithoscope.llm import similar

    return similar.one_of_each_group(docs, id_col, words, text_col, similarity)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of every whole text of ``documents``."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
