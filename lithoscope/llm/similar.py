"""Operator 6 by similarity: the groups of texts whose sets of five-word shingles have a Jaccard index of at least 0.8.

Near copies at that similarity differ in about ten of 64 fingerprint bits, which no family of covering masks of a useful
size reaches. So covering LSH gives candidates only (fingerprints within its radius), each is checked by the sets
themselves, and prefix filtering finds the pairs beyond the radius, so that the result is exact:

- Equal sets are one from the start. Of two sets of n and m shingles with an index of p / q or more, each has
  floor((q - p) n / q) + 1 shingles that come first in any one order of all shingles, and these prefixes share one. The order
  is by the count in a sample of documents, then by hash: shingles of common passages come last, so that hardly any prefix
  holds them. The sample changes the work, never the result. Sets that share a shingle of their prefixes make a bucket.
- Of pairs of a bucket, those whose parity bitmaps (a coarse one first) differ in more bits than the sets may differ in
  shingles go at once; whole sets are read again only for the few pairs left, and compared.
- First each bucket's sets are compared with one of them, the pivot, and components are made of what this and the
  fingerprints give. Then a bucket's sets outside its commonest component are compared with all of other components. So
  a large group of near copies costs comparisons with few of its members, and no pair is left out. A pair that shares many
  keys is passed on from few buckets: each row bears the set's two keys before this one, and a pair that has one of them in
  common is left to that bucket. The bucket of the first common key never leaves it to another.
- A bucket of more than ``BLOCK`` sets is dealt to blocks; the sets to compare with go to each of its blocks.

Edge cases: as in ``simhash``: wordless texts are one group, fewer words than a shingle are one shingle, A-Z are lower-cased,
rows of one id have their own sets, a null id gets a component but never names one unless it is alone there.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from lithoscope.llm import simhash
from lithoscope.llm.common import appended, checkpoint, parts, plain, received, sent, tidy, unit_hash
from lithoscope.llm.components import components, named_by_least

#: Words of a shingle and the least Jaccard index.
WORDS, SIMILARITY = 5, 0.8
#: Documents of the sample, and the shingles of it that are held with their counts.
SAMPLE, COMMON = 10_000, 200_000
#: Bits of a set's coarse bitmap, those of a set of more than ``LONG`` shingles, and of the filter of candidates.
COARSE_BITS, LONG_BITS, LONG, FILTER_BITS = 512, 2_048, 400, 1 << 24
#: Most removed rows that go to all executors as a table of ids and hashes.
BROADCAST_ROWS = 1_000_000
#: Sets of a block of a bucket, and pairs that are looked at together.
BLOCK, PAIRS = 4_096, 200_000


def shingle_set(text, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(simhash.shingle_hashes(text if isinstance(text, str) else None, words))


def set_id(s: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(s.tobytes(), 42)
    return n - (1 << 64) if n >> 63 else n


class Likeness:
    """What a Jaccard index of at least p / q means for sets of n and m shingles, in whole numbers."""

    def __init__(self, least: float):
        f = Fraction(least).limit_denominator(1_000)
        self.p, self.q = f.numerator, f.denominator

    def alike(self, n, m, both):
        return (self.p + self.q) * both >= self.p * (n + m)

    def may_differ(self, differing, n, m):
        """Whether so many shingles may be in one of the sets only."""
        return differing * (self.p + self.q) <= (n + m) * (self.q - self.p)

    def near_size(self, n, m):
        return self.q * np.minimum(n, m) >= self.p * np.maximum(n, m)

    def prefix(self, n: int) -> int:
        return (self.q - self.p) * n // self.q + 1


def parity(s: np.ndarray) -> bytes:
    """A bit for each slot: whether an odd number of the shingles fall in it. Each shingle that one of two sets lacks turns
    one bit. There are twice as many slots as shingles or more."""
    bits = max(LONG_BITS if len(s) > LONG else COARSE_BITS, 1 << (2 * len(s)).bit_length())
    slot = (s >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(slot.astype(np.int64), minlength=bits) & 1).tobytes()


def halved(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer slots."""
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def coarse(bitmap: bytes, n: int) -> bytes:
    """The bitmap of a set of n shingles that goes to its buckets: long sets need more bits to be told apart."""
    return halved(np.frombuffer(bitmap, np.uint8), (LONG_BITS if n > LONG else COARSE_BITS) // 8).tobytes()


def coarse_matrices(bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of coarse bitmaps: which are long, all at the size of the short ones, and the long ones whole (others zero)."""
    long = np.array([len(x) for x in bitmaps]) > COARSE_BITS // 8
    whole = np.zeros((len(bitmaps), LONG_BITS // 64), np.uint64)
    short = np.zeros((len(bitmaps), COARSE_BITS // 64), np.uint64)
    if long.any():
        whole[long] = np.frombuffer(b"".join(x for x, y in zip(bitmaps, long) if y), np.uint64).reshape(-1, LONG_BITS // 64)
        folded = whole[long]
        while folded.shape[1] > short.shape[1]:
            folded = folded[:, : folded.shape[1] // 2] ^ folded[:, folded.shape[1] // 2 :]
        short[long] = folded
    if not long.all():
        short[~long] = np.frombuffer(b"".join(x for x, y in zip(bitmaps, long) if not y), np.uint64).reshape(-1, COARSE_BITS // 64)
    return long, short, whole


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample have, sorted, and in how many."""
    total = texts.count()

    def run(batches):
        tidy()
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"h": shingle_set(t, words).view(np.int64)})

    part = texts.where(unit_hash("text") < min(1.0, SAMPLE / max(total, 1))).select("text").mapInPandas(run, "h long")
    found = part.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["count"] for r in found], np.int64)[order]


def prefix(s: np.ndarray, size: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set that any set alike has one of in its own prefix."""
    h, count = common
    if len(h):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        rank = np.where(h[at] == s, count[at], 0)
        if rank.any():
            return s[np.argsort(rank, kind="stable")[:size]]
    return s[:size]


def marked_sets(docs: DataFrame, id_col: str, words: int, like: Likeness) -> DataFrame:
    """``id, th, set_id, n, fp, parity, coarse, keys`` for each row of ``docs(id, th, text)``: one pass over all texts."""
    held = sent(docs, common_shingles(docs, words))
    extra = [StructField("set_id", LongType()), StructField("n", LongType()), StructField("fp", LongType()), StructField("parity", BinaryType()), StructField("coarse", BinaryType()), StructField("keys", ArrayType(LongType()))]

    def run(batches):
        common = received(held)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in parts(texts):
                ids, sizes, bitmaps, keys = [], [], [], [np.zeros(0, np.uint64)]
                counts, shingles = np.zeros((hi - lo, 64), np.int64), np.zeros(hi - lo, np.int64)
                waiting, rows, total = [], [], 0
                for i, t in enumerate(texts[lo:hi]):
                    h = simhash.shingle_hashes(t, words)
                    s = np.unique(h)
                    ids.append(set_id(s)), sizes.append(len(s)), bitmaps.append(parity(s))
                    keys.append(prefix(s, like.prefix(len(s)), common) if len(s) else s)
                    for at in range(0, len(h), simhash.HELD):
                        waiting.append(h[at : at + simhash.HELD]), rows.append(i)
                        total += len(waiting[-1])
                        if total > simhash.HELD:
                            _add_bits(counts, shingles, waiting, rows)
                            waiting, rows, total = [], [], 0
                _add_bits(counts, shingles, waiting, rows)
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys[1:]])]).astype(np.int32)
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(simhash.folded(counts, shingles)),
                     pa.array(bitmaps, pa.binary()), pa.array(list(map(coarse, bitmaps, sizes)), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64)))],
                    names=[id_col, "th", "set_id", "n", "fp", "parity", "coarse", "keys"],
                )

    return docs.select(id_col, "th", "text").mapInArrow(run, appended(docs.select(id_col, "th").schema, extra))


def _add_bits(counts, shingles, waiting, rows) -> None:
    if rows:
        c, n = simhash.set_bits(waiting)
        np.add.at(counts, rows, c)
        np.add.at(shingles, rows, n)


def shared_keys(batches):
    """Rows sorted by key, less those that are alone with theirs; one row is held back between batches."""
    tidy()
    last, last_shared = None, False
    for b in batches:
        t = b.to_pandas()
        if not len(t):
            continue
        key = t["key"].to_numpy()
        joins = last is not None and last["key"].iloc[0] == key[0]
        if last is not None and (joins or last_shared):
            yield pa.RecordBatch.from_pandas(last, b.schema, preserve_index=False)
        same = key[1:] == key[:-1]
        before, after = np.concatenate([[joins], same]), np.concatenate([same, [False]])
        yield pa.RecordBatch.from_pandas(t[:-1][(before | after)[:-1]], b.schema, preserve_index=False)
        last, last_shared = t[-1:], bool(before[-1])
    if last is not None and last_shared:
        yield pa.RecordBatch.from_pandas(last, b.schema, preserve_index=False)


def buckets(sets: DataFrame) -> DataFrame:
    """``key, set_id, n``: members of the buckets of two or more sets."""
    rows = sets.select(F.explode("keys").alias("key"), "set_id", "n")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(shared_keys, "key long, set_id long, n long")


def _pair_blocks(key, probe, root, stars):
    """Pairs of places, of rows sorted by bucket (and members before probes), that a bucket's comparisons need."""
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    size = ends - starts
    whole = probe[starts] == 2  # the bucket is no block of a larger one
    a, b = [], []
    if stars:
        many = np.flatnonzero(whole & (size > 1))
        pivot = starts[many] + key[starts[many]].view(np.uint64) % size[many].astype(np.uint64)
        a.append(np.repeat(pivot.astype(np.int64), size[many]))
        b.append(np.concatenate([np.zeros(0, np.int64), *(np.arange(lo, hi) for lo, hi in zip(starts[many].tolist(), ends[many].tolist()))]))
        rest = np.flatnonzero(~whole)
    else:
        two = np.flatnonzero(whole & (size == 2))
        a.append(starts[two])
        b.append(starts[two] + 1)
        rest = np.flatnonzero(~whole | (size > 2))
    yield np.concatenate(a), np.concatenate(b)
    for i in rest.tolist():
        lo, hi = starts[i], ends[i]
        if whole[i]:
            own = root[lo:hi]
            values, counts = np.unique(own, return_counts=True)
            if len(values) == 1:
                continue
            probes = lo + np.flatnonzero(own != values[counts.argmax()])
            members = np.arange(lo, hi)
        else:
            is_probe = probe[lo:hi] == 1
            probes, members = lo + np.flatnonzero(is_probe), lo + np.flatnonzero(~is_probe)
        step = max(1, PAIRS // max(1, len(members)))
        for at in range(0, len(probes), step):
            part = probes[at : at + step]
            yield np.repeat(part, len(members)), np.tile(members, len(part))


def plausible(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs but for those whose bitmaps rule out that their sets are alike."""
    one, two = (sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}")) for c in "uv")

    def run(batches):
        for b in batches:
            differing = []
            for x, y in zip(b["p_u"], b["p_v"]):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                differing.append(np.bitwise_count(halved(x, size) ^ halved(y, size)).sum(dtype=np.int64))
            yield b.loc[like.may_differ(np.array(differing, np.int64), b["n_u"].to_numpy(), b["n_v"].to_numpy()), ["u", "v"]]

    return pairs.join(one, "u").join(two, "v").select("u", "v", "n_u", "n_v", "p_u", "p_v").mapInPandas(run, "u long, v long")


def near_pairs(members: DataFrame, stars: bool, like: Likeness) -> DataFrame:
    """Distinct pairs ``u, v`` of a bucket's sets of near sizes: with the bucket's pivot; or of other ``root``, of all that
    aren't in the bucket's commonest component with all, if their bitmaps let them be alike."""
    payload = [] if stars else ["root", "coarse", "p1", "p2"]
    hot = checkpoint(members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    if hot.isEmpty():
        dealt = members.select(F.col("key").alias("bucket"), F.lit(2).cast("byte").alias("probe"), "key", "set_id", "n", *payload)
    else:
        own = members.join(hot, "key")
        if stars:
            chosen = own.groupBy("key", "size").agg(F.min_by("set_id", F.xxhash64("key", "set_id")).alias("chosen"))
            asks = F.col("set_id") == F.col("chosen")
        else:
            chosen = own.groupBy("key", "size", "root").agg(F.count("*").alias("c")).groupBy("key", "size").agg(F.max_by("root", F.struct("c", "root")).alias("chosen"))
            asks = F.col("root") != F.col("chosen")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        place = F.concat(
            F.array(F.struct(F.pmod(F.xxhash64("set_id"), blocks).cast("int").alias("block"), F.lit(0).cast("byte").alias("probe"))),
            F.when(asks, F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.alias("block"), F.lit(1).cast("byte").alias("probe")))).otherwise(F.array()),
        )
        placed = members.join(chosen, "key", "left").withColumn("p", F.explode(F.when(F.col("size").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.lit(2).cast("byte").alias("probe")))).otherwise(place)))
        bucket = F.when(F.col("size").isNull(), F.col("key")).otherwise(F.xxhash64("key", "p.block"))
        dealt = placed.select(bucket.alias("bucket"), F.col("p.probe").alias("probe"), "key", "set_id", "n", *payload)

    def found(rows):
        key, probe, ids, n, root, *more = rows
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _pair_blocks(key, probe, root, stars):
            for at in range(0, len(a), PAIRS):
                x, y = a[at : at + PAIRS], b[at : at + PAIRS]
                ok = (root[x] != root[y]) & (ids[x] != ids[y]) & like.near_size(n[x], n[y])
                x, y = x[ok], y[ok]
                ok = slice(None)
                if more:
                    long, short, whole, this, *before = more
                    met = np.zeros(len(x), bool)  # in the bucket of an earlier key that both have
                    for p in before:
                        for q in before:
                            met |= (p[x] == q[y]) & (p[x] != this[x])
                    x, y = x[~met], y[~met]
                    differing = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64)
                    both = np.flatnonzero(long[x] & long[y])
                    differing[both] = np.bitwise_count(whole[x[both]] ^ whole[y[both]]).sum(axis=1, dtype=np.int64)
                    ok = like.may_differ(differing, n[x], n[y])
                us.append(np.minimum(ids[x[ok]], ids[y[ok]])), vs.append(np.maximum(ids[x[ok]], ids[y[ok]]))
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}).drop_duplicates()

    def run(batches):
        """Whole buckets go through ``found``; of a block whose probes don't end, its members stay and probes pass."""
        tidy()
        held = None
        for b in batches:
            if not len(b):
                continue
            # A block's bucket is a hash, so buckets are told apart by their key, too.
            key = (b["bucket"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b["key"].to_numpy().view(np.uint64)).view(np.int64)
            now = [key, b["probe"].to_numpy(), b["set_id"].to_numpy(), b["n"].to_numpy()]
            now += [now[2]] if stars else [b["root"].to_numpy(), *coarse_matrices(b["coarse"].tolist()), b["key"].to_numpy(), b["p1"].to_numpy(), b["p2"].to_numpy()]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            other = np.flatnonzero(rows[0] != rows[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield found([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
            if len(held[0]) > 4 * BLOCK and (held[1] == 1).any():
                yield found(held)
                held = [x[held[1] != 1] for x in held]
        if held is not None:
            yield found(held)

    rows = dealt.repartition("bucket", "key").sortWithinPartitions("bucket", "key", "probe", "set_id")
    return rows.mapInPandas(run, "u long, v long").distinct()


def candidate_sets(texts: DataFrame, sets: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """``set_id, shingles`` of the sets in ``pairs``, and of a few others that its filter doesn't tell from them.

    A text is known by its hash ``th``; only those of one text of each candidate set pass the filter, so that few are split
    into shingles again.
    """
    members = pairs.select(F.explode(F.array("u", "v")).alias("set_id")).distinct().join(sets.select("set_id", "th"), "set_id")
    slot = F.pmod("th", F.lit(FILTER_BITS))
    filled = members.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(s & 31)))").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS >> 5, np.uint32)
    bits[filled["w"].to_numpy(np.int64)] = filled["b"].to_numpy(np.int64)
    held = sent(texts, bits)

    def run(batches):
        bits, seen = received(held), set()
        for b in batches:
            th = b.column("th").to_numpy()
            at = np.mod(th, FILTER_BITS)
            rows = np.flatnonzero(bits[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            ids, found = [], []
            for i in rows.tolist():
                if int(th[i]) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(int(th[i]))
                s = shingle_set(b.column("text")[i].as_py(), words)
                ids.append(set_id(s)), found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["set_id", "shingles"])

    return texts.select("th", "text").mapInArrow(run, "set_id long, shingles binary").groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def verified(texts: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, like: Likeness) -> DataFrame:
    """The pairs whose sets are alike."""
    if pairs.isEmpty():
        return pairs
    found = checkpoint(candidate_sets(texts, sets, pairs, words))
    both = pairs.join(found.select(F.col("set_id").alias("u"), F.col("shingles").alias("a")), "u").join(found.select(F.col("set_id").alias("v"), F.col("shingles").alias("b")), "v")

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b["a"], b["b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(like.alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            yield b.loc[np.array(ok, bool), ["u", "v"]]

    return both.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def fingerprint_pairs(sets: DataFrame, radius: int, like: Likeness) -> DataFrame:
    """Pairs ``u, v`` of sets whose fingerprints are equal or linked by covering LSH, and whose sizes are near."""
    own = sets.where("n > 0").select("set_id", "n", "fp")
    first = own.groupBy("fp").agg(F.min("set_id").alias("one"), F.min_by("n", "set_id").alias("one_n"))
    same = own.join(first, "fp").where("set_id <> one").select("one", F.col("set_id").alias("other"), "one_n", F.col("n").alias("other_n"))
    found = simhash.links(first.select("fp"), radius).distinct()
    a, b = (first.select(F.col("fp").alias(c), F.col("one").alias(f"s_{c}"), F.col("one_n").alias(f"n_{c}")) for c in "uv")
    linked = found.join(a, "u").join(b, "v").select(F.col("s_u").alias("one"), F.col("s_v").alias("other"), F.col("n_u").alias("one_n"), F.col("n_v").alias("other_n"))
    near = F.lit(like.q) * F.least("one_n", "other_n") >= F.lit(like.p) * F.greatest("one_n", "other_n")
    return same.unionByName(linked).where(near).select(F.least("one", "other").alias("u"), F.greatest("one", "other").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", words: int = WORDS, text_col: str = "text", similarity: float = SIMILARITY, radius: int = 4) -> DataFrame:
    """``id, th, set_id, component, component_id`` for each row of ``docs``: a hash of its text, its set, and its component
    by the key of the component's first set and by its least id."""
    like = Likeness(similarity)
    docs = plain(docs.select(F.col(id_col), F.col(text_col).alias("text"))).withColumn("th", F.xxhash64("text"))
    marked = checkpoint(marked_sets(docs, id_col, words, like))
    sets = checkpoint(marked.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "fp", "parity", "coarse", "keys", "th")], F.min(id_col).alias("least")))
    members = checkpoint(buckets(sets))
    candidates = near_pairs(members, True, like).unionByName(fingerprint_pairs(sets, radius, like)).distinct()
    first = checkpoint(verified(docs, sets, checkpoint(plausible(candidates, sets, like)), words, like))
    roots = components(first).select(F.col("u").alias("set_id"), F.col("root").alias("r"))
    earlier = lambda i: F.coalesce(F.lag("key", i).over(Window.partitionBy("set_id").orderBy("key")), F.col("key")).alias(f"p{i}")
    placed = members.join(roots, "set_id", "left").join(sets.select("set_id", "coarse"), "set_id").select("key", "set_id", "n", "coarse", F.coalesce("r", "set_id").alias("root"), earlier(1), earlier(2))
    second = checkpoint(verified(docs, sets, checkpoint(plausible(near_pairs(placed, False, like), sets, like)), words, like))
    named = checkpoint(named_by_least(sets.select("set_id", "least"), "set_id", first.unionByName(second)))
    return marked.select(id_col, "th", "set_id").join(named, "set_id").select(id_col, "th", "set_id", "component", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", words: int = WORDS, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with exactly one row of each group of near duplicates: one with the least id (null if all are), and of several
    such rows that with the least hash of its text; of repeated rows one stays. Rows are told apart by id and text only."""
    groups = checkpoint(near_duplicates(docs, id_col, words, text_col, similarity))
    named = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("set_id") == F.col("component"))
    heads = groups.where(named).select(F.col(id_col).alias("i"), F.col("th").alias("t"), "component")
    several = checkpoint(heads.groupBy("component").agg(F.min("t").alias("chosen"), F.count("*").alias("n")).where("n > 1"))
    others = groups.where(~named).select(F.col(id_col).alias("i"), F.col("th").alias("t"))
    others = others.unionByName(heads.join(several, "component").where("t <> chosen").select("i", "t")).distinct()
    others = checkpoint(others)
    if others.count() <= BROADCAST_ROWS:  # 16 bytes each; beyond it, texts are shuffled to meet them
        others = F.broadcast(others)
    rows = docs.withColumn("__th", F.xxhash64(F.col(f"`{text_col}`")))
    same = F.col(id_col).eqNullSafe(F.col("i")) & (F.col("__th") == F.col("t"))
    left = rows.join(others, same, "left_anti")
    repeated = checkpoint(heads.join(several, "component").where("t = chosen").groupBy("i", "t").count().where(F.col("count") > 1).select("i", "t"))
    if repeated.isEmpty():
        return left.drop("__th")
    return left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates([id_col, "__th"])).drop("__th")
