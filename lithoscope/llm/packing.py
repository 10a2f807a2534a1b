"""Operator 7, packing: documents routed to context-size tiers, tiers packed, gaps of long windows filled, steps balanced.

Each task packs its own documents in blocks of bounded size, in one pass and without a shuffle. A document of more than
the longest window gives whole windows; what is left goes to the smallest tier that holds it. From the longest tier to
the shortest, each window takes the longest document left in its tier, and its gap is filled with the longest documents of
the same or shorter tiers that still fit. A gap that is left is closed with the head of a longer document, whose rest goes
back to its tier. So all windows are full powers of two, but for the last one of a task; a gap of at most ``slack`` ids in
a longest window is padded rather than filled by a splinter. What can't fill a window waits for the next block.
Sequences of a block are then dealt to step groups of about ``step_tokens`` ids, the longest first to the lightest group.

Ids of sequences and steps are the task's number and a count, so a task that is run again gives the same rows.

Edge cases: a null or empty text is the end id alone; any length of text is cut, never dropped; repeated rows are packed
each; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.llm.common import read, received, sent, small_batches

TIERS = (4096, 2048, 1024, 512)
#: ASCII punctuation, which no pre-token joins to letters before it.
STOPS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of small letters of ASCII and Latin-1: letters to any tokenizer, and as the normaliser has them.
SMALL_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: Words and bytes that a cache holds before it is emptied of those not in use; words of texts that are put together at a time.
CACHED, CACHED_BYTES, SLICE = 500_000, 64 << 20, 1 << 17
#: Characters of the texts that are encoded at a time, if there are several.
CHARS = 4_000_000
#: Ids that a task holds before it packs them, and ids of a step group.
BLOCK_TOKENS, STEP_TOKENS = 1_500_000, 16 * 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


class Words:
    """A cache of the ids of words: for each word its part of one array, or the mark ``OTHER`` and no part."""

    #: The start of a word that can't be encoded apart from the punctuation after it.
    OTHER = -1

    def __init__(self, kind: np.dtype):
        self.words, self.ids = pa.array([], pa.large_string()), np.empty(0, kind)
        self.starts = self.lengths = np.empty(0, np.int64)

    def append(self, words: list[str], ids: list[np.ndarray], lengths: np.ndarray) -> None:
        """Add new words, with their ids one after the other and the number of ids of each."""
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *ids])

    def mark(self, words: list[str]) -> None:
        """Add new words as ``OTHER``."""
        first = len(self.words)
        self.append(words, [], np.zeros(len(words), np.int64))
        self.starts[first:] = self.OTHER

    def parts(self, words, learn, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the words, an Arrow array of distinct ones, of which ``learn`` adds a list of new ones.

        A cache of more than ``most`` words, or of more than ``CACHED_BYTES``, forgets all but these first.
        """
        at = pc.index_in(words, value_set=self.words)
        if len(self.words) > most or self.words.nbytes > CACHED_BYTES:
            kept = at.drop_null().to_numpy()
            self.words, marked = self.words.take(pa.array(kept)), self.starts[kept] == self.OTHER
            self.ids, ends = gathered(self.ids, self.starts[kept], self.lengths[kept])
            self.starts, self.lengths = np.where(marked, self.OTHER, ends[:-1]), self.lengths[kept]
            at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            learn(strings(words.filter(at.is_null())))
            at = pc.index_in(words, value_set=self.words)
        at = at.to_numpy()
        return self.starts[at], self.lengths[at]


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``ids`` that begin at ``starts``, one after the other, and the bounds between them."""
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    places = np.repeat(starts - ends[:-1], lengths)
    places += np.arange(len(places))
    return ids[places], ends


def strings(words) -> list[str]:
    """The values of an Arrow array of strings."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordTokenizer:
    """A public tokenizer that treats the runs between ASCII white space, and a run of letters and what follows, separately.

    So the words of a text are encoded once, and a bounded cache of words is exact: punctuation after a word of letters is
    encoded apart from it, words are encoded in lower case (as the normaliser has them) and words of letters many at
    a time, where a token with the end-of-word mark ends each. ``alone`` is false for tokenizers of which this doesn't hold; their texts are encoded whole.
    So are texts that hold an added token as it is written: lower-casing must neither hide one nor make one of other words.

    Texts are split, and the ids of their words put together, in Arrow and NumPy: only words that differ, without the
    punctuation after them, are Python's strings.
    """

    def __init__(self, definition: str, alone: bool = True, mark: str = "</w>"):
        self.definition, self.alone, self.mark = definition, alone, mark

    @classmethod
    def load(cls, path: str, alone: bool = True) -> WordTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), alone)

    def ready(self, cached: int = CACHED):
        """``encode(texts) -> list of uint16 or uint32 ids as bytes`` and the type of the ids."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_str(self.definition)  # for words, of which none is an added token
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        tokenizer.encode_special_tokens = True
        usual = plain = tokenizer.normalizer, tokenizer.pre_tokenizer
        letters: dict[int, str] = {}
        if '"ByteLevel"' in self.definition and self.alone:
            # For small letters and single spaces between them, the normaliser and the patterns change nothing, and the
            # bytes of a letter are written as the pre-tokenizer writes them, which leaves ASCII as it is.
            plain = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256) if SMALL_LETTERS.fullmatch(chr(i))}
        vocabulary = tokenizer.get_vocab(True)
        size = max(vocabulary.values()) + 1
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        ends = np.zeros(size, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(self.mark)]] = True
        cache, entire = Words(kind), Words(kind)
        small = SMALL_LETTERS.fullmatch
        usual_call: list[Tokenizer] = []

        def whole(texts: list[str], by=tokenizer) -> list[np.ndarray]:
            return [np.array(e.ids, kind) for e in by.encode_batch_fast(texts, add_special_tokens=False)]

        def as_the_library(texts: list[str]) -> list[bytes]:
            if not usual_call:
                usual_call.append(Tokenizer.from_str(self.definition))
            return [ids.tobytes() for ids in whole(texts, usual_call[0])]

        def learn_alone(words: list[str], known: Words) -> None:
            """Put words, each encoded by itself, into a cache."""
            if words:
                ids = whole(words)
                known.append(words, ids, np.array([len(i) for i in ids]))

        def learn_letters(words: list[str], lowered: list[str], steps, written: dict[int, str]) -> None:
            """Put words of letters, encoded as their small letters are, into the cache, many at a time."""
            tokenizer.normalizer, tokenizer.pre_tokenizer = steps
            done, ids, lengths, others = [], [], [], []
            for lo in range(0, len(words), 256):
                part = words[lo : lo + 256]
                text = " ".join(lowered[lo : lo + 256])
                if written and not text.isascii():
                    text = text.translate(written)
                found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
                stops = np.flatnonzero(ends[found]) + 1
                if len(stops) == len(part) and stops[-1] == len(found):
                    done += part
                    ids.append(found)
                    lengths.append(np.diff(stops, prepend=0))
                else:  # a word that isn't one run of letters to the tokenizer
                    others += part
            tokenizer.normalizer, tokenizer.pre_tokenizer = usual
            if done:
                cache.append(done, ids, np.concatenate(lengths))
            learn_alone(others, cache)

        def learn(words: list[str]) -> None:
            """Put words without the punctuation after them, and such punctuation, into the cache."""
            of_letters = [w for w in words if w.isalpha()]
            others = [w for w in words if not w.isalpha()]
            learn_alone([w for w in others if not w or w[-1] in STOPS], cache)
            others = [w for w in others if w and w[-1] not in STOPS]
            easy = [w for w in of_letters if w.isascii()]
            easy_lower, hard, hard_lower = easy.copy(), [], []
            if len(easy) < len(of_letters):
                for w in of_letters:
                    if w.isascii():
                        continue
                    if small(w):
                        easy.append(w)
                        easy_lower.append(w)
                        continue
                    low = w.lower()
                    if not low.isalpha():  # a capital letter may become a small one and a mark
                        others.append(w)
                    elif len(w) != len(low) or "\u03a3" in w:  # a capital sigma's small form depends on its place
                        hard.append(w)
                        hard_lower.append(w)
                    elif small(low):
                        easy.append(w)
                        easy_lower.append(low)
                    else:
                        hard.append(w)
                        hard_lower.append(low)
            learn_letters(easy, easy_lower, plain, letters)
            learn_letters(hard, hard_lower, usual, {})
            cache.mark(others)

        def distinct_words(words) -> tuple[np.ndarray, np.ndarray]:
            """Ids of the words, an Arrow array of large strings, one after the other, and the bounds between them."""
            n = len(words)
            _, bounds, data = words.buffers()
            at = np.frombuffer(bounds, np.int64)[words.offset : words.offset + n + 1]
            both = np.empty(2 * n + 1, np.int64)  # bounds of words without, and of the punctuation after them, in turn
            both[::2] = at
            both[1::2] = at[:-1] + pc.binary_length(pc.ascii_rtrim(words, characters=STOPS)).to_numpy()
            parted = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(both), data).dictionary_encode()
            starts, lengths = (x[parted.indices.to_numpy()] for x in cache.parts(parted.dictionary, learn, cached))
            odd = np.flatnonzero(starts[::2] == Words.OTHER)
            lengths[2 * odd + 1] = 0
            ids = cache.ids
            if len(odd):
                own = entire.parts(words.take(pa.array(odd)), lambda new: learn_alone(new, entire), cached)
                starts[2 * odd], lengths[2 * odd] = len(ids) + own[0], own[1]
                ids = np.concatenate([ids, entire.ids])
            ids, ends = gathered(ids, starts, lengths)
            return ids, ends[::2]

        def encode(texts: list[str]) -> list[bytes]:
            if not self.alone:
                return as_the_library(texts)
            special = [i for i, t in enumerate(texts) if any(a in t for a in added)]
            if special:
                out, rest = [b""] * len(texts), sorted(set(range(len(texts))).difference(special))
                for i in special:
                    out[i] = as_the_library([texts[i]])[0]
                for i, ids in zip(rest, encode([texts[i] for i in rest]) if rest else ()):
                    out[i] = ids
                return out
            # These know A-Z and ASCII white space only, which str.lower() and str.split() don't.
            split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
            words = split.flatten().dictionary_encode()
            if not len(words):
                return [b""] * len(texts)
            ids, ends = distinct_words(words.dictionary)
            starts, lengths, codes = ends[:-1], np.diff(ends), words.indices.to_numpy()
            data, at = [], [np.zeros(1, np.int64)]
            for lo in range(0, len(codes), SLICE):
                part = codes[lo : lo + SLICE]
                found, bounds = gathered(ids, starts[part], lengths[part])
                data.append(found.tobytes())
                at.append(bounds[1:] + at[-1][-1])
            joined = data[0] if len(data) == 1 else b"".join(data)
            cuts = (np.concatenate(at)[split.offsets.to_numpy()] * kind.itemsize).tolist()
            return [joined[lo:hi] for lo, hi in zip(cuts, cuts[1:])]

        return encode, kind


class Packer:
    """Packing of one task's documents; ``add`` and ``flush`` return rows of pieces."""

    def __init__(self, tiers=TIERS, slack: int = 8, step_tokens: int = STEP_TOKENS, first_id: int = 0):
        self.tiers, self.longest, self.slack, self.step_tokens = tuple(sorted(tiers, reverse=True)), max(tiers), slack, step_tokens
        self.sequences = self.steps = first_id
        self.left: list[tuple[int, int, int]] = []  # (length, document, start) by length, of what waits
        self.docs: dict[int, tuple] = {}  # document: its id, its ids and what is left of it
        self.held = self.count = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, key = len(ids), self.count
        self.count += 1
        self.docs[key] = [doc_id, ids, n]
        start = 0
        while n - start >= self.longest:
            self.windows.append((self.longest, [(key, start, self.longest)]))
            start += self.longest
        if n > start:
            insort(self.left, (n - start, key, start))
        self.held += n

    def begin(self) -> None:
        self.windows: list[tuple[int, list]] = []

    def _filled(self, size: int, last: bool) -> list | None:
        """A window of ``size`` from the longest pieces that fit; None (and nothing taken) if it can't be filled."""
        left = self.left
        if not last and sum_upto(left, size) < size:
            return None
        window, room = [], size
        while room and left:
            i = bisect_right(left, (room, 1 << 62, 0)) - 1
            if i >= 0:
                n, key, start = left.pop(i)
                window.append((key, start, n))
                room -= n
            elif room <= self.slack and size == self.longest:
                break
            else:  # all that is left is longer than the gap: it gets the head of the shortest
                n, key, start = left.pop(0)
                window.append((key, start, room))
                insort(left, (n - room, key, start + room))
                room = 0
        return window

    def pack(self, last: bool) -> list[tuple]:
        """Pack what is held; pieces that fill no window stay, unless this is the last block."""
        left = self.left
        bounds = (*self.tiers[1:], 0)
        for size, below in zip(self.tiers, bounds):
            while left and left[-1][0] > below:
                window = self._filled(size, False)
                if window is None:
                    break
                self.windows.append((size, window))
        if last:
            while left:
                self.windows.append((self.longest, self._filled(self.longest, True)))
        rows = self._rows()
        self.held = sum(n for n, _, _ in left)
        return rows

    def _rows(self) -> list[tuple]:
        total = sum(size for size, _ in self.windows)
        groups = [(0, g) for g in range(max(1, round(total / self.step_tokens)))]
        rows = []
        for size, window in sorted(self.windows, key=lambda w: -w[0]):
            load, g = heapq.heappop(groups)
            heapq.heappush(groups, (load + size, g))
            offset = 0
            for key, start, n in window:
                doc = self.docs[key]
                rows.append((doc[0], start, n, doc[1][start : start + n].astype("<u4").tobytes(), len(doc[1]), self.sequences, offset, size, self.steps + g))
                offset += n
                doc[2] -= n
                if not doc[2]:
                    del self.docs[key]
            self.sequences += 1
        self.steps += len(groups) if self.windows else 0
        return rows


def sum_upto(left: list[tuple[int, int, int]], most: int) -> int:
    """The sum of the lengths, or ``most`` as soon as it is reached."""
    total = 0
    for n, _, _ in reversed(left):
        total += n
        if total >= most:
            return most
    return total


def together(batches, chars: int = CHARS):
    """Ids and texts (null: empty) of the batches' rows, in lists of as many rows as have about so many characters."""
    doc_ids, texts, held = [], [], 0
    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"]):
            text = text if text is not None else ""
            if held and held + len(text) > chars:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
            doc_ids.append(doc_id)
            texts.append(text)
            held += len(text) + 100  # for the row
    if texts:
        yield doc_ids, texts


def pack_documents(docs: DataFrame, tokenizer: WordTokenizer, end_id: int, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS) -> DataFrame:
    """One row for each piece of a document, with its ids and its place; see ``PIECES``."""
    held = sent(small_batches(docs), tokenizer)

    def run(batches):
        encode, kind = received(held).ready()
        end = np.array([end_id], kind)
        packer = Packer(tiers, first_id=TaskContext.get().partitionId() << 36)
        packer.begin()

        def frame(rows):
            f = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id"])
            return f.astype({"doc_id": "Int64"})

        for doc_ids, texts in together(batches):
            for doc_id, ids in zip(doc_ids, encode(texts)):
                packer.add(doc_id, np.concatenate([np.frombuffer(ids, kind), end]))
                if packer.held >= BLOCK_TOKENS:
                    yield frame(packer.pack(False))
                    packer.begin()
        yield frame(packer.pack(True))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``docs(doc_id, text)``."""
    import public_tokenizers

    pieces = pack_documents(docs, WordTokenizer.load(public_tokenizers.path("word_bpe_49k.json")), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of at most 4096 ids."""
    return packed_pieces(read(spark, sf_dir, "documents"))
