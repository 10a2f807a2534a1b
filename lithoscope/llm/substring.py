"""Operator 2, substring deduplication by a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of a document. In it, the run of ``GRAM`` words of the least hash is its anchor;
equal windows have equal anchors, and neighbouring windows mostly share one. So an index row holds 24 bits of an anchor's
hash, its document and the first of its windows, and the whole 64-bit hash of each of its windows. Words themselves are not
compared: 88 bits tell any two windows, and 64 those that share an anchor, however common it is.

- A task reads documents into a bounded memory table. Windows that a smaller document of the table has are flagged there
  and then; the rest becomes rows, so a passage that a third of all documents share gives one row a table, not a row each.
- Rows of all tables and of earlier, immutable runs are sorted by anchor and merge-joined in one streaming pass. A window
  counts as found only if its own 64-bit hash agrees too (verification), and is flagged if a smaller document, or an earlier run,
  has it. Of a common anchor only one entry for each of its distinct windows is held in memory.
- ``FingerprintIndex`` keeps the sorted runs of past batches in a folder and compacts them into one.

Flags (document, start, bits) meet the documents in one join, and every word under a flagged window goes.

Edge cases: null, empty and short texts (under ``WINDOW`` words) lose nothing; windows are judged on the input, so a
removed passage still counts as the smaller document's; rows with one id don't remove each other's words, and are told
apart by a hash of their text; a null id counts as greater than all others; the smallest document keeps all; added columns
replace those of the same name, other columns stay.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from lithoscope.llm.common import Memo, appended, plain, read, small_batches, tidy, without

#: Words of a window and of an anchor; bytes of a window's hash in a row; words of a memory table.
WINDOW, GRAM, CHECK, TABLE_WORDS = 13, 5, 8, 500_000
#: Odd multipliers that place words within a window, and a mixer.
FACTORS = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: The id that a null one counts as, and that of all documents of earlier runs.
LAST, EARLIER = (1 << 63) - 1, -(1 << 63)
ROWS = pa.schema([("a", pa.int64()), ("doc", pa.int64()), ("st", pa.int64()), ("windows", pa.binary())])
ROWS_DDL, FLAGS_DDL = "a long, doc long, st long, windows binary", "doc long, st long, bits int"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def _hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    size = len(words) - n + 1
    h = words[:size] * FACTORS[0]
    for j in range(1, n):
        h += words[j : j + size] * FACTORS[j]
    return _mixed(h)


def _table_rows(docs: list[tuple[int, int, list[bytes]]], word_hash) -> pa.RecordBatch:
    """Index rows, and flags of what is already doubled, of a memory table's ``(id, hash of text, words)``."""
    docs = sorted((d for d in docs if len(d[2]) >= WINDOW), key=lambda d: d[0])
    if not docs:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in ROWS.types], schema=ROWS)
    sizes = np.array([len(d[2]) for d in docs])
    words = np.fromiter((word_hash[w] for d in docs for w in d[2]), np.uint64, int(sizes.sum()))
    ids, marks = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int64)
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    whole = np.flatnonzero(doc_of[: len(words) - WINDOW + 1] == doc_of[WINDOW - 1 :])  # starts of windows within a document
    # Memory table: windows by hash, documents ascending; those after a smaller document's are flagged.
    h = _hashes(words, WINDOW)[whole]
    order = np.argsort(h, kind="stable")
    sorted_h, sorted_doc = h[order], ids[doc_of[whole[order]]]
    head = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
    least = sorted_doc[head][np.cumsum(head) - 1]
    flagged = np.zeros(len(whole), bool)
    flagged[order] = sorted_doc > least
    # Anchors: the leftmost least gram of each window.
    grams = _hashes(words, GRAM)
    best, place = grams[whole], np.zeros(len(whole), np.int64)
    for j in range(1, WINDOW - GRAM + 1):
        other = grams[whole + j]
        less = other < best
        best = np.where(less, other, best)
        place[less] = j
    anchor = whole + place
    run = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)]))
    n = np.diff(np.concatenate([run, [len(whole)]]))
    open_ones = np.add.reduceat((~flagged).astype(np.int64), run) > 0
    run, n = run[open_ones], n[open_ones]
    start, at = whole[run], anchor[run]
    offsets = np.concatenate([[0], np.cumsum(n)])
    each = np.arange(offsets[-1]) + np.repeat(run - offsets[:-1], n)
    checks = np.ascontiguousarray(h[each].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK])
    offsets *= CHECK
    d = doc_of[start]
    st = (start - first[d]) | (marks[d] << 36)
    a = (grams[at] >> np.uint64(40)).astype(np.int64)
    # Runs of flagged windows pass through the join as rows of four bytes.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flagged.view(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    if len(lo):  # a run may go on over the end of a document, whose windows are no neighbours
        cut = np.flatnonzero(flagged[1:] & flagged[:-1] & (whole[1:] != whole[:-1] + 1)) + 1
        lo, hi = np.sort(np.concatenate([lo, cut])), np.sort(np.concatenate([hi, cut]))
    own = whole[lo]
    fd = doc_of[own]
    f_st = (own - first[fd]) | (marks[fd] << 36)
    f_n = (hi - lo).astype("<u4")
    data = checks.tobytes() + f_n.tobytes()
    ends = np.concatenate([offsets, offsets[-1] + 4 * np.arange(1, len(lo) + 1)]).astype(np.int32)
    rows = len(run) + len(lo)
    binary = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    fa = (_mixed(ids[fd].view(np.uint64) + own.astype(np.uint64)) >> np.uint64(40)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([a, fa])), pa.array(np.concatenate([ids[d], ids[fd]])), pa.array(np.concatenate([st, f_st])), binary], schema=ROWS
    )


def _batch_rows(batches):
    """Arrow batches of (id, mark, text) to index rows, by memory tables of about ``TABLE_WORDS`` words."""
    tidy()
    word_hash = Memo(xxhash.xxh64_intdigest, 200_000)
    held, total = [], 0
    for b in batches:
        for doc, mark, text in zip(b.column(0), b.column(1), b.column(2)):
            words = (text.as_py() or "").encode().split()
            if len(words) >= WINDOW:
                held.append((LAST if (i := doc.as_py()) is None else i, mark.as_py(), words))
                total += len(words)
            if total >= TABLE_WORDS:
                yield _table_rows(held, word_hash)
                held, total = [], 0
    if held:
        yield _table_rows(held, word_hash)


def _merge_join(batches):
    """Rows sorted by anchor and document to flags, by one streaming pass."""
    tidy()
    seen_h, seen_doc, seen_a = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
    for b in batches:
        if not b.num_rows:
            continue
        a, doc, st = (b.column(i).to_numpy() for i in range(3))
        windows = b.column(3)
        ends = np.frombuffer(windows.buffers()[1], np.int32)[windows.offset : windows.offset + len(windows) + 1].astype(np.int64)
        data = np.frombuffer(windows.buffers()[2] or b"", np.uint8)
        length = np.diff(ends)
        past = length == 4  # flags of a memory table
        out_doc, out_st, out_bits = [doc[past]], [st[past]], []
        if past.any():
            where = ends[:-1][past][:, None] + np.arange(4)
            out_bits.append(-(data[where].view("<u4").ravel().astype(np.int64)))
        rows = np.flatnonzero(~past)
        if len(rows):
            n = length[rows] // CHECK
            row = np.repeat(np.arange(len(rows)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            check = np.zeros((len(row), 8), np.uint8)
            check[:, :CHECK] = data[(ends[:-1][rows][row] + CHECK * j)[:, None] + np.arange(CHECK)]
            h = _mixed(check.view("<u8").ravel() * FACTORS[0] + _mixed(a[rows].view(np.uint64) + FACTORS[1])[row])
            w_doc, w_a = doc[rows][row], a[rows][row]
            if seen_a is not None and w_a[0] != seen_a:
                seen_h, seen_doc = seen_h[:0], seen_doc[:0]
            all_h, all_doc = np.concatenate([seen_h, h]), np.concatenate([seen_doc, w_doc])
            order = np.argsort(all_h, kind="stable")
            sorted_h = all_h[order]
            head = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
            heads = order[head]
            flagged = np.zeros(len(all_h), bool)
            flagged[order] = all_doc[order] > all_doc[heads][np.cumsum(head) - 1]
            flagged = flagged[len(seen_h) :]
            bits = np.bincount(row, flagged * (1 << j), len(rows)).astype(np.int64)
            hit = (bits > 0) & (doc[rows] != EARLIER)
            out_doc.append(doc[rows][hit]), out_st.append(st[rows][hit]), out_bits.append(bits[hit])
            # What the last anchor's windows were, in their smallest documents, goes on to the next batch.
            last_a = w_a[-1]
            own = np.concatenate([np.full(len(seen_h), last_a == (seen_a if seen_a is not None else ~last_a)), w_a == last_a])
            kept = heads[own[heads]]
            seen_h, seen_doc, seen_a = all_h[kept], all_doc[kept], last_a
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_st)), pa.array(np.concatenate(out_bits).astype(np.int32) if out_bits else np.zeros(0, np.int32))],
            schema=pa.schema([("doc", pa.int64()), ("st", pa.int64()), ("bits", pa.int32())]),
        )


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__mark``, 24 bits of a hash of the text, which tell rows of one id apart."""
    return docs.withColumn("__mark", F.xxhash64(F.col(f"`{text_col}`")).bitwiseAND(F.lit((1 << 24) - 1)))


def _pressed(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts in ``__text`` compressed, as they go through a shuffle."""
    schema = appended(docs.schema, [StructField("__text", BinaryType())])

    def run(batches):
        tidy()
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            i = b.schema.get_field_index("__text")
            texts = pa.array([None if t is None else press(t.encode()) for t in b.column(i).to_pylist()], pa.binary())
            rest = [j for j in range(b.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in rest), texts], names=[*(b.schema.names[j] for j in rest), "__text"])

    return docs.mapInArrow(run, schema)


def index_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index rows of a batch of documents."""
    marked = _marked(small_batches(docs).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    return marked.select("__id", "__mark", "__text").mapInArrow(_batch_rows, ROWS_DDL)


def flags(rows: DataFrame) -> DataFrame:
    """``doc, st, bits`` of the windows in ``rows`` that a smaller document has."""
    return rows.repartition("a").sortWithinPartitions("a", "doc").mapInArrow(_merge_join, FLAGS_DDL)


def remove_flagged(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by spaces), ``n_words`` and ``n_removed``."""
    docs = plain(docs)
    kept = without(docs, ["kept", "n_words", "n_removed"])
    schema = appended(kept.schema, [StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    names, rest = schema.names, [c for c in kept.columns if c != text_col]
    by_row = found.select("doc", F.shiftrightunsigned("st", 36).alias("mark"), F.col("st").bitwiseAND(F.lit(0xFFFFFFFF)).cast("long").alias("start"), "bits").groupBy("doc", "mark").agg(
        F.collect_list("start").alias("__starts"), F.collect_list("bits").alias("__bits")
    )
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    marked = _marked(docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").alias("__text"), key.alias("__key")), "__key", "__text")
    joined = _pressed(marked).join(by_row, (F.col("__key") == F.col("doc")) & (F.col("__mark") == F.col("mark")), "left").select(
        *[F.col(f"`{c}`") for c in rest], "__text", "__starts", "__bits"
    )

    def run(batches):
        tidy()
        open_text = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts, n_words, n_removed, whole = [], [], [], []
            for pressed, starts, bits in zip(b.pop("__text"), b.pop("__starts"), b.pop("__bits")):
                text = None if pressed is None else open_text(pressed)
                whole.append(None if text is None else text.decode())
                words = (text or b"").split()
                n_words.append(len(words))
                if starts is not None and len(starts):
                    depth = np.zeros(len(words) + 1, np.int64)
                    starts, bits = np.asarray(starts, np.int64), np.asarray(bits, np.int64)
                    runs = bits < 0
                    np.add.at(depth, starts[runs], 1)
                    np.add.at(depth, starts[runs] - bits[runs] + WINDOW - 1, -1)
                    for j in range(WINDOW - GRAM + 1):
                        on = starts[~runs][(bits[~runs] >> j) & 1 == 1] + j
                        np.add.at(depth, on, 1)
                        np.add.at(depth, on + WINDOW, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                texts.append(b" ".join(words).decode())
                n_removed.append(n_words[-1] - len(words))
            b = b.assign(kept=texts, n_words=n_words, n_removed=n_removed)
            if text_col in names:
                b[text_col] = whole
            yield b[names]

    return joined.mapInPandas(run, schema)


def deduplicate(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without passages that smaller documents, or ``history`` (rows of earlier runs), have; see ``remove_flagged``."""
    rows = index_rows(docs, id_col, text_col)
    if history is not None:
        rows = rows.unionByName(history.select("a", F.lit(EARLIER).alias("doc"), "st", "windows"))
    return remove_flagged(docs, flags(rows), id_col, text_col)


class FingerprintIndex:
    """Sorted immutable runs of past batches under ``path``, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _store(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def runs(self) -> list[str]:
        """Paths of complete runs, oldest first."""
        where, store, jvm = self._store()
        if not store.exists(where):
            return []
        found = sorted(x.getPath().toString() for x in store.listStatus(where))
        return [p for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]

    def rows(self) -> DataFrame | None:
        runs = self.runs()
        return self.spark.read.schema(ROWS_DDL).parquet(*runs).where(F.octet_length("windows") > 4) if runs else None

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/run-{len(self.runs()):06d}-{uuid.uuid4().hex[:8]}"
        rows.repartition("a").sortWithinPartitions("a", "doc").write.option("compression", "zstd").parquet(path)
        return path

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch against itself and all runs, and append its run. Every past document counts as smaller.

        The batch's rows are computed once, into its run; what its memory tables flagged lies there too, and is not read
        as history.
        """
        history = self.rows()
        path = self._write(index_rows(docs, id_col, text_col))
        rows = self.spark.read.schema(ROWS_DDL).parquet(path)
        if history is not None:
            rows = rows.unionByName(history.select("a", F.lit(EARLIER).alias("doc"), "st", "windows"))
        return remove_flagged(docs, flags(rows), id_col, text_col)

    def compact(self) -> None:
        """Merge all runs into one, one row for each anchor and its windows; then the old runs go."""
        old = self.runs()
        if len(old) > 1:
            merged = self.rows().groupBy("a", "windows").agg(F.min("doc").alias("doc"))
            self._write(merged.select("a", "doc", F.lit(0).cast("long").alias("st"), "windows"))
            _, store, jvm = self._store()
            for p in old:
                store.delete(jvm.org.apache.hadoop.fs.Path(p), True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` without passages of 13 words or more that a smaller document has."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM texts)),
firsts AS (SELECT k, min(doc_id) AS doc_id FROM windows GROUP BY k),
covered AS (SELECT DISTINCT x.doc_id, x.i + j.j AS i FROM windows x JOIN firsts f ON x.k = f.k AND x.doc_id > f.doc_id CROSS JOIN range(0, 13) j(j)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept
  FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
