"""Stupid-backoff language-model scores from n-gram counts of the whole corpus."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .textvec import buffers, mix, slices, word_hashes

ORDERS = (1, 2, 3)
#: Bytes of text that are one chunk, and n-grams of chunks that one partition of a count table is made of.
CHUNK_BYTES, PART_GRAMS = 8 << 20, 4 << 20
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _packed(x: np.ndarray) -> bytes:
    """An array of unsigned integers by planes of bytes, each compressed by itself or, if that doesn't pay, as it is."""
    wide = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    parts = []
    for i in range(planes):
        raw = wide[:, i].tobytes()
        small = zstandard.compress(raw, 1)
        parts.append(small if len(small) < len(raw) else raw)
    return struct.pack(f"<BI{planes}I", planes, len(x), *map(len, parts)) + b"".join(parts)


def _unpacked(data: bytes) -> np.ndarray:
    planes, n = struct.unpack_from("<BI", data)
    sizes = struct.unpack_from(f"<{planes}I", data, 5)
    wide, at = np.zeros((n, 8), np.uint8), 5 + 4 * planes
    for i, size in enumerate(sizes):
        part = data[at : at + size]
        wide[:, i] = np.frombuffer(part if size == n else zstandard.decompress(part), np.uint8)
        at += size
    return wide.view("<u8").ravel()


def _chunks(size: int):
    """(chunk, doc_ids, counts, vocabulary, sequence): the words of documents of `size` bytes or more as places in their vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list = []
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held
            vocabulary, sequence, many = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-many, kind="stable")  # frequent words first, so that most numbers are small
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            steps = np.diff(vocabulary[order], prepend=np.uint64(0))
            out = [part << 32 | n, ids[:], np.concatenate(counts).tolist(), _packed(steps), _packed(rank[sequence])]
            n, held = n + 1, 0
            for x in (ids, hashes, counts):
                x.clear()
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds, strict=True)], names=["chunk", "doc_ids", "counts", "vocabulary", "sequence"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, end, data, off in slices(*buffers(batch.column(1)), min(size, 1 << 20)):
                h, c = word_hashes(data, off)
                ids += doc_ids[first:end]
                hashes.append(h)
                counts.append(c)
                held += len(data)
                if held >= size:
                    yield flush()
        if ids:
            yield flush()

    return run


class _Grams:
    """A chunk's words, and the n-grams that they end."""

    def __init__(self, counts: list[int], vocabulary: bytes, sequence: bytes):
        known = np.cumsum(_unpacked(vocabulary), dtype=np.uint64)
        self.words = known[_unpacked(sequence).astype(np.int64)]
        self.counts = np.array(counts, np.int64)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)  # of a word in its document

    def of(self, n: int) -> np.ndarray:
        """The hash, of 64 bits, of the n-gram that each word ends, of those that have one."""
        grams = np.full(len(self.words), n, np.uint64)
        for j in range(n):
            grams[n - 1 :] += self.words[j : len(self.words) - n + 1 + j] * _MULT[j]
        return mix(grams[self.place >= n - 1])


def _sorted_packed(x: np.ndarray) -> bytes:
    """Ascending numbers as _packed() steps."""
    return _packed(np.diff(x, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _exploded(n: int, bits: int):
    """(part, chunk, grams, many): a chunk's distinct n-grams of an order and how often they stand there, by the top bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, *parts = (batch.column(c)[i].as_py() for c in range(4))
                own, many = np.unique(_Grams(*parts).of(n), return_counts=True)
                part = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
                cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
                out = [(int(p), chunk, _sorted_packed(own[x:y]), _packed(many[x:y])) for p, x, y in zip(range(1 << bits), cuts, cuts[1:], strict=False) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "chunk", "grams", "many"])

    return run


def _counted(least: int):
    """A partition of the count table, (part, grams, totals): the n-grams of all chunks there that the corpus has `least` times or more."""

    def run(rows: pa.Table) -> pa.Table:
        grams, inverse = np.unique(np.concatenate([_sorted_unpacked(x) for x in rows.column("grams").to_pylist()]), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([_unpacked(x) for x in rows.column("many").to_pylist()]).astype(np.float64)).astype(np.uint64)
        kept = totals >= least
        out = rows.column("part")[0].as_py(), _sorted_packed(grams[kept]), _packed(totals[kept])
        return pa.table([pa.array([x], t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "grams", "totals"])

    return run


def _joined(rows: pa.Table, table: pa.Table) -> pa.Table:
    """(chunk, part, totals): for the n-grams of each chunk, in their order, the totals of a partition of the count table, 0 where it has none."""
    grams, totals = (f(table.column(c)[0].as_py()) for f, c in ((_sorted_unpacked, "grams"), (_unpacked, "totals")))
    out = []
    for own in map(_sorted_unpacked, rows.column("grams").to_pylist()):
        at = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
        out.append(_packed(np.where(grams[at] == own, totals[at], 0) if len(grams) else np.zeros(len(own), np.uint64)))
    return pa.table([rows.column("chunk"), rows.column("part"), pa.array(out, pa.binary())], names=["chunk", "part", "totals"])


def _scored(total_words: int, backoff: float):
    """Scores of the documents of a chunk, from its words and the totals of its n-grams."""
    log_b = np.log(backoff)

    def run(heads: pa.Table, found: pa.Table) -> pa.Table:
        g = _Grams(*(heads.column(c)[0].as_py() for c in ("counts", "vocabulary", "sequence")))
        totals: dict[int, list] = {n: [] for n in ORDERS}
        for n, part, data in zip(*(found.column(c).to_pylist() for c in ("n", "part", "totals")), strict=True):
            totals[n].append((part, data))
        c = {}
        for n in ORDERS:
            c[n] = np.zeros(len(g.place))
            if totals[n]:
                _, inverse = np.unique(g.of(n), return_inverse=True)
                c[n][g.place >= n - 1] = np.concatenate([_unpacked(x) for _, x in sorted(totals.pop(n))]).astype(np.float64)[inverse]
        before = {n: np.concatenate([[0.0], c[n][:-1]]) for n in (1, 2)} if len(g.place) else {1: c[1], 2: c[2]}
        has3, has2 = c[3] > 0, c[2] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            three = np.log(c[3]) - np.log(before[2])
            two = np.log(c[2]) - np.log(before[1]) + log_b * (g.place >= 2)
            one = np.log(c[1]) - np.log(total_words) + log_b * np.minimum(g.place, 2)
        each = np.where(has3, three, np.where(has2, two, one))
        doc = np.repeat(np.arange(len(g.counts)), g.counts)
        tally = lambda w: np.bincount(doc, w, len(g.counts)).astype(np.float64)
        out = [g.counts, tally(has3).astype(np.int64), tally(has2 & ~has3).astype(np.int64), tally(each)]
        return pa.table([pa.array(heads.column("doc_ids")[0].as_py(), pa.int64()), *map(pa.array, out)], names=["doc_id", "n_words", "n_order3", "n_order2", "log_score"])

    return run


def stupid_backoff(docs: DataFrame, least: int = 2, backoff: float = 0.4, chunk_bytes: int = CHUNK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """(doc_id, n_words, n_order3, n_order2, log_score) for each row of docs(doc_id, text).

    log_score sums the logs of the stupid-backoff scores of the document's words given the two before: the share of
    the trigram in its first two words if the corpus has it `least` times or more, else `backoff` times the share of the
    bigram in its first word if that is so frequent, else `backoff` times again the word's share of all words. Counts
    are those of all documents, ASCII letters as lower case. n_order3 and n_order2 count the words scored at an order.

    Documents are written as chunks of word numbers. For each order they are exploded into their distinct n-grams, in
    blocks by the top bits of the n-grams' hashes: an n-gram reaches its partition once for each chunk, so frequent ones
    don't gather. The blocks of a partition are summed into a count table, which is written; the exploded n-grams are then joined to it, partition by partition, and what it
    holds of them goes back to their chunks, where scores are summed by document. Words and n-grams are told apart by 64
    bits of hash. Blocks hold n-grams as packed arrays: as rows of their own they took more than five times the input's
    size of disk (README).

    Null text has no words and score 0, as an empty one; a null doc_id is kept; equal rows count and are scored each;
    an empty table gives no rows. Whole texts are used. Other columns are ignored, whatever their names.
    """
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _chunks(chunk_bytes), "chunk long, doc_ids array<long>, counts array<long>, vocabulary binary, sequence binary"
    )
    with scratch(docs.sparkSession) as kept:
        chunks = written(chunks)
        words = chunks.select(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        bits = (words // part_grams).bit_length()
        found = []
        for n in ORDERS:
            blocks = chunks.select("chunk", "counts", "vocabulary", "sequence").mapInArrow(_exploded(n, bits), "part long, chunk long, grams binary, many binary")
            blocks = blocks.repartition(1 << bits, "part").groupBy("part")
            table = written(blocks.applyInArrow(_counted(least if n > 1 else 1), "part long, grams binary, totals binary"))
            joined = blocks.cogroup(table.groupBy("part")).applyInArrow(_joined, "chunk long, part long, totals binary")
            found.append(written(joined.withColumn("n", F.lit(n))))
        kept += [chunks, *found]
    by_chunk = chunks.groupBy("chunk").cogroup(reduce(DataFrame.union, found).groupBy("chunk"))
    return by_chunk.applyInArrow(_scored(words, backoff), "doc_id long, n_words long, n_order3 long, n_order2 long, log_score double")


QUERY_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT rid, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1
      FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT w3 AS a, count(*) AS n FROM p GROUP BY 1),
c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM p WHERE w1 IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
t AS (SELECT count(*) AS n FROM p),
s AS (SELECT rid, c3.n IS NOT NULL AS h3, c2.n IS NOT NULL AS h2,
        CASE WHEN c3.n IS NOT NULL THEN ln(c3.n::DOUBLE) - ln(x2.n::DOUBLE)
             WHEN c2.n IS NOT NULL THEN ln(c2.n::DOUBLE) - ln(x1.n::DOUBLE) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
             ELSE ln(c1.n::DOUBLE) - ln(t.n::DOUBLE) + least(i - 1, 2) * ln(0.4) END AS s
      FROM p CROSS JOIN t JOIN c1 ON c1.a = w3 LEFT JOIN c1 x1 ON x1.a = w2 LEFT JOIN c2 ON c2.a = w2 AND c2.b = w3
        LEFT JOIN c2 x2 ON x2.a = w1 AND x2.b = w2 LEFT JOIN c3 ON c3.a = w1 AND c3.b = w2 AND c3.c = w3),
g AS (SELECT rid, sum(h3::INT)::BIGINT AS n3, sum((h2 AND NOT h3)::INT)::BIGINT AS n2, sum(s) AS s FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n3, 0)::BIGINT AS n_order3, coalesce(n2, 0)::BIGINT AS n_order2,
       round(coalesce(s, 0), 3) AS log_score
FROM d LEFT JOIN g USING (rid)
"""
