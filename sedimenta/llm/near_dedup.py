"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, groups, scratch, written
from .textvec import buffers, mix, shingles, slices, word_hashes

WIDTH = 5
#: Pairs of a text and a shingle are counted by the top CELL_BITS bits of the shingle's hash, in blocks of 2**16 cells.
CELL_BITS, BLOCK_BITS = 22, 16
#: ICWS draws r and beta for a shingle from tables by the low ROW_BITS bits of its hash, c by the ROW_BITS above: two shingles share all draws by 32 equal bits alone.
ROW_BITS = 16
#: Texts and bytes that one task compares with each other at a time.
MEMBERS, BYTES = 512, 8 << 20
#: Rounds in which large buckets are dealt in blocks, before what is left apart is compared in full.
TURNS = 2


def documents_shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, repeats, ends): the distinct shingles of each text in order of hash, how often each stands there, and where each text's end."""
    hashes, counts = shingles(*word_hashes(data, off), WIDTH)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) < 1 << 16 else np.int64), counts)
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order], kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(doc[at], np.arange(len(counts)), "right")


def _cell_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(counts, texts): for each of 2**CELL_BITS classes of shingle hashes the pairs of a text and a distinct shingle of it.

    Each task counts its own texts in an array and sends its non-empty blocks, compressed; the blocks of a number are
    added up in one task. The result has a fixed size at any size of the input.
    """
    cells, block = 1 << CELL_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held, texts = np.zeros(cells, np.uint32), [], 0, 0
        for batch in batches:
            for _, _, data, off in slices(*buffers(batch.column(0))):
                hashes, _, ends = documents_shingles(data, off)
                texts += int((np.diff(ends, prepend=0) > 0).sum())
                waiting.append((hashes >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
                held += len(hashes)
                if held > cells:
                    total += np.bincount(np.concatenate(waiting), minlength=cells).astype(np.uint32)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=cells).astype(np.uint32)
        out = [(-1, int(texts).to_bytes(8, "little"))]
        for b in range(cells // block):
            part = total[b * block : (b + 1) * block]
            if (at := np.flatnonzero(part)).size:
                out.append((b, zstandard.compress(at.astype(np.uint16).tobytes() + part[at].tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        texts = 0
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b < 0:
                    texts += int.from_bytes(data, "little")
                    continue
                raw = zstandard.decompress(data)
                n = len(raw) // 6
                total = sums.setdefault(b, np.zeros(block, np.uint64))
                total[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, np.uint32, n, 2 * n)
        out = [(b, zstandard.compress(t.tobytes(), 1)) for b, t in sums.items()] + [(-1, texts.to_bytes(8, "little"))]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "data"])

    counts, texts = np.zeros(cells, np.uint64), 0
    for b, data in docs.select("text").mapInArrow(count, "block int, data binary").repartition(32, "block").mapInArrow(add, "block int, data binary").collect():
        if b < 0:
            texts += int.from_bytes(data, "little")
        else:
            counts[b * block : (b + 1) * block] = np.frombuffer(zstandard.decompress(data), np.uint64)
    return counts, texts


@dataclass
class Idf:
    """Inverse document frequencies: 1 + strength * ln(texts / df) / ln(texts / floor), where a df below `floor` counts as it.

    hashes holds the shingles of `floor` texts or more, ascending, df their exact document frequencies, cells which
    cells of hashes they are in.
    """

    texts: int
    floor: int
    strength: float
    hashes: np.ndarray
    df: np.ndarray
    cells: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), 1 + self.strength if self.texts > self.floor else 1.0)
        if len(self.hashes):
            at = np.flatnonzero(self.cells[hashes >> np.uint64(64 - CELL_BITS)])
            place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            known = self.hashes[place] == hashes[at]
            out[at[known]] = 1 + self.strength * np.log(self.texts / self.df[place[known]]) / max(np.log(self.texts / self.floor), 1e-9)
        return out


def idf(docs: DataFrame, strength: float, most: int = 1 << 20) -> Idf:
    """The Idf of all texts of docs(text), with a table of at most `most` shingles whatever the size of the input.

    floor is the pairs of a text and a distinct shingle of it, divided by `most` (2 at least), so no more shingles can
    reach it. A first pass counts cells of hashes; a shingle that reaches floor lies in a cell that does. A second pass counts the shingles
    of those cells themselves: summed in each task, then by hash.
    """
    counts, texts = _cell_counts(docs)
    floor = max(2, -(-int(counts.sum()) // most))
    cells = counts >= floor
    none = Idf(texts, floor, strength, np.zeros(0, np.uint64), np.zeros(0, np.int64), cells)
    if not cells.any() or texts <= floor:
        return none
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, off in slices(*buffers(batch.column(0))):
                hashes, _, _ = documents_shingles(data, off)
                held.append(hashes[shared.value[hashes >> np.uint64(64 - CELL_BITS)]])
                n += len(held[-1])
                if n > 1 << 21:
                    yield summed(held)
                    held, n = [], 0
        if n:
            yield summed(held)

    got = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow()
    shared.unpersist()
    hashes, df = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(hashes)
    cells = np.zeros(len(cells), bool)
    cells[hashes >> np.uint64(64 - CELL_BITS)] = True
    return Idf(texts, floor, strength, hashes[order], df[order], cells)


def weighted(data: np.ndarray, off: np.ndarray, table: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, weights, ends): documents_shingles() with (1 + ln tf) * idf for each."""
    hashes, tf, ends = documents_shingles(data, off)
    return hashes, (1 + np.log(tf)) * table.of(hashes), ends


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the lesser weights over sum of the greater ones; hashes ascend. 0 if either has none."""
    if not len(ha) or not len(hb):
        return 0.0
    if len(ha) > len(hb):
        ha, wa, hb, wb = hb, wb, ha, wa
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    low = float(np.minimum(wa[both], wb[at[both]]).sum())
    return low / (float(wa.sum()) + float(wb.sum()) - low)


@lru_cache(4)
def _draws(k: int) -> tuple[np.ndarray, ...]:
    rng = np.random.Generator(np.random.PCG64(20))
    shape = (1 << ROW_BITS, k)
    r = rng.gamma(2, 1, shape).astype(np.float32)
    log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
    beta = rng.random(shape, np.float32)
    return r, (1 / r).astype(np.float32), log_c, beta


def icws(hashes: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k samples of a weighted set; two sets agree in one with the probability of their weighted Jaccard similarity.

    For each member: t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1); the sample is (member, t) of the least a.
    """
    r, inverse, log_c, beta = _draws(k)
    least, who, when = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.int64)
    every = np.arange(k)
    log_w = np.log(weights).astype(np.float32)
    for a in range(0, len(hashes), 8192):
        h = hashes[a : a + 8192]
        row = (h & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)
        other = (h >> np.uint64(ROW_BITS) & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64)
        b = beta[row]
        t = np.floor(log_w[a : a + 8192, None] * inverse[row] + b)
        v = log_c[other] - r[row] * (t - b + 1)
        at = v.argmin(0)
        low = v[at, every]
        better = low < least
        least[better], who[better], when[better] = low[better], h[at[better]], t[at[better], every[better]].astype(np.int64)
    return mix(who ^ (when.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def bands(samples: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each `rows` samples and the band's number, as int64."""
    parts = samples.reshape(-1, rows)
    out = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, j])
    return out.view(np.int64)


def signatures(rows: DataFrame, table: Broadcast, n_bands: int, n_rows: int) -> DataFrame:
    """rows(..., text) with bands in place of text; bands are null for a text without words."""
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list = []
            for _, _, data, off in slices(*buffers(batch.column("text"))):
                hashes, weights, ends = weighted(data, off, table.value)
                begin = 0
                for end in ends.tolist():
                    made.append(bands(icws(hashes[begin:end], weights[begin:end], n_bands * n_rows), n_rows) if end > begin else None)
                    begin = end
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(made, pa.list_(pa.int64()))], names=[*[f.name for f in kept], "bands"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", bands array<bigint>")


def _connected(part: pa.Table, buckets: list[list], table: Idf, threshold: float) -> list[bytes]:
    """For each of some texts the least fp of its component, connected by verified links of texts that share a bucket.

    Pairs that are connected already aren't compared, so copies cost a comparison each.
    """
    sets = []
    for _, _, data, off in slices(*buffers(part.column("text"))):
        hashes, weights, ends = weighted(data, off, table)
        sets += [(hashes[x:y], weights[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
    up = list(range(len(sets)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where: dict = {}
    for i, own in enumerate(buckets):
        for bucket in own:
            where.setdefault(bucket, []).append(i)
    seen = set()
    for members in where.values():
        for at, i in enumerate(members):
            for j in members[:at]:
                if (j, i) not in seen and root(i) != root(j):
                    seen.add((j, i))
                    if weighted_jaccard(*sets[i], *sets[j]) >= threshold:
                        up[root(i)] = root(j)
    fps, least = part.column("fp").to_pylist(), {}
    for i, fp in enumerate(fps):
        least[root(i)] = min(least.get(root(i), fp), fp)
    return [least[root(i)] for i in range(len(fps))]


def _few(table: Broadcast, threshold: float):
    """(a, b) for whole candidate components (root, fp, buckets, text): each fp that isn't the least of its component, and that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["root"]):
            heads = _connected(part, part.column("buckets").to_pylist(), table.value, threshold)
            pairs = [(a, b) for a, b in zip(part.column("fp").to_pylist(), heads, strict=True) if a != b]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _blocks(table: Broadcast, threshold: float):
    """(bucket, a, b) for blocks of buckets (bucket, block, fp, text): each fp and the least of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["bucket", "block"]):
            heads = _connected(part, [[0]] * len(part), table.value, threshold)
            yield pa.RecordBatch.from_arrays([part.column("bucket").combine_chunks(), part.column("fp").combine_chunks(), pa.array(heads, pa.binary())], names=["bucket", "a", "b"])

    return run


def _across(table: Broadcast, threshold: float):
    """(a, b) for pairs of blocks (pair, bucket, side, fp, root, own, text): verified links of texts of different roots.

    side is 0 or 1, or 2 where a block meets itself. A pair of texts is compared in the least bucket of both `own` alone.
    Sums of lesser weights are taken for one text and all others at once; what comes near the threshold is compared as elsewhere.
    """

    def found(part: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        sets = []
        for _, _, data, off in slices(*buffers(part.column("text"))):
            hashes, weights, ends = weighted(data, off, table.value)
            sets += [(hashes[x:y], weights[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        fps, roots, sides = (part.column(c).to_pylist() for c in ("fp", "root", "side"))
        own, bucket = [set(x) for x in part.column("own").to_pylist()], part.column("bucket")[0].as_py()
        up: dict = {}

        def root(x: bytes) -> bytes:
            while x in up:
                x = up[x]
            return x

        left, right = ([i for i, s in enumerate(sides) if s in (k, 2)] for k in (0, 1))
        if len(left) > len(right):
            left, right = right, left
        known, codes = np.unique(np.concatenate([sets[j][0] for j in right]), return_inverse=True)
        others = np.concatenate([sets[j][1] for j in right])
        sizes = np.array([len(sets[j][0]) for j in right])
        starts, sums = np.cumsum(sizes) - sizes, np.array([sets[j][1].sum() for j in right])
        mine = np.zeros(len(known))
        for i in left:
            h, w = sets[i]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            both = known[at] == h
            mine[at[both]] = w[both]
            low = np.add.reduceat(np.minimum(mine[codes], others), starts)
            mine[at[both]] = 0
            for k in np.flatnonzero(low >= (threshold - 1e-6) * (w.sum() + sums - low)).tolist():
                j = right[k]
                if i == j or sides[i] == 2 and j < i or root(roots[i]) == root(roots[j]) or min(own[i] & own[j]) != bucket:
                    continue
                if weighted_jaccard(*sets[i], *sets[j]) >= threshold:
                    up[root(roots[i])] = root(roots[j])
                    yield fps[i], fps[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["pair"]):
            pairs = list(found(part))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _rest(members: DataFrame, roots: DataFrame, texts: DataFrame, sized: DataFrame, table: Broadcast, threshold: float) -> DataFrame | None:
    """(a, b): the verified links of members(bucket, fp) between texts of different roots(fp, root), or None if there can't be any.

    Every pair of texts of a bucket that aren't connected meets: blocks of MEMBERS / 2 texts or BYTES / 2 meet in pairs, each in
    a group of its own. A component that fills a block has blocks of its own, and these don't meet each other.
    """
    each = written(members.join(roots, "fp", "left").select("bucket", "fp", F.coalesce("root", "fp").alias("root")).join(sized, "fp"))
    split = written(each.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket"))
    if split.isEmpty():
        return None
    many = lambda: F.greatest(F.ceil(2 * F.sum("n") / MEMBERS), F.ceil(2 * F.sum("size") / BYTES)).cast("int")
    each = written(each.join(split, "bucket"))
    parts = each.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    filled = (2 * F.col("n") >= MEMBERS) | (2 * F.col("size") >= BYTES)
    parts = written(parts.withColumn("owner", F.when(filled, F.col("root")).otherwise(F.lit(b""))))
    blocks = parts.groupBy("bucket", "owner").agg(many().alias("blocks"))
    named = written(parts.join(blocks, ["bucket", "owner"]).select("bucket", "root", "owner", "blocks"))
    dealt = each.join(named, ["bucket", "root"]).withColumn("block", F.pmod(F.xxhash64("fp", "bucket"), F.col("blocks")).cast("int"))
    own = each.groupBy("fp").agg(F.collect_list("bucket").alias("own"))
    dealt = written(dealt.select("bucket", "owner", "block", "fp", "root"))
    blocks = written(dealt.select("bucket", "owner", "block").distinct().withColumn("no", F.monotonically_increasing_id()))
    other = blocks.select("bucket", F.col("owner").alias("owner_"), F.col("no").alias("no_"))
    pairs = blocks.join(other, "bucket").where("no <= no_ AND (owner <> owner_ OR owner = X'')")
    pairs = written(pairs.select("bucket", "no", "no_").withColumn("pair", F.monotonically_increasing_id()))
    sides = pairs.select("pair", "no", F.when(F.col("no") == F.col("no_"), 2).otherwise(0).alias("side"))
    sides = written(sides.union(pairs.where("no < no_").select("pair", "no_", F.lit(1))))
    rows = dealt.join(blocks, ["bucket", "owner", "block"]).select("bucket", "no", "fp", "root").join(own, "fp").join(texts, "fp")
    rows = written(rows).join(sides, "no").select("pair", "bucket", "side", "fp", "root", "own", "text")
    return written(rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_across(table, threshold), "a binary, b binary"))


def links(members: DataFrame, texts: DataFrame, table: Broadcast, threshold: float) -> DataFrame:
    """(fp, root): for each text that has one the least fp that verified links among what members(bucket, fp) puts together connect it with.

    Texts that hang together by shared buckets are candidates. A candidate component of at most MEMBERS texts and BYTES
    goes to one task, each text once, which compares every pair that shares a bucket unless it is connected already.
    The buckets of larger ones are dealt in blocks of that size; a block finds its components in the same way and sends
    on one text of each, and those of a bucket meet in new blocks, until a bucket is a single block, a round finds no
    link or TURNS rounds are over. Then every two texts of a bucket of several blocks that aren't connected by now are compared, two blocks at a time.
    So no group, however large, meets in one task, and copies don't make pairs. What one row for each key is
    joined to is written before, so that the rows of a hot key can be split over tasks.
    """
    heads = written(members.groupBy("bucket").agg(F.min("fp").alias("head")))
    pairs = members.join(heads, "bucket").where("fp <> head").select("fp", "head")
    roots = written(components(pairs, "fp", "head").withColumnRenamed("id", "fp"))
    sized = texts.select("fp", F.octet_length("text").cast("long").alias("size"))
    sums = roots.join(sized, "fp").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sums = written(sums.select("root", ((F.col("n") <= MEMBERS) & (F.col("bytes") <= BYTES)).alias("few")))
    own = members.join(roots.join(sums.where("few"), "root").select("fp", "root"), "fp").groupBy("root", "fp").agg(F.collect_list("bucket").alias("buckets"))
    rows = own.join(texts, "fp").select("root", "fp", "buckets", "text").repartition("root").sortWithinPartitions("root")
    found = written(rows.mapInArrow(_few(table, threshold), "a binary, b binary"))
    now = written(members.join(roots.join(sums.where("NOT few"), "root").select("fp"), "fp").select("bucket", "fp"))
    parts, apart = [found], None
    for turn in range(TURNS):
        if now.isEmpty():
            break
        each = now.join(sized, "fp")
        blocks = each.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("size") / BYTES)).cast("int").alias("blocks"))
        blocks = written(blocks)
        dealt = now.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("fp", "bucket", F.lit(turn)), F.col("blocks")).cast("int"))
        rows = dealt.join(texts, "fp").select("bucket", "block", "fp", "text").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
        out = written(rows.mapInArrow(_blocks(table, threshold), "bucket long, a binary, b binary"))
        new = out.where("a <> b").select("a", "b")
        parts.append(new)
        several = blocks.where("blocks > 1").select("bucket")
        if apart is None:
            apart = written(now.join(several, "bucket"))
        if turn and new.isEmpty():
            break
        now = written(out.where("a = b").join(several, "bucket").select("bucket", F.col("a").alias("fp")))
    roots = written(components(reduce(DataFrame.union, parts)).withColumnRenamed("id", "fp"))
    more = _rest(apart, roots, texts, sized, table, threshold) if apart is not None and not apart.isEmpty() else None
    if more is None or more.isEmpty():
        return roots
    # What is left to unite are the components found, so roots stand for their texts.
    of = lambda c: roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}"))
    lifted = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    top = written(components(lifted))
    single = top.select(F.col("id").alias("fp"), F.col("id").alias("root")).join(roots.select("fp"), "fp", "left_anti")
    every = roots.select("fp", F.col("root").alias("id")).union(single.select("fp", F.col("root").alias("id")))
    return written(every.join(top, "id", "left").select("fp", F.coalesce("root", "id").alias("root")))


def _classes(docs: DataFrame, threshold: float, n_bands: int, n_rows: int, strength: float, whole_rows: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, rid, bands, row) of each row, and (fp, root, class_id, class_size) of each text with words; both written or cheap to read again."""
    spark: SparkSession = docs.sparkSession
    whole = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("fp"), F.monotonically_increasing_id().alias("rid"), *whole, "text")
    with scratch(spark) as kept:
        table = spark.sparkContext.broadcast(idf(rows, strength))
        signed = written(signatures(rows, table, n_bands, n_rows))
        nodes = written(signed.where("bands IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("n")))
        each = nodes.select("fp", F.explode("bands").alias("bucket"))
        shared = written(each.groupBy("bucket").count().where("count > 1").select("bucket"))
        members = written(each.join(shared, "bucket"))
        wanted = members.select("fp").distinct().join(nodes.select("fp", "doc_id"), "fp").select("fp", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"))
        texts = rows.select("fp", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "text").join(wanted, ["_id", "fp"], "left_semi")
        texts = written(texts.select("fp", "text").dropDuplicates(["fp"]))
        roots = links(members, texts, table, threshold)
        placed = written(nodes.select("fp", "doc_id", "n").join(roots, "fp", "left").select("fp", "doc_id", "n", F.coalesce("root", "fp").alias("root")))
        kept += [signed, placed]
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").cast("long").alias("class_size"))
    return signed, placed.select("fp", "root").join(classes, "root")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n_bands: int = 16, n_rows: int = 4, strength: float = 0.25) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for each row of docs(doc_id, text).

    A class holds texts connected by links; a link joins texts whose sets of 5-word shingles, weighted by
    (1 + ln tf) * idf, have a weighted Jaccard similarity of `threshold` or more. Document frequencies come from all
    texts, exact from a floor that bounds their table (idf()); the idf lies between 1 and 1 + strength, so that a large group of near copies, whose shingles are frequent
    because of the copies, isn't torn apart. Pairs to compare share one of n_bands bands of n_rows ICWS samples each
    (at similarity 0.8 a pair shares none with probability 0.0003) and are
    verified by their weights. Equal texts are
    one text from the start, so copies cost a row each and no comparison. class_id is the least doc_id of a class; kept
    marks that document.

    A text that is null or has no words is in a class of its own. A text of one to four words has one shingle, of all
    its words. Words are compared with ASCII letters as lower case. A null doc_id can belong to a class but names none,
    unless all of the class are null: then class_id is null, and kept is true. Equal rows are in one class, and kept
    together. An empty table gives no rows. Whole texts are used. Other columns are ignored, whatever their names.
    """
    signed, named = _classes(docs, threshold, n_bands, n_rows, strength, False)
    out = signed.select("doc_id", "fp", F.col("bands").isNull().alias("_none")).join(named, "fp", "left")
    class_id = F.when(F.col("_none"), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, n_bands: int = 16, n_rows: int = 4, strength: float = 0.25) -> DataFrame:
    """The rows of docs, one for each class of near_duplicates(): that of the least doc_id (null last). Texts without words all stay."""
    signed, named = _classes(docs, threshold, n_bands, n_rows, strength, True)
    placed = signed.select("rid", "doc_id", "fp", "bands").where("bands IS NOT NULL").select("rid", "doc_id", "fp").join(named.select("fp", "root"), "fp")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")).select(F.col("best.rid").alias("rid"))
    alone = signed.where("bands IS NULL").select("rid")
    return signed.select("rid", "row").join(best.union(alone), "rid", "left_semi").select("row.*")
