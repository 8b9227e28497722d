"""Best-fit packing into bins of several permitted capacities."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, n_words, words, written

SCHEMA = "row_id long, doc_id long, piece long, n_pieces long, start long, size long, bin_id long, bin_capacity long, bin_fill long, bin_offset long"
#: A bin of capacity c costs OVERHEAD + c + c * c / SPAN: a fixed part, one for each word, and attention's, which grows with the square.
OVERHEAD, SPAN = 64, 8192


def cost(capacity: int, overhead: int = OVERHEAD, span: int = SPAN) -> float:
    return overhead + capacity + capacity * capacity / span


def pack(sizes: list[int], capacities: list[int], overhead: int = OVERHEAD, span: int = SPAN) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset of each item, capacity of each bin); sizes fall, none is above the largest capacity.

    An item goes to the open bin that it leaves the least room in. If none has room, the bin size that costs least for
    each word it can be expected to hold is opened. Its room beside the item is expected to be filled as far as the
    items to come that fit there can fill all open room together with it. At the end each bin shrinks to the least capacity that holds
    its contents, which lowers its cost.
    """
    capacities = sorted(capacities)
    costs = {c: cost(c, overhead, span) for c in capacities}
    rooms: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by their room
    have = 0  # bit r: some bin has room r
    open_room = 0
    fill: list[int] = []
    bins, offsets = [], []
    upto = np.append(np.cumsum(sizes[::-1])[::-1], 0).tolist()  # of an item and all after it
    negative = [-s for s in sizes]
    for i, s in enumerate(sizes):
        above = have >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                have &= ~(1 << room)
            open_room -= s
        else:
            room, best = 0, float("inf")
            for c in capacities:
                if c >= s:
                    rest = c - s
                    to_come = upto[max(i + 1, bisect_left(negative, -rest))] if rest else 0
                    price = costs[c] / (s + rest * min(1.0, to_come / (open_room + rest)) if rest else s)
                    if price < best:
                        room, best = c, price
            b = len(fill)
            fill.append(0)
            open_room += room - s
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += s
        if room > s:
            rooms[room - s].append(b)
            have |= 1 << (room - s)
    return bins, offsets, [next(c for c in capacities if c >= f) for f in fill]


def best_fit(
    docs: DataFrame, capacities: tuple[int, ...] = (512, 1024, 2048, 4096), overhead: int = OVERHEAD, span: int = SPAN, shard_items: int = 20_000, size: str | None = None
) -> DataFrame:
    """(row_id, doc_id, piece, n_pieces, start, size, bin_id, bin_capacity, bin_fill, bin_offset): where each piece of each document is.

    Sizes are words, or the column `size`. A document longer than the largest capacity is cut into pieces of it and a
    rest, and every piece is packed: words [start, start + size) of the document lie at bin_offset of bin bin_id, which
    has room for bin_capacity and holds bin_fill. Items are dealt by their place in the written table of sizes, so
    shards have about shard_items each whatever the keys are, and each is packed alone by pack(). row_id tells rows apart that
    share a doc_id (copies of a mix).

    A document without words (or null text) has one piece of size 0 and null bin columns. Equal rows are each packed; a
    null doc_id is kept. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    largest = max(capacities)
    whole = F.col(size).cast("long") if size else n_words(F.col("text"))
    rows = docs.select("doc_id", F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    rows = written(rows.withColumn("pieces", F.greatest(F.ceil(F.col("n") / largest), F.lit(1)).cast("long")))
    total = rows.agg(F.sum("pieces")).first()[0] or 0
    shards = max(1, -(-total // shard_items))
    items = rows.withColumn("at", F.monotonically_increasing_id()).select("doc_id", "n", "pieces", "at", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("at", "piece"), F.lit(shards)))
    capacities = tuple(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["shard"]):
            yield from packed(group)

    def packed(t: pa.Table) -> list[pa.RecordBatch]:
        doc, n, pieces, at, piece, shard = (t.column(c) for c in ("doc_id", "n", "pieces", "at", "piece", "shard"))
        n, piece, at = n.to_numpy(), piece.to_numpy(), at.to_numpy()
        part = np.minimum(n - piece * largest, largest)
        order = np.lexsort((piece, at, -part))
        order = order[part[order] > 0]
        bins, offsets, sizes = pack(part[order].tolist(), capacities, overhead, span)
        base = int(shard[0].as_py()) << 32 if len(shard) else 0
        cols = [np.zeros(len(n), np.int64) for _ in range(4)]
        b = np.array(bins, np.int64)
        fill = np.bincount(b, part[order], len(sizes)).astype(np.int64) if len(b) else np.zeros(0, np.int64)
        if len(b):
            for col, v in zip(cols, (base + b, np.array(sizes, np.int64)[b], fill[b], np.array(offsets, np.int64)), strict=True):
                col[order] = v
        none = part <= 0
        out = [pa.array(at), doc.combine_chunks(), pa.array(piece), pieces.combine_chunks(), pa.array(piece * largest), pa.array(part), *[pa.array(c, mask=none) for c in cols]]
        return pa.table(out, names=[x.split()[0] for x in SCHEMA.split(", ")]).to_batches()

    dealt = items.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, SCHEMA)


def sequences(docs: DataFrame, separator: str = " ", **options) -> DataFrame:
    """(bin_id, bin_capacity, bin_fill, row_ids, text): the packed sequences themselves, from docs(doc_id, text).

    A sequence is its pieces' words in order of offset; row_ids has a number for the row of each piece, the same for pieces of one row. A
    piece has at most the largest capacity of words, so a bin's pieces meet in one task whatever the sizes of documents are.
    Documents without words are in no sequence. An empty table gives no rows.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("doc_id"), words(F.col("text")).alias("words"))
    numbered = written(numbered.withColumn("size", F.size("words").cast("long")))
    places = best_fit(numbered, size="size", **options).where("bin_id IS NOT NULL")
    pieces = places.select(F.col("doc_id").alias("_row"), "start", "size", "bin_id", "bin_capacity", "bin_fill", "bin_offset")
    rows = numbered.select(F.col("doc_id").alias("_row"), "words").join(pieces, "_row")
    part = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("size").cast("int")), separator)
    held = rows.select("bin_id", "bin_capacity", "bin_fill", F.struct("bin_offset", "_row", part.alias("text")).alias("p"))
    bins = held.groupBy("bin_id", "bin_capacity", "bin_fill").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return bins.select("bin_id", "bin_capacity", "bin_fill", F.col("p._row").alias("row_ids"), F.array_join(F.col("p.text"), separator).alias("text"))
