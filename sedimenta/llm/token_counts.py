"""Token counts by a lookup in two tiers: a broadcast hash table of frequent pre-tokens, then each worker's cache."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, mix, powers, slices

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pre-tokens of more bytes are encoded each time; others are told apart by 64 bits of hash.
LONGEST = 64


def pre_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text): the pre-tokens of some texts, a space put before each text that isn't empty.

    A pre-token is a run of spaces with what follows up to a space or line feed, or a line feed; what follows a line
    feed has none. So they cover a text without gaps.
    """
    some = np.flatnonzero(np.diff(off) > 0)
    wide = np.insert(data, off[some], 32)
    begin = off[some] + np.arange(len(some))
    space, feed = wide == 32, wide == 10
    first = np.empty(len(wide), bool)
    first[0:1] = True
    first[1:] = feed[1:] | (space[1:] & ~space[:-1]) | (~space[1:] & ~feed[1:] & feed[:-1])
    first[begin] = True
    starts = np.flatnonzero(first)
    return wide, starts, np.append(starts[1:], len(wide)), some[np.searchsorted(begin, starts, "right") - 1] if len(some) else np.zeros(0, np.int64)


def pre_token_hashes(wide: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(wide) + 1)
    total = np.zeros(len(wide) + 1, np.uint64)
    np.cumsum((wide.astype(np.uint64) + np.uint64(1)) * up[: len(wide)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Pieces:
    """Counts tokens as the sentencepiece model does, pre-token by pre-token.

    A text is marked as the model marks it (a mark before it and for each space), and cut before each run of marks and
    around each line feed. No piece of the vocabulary has a mark after another character, or a line feed; so no merge
    crosses a cut, and the counts of the parts add up exactly. The constructor checks both, and that the model doesn't
    change characters; it raises for a model of another kind.
    """

    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray] | None = None, cache: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        special = {i for i in range(len(pieces)) if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for i, p in enumerate(pieces) if i not in special):
            raise ValueError("pieces of this model cross the borders of pre-tokens")
        for probe, wanted in (("ﬁ a  b", [MARK, "ﬁ", MARK + "a", MARK, MARK + "b"]), (" ", [MARK * 2])):
            got = self.model.encode(probe, out_type=str)
            if "".join(got) != "".join(wanted):
                raise ValueError("this model normalises texts")
        self.table = table if table is not None else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        self.most = cache
        self.cache: dict[int, int] = {}
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.before = len(self.model.encode("\n"))

    def encoded(self, part: str) -> int:
        """Tokens of a pre-token, by the model. The mark that the model itself adds stands for the part's first one."""
        if part == "\n":
            return self.before - 1
        if part == MARK:
            return 1
        if part[0] == MARK:
            return len(self.model.encode(part[1:]))
        return len(self.model.encode("\n" + part)) - self.before

    def encoded_all(self, parts: list[str]) -> list[int]:
        """encoded() of many, in one call of the library."""
        texts = [p[1:] if p[0] == MARK else "\n" + p for p in parts]
        off = [1 if p == MARK else 0 if p[0] == MARK else -self.before for p in parts]
        return [len(x) + o for x, o in zip(self.model.encode(texts, num_threads=1), off, strict=True)] if parts else []

    def count(self, text: str) -> int:
        """Tokens of a text by its pre-tokens, without the tiers."""
        return sum(self.encoded_all(self.cut.findall(MARK + text.replace(" ", MARK)))) if text else 0

    def looked_up(self, hashes: np.ndarray, part) -> np.ndarray:
        """Tokens of the pre-tokens of some distinct hashes: by the table, the cache, or the model, which is given part(i)."""
        known, lengths = self.table
        out = np.zeros(len(hashes), np.int64)
        missing = np.arange(len(hashes))
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            out[hit] = lengths[at[hit]]
            missing = np.flatnonzero(~hit)
        new, cache = [], self.cache
        for i, h in zip(missing.tolist(), hashes[missing].tolist(), strict=True):
            if (n := cache.get(h)) is None:
                new.append((i, h))
            else:
                out[i] = n
        if len(cache) + len(new) > self.most:
            cache.clear()
        for (i, h), n in zip(new, self.encoded_all([part(i) for i, _ in new]), strict=True):
            out[i] = n
            if len(cache) < self.most:
                cache[h] = n
        return out

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each of some texts."""
        out = np.zeros(len(off) - 1, np.int64)
        raw = data.tobytes()
        if (mark := MARK.encode()) in raw:  # the model's mark itself: these few texts are cut as strings
            own = [i for i in range(len(out)) if mark in raw[off[i] : off[i + 1]]]
            for i in own:
                out[i] = self.count(raw[off[i] : off[i + 1]].decode(errors="replace"))
            rest = np.delete(np.arange(len(out)), own)
            parts = [data[off[i] : off[i + 1]] for i in rest]
            out[rest] = self.counts(np.concatenate(parts) if parts else data[:0], np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64))
            return out
        if not len(data):
            return out
        wide, starts, ends, text = pre_tokens(data, off)
        raw = wide.tobytes()
        string = lambda j: raw[starts[j] : ends[j]].decode(errors="replace").replace(" ", MARK)
        n = np.zeros(len(starts), np.int64)
        short = ends - starts <= LONGEST
        hashes, first, inverse = np.unique(pre_token_hashes(wide, starts[short], ends[short]), return_index=True, return_inverse=True)
        places = np.flatnonzero(short)
        n[short] = self.looked_up(hashes, lambda i: string(places[first[i]]))[inverse]
        long = np.flatnonzero(~short)
        n[long] = self.encoded_all([string(j) for j in long])
        return np.bincount(text, n, len(out)).astype(np.int64)


_workers: dict[tuple, Pieces] = {}


def _worker(path: str, key: int, table: tuple[np.ndarray, np.ndarray]) -> Pieces:
    """The model and cache of this Python worker; they outlive a task."""
    if (path, key) not in _workers:
        _workers.clear()
        _workers[path, key] = Pieces(path, table)
    return _workers[path, key]


def frequent(docs: DataFrame, name: str, most: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, tokens) of the `most` pre-tokens that are most frequent in the first `sample` rows of a partition of docs(text), by hash.

    Only the first partition with rows is read, and nothing but the table leaves its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen, left = Pieces(SparkFiles.get(name)), {}, sample
        for batch in batches:
            batch, left = batch.slice(0, left), left - batch.num_rows
            for _, _, data, off in slices(*buffers(batch.column(0))):
                if MARK.encode() in data.tobytes() or not len(data):
                    continue
                wide, starts, ends, _ = pre_tokens(data, off)
                short = ends - starts <= LONGEST
                starts, ends, raw = starts[short], ends[short], wide.tobytes()
                hashes, first, many = np.unique(pre_token_hashes(wide, starts, ends), return_index=True, return_counts=True)
                for h, i, n in zip(hashes.tolist(), first.tolist(), many.tolist(), strict=True):
                    if h in seen:
                        seen[h][0] += n
                    else:
                        seen[h] = [n, raw[starts[i] : ends[i]]]
            if left <= 0:
                break
        if left == sample:
            return
        best = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[:most]
        lengths = pieces.encoded_all([x[1].decode(errors="replace").replace(" ", MARK) for _, x in best])
        order = np.argsort(np.array([h for h, _ in best], np.uint64))
        hashes, lengths = np.array([h for h, _ in best], np.uint64)[order], np.array(lengths, np.uint8)[order]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (hashes, lengths)], names=["hashes", "lengths"])

    got = docs.select("text").mapInArrow(run, "hashes binary, lengths binary").limit(1).collect()
    return (np.frombuffer(bytes(got[0].hashes), np.uint64), np.frombuffer(bytes(got[0].lengths), np.uint8)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, table: int = 65_536, sample: int = 2_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text), as the sentencepiece model at model_path counts.

    One pass over the texts, without a shuffle of pre-tokens: each worker cuts texts into pre-tokens and hashes them by
    whole-array arithmetic, looks them up in a broadcast table, then in a cache of bounded size that the worker keeps
    from task to task, and asks the model for the others. The table holds hashes and lengths, 9 bytes each, of the `table` pre-tokens that are
    most frequent in the first `sample` documents of one partition. What is in the tiers changes the speed alone. Equal 64-bit hashes count as
    equal pre-tokens; longer ones than LONGEST bytes are always encoded. The model file is sent to the executors.

    Null or empty text has 0 bytes and tokens; a null doc_id is kept; each of equal rows is counted; an empty table
    gives no rows. Texts are counted whole, whatever their length. Other columns are ignored, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    name = model_path.rsplit("/", 1)[-1]
    if not any(f.rsplit("/", 1)[-1] == name for f in context.listFiles):
        context.addFile(model_path)
    shared = context.broadcast(frequent(docs, name, table, sample))
    key = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker(SparkFiles.get(name), key, shared.value)
        for batch in batches:
            parts = [pieces.counts(data, off) for _, _, data, off in slices(*buffers(batch.column(2)))]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, SCHEMA)
