"""Personal data: fixed expressions, and contexts learned from what they find."""

from __future__ import annotations

import hashlib
import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textvec import buffers, slices, word_hashes

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NUMERIC = re.compile(r"(?=[+().\-/]*[0-9])[+0-9().\-/]+[,;:]?")
_HINT = re.compile(r"[0-9@]")
#: No identifier has more digits.
DIGITS = 19
#: Contexts are looked for in texts by the low CELL_BITS bits of their numbers.
CELL_BITS = 27
_EDGE = ".,;:!?\"'()[]<>|"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed expressions find, in order. Linear in the text, whatever it holds."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split("."))]
        for kind, expression, least, most in ((2, _CARD, 14, 19), (3, _PHONE, 10, 15)):
            if kind == 3 and "+" not in text:
                continue
            for m in expression.finditer(text):
                digits = "".join(_DIGIT.findall(m[0])) if len(m[0]) <= 2000 else ""
                n = len(digits) if digits else len(_DIGIT.findall(m[0]))
                if least <= n <= most:
                    digits = digits or "".join(_DIGIT.findall(m[0]))
                    if kind == 3 or _luhn(digits):
                        out.append((m.start(), kind, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _shapes(token: str) -> int:
    """Bit k: a token could be an identifier of kind k that its expression doesn't cover."""
    if "@" in token:
        return 1
    n = sum(c in "0123456789" for c in token)
    if not _NUMERIC.fullmatch(token.replace(" ", "")):
        return 0
    return (2 if 4 <= n <= 15 and token.count(".") >= 3 else 0) | (4 if 12 <= n <= 19 else 0) | (8 if 7 <= n <= 15 else 0)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, list[str]]]:
    """(start, end, kind or -1, shapes, instance, contexts) of the base spans and of other tokens that look like identifiers.

    Contexts are the word before ("1 word"), the two before ("2 word word") and the word after ("r word"), with ASCII
    letters as lower case. Numeric tokens one space apart are one token as long as they have DIGITS digits together at
    most, as many as the longest identifier. Tokens and words count whatever their length.
    """
    if not base and "@" not in text and not _DIGIT.search(text):
        return []
    tokens = [m.span() for m in _WORD.finditer(text)]
    begins, ends = [t[0] for t in tokens], [t[1] for t in tokens]
    found = [(s, e, k, 0) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    starts, i = [t[0] for t in taken], 0
    while i < len(tokens):
        s, e = tokens[i]
        i += 1
        if not _HINT.search(text, s, e):
            continue
        if _NUMERIC.fullmatch(text, s, e):
            n = len(_DIGIT.findall(text, s, e))
            while i < len(tokens) and tokens[i][0] == e + 1 and text[e] == " " and _NUMERIC.fullmatch(text, *tokens[i]):
                n += len(_DIGIT.findall(text, *tokens[i]))
                if n > DIGITS:
                    break
                e = tokens[i][1]
                i += 1
        while s < e and text[s] in _EDGE:
            s += 1
        while s < e and text[e - 1] in _EDGE:
            e -= 1
        at = bisect_left(starts, e)
        if s < e and not any(b > s for _, b in taken[max(0, at - 4) : at]) and (shapes := _shapes(text[s:e])):
            found.append((s, e, -1, shapes))
    out = []
    for s, e, kind, shapes in found:
        left, right = bisect_right(ends, s), bisect_left(begins, e)
        word = lambda j: text[begins[j] : ends[j]].translate(_LOWER)
        near = [f"1 {word(left - 1)}"] if left else []
        near += [f"2 {word(left - 2)} {word(left - 1)}"] if left > 1 else []
        near += [f"r {word(right)}"] if right < len(tokens) else []
        out.append((s, e, kind, shapes, text[s:e].translate(_LOWER), near))
    return out


def _context_hashes(contexts: list[str]) -> np.ndarray:
    """A number for each context, equal to the one that _totals() makes of running text."""
    out = np.zeros(len(contexts), np.uint64)
    for i, c in enumerate(contexts):
        kind, *words = c.split(" ")
        data = " ".join(words).encode()
        h, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))
        out[i] = _number(kind, h)[-1 if kind == "2" else 0]
    return out


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_context_hashes(batch.column(0).to_pylist()).view(np.int64))], names=["context", "number"])


def _number(kind: str, h: np.ndarray) -> np.ndarray:
    if kind == "2":
        return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else np.zeros(1, np.uint64)
    return h ^ np.uint64(1 if kind == "1" else 2)


def _totals(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(context, total) for asked(context): how often each stands in the texts, whatever is beside it. One pass.

    A task keeps the words whose number has its bit set in a table of 2**CELL_BITS bits, a fixed size, and sends sums by
    number; these are joined to the contexts, so numbers that share a bit alone count for nothing.
    """
    asked = written(asked.mapInArrow(_numbered, "context string, number long"))
    cells = asked.select(F.col("number").bitwiseAND((1 << CELL_BITS) - 1).alias("c"))
    cells = cells.groupBy(F.shiftright("c", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(c & 63 AS INT)))").alias("bits")).toArrow()
    table = np.zeros(1 << (CELL_BITS - 6), np.uint64)
    table[cells.column("word").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    bits = docs.sparkSession.sparkContext.broadcast(table)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], names=["number", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, off in slices(*buffers(batch.column(0))):
                h, counts = word_hashes(data, off)
                for kind in "12r":
                    if len(h) < (2 if kind == "2" else 1):
                        continue
                    x = _number(kind, h)
                    c = x & np.uint64((1 << CELL_BITS) - 1)
                    hit = (bits.value[c >> np.uint64(6)] >> (c & np.uint64(63)) & np.uint64(1)) > 0
                    if kind == "2":  # not across texts
                        last = np.cumsum(counts)[:-1]
                        last = last[(last > 0) & (last < len(h))] - 1
                        hit[last[last < len(hit)]] = False
                    held.append(x[hit])
                    n += len(held[-1])
                if n > 1 << 20:
                    yield summed(held)
                    held, n = [], 0
        if held:
            yield summed(held)

    sums = docs.select("text").mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("total"))
    return written(asked.join(sums, "number").select("context", "total"))


_MENTION = "array<struct<start:int,end:int,kind:int,shapes:int,instance:string,contexts:array<string>>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("shapes", pa.int32()), ("instance", pa.string()), ("contexts", pa.list_(pa.string()))])
    names = [f.name for f in struct]
    for batch in batches:
        hashes, spans, found, counts = [], [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            text_spans = joined(base)
            hashes.append(hashlib.sha256(text_spans.encode()).hexdigest())
            spans.append(text_spans)
            counts.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
            found.append([dict(zip(names, m, strict=True)) for m in mentions(text, base)])
        keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        new = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
        new += [pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(found, pa.list_(struct))]
        yield pa.RecordBatch.from_arrays(keep + new, names=[n for n in batch.schema.names if n != "text"] + [f"n_{k}" for k in KINDS] + ["base_sha256", "base", "found"])


def discovered(edges: DataFrame, docs: DataFrame, rounds: int, support: int, purity: float, accept: float) -> DataFrame | None:
    """(instance, kind) that patterns found, from edges(context, instance, kind, shapes, n); None if there are none.

    Each round scores the graph of contexts and instances: a context stands for a kind if enough distinct known
    instances of it stand there (`support`, at any size), nearly all known or impossible fillers are for it (`purity`), and in the texts an identifier stands
    there more often than anything else. An unseen instance's score is one minus the product of its contexts' doubts;
    from `accept` on it is known in the next round. Rounds end when one changes nothing; a warning tells if `rounds` weren't enough.
    """
    new = None
    known = edges.where("kind >= 0").select("instance", "kind").distinct()
    totals = now = None
    for _ in range(rounds):
        everything = known if new is None else known.unionByName(new)
        state = edges.drop("kind").join(everything, "instance", "left")
        sums = []
        for k in range(len(KINDS)):
            fits = F.col("shapes").bitwiseAND(1 << k) > 0
            sums += [
                F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"pos{k}"),
                F.sum(F.when(F.col("kind") == k, 0).when(F.col("kind").isNull() & fits, 0).otherwise(1)).alias(f"neg{k}"),
                F.sum(F.when((F.col("kind") == k) | (F.col("kind").isNull() & fits), F.col("n")).otherwise(0)).alias(f"occ{k}"),
            ]
        each = state.groupBy("context").agg(*sums)
        rows = F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{c}{k}").alias(c) for c in ("pos", "neg", "occ")]) for k in range(len(KINDS))])
        good = each.select("context", F.explode(rows).alias("r")).select("context", "r.*").withColumn("conf", F.col("pos") / (F.col("pos") + F.col("neg") + 1))
        good = written(good.where((F.col("pos") >= support) & (F.col("conf") >= purity)))
        ask = good.select("context").distinct()
        ask = written(ask if totals is None else ask.join(totals, "context", "left_anti"))
        if not ask.isEmpty():
            more = _totals(docs, ask)
            totals = more if totals is None else totals.union(more)
        if totals is None:
            break
        patterns = good.join(totals, "context", "left").where(F.col("occ") * 2 > F.coalesce("total", F.lit(0)))
        patterns = written(patterns.select("context", "kind", "conf"))
        if patterns.isEmpty():
            break
        doubts = edges.where("kind < 0").drop("kind").join(patterns, "context").where(F.expr("(shapes & shiftleft(1, kind)) > 0"))
        scored = doubts.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")).where(F.col("score") >= accept)
        best = scored.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        new = written(best.join(known, "instance", "left_anti"))
        last, now = now, new.agg(F.count("*"), F.sum(F.xxhash64("instance", "kind").cast("decimal(38,0)"))).first()
        if now == last or not now[0] and last is None:
            break
    else:
        warnings.warn(f"identifiers still change after {rounds} rounds", stacklevel=2)
    return new


def find(
    docs: DataFrame, rounds: int = 60, support: int = 5, purity: float = 0.8, accept: float = 0.7, whole_rows: bool = False
) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans; with whole_rows also the row.

    The counts and base_sha256 are of what fixed expressions find: e-mail addresses, IPv4 addresses, card numbers that
    pass Luhn and international phone numbers, leftmost and not overlapping for each kind. spans, and their number n_spans, add what bootstrapping
    finds: these entities are seeds; the words around them are patterns; discovered() scores the graph of patterns and
    instances in rounds; tokens that look like identifiers of a kind but miss its expression (a phone number without a
    country code, an address at a host without a dot) are added, wherever they stand, once patterns vouch for them.

    Texts are scanned once, whole, and the graph has only identifiers and their contexts. Where patterns look promising
    a second pass counts how often they stand before anything else. Null text is empty (no spans); a null doc_id is
    kept; equal rows have equal results; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    whole = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), *whole, "text")
    kept = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    scanned = written(rows.mapInArrow(_scanned, f"{schema}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, base string, found {_MENTION}"))
    found = scanned.select("rid", F.explode("found").alias("m"))
    edges = found.select(F.explode("m.contexts").alias("context"), "m.instance", "m.kind", "m.shapes").groupBy("context", "instance", "kind", "shapes").agg(F.count("*").alias("n"))
    new = discovered(written(edges), docs, rounds, support, purity, accept)
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(F.filter("found", lambda m: m.kind >= 0), lambda m: F.struct(m.start.alias("start"), m.kind.alias("kind"), m.end.alias("end")))
    out = scanned.withColumn("_base", base)
    if new is not None:
        hits = found.where("m.kind < 0").select("rid", F.col("m.instance").alias("instance"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))
        hits = hits.join(new, "instance").groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_more"))
        out = out.join(hits, "rid", "left")
    else:
        out = out.withColumn("_more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    spans = F.sort_array(F.concat("_base", F.coalesce("_more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"), F.size(spans).cast("long").alias("n_spans"), *(["row"] if whole_rows else []))


def redacted(text: str, spans: str) -> str:
    """A text with each span's kind in place of it; of overlapping spans one covers all."""
    out, at = [], 0
    for part in spans.split(",") if spans else []:
        kind, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"<{kind.upper()}>"]
        at = max(at, int(end))
    return "".join(out) + text[at:]


def without(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with redacted() texts; n_chars, if there, is the new length. Null texts stay null."""
    found = find(docs, whole_rows=True, **options)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t.as_py(), s.as_py()) if t.is_valid else None for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("row")], names=["text", "row"])

    clean = found.where("spans = ''").select("row.*")
    dirty = found.where("spans <> ''").select(F.col("row.text").alias("text"), "spans", "row")
    row = next(f.dataType.simpleString() for f in found.schema if f.name == "row")
    dirty = dirty.mapInArrow(run, f"text string, row {row}")
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return clean.union(dirty.select(*[new[c].cast(kinds[c]).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns]))
