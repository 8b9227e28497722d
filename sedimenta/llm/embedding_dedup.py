"""Near duplicates among embeddings: a navigable small-world graph for each shard, and every shard asked about every vector."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, scratch, written

#: Links of a node in the upper layers and, twice that, in layer 0; the beam while building.
LINKS, BUILD_BEAM = 12, 48
#: Candidates that one step of a search expands (an eighth of a wide beam), and bits of "seen" flags that a batch of searches may hold.
EXPAND, SEEN_BITS = 8, 1 << 25
#: A leader stands in the graph for vectors of at least this cosine to it, and bytes of a shard in one row.
LEADER, SLICE = 0.975, 4 << 20


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches.

    Every vector is in layer 0 and, with probability LINKS ** -k by a hash of its number, in layer k. Vectors enter in
    blocks that double: a block is searched for in the graph so far and compared within itself; of the candidates a
    node links to those that are nearer to it than to a link it already has, then to the nearest others; links go both
    ways and are chosen anew the same way where they are too many.
    """

    def __init__(self, vectors: np.ndarray):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(self.v)
        u = ((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # from the top: members, links (-1: none)
        for k in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= k)
            if len(members):
                self.layers.append((members, np.full((n, LINKS * (1 if k else 2)), -1, np.int32)))
                self._fill(members)
        if n:
            self._mend()

    def _mend(self, rounds: int = 6) -> None:
        """Lead to the vectors that a search for themselves doesn't find: a link, in a column kept for it, from the nearest found.

        A group of near copies links within itself, and can be cut off as a whole; a link to one of it in each round is enough.
        """
        spare = np.full((len(self.v), 4), -1, np.int32)
        members, links = self.layers[-1]
        self.layers[-1] = members, np.concatenate([links, spare], 1)
        links = self.layers[-1][1]
        left = np.arange(len(self.v))
        for _ in range(rounds):
            ids, sims = self._search(self.v[left], BUILD_BEAM, self._entries(self.v[left]))
            lost = ~((ids == left[:, None]).any(1) | (sims.max(1) >= 1 - 1e-6))
            left = left[lost]
            if not len(left):
                break
            near = np.take_along_axis(ids[lost], sims[lost].argmax(1)[:, None], 1)[:, 0]
            nodes, first = np.unique(near, return_index=True)
            for node, x in zip(nodes.tolist(), left[first].tolist(), strict=True):
                for a, b in ((node, x), (x, node)):
                    free = np.flatnonzero(links[a, -4:] < 0)
                    links[a, (free[0] if len(free) else b % 4) - 4] = b

    def _fill(self, members: np.ndarray) -> None:
        links = self.layers[-1][1]
        done, size = 0, 64
        while done < len(members):
            block = members[done : done + size]
            within = self.v[block] @ self.v[block].T
            np.fill_diagonal(within, -2)
            m = min(BUILD_BEAM, len(block))
            near = np.argpartition(-within, m - 1, axis=1)[:, :m] if len(block) > m else np.tile(np.arange(len(block)), (len(block), 1))
            ids, sims = block[near].astype(np.int32), np.take_along_axis(within, near, 1)
            ids[sims < -1.5] = -1
            if done:
                old, old_sims = self._search(self.v[block], BUILD_BEAM, self._entries(self.v[block], members[:done]))
                ids, sims = np.concatenate([ids, old], 1), np.concatenate([sims, old_sims], 1)
            chosen = self._chosen(block, ids, links.shape[1] // 2 if len(self.layers) else links.shape[1])
            links[block, : chosen.shape[1]] = chosen
            self._back(links, block, chosen)
            done += len(block)
            size = min(2 * size, 1024)

    def _chosen(self, nodes: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """For each node at most `most` of the candidates ids (-1: none), the diverse ones first."""
        out = np.full((len(nodes), most), -1, np.int32)
        for a in range(0, len(nodes), 256):
            part = ids[a : a + 256]
            sims = np.matmul(self.v[part], self.v[nodes[a : a + 256]][:, :, None])[:, :, 0]
            sims[part < 0] = -3
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * BUILD_BEAM]
            part, sims = np.take_along_axis(part, order, 1), np.take_along_axis(sims, order, 1)
            vectors = self.v[part]
            among = np.matmul(vectors, vectors.transpose(0, 2, 1))
            keep = np.zeros(part.shape, bool)
            for j in range(part.shape[1]):
                blocked = (keep & (among[:, j, :] > sims[:, j : j + 1])).any(1)
                keep[:, j] = (sims[:, j] > -2.5) & ~blocked & (keep.sum(1) < most - 2)
            rank = np.argsort(np.where(sims <= -2.5, 2, 1 - keep), axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(part, rank, 1)
            got[np.take_along_axis(sims, rank, 1) <= -2.5] = -1
            out[a : a + 256, : got.shape[1]] = got
        return out

    def _back(self, links: np.ndarray, block: np.ndarray, chosen: np.ndarray) -> None:
        """The links from the chosen to the block's nodes."""
        source = np.repeat(block, chosen.shape[1]).astype(np.int32)
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        width = links.shape[1]
        for a in range(0, len(nodes), 512):
            part, f, m = nodes[a : a + 512], first[a : a + 512], many[a : a + 512]
            more = np.full((len(part), int(m.max())), -1, np.int32)
            row = np.repeat(np.arange(len(part)), m)
            more[row, np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)] = source[np.concatenate([np.arange(x, x + y) for x, y in zip(f, m, strict=True)])]
            both = np.concatenate([links[part], more], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            few = (both >= 0).sum(1) <= width
            ranked = -np.sort(-both[few], axis=1)[:, :width]
            links[part[few], : ranked.shape[1]] = ranked
            if (~few).any():
                links[part[~few]] = self._chosen(part[~few], both[~few], width)

    def _entries(self, queries: np.ndarray, members: np.ndarray | None = None) -> np.ndarray:
        """A node to start from in the last layer, found by a narrow search down the layers above."""
        at = np.full(len(queries), self.layers[0][0][0] if members is None or len(self.layers) > 1 else members[0], np.int32)
        for members_, links in self.layers[:-1]:
            del members_
            ids, sims = self._walk(queries, 4, at, links)
            at = np.take_along_axis(ids, sims.argmax(1)[:, None], 1)[:, 0]
        return at

    def _search(self, queries: np.ndarray, beam: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._walk(queries, beam, at, self.layers[-1][1])

    def _walk(self, queries: np.ndarray, beam: int, at: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -2, np.float32)]
        size = max(16, min(512, SEEN_BITS // max(1, len(self.v))))
        for a in range(0, len(queries), size):
            for x, y in zip(out, self._walk_batch(queries[a : a + size], beam, at[a : a + size], links), strict=True):
                x[a : a + size] = y
        return out[0], out[1]

    def _walk_batch(self, queries: np.ndarray, beam: int, at: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(queries), max(1, min(EXPAND, beam // 4), beam // 8)
        ids, sims, open_ = np.full((n, beam), -1, np.int32), np.full((n, beam), -2, np.float32), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = at, (self.v[at] * queries).sum(1), True
        seen = np.zeros((n, len(self.v)), bool)
        seen[np.arange(n), at] = True
        live = np.arange(n)
        while len(live):
            s = np.where(open_[live], sims[live], -3)
            pick = np.argpartition(-s, wide - 1, axis=1)[:, :wide] if beam > wide else np.tile(np.arange(beam), (len(live), 1))
            good = np.take_along_axis(s, pick, 1) > -2.5
            on = good.any(1)
            live, pick, good = live[on], pick[on], good[on]
            if not len(live):
                break
            rows = live[:, None]
            open_[rows, pick] = False
            next_ = np.where(good[:, :, None], links[np.take_along_axis(ids[live], pick, 1)], -1).reshape(len(live), -1)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_[seen[rows, next_]] = -1
            most = int((next_ >= 0).sum(1).max())
            if not most:
                continue
            next_ = -np.partition(-next_, most - 1, axis=1)[:, :most]
            real = next_ >= 0
            r, c = np.nonzero(real)
            seen[live[r], next_[r, c]] = True
            new = np.full(next_.shape, -2, np.float32)
            new[r, c] = np.einsum("ij,ij->i", self.v[next_[r, c]], queries[live[r]])
            all_ids, all_sims = np.concatenate([ids[live], next_], 1), np.concatenate([sims[live], new], 1)
            all_open = np.concatenate([open_[live], real], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open))
        return ids, sims

    def near(self, queries: np.ndarray, beam: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of what a beam finds with a product of `floor` or more; a beam that is full of them is doubled."""
        found_q, found_n = [], []
        left = np.arange(len(queries))
        start = self._entries(queries)
        while len(left):
            ids, sims = self._search(queries[left], beam, start[left])
            hit = (sims >= floor) & (ids >= 0)
            full = (hit.sum(1) > beam // 2) & (beam < 2 * len(self.v))
            q, j = np.nonzero(hit & ~full[:, None])
            found_q.append(left[q])
            found_n.append(ids[q, j])
            left = left[full]
            beam *= 2
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_n))


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1 and their lengths; scaled first, so that no square overflows."""
    top = np.abs(v).max(1, keepdims=True)
    v = v / top
    length = np.linalg.norm(v, axis=1)
    return v / length[:, None], length * top[:, 0]


def leaders(v: np.ndarray) -> np.ndarray:
    """For each of some unit vectors the place of its leader, at a cosine of LEADER or more; a leader leads itself.

    Vectors are dealt by the signs of random projections; of those together the first leads all near it, and so on.
    """
    n = len(v)
    out = np.arange(n)
    bits = max(0, int(np.log2(max(n, 1) / 64)))
    planes = np.random.Generator(np.random.PCG64(5)).normal(size=(v.shape[1], bits)) if n else np.zeros((0, 0))
    code = (v @ planes > 0) @ (1 << np.arange(bits)) if bits else np.zeros(n, np.int64)
    order = np.argsort(code, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if n else []:
        while len(part):
            near = v[part] @ v[part[0]] >= LEADER
            near[0] = True
            out[part[near]] = part[0]
            part = part[~near]
    return out


class Shard:
    """Some vectors with numbers and weights: leaders in a graph, and for each leader those that it leads.

    A group of near copies is one node of the graph however large it is. A question's links are looked for at leaders
    near enough that one they lead can be at `threshold`, and each is verified in double precision.
    """

    def __init__(self, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, threshold: float):
        self.ids, self.n, self.threshold = ids, n, threshold
        self.raw = raw.astype(np.float32) if (raw == raw.astype(np.float32)).all() else raw
        self._units()
        lead = leaders(self.unit)
        order = np.argsort(lead, kind="stable")
        self.heads, first = np.unique(lead[order], return_index=True)
        self.members, self.first = order, np.append(first, len(order))
        wide = np.arccos(np.clip((self.unit * self.unit[lead]).sum(1), -1, 1))
        theta = np.arccos(threshold) + 1e-3
        angle = np.array([wide[order[x:y]].max() for x, y in zip(self.first, self.first[1:], strict=False)]) if len(order) else np.zeros(0)
        self.floor = np.cos(np.minimum(theta + np.where(np.diff(self.first) > 1, angle, 0), np.pi)).astype(np.float32)
        self.graph = Graph(self.unit[self.heads])
        self.beam = 0

    def _units(self) -> None:
        self.unit, _ = _unit(self.raw.astype(np.float64))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "unit"} | {"graph": [(m, links[m]) for m, links in self.graph.layers]}

    def __setstate__(self, state: dict) -> None:
        layers = state.pop("graph")
        self.__dict__ |= state
        self._units()
        self.graph = Graph.__new__(Graph)
        self.graph.v = np.ascontiguousarray(self.unit[self.heads], np.float32)
        self.graph.layers = []
        for members, links in layers:
            whole = np.full((len(self.heads), links.shape[1]), -1, np.int32)
            whole[members] = links
            self.graph.layers.append((members, whole))

    def asked(self, ids: np.ndarray, unit: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many vectors each question links with, and (question, place of a leader) of links that connect each with all its own)."""
        count = np.zeros(len(ids))
        if not len(self.ids) or not len(ids):
            return count, np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, head = self.graph.near(unit.astype(np.float32), beam, float(self.floor.min()))
        order = np.argsort(head, kind="stable")
        q, head = q[order], head[order]
        many = np.diff(self.first)[head]
        on = np.zeros(len(q), bool)
        one = np.flatnonzero(many == 1)
        for a in range(0, len(one), 65536):
            x, m = q[one[a : a + 65536]], self.members[self.first[head[one[a : a + 65536]]]]
            good = (np.einsum("ij,ij->i", unit[x], self.unit[m]) >= self.threshold) & (ids[x] != self.ids[m])
            on[one[a : a + 65536]] = good
            np.add.at(count, x[good], self.n[m[good]])
        rest = np.flatnonzero(many > 1)
        for part in np.split(rest, np.flatnonzero(np.diff(head[rest])) + 1) if len(rest) else []:
            m = self.members[self.first[head[part[0]]] : self.first[head[part[0]] + 1]]
            for b in range(0, len(m), 4096):
                own = m[b : b + 4096]
                for a in range(0, len(part), 1024):
                    x = part[a : a + 1024]
                    good = (unit[q[x]] @ self.unit[own].T >= self.threshold) & (ids[q[x]][:, None] != self.ids[own])
                    on[x] |= good.any(1)
                    count[q[x]] += good @ self.n[own]
        return count, q[on], self.heads[head[on]]

    def audited(self, beam: int, goal: float, audit: int) -> int:
        """The least doubling of `beam` at which `audit` of the shard's own vectors find, on average, `goal` of their links; a wider one than the graph finds all there is."""
        at = np.unique(np.linspace(0, len(self.ids) - 1, min(len(self.ids), audit)).astype(int)) if len(self.ids) else np.zeros(0, int)
        true = np.zeros(len(at))
        for a in range(0, len(self.ids), 8192):
            good = (self.unit[at] @ self.unit[a : a + 8192].T >= self.threshold) & (self.ids[at][:, None] != self.ids[a : a + 8192])
            true += good @ self.n[a : a + 8192]
        some = true > 0
        while beam < 2 * len(self.heads) and some.any():
            got, _, _ = self.asked(self.ids[at], self.unit[at], beam)
            if np.minimum(got[some] / true[some], 1).mean() >= goal:
                break
            beam *= 2
        return beam


def _built(threshold: float, beam: int, goal: float, audit: int):
    """For the rows (dim, shard, id, n, embedding) of each shard: the shard in slices, and the links of leaders."""

    def made(key: tuple, ids: list, n: list, v: list) -> Iterator[pa.RecordBatch]:
        shard = Shard(np.concatenate(ids), np.concatenate(n), np.concatenate(v), threshold)
        shard.beam = shard.audited(beam, goal, audit)
        data = pickle.dumps(shard, 5)
        parts = [data[i : i + SLICE] for i in range(0, len(data), SLICE)]
        for i, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, i, part, None, None), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["dim", "shard", "slice", "data", "a", "b"])
        lead = np.repeat(shard.heads, np.diff(shard.first))
        on = shard.members != lead
        a, b = shard.ids[shard.members[on]], shard.ids[lead[on]]
        none = lambda t: pa.nulls(len(a), t)
        yield pa.RecordBatch.from_arrays([none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["dim", "shard", "slice", "data", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])
        for t in groups(batches, ["dim", "shard"]):
            key = t.column(0)[0].as_py(), t.column(1)[0].as_py()
            if key != last and held[0]:
                yield from made(last, *held)
                held = ([], [], [])
            last = key
            held[0].append(t.column(2).to_numpy())
            held[1].append(t.column(3).to_numpy().astype(np.float64))
            held[2].append(np.concatenate([x.flatten().to_numpy() for x in t.column(4).chunks]).astype(np.float64).reshape(-1, key[0]))
        if held[0]:
            yield from made(last, *held)

    return run


def _linked():
    """For (dim, shard, part, slice, data, id, embedding), a shard's slices first: how many vectors each question links with, and links that connect them."""
    names, kinds = ["a", "b", "n"], (pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slices, shard, up = None, [], None, {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in batches:
            for t in groups(iter([batch]), ["dim", "shard", "part"]):
                now = tuple(t.column(c)[0].as_py() for c in ("dim", "shard", "part"))
                if now != key:
                    key, slices, shard, up = now, [], None, {}
                is_data = t.column("data").is_valid().to_numpy()
                slices += [x for x in t.column("data").filter(pa.array(is_data)).to_pylist()]
                t = t.filter(pa.array(~is_data))
                if not len(t):
                    continue
                if shard is None:
                    shard, slices = pickle.loads(b"".join(slices)) if slices else None, []
                for a in range(0, len(t), 2048):
                    part = t.slice(a, 2048).combine_chunks()
                    ids = part.column("id").to_numpy()
                    v = np.concatenate([x.flatten().to_numpy() for x in part.column("embedding").chunks]).astype(np.float64).reshape(-1, key[0])
                    if shard is None:
                        n, q, head = np.zeros(len(ids)), [], []
                    else:
                        n, q, head = shard.asked(ids, _unit(v)[0], shard.beam)
                    rows = [(x, None, int(y)) for x, y in zip(ids.tolist(), n, strict=True)]
                    for x, y in zip(ids[q].tolist(), shard.ids[head].tolist(), strict=True) if shard else []:
                        rx, ry = root(x), root(y)
                        if rx != ry:
                            up[max(rx, ry)] = min(rx, ry)
                            rows.append((x, y, 0))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def near_embeddings(
    vectors: DataFrame, threshold: float = 0.9, shard_bytes: int = 64 << 20, least_shards: int = 2, questions: int = 16_384, beam: int = 32, goal: float = 0.999, audit: int = 512
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding).

    Equal embeddings are one class from the start. Classes are dealt by hash over shards of about shard_bytes of
    components (at least least_shards), each built in one task: a vector near others leads them, and leaders form a small-world graph. Shards are written, and
    every class asks every shard, about `questions` in a task. A shard's beam starts
    at `beam` and is doubled until, for `audit` of its vectors, it finds on average `goal` of the links that a scan of the shard finds; the
    beam of a single question is doubled while most of it is near enough, so that no dense group is cut.
    What is found is verified by its cosine in double precision. n_links sums the sizes of the classes found (and a
    class's other rows); only links that connect something new within a task are sent on, and components are united.

    Null embeddings, and those with null or non-finite components or only zeros, link with nothing: n_links 0, a
    component of their own. Embeddings of different lengths don't link. A null vec_id links but names no component,
    unless all there are null: then component_id is null, and kept is true. Repeated rows are vectors each and link. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    with scratch(vectors.sparkSession) as kept:
        classes = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
        classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "vec_id", "n", F.size("embedding").alias("dim"), "embedding"))
        size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("dims")).first()
        shards, parts = max(least_shards, -(-4 * size.dims // shard_bytes)), max(1, -(-size.n // questions))
        own = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
        members = classes.select("dim", own.alias("shard"), "id", "n", "embedding").repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard")
        built = written(members.mapInArrow(_built(threshold, beam, goal, audit), "dim int, shard int, slice int, data binary, a long, b long"))
        each = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
        blobs = built.where("slice IS NOT NULL").select("dim", "shard", each(parts, "part"), "slice", "data")
        asks = classes.select("dim", each(shards, "shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("int").alias("slice"), "id", "embedding")
        both = blobs.unionByName(asks, allowMissingColumns=True).repartitionById(shards * parts, F.col("shard") * parts + F.col("part"))
        both = both.sortWithinPartitions("dim", "shard", "part", F.col("slice").asc_nulls_last())
        found = written(both.mapInArrow(_linked(), "a long, b long, n long"))
        roots = components(found.select("a", "b").union(built.select("a", "b")).where("b IS NOT NULL"))
        counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("found"))
        placed = classes.join(counts, F.col("id") == F.col("a"), "left").drop("a").join(roots, "id", "left")
        placed = written(placed.select("id", "vec_id", "embedding", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root")))
        kept.append(placed)
    names = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = placed.select("embedding", "n_links", "root").join(names, "root").drop("root")
    good = rows.where(usable).join(named, "embedding").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


QUERY_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.root = l.a)
SELECT vec_id, coalesce((SELECT count(*) FROM l WHERE a = vec_id), 0)::BIGINT AS n_links, (SELECT min(root) FROM r WHERE id = vec_id) AS component_id,
       vec_id = (SELECT min(root) FROM r WHERE id = vec_id) AS kept
FROM v
"""
