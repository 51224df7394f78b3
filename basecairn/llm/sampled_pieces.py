"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has an edge for every piece of the vocabulary that matches at a place (characters without a piece
are spelled by byte pieces). A piece's log weight is -TEMPER * log(rank), rank its place in the vocabulary; a segmentation's
probability is the product of its weights over the lattice's sum. A perturbed A-star search emits the k segmentations of
the largest Gumbel-perturbed log probabilities, largest first:

* a queue holds regions of the lattice's tree of segmentations, each with its perturbed maximum: a region is a prefix and
  the continuations at its end that no emitted path has taken;
* the best region's maximum is the next segmentation: one sampled descent from it (backward sums of the lattice give the
  exact conditional probabilities); every step of that descent opens a region for its untaken edges, whose maximum is a
  Gumbel of the region's log mass truncated at the path's own value.

Places that every path passes cut the lattice: those between two characters that stand side by side in no piece, and around a
character that only byte pieces spell. So all parts of a batch of texts descend together in numpy, and the lattice of a part is
built once and remembered. Random numbers are hashes of (seed, row key, sample, part, step): they depend neither on batches nor on partitions.

Each sample has log_p, perturbed (its Gumbel value) and inclusion: the probability to be among the samples given the
next value, kappa: 1 - exp(-exp(log_p - kappa)); 1 if there is no further segmentation.

Defined results: null text: no samples (empty array). Empty text: one empty segmentation. Fewer than k segmentations: all.
Equal rows get equal samples. Null key: keyed as "null". Whole texts are segmented, however long. No documents: no rows. Ties of
perturbed values: the first region in the text. A column pieces that docs has already is replaced, other columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from .common import fresh, prepare

SAMPLES = 2
TEMPER = 1.0
MARK = "▁"
WIDE = 24
DEEP = 40
_B = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "array<struct<rank:int,ids:array<int>,log_p:double,perturbed:double,inclusion:double,decoded:boolean>>"


def _hash_rows(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points: P[:, i] of the first i."""
    p = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            p[:, i + 1] = p[:, i] * _B + codes[:, i].astype(np.uint64) + np.uint64(1)
    return p


def _slot(h: np.ndarray) -> np.ndarray:
    """One of 2^20 slots for each hash; short pieces, whose hashes are small numbers, spread as others."""
    with np.errstate(over="ignore"):
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def _mixed(key: np.ndarray, *parts, first: int = 0) -> np.ndarray:
    """key with counters mixed in, the first of them counter number ``first``."""
    with np.errstate(over="ignore"):
        x = key
        for i, part in enumerate(parts, first):
            x = (x ^ (np.asarray(part).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 + i))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
    return x


def _uniform(key: np.ndarray, *parts, first: int = 0) -> np.ndarray:
    """Uniform numbers in (0, 1) hashed from the row's key and counters; key may have counters below ``first`` mixed in."""
    with np.errstate(over="ignore"):
        x = _mixed(key, *parts, first=first)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Lattices:
    """The vocabulary of a model, and the lattices of parts of texts."""

    def __init__(self, model_file: str, temper: float = TEMPER):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usable = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.single = {self.pieces[i] for i in usable if len(self.pieces[i]) == 1}
        self.column = pa.array(self.bytes_of, pa.large_binary())
        # characters by number (0: in no piece), and which two stand side by side in a piece
        chars = sorted({c for i in usable for c in self.pieces[i]})
        self.number = np.zeros(0x110000, np.int16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1,) * 2, bool)
        for i in usable:
            of = self.number[np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32)]
            self.beside[of[:-1], of[1:]] = True
        assert not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in usable)  # a mark after another character starts a piece
        hashes = []
        for i in usable:
            codes = np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32)[None, :]
            hashes.append(_hash_rows(codes)[0, -1])
        order = np.argsort(_slot(np.array(hashes, np.uint64)), kind="stable")
        self.hash, self.id = np.array(hashes, np.uint64)[order], np.array(usable)[order]
        assert len(np.unique(self.hash)) == len(self.hash)
        self.weight = -temper * np.log(self.id + 1.0)
        self.linear = np.exp(self.weight)
        self.maybe = np.zeros(1 << 20, bool)
        top = _slot(self.hash)
        self.maybe[top] = True
        # where the pieces of a slot begin, and how many share one at most
        self.begin = np.zeros(1 << 20, np.uint16 if len(top) < 1 << 16 else np.int32)
        self.begin[top[::-1]] = np.arange(len(top))[::-1]
        self.sharing = int(np.bincount(top).max())
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.longest):
                self.powers[i + 1] = self.powers[i] * _B

    def parts(self, texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The parts of all texts one after another, and how many each text has."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        raw = "".join(marked).encode()
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        number = self.number[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(number) + 1, bool)
        cut[1:-1] = ~self.beside[number[:-1], number[1:]]
        cut[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        places = np.append(starts, len(raw))[cut] if len(raw) else np.zeros(1, np.int64)
        all_ = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw))
        before = np.concatenate([[0], np.cumsum(cut[:-1])]) if len(raw) else np.zeros(1, np.int64)
        return all_.dictionary_encode(), before[ends] - before[ends - sizes]

    def edges(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The edges of parts of about one width in order of part, place and falling length: part, place, length, piece id, probability given the place."""
        lengths = np.array([len(p) for p in parts])
        width = int(lengths.max())
        codes = np.frombuffer("".join([p.ljust(width, "\0") for p in parts]).encode("utf-32-le"), np.uint32).reshape(len(parts), width)
        longest = min(self.longest, width)
        prefix = _hash_rows(codes)
        logs = width > DEEP  # products of weights would underflow
        weight = np.full((len(parts), width, longest), -np.inf if logs else 0.0)
        ids = np.full((len(parts), width, longest), -1, np.int32)
        with np.errstate(over="ignore"):
            for n in range(1, longest + 1):
                h = prefix[:, n:] - prefix[:, : width - n + 1] * self.powers[n]
                slot = _slot(h)
                r, s = np.nonzero(self.maybe[slot])
                fits = s + n <= lengths[r]
                r, s = r[fits], s[fits]
                h, at = h[r, s], self.begin[slot[r, s]].astype(np.int64)
                hit = self.hash[at] == h
                for _ in range(self.sharing - 1):
                    on = np.flatnonzero(~hit)
                    on = on[at[on] + 1 < len(self.hash)]
                    at[on] += 1
                    hit[on] = self.hash[at[on]] == h[on]
                r, s, at = r[hit], s[hit], at[hit]
                weight[r, s, n - 1] = self.weight[at] if logs else self.linear[at]
                ids[r, s, n - 1] = self.id[at]
        beta = np.full((len(parts), width + longest), -np.inf if logs else 0.0)
        beta[np.arange(len(parts)), lengths] = 0.0 if logs else 1.0
        for s in range(width - 1, -1, -1):
            after, inside = beta[:, s + 1 : s + 1 + longest], s < lengths
            if logs:
                x = weight[:, s, :] + after
                top = x.max(1)
                live = top > -np.inf
                x = np.exp(x - np.where(live, top, 0)[:, None])
                total = x.sum(1)
                beta[:, s] = np.where(inside & live, np.where(live, top, 0) + np.log(np.where(live, total, 1)), beta[:, s])
            else:
                x = weight[:, s, :] * after
                total = x.sum(1)
                beta[:, s] = np.where(inside, total, beta[:, s])
            weight[:, s, :] = x / np.where(total > 0, total, 1)[:, None] * inside[:, None]
        part, place, n = np.nonzero(weight[:, :, ::-1] > 0)  # long pieces first, they are the likely ones
        n = longest - 1 - n
        return part, place, n + 1, ids[part, place, n], weight[part, place, n]


def _room(column: np.ndarray, size: int) -> np.ndarray:
    """column, or a longer copy if it has fewer than size places."""
    return column if len(column) >= size else np.concatenate([column, np.zeros(max(size - len(column), len(column) // 8), column.dtype)])


class Store:
    """The lattices of remembered parts: nodes numbered through, the edges of node x from edge[x] to edge[x + 1].
    Parts that only byte pieces spell have no lattice; their places are negative, -1 - place being their number in ``spelling``.
    When it is full, parts that were used once since the last time are forgotten."""

    most = 100_000

    def __init__(self, lattices: Lattices, most: int | None = None):
        self.lattices, self.most = lattices, most or self.most
        self.place: dict[str, int] = {}
        self.count, self.spelling = 0, []
        self.base, self.length, self.uses = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.edge = np.zeros(1 << 14, np.int32)
        self.nodes = self.used = 0
        self.columns = {"cum": np.zeros(1 << 16, np.float32), "p": np.zeros(1 << 16, np.float32), "id": np.zeros(1 << 16, np.uint16 if len(lattices.pieces) <= 1 << 16 else np.int32), "n": np.zeros(1 << 16, np.int8)}

    def places(self, parts: list[str]) -> np.ndarray:
        """The places of distinct parts."""
        if self.count > self.most:
            self._forget()
        known = self.place
        found = list(map(known.get, parts))
        missing = [i for i, at in enumerate(found) if at is None]
        self.add([parts[i] for i in missing])
        for i in missing:
            found[i] = known[parts[i]]
        out = np.array(found, np.int64)
        self.uses[out[out >= 0]] += 1
        return out

    def _forget(self) -> None:
        uses = self.uses[: self.count]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(np.argsort(-uses, kind="stable")[: self.most // 2])
        to = np.full(self.count, -1)
        to[kept] = np.arange(len(kept))
        for p in [p for p, at in self.place.items() if at >= 0 and to[at] < 0]:
            del self.place[p]
        self.place.update([(p, int(to[at])) for p, at in self.place.items() if at >= 0])
        sizes = self.length[kept].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        nodes = np.repeat(self.base[kept] - starts, sizes) + np.arange(int(sizes.sum()))
        many = (self.edge[nodes + 1] - self.edge[nodes]).astype(np.int64)
        first = np.cumsum(many) - many
        edges = np.repeat(self.edge[nodes] - first, many) + np.arange(int(many.sum()))
        self.columns = {k: c[edges] for k, c in self.columns.items()}
        self.edge = np.append(first, len(edges)).astype(np.int32)
        self.base, self.length, self.uses = starts.astype(np.int32), sizes.astype(np.int32), np.ones(len(kept), np.int32)
        self.count, self.nodes, self.used = len(kept), len(nodes), len(edges)

    def add(self, parts: list[str]) -> None:
        """Remembers parts that it does not hold yet."""
        for p in parts:
            if len(p) == 1 and p not in self.lattices.single:
                self.spelling.append([self.lattices.byte_id[b] for b in p.encode()])
                self.place[p] = -len(self.spelling)
        parts = [p for p in parts if p not in self.place]
        start = self.count
        self.place.update(zip(parts, range(start, start + len(parts))))
        self.count += len(parts)
        self.base, self.length, self.uses = (_room(c, self.count) for c in (self.base, self.length, self.uses))
        self.uses[start : self.count] = 0
        sizes = np.array([len(p) for p in parts])
        low, high = 0, 4
        while low < int(sizes.max(initial=0)):
            here = np.flatnonzero((sizes > low) & (sizes <= high))
            for lot in np.array_split(here, max(1, -(-len(here) * high * min(high, self.lattices.longest) // 1_000_000))):
                if len(lot):
                    self._append(start + lot, [parts[i] for i in lot], sizes[lot])
            low, high = high, high + 4 if high < WIDE else high * 2

    def _append(self, places: np.ndarray, parts: list[str], sizes: np.ndarray) -> None:
        part, place, n, ids, p = self.lattices.edges(parts)
        base = self.nodes + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.base[places], self.length[places] = base, sizes
        self.nodes += int(sizes.sum())
        node = base[part] + place - base[0]
        many = np.bincount(node, minlength=int(sizes.sum()))
        ends = np.cumsum(many)
        run = np.cumsum(p)
        start = ends - many
        cum = run - np.where(start > 0, run[np.maximum(start - 1, 0)], 0.0)[node]
        last = ends[many > 0] - 1
        cum[last] = 2.0  # the last edge takes the rest
        self.edge = _room(self.edge, self.nodes + 1)
        self.edge[base[0] : self.nodes] = self.used + start
        self.edge[self.nodes] = self.used + len(p)
        end = self.used + len(p)
        self.columns = {k: _room(c, end) for k, c in self.columns.items()}
        for k, c in (("cum", cum), ("p", p), ("id", ids), ("n", n)):
            self.columns[k][self.used : end] = c
        self.used = end


def sample(store: Store, texts: list[str | None], keys: list[str], samples: int = SAMPLES, seed: int = 0) -> list[list[tuple]]:
    """For each text up to ``samples`` distinct segmentations: (ids, log_p, perturbed, inclusion, decoded), the largest value first."""
    lattices, n_rows = store.lattices, len(texts)
    coded, counts = lattices.parts(texts)
    parts = store.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(n_rows), counts)
    row_key = np.array([xxhash.xxh3_64_intdigest(str(k), seed=seed) for k in keys], np.uint64)
    part_key, part_no = row_key[owner], np.arange(len(parts)) - first[owner]
    cum, prob, piece, width = (store.columns[k][: store.used] for k in ("cum", "p", "id", "n"))
    base, length = store.base[np.maximum(parts, 0)], store.length[np.maximum(parts, 0)]
    edge = store.edge

    mixed = [_mixed(part_key, r, part_no) for r in range(samples)]

    def descend(which: np.ndarray, at: np.ndarray, step: np.ndarray, r: int) -> dict:
        """Sampled steps of the parts ``which``, each from its place on, in order: part, step, node, edge, id, p."""
        out, raw = [], which[parts[which] < 0]
        live = parts[which] >= 0
        cur, pos, n = which[live], at[live], step[live]
        while len(cur):
            node = base[cur] + pos
            e, x = edge[node], _uniform(mixed[r][cur], n, 1, first=2).astype(np.float32)
            beyond = np.flatnonzero(cum[e] < x)
            while len(beyond):
                e[beyond] += 1
                beyond = beyond[cum[e[beyond]] < x[beyond]]
            out.append((cur, n, node, e))
            pos = pos + width[e]
            more = pos < length[cur]
            cur, pos, n = cur[more], pos[more], n[more] + 1
        if len(raw):
            out.append((raw, np.zeros(len(raw), np.int64), np.full(len(raw), -1), np.full(len(raw), -1)))
        if not out:
            out = [(np.zeros(0, np.int64),) * 4]
        part, n, node, e = (np.concatenate(c) for c in zip(*out, strict=True))
        least = np.zeros(len(parts), np.int64)
        least[which] = step
        many = np.bincount(part, minlength=len(parts))
        begin = np.cumsum(many) - many
        to = (begin - least)[part] + n
        node, e, got = np.empty_like(node), np.empty_like(e), (node, e)
        node[to], e[to] = got
        part = np.repeat(np.arange(len(parts)), many)
        n = np.arange(len(part)) - (begin - least)[part]
        byte = e < 0
        safe = np.maximum(e, 0)
        p = np.where(byte, 1.0, prob[safe].astype(np.float64)) if len(prob) else np.ones(len(e))
        ids = np.where(byte, parts[part], piece[safe]) if len(piece) else parts[part]
        row = owner[part]
        return {"part": part, "step": n, "node": node, "edge": e, "id": ids.astype(np.int32), "p": p, "start": np.searchsorted(row, np.arange(n_rows)), "end": np.searchsorted(row, np.arange(n_rows), side="right"), "row": row}

    def opened(path: dict, r: int, bound: np.ndarray, so_far: np.ndarray) -> None:
        """Adds to a path the log probability before each step, the whole, and the perturbed maxima of the regions that its steps leave."""
        row, p = path["row"], path["p"]
        logs = np.log(p)
        run = np.concatenate([[0.0], np.cumsum(logs)])
        path["upto"] = so_far[row] + run[:-1] - run[path["start"]][row]
        path["total"] = so_far + np.bincount(row, weights=logs, minlength=n_rows)
        path["g"] = np.full(len(p), -np.inf)
        free = np.flatnonzero(1 - p > 1e-12)
        phi = path["upto"][free] + np.log1p(-p[free])
        e = -np.log(_uniform(mixed[r][path["part"][free]], path["step"][free], 2, first=2))
        path["g"][free] = phi - np.log(e + np.exp(np.minimum(phi - bound[row[free]], 700)))

    g0 = -np.log(-np.log(_uniform(row_key, 0, 0, 0, 3))) if n_rows else np.zeros(0)
    zero = np.zeros(len(parts), np.int64)
    paths = [descend(np.arange(len(parts)), zero, zero, 0)]
    opened(paths[0], 0, g0, np.zeros(n_rows))
    # of each sample: its rows, log probabilities and values, and of each row where its ids stand: slices of paths and single ids
    some = np.array([i for i in range(n_rows) if texts[i] is not None], np.int64)
    taken = [(some, paths[0]["total"][some], g0[some])]
    heads: dict[tuple[int, int], list] = {}
    gone: dict[tuple[int, int], list[int]] = {}
    kappa, live = np.full(n_rows, -np.inf), np.zeros(n_rows, bool)
    live[some] = True
    for r in range(1, samples + 1):
        best, of, where = np.full(n_rows, -np.inf), np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
        for q, path in enumerate(paths):
            filled = np.flatnonzero(path["end"] > path["start"])
            if len(filled):
                top = np.full(n_rows, -np.inf)
                top[filled] = np.maximum.reduceat(path["g"], path["start"][filled])
                at = np.flatnonzero((path["g"] == top[path["row"]]) & (top > best)[path["row"]])
                rows, lead = np.unique(path["row"][at], return_index=True)  # of equal values the first
                best[rows], of[rows], where[rows] = top[rows], q, at[lead]
        if r == samples:
            kappa = best
            break
        live &= best > -np.inf
        todo = np.flatnonzero(live)
        if not len(todo):
            break
        which, at0, step0, so_far = [], [], [], np.zeros(n_rows)
        for q in np.unique(of[todo]).tolist():
            rows, path = todo[of[todo] == q], paths[q]
            at = where[rows]
            part, step, node, upto = path["part"][at], path["step"][at], path["node"][at], path["upto"][at]
            lo, hi = edge[node].astype(np.int64), edge[node + 1].astype(np.int64)
            spots = lo[:, None] + np.arange(int((hi - lo).max()))
            rest = np.where(spots < hi[:, None], prob[np.minimum(spots, len(prob) - 1)].astype(np.float64), 0.0)
            for j, a in enumerate(at.tolist()):
                for e in gone.setdefault((q, a), [int(path["edge"][a])]):
                    rest[j, e - lo[j]] = 0
            line = np.arange(len(rows))
            x = _uniform(mixed[r][part], step, 4, first=2) * rest.sum(1)
            k = np.minimum((np.cumsum(rest, 1) <= x[:, None]).sum(1), hi - lo - 1)
            k = np.where(rest[line, k] > 0, k, rest.argmax(1))
            p = rest[line, k]
            mass = rest.sum(1) - p
            # what stays of the region, under the value just taken
            phi = upto + np.log(np.maximum(mass, 1e-300))
            e = -np.log(_uniform(mixed[r][part], step, 5, first=2))
            path["g"][at] = np.where(mass > 1e-12, phi - np.log(e + np.exp(np.minimum(phi - best[rows], 700))), -np.inf)
            so_far[rows] = upto + np.log(p)
            chosen = lo + k
            for i, a, s, c in zip(rows.tolist(), at.tolist(), path["start"][rows].tolist(), chosen.tolist(), strict=True):
                gone[q, a].append(c)
                heads[i, r] = heads.get((i, q), []) + [(q, s, a), (-1, int(piece[c]), 0)]
            # the rest of the part, if any, and all later parts of the text
            place = node - base[part] + width[chosen]
            begin = part + (place >= length[part])
            many = first[rows + 1] - begin
            new = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            within = new == np.repeat(part, many)
            which.append(new)
            at0.append(np.where(within, np.repeat(place, many), 0))
            step0.append(np.where(within, np.repeat(step + 1, many), 0))
        which, at0, step0 = np.concatenate(which), np.concatenate(at0), np.concatenate(step0)
        order = np.argsort(which, kind="stable")
        paths.append(descend(which[order], at0[order], step0[order], r))
        opened(paths[-1], r, best, so_far)
        taken.append((todo, paths[-1]["total"][todo], best[todo]))
    spelled = [np.array(x, np.int32) for x in store.spelling]
    out: list[list[tuple]] = [[] for _ in texts]
    for r, (rows, logs, values) in enumerate(taken):
        ids, sizes = _ids(paths, heads, r, rows)
        if len(ids) and ids.min() < 0:
            raw = np.flatnonzero(ids < 0)
            wide = np.ones(len(ids), np.int64)
            bytes_ = [spelled[-1 - j] for j in ids[raw].tolist()]
            wide[raw] = [len(x) for x in bytes_]
            ends = np.cumsum(sizes)
            sizes = np.diff(np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], ends])])
            ids = np.repeat(ids, wide)
            ids[ids < 0] = np.concatenate(bytes_)
        ends = np.cumsum(sizes)
        decoded = lattices.column.take(pa.array(ids))
        spots, data = np.frombuffer(decoded.buffers()[1], np.int64)[decoded.offset :] if len(ids) else np.zeros(1, np.int64), memoryview(decoded.buffers()[2] or b"")
        inclusion = np.where(np.isneginf(kappa[rows]), 1.0, -np.expm1(-np.exp(np.minimum(logs - np.where(np.isneginf(kappa[rows]), 0, kappa[rows]), 700))))
        for j, (i, a, b) in enumerate(zip(rows.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)):
            again = bytes(data[spots[a] : spots[b]])
            out[i].append((ids[a:b], float(logs[j]), float(values[j]), float(inclusion[j]), again.removeprefix(b" ") == texts[i].encode()))
    return out


def _ids(paths: list[dict], heads: dict, r: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of sample r of rows one after another, and how many each row has."""
    path = paths[r]
    if not r:  # the first path is what it is
        sizes = (path["end"] - path["start"])[rows]
        return path["id"], sizes
    each = []
    for i, a, b in zip(rows.tolist(), path["start"][rows].tolist(), path["end"][rows].tolist(), strict=True):
        each += [paths[q]["id"][x:y] if q >= 0 else np.array([x], np.int32) for q, x, y in heads[i, r]] + [path["id"][a:b]]
    sizes = np.array([sum(y - x if q >= 0 else 1 for q, x, y in heads[i, r]) + int(path["end"][i] - path["start"][i]) for i in rows.tolist()], np.int64)
    return np.concatenate(each) if each else np.zeros(0, np.int32), sizes


def _column(rows: list[list[tuple]]) -> pa.Array:
    flat = [x for row in rows for x in row]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    id_ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(id_ends), pa.array(np.concatenate([x[0] for x in flat]) if flat else np.zeros(0, np.int32), pa.int32()))
    rank = pa.array([j + 1 for r in rows for j in range(len(r))], pa.int32())
    columns = [pa.array([x[k] for x in flat], pa.bool_() if k == 4 else pa.float64()) for k in (1, 2, 3, 4)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([rank, ids, *columns], ["rank", "ids", "log_p", "perturbed", "inclusion", "decoded"]))


_STORES: dict[tuple[str, float, int | None], Store] = {}


def _store(model_file: str, temper: float, remembered: int | None = None) -> Store:
    """One store for each worker process, so that its lattices outlive a task."""
    if (model_file, temper, remembered) not in _STORES:
        _STORES[model_file, temper, remembered] = Store(Lattices(model_file, temper), remembered)
    return _STORES[model_file, temper, remembered]


def sampled(
    spark: SparkSession, docs: DataFrame, model_file: str, key: Column, samples: int = SAMPLES, seed: int = 0, temper: float = TEMPER, keep: Sequence[str] | None = None, remembered: int | None = None
) -> DataFrame:
    """docs (or only its columns ``keep``) with pieces: for each text up to ``samples`` segmentations (SCHEMA); decoded tells that the ids give the text again. No shuffle.

    remembered: parts whose lattices a worker keeps (Store.most if None); more take memory and spare time, samples are the same."""
    prepare(spark)
    kept = [f for f in docs.schema.fields if f.name != "pieces" and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    # a text that comes back as it is crosses to Python once
    at = names.index("text") if "text" in names and docs.schema["text"].dataType == StringType() else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(model_file, temper, remembered)
        for batch in batches:
            texts, keys, lo, size = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 400_000 or i == len(texts) - 1:  # samples take many times a text's room, so they leave in lots
                    found = sample(store, texts[lo : i + 1], keys[lo : i + 1], samples, seed)
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, i + 1 - lo) for c in batch.columns[: len(names)]), _column(found)], names=[*names, "pieces"])
                    lo, size = i + 1, 0

    text = [F.col("text").cast("string").alias(fresh("__text", names))] if at == len(kept) else []
    wide = docs.select(*(F.col(f"`{n}`") for n in names), *text, F.coalesce(key.cast("string"), F.lit("null")).alias(fresh("__key", names)))
    return wide.mapInArrow(run, StructType([*kept, StructField("pieces", _parse(SCHEMA))]))


def _parse(ddl: str) -> DataType:
    return DataType.fromDDL(ddl)
