"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by perturbed A-star search over the lattice.

A text's segmentations are the paths of a lattice whose edges are the vocabulary's pieces; a path has the product of its
pieces' probabilities, over the sum of all paths. The model file holds ranks, not probabilities, so a piece has the
Zipf-Mandelbrot probability of its rank. A character outside the vocabulary is one edge of byte pieces.

The agenda holds regions of paths: those that begin like a path already found and differ at one step. The largest
perturbed log-probability (log p plus a Gumbel variable for each path) in a region is drawn at once, as a Gumbel variable at the
region's log-mass, below the value of the region it was cut from. The best region is taken off, its best path completed by
forward sampling, and what remains of it cut up by steps; paths so come out in order of their perturbed values, without
replacement. The value after the last one kept gives inclusion probabilities.

No piece spans two characters that are not neighbours in some piece. Texts are cut there, and equal chunks of a batch share
their part of the lattice, so sums over all paths are products over chunks. All randomness is a hash of the row's key, the
path's number and the place in the text, so it depends on neither batches nor order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import map_arrow
from quire.llm.wordhash import mix, powers, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Texts are worked on so many rows and about so many bytes at a time.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
#: Regions whose log-mass is by so much below a value can't reach it: uniform numbers have 53 bits.
DEPTH = 38.0
#: Steps of a path whose regions are all worked out.
NEAR = 128
_U = np.uint64
_MARK = 0x2581
_PAIRS = 1 << 22
_SLOTS = 1 << 19


class Vocabulary:
    """The pieces of a model with their probabilities, ready for look-ups of many substrings at once."""

    def __init__(self, pieces: list[str], scores: list[float], special: list[bool]):
        self.byte_id = np.zeros(256, np.int32)
        rank = np.minimum(-np.array(scores), len(pieces))
        logp = -np.log(rank + 2.7)
        keep = []
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                self.byte_id[int(p[3:5], 16)] = i
            elif not special[i] and p:
                keep.append(i)
        logp -= np.log(np.exp(logp[keep]).sum())
        self.least = float(logp[keep].min())
        self.longest = max(len(pieces[i]) for i in keep)
        chars = sorted({ord(c) for i in keep for c in pieces[i]})
        self.known = np.zeros(0x110000, bool)
        self.known[chars] = True
        self.pair = np.zeros(_PAIRS, bool)
        prefixes: dict[str, int] = {}
        for i in keep:
            p = pieces[i]
            for n in range(1, len(p)):
                prefixes.setdefault(p[:n], -1)
            prefixes[p] = i
        joined = np.array([(ord(a), ord(b)) for a, b in {p[-2:] for p in prefixes if len(p) > 1}], np.int64).reshape(-1, 2)
        self.pair[self.pair_cell(joined[:, 0], joined[:, 1])] = True
        self.logp = logp
        # Open addressing; a slot has a prefix's hash and its piece, -1 for a prefix that is no piece.
        self.key, self.piece = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -2, np.int32)
        for n in range(1, self.longest + 1):
            some = [p for p in prefixes if len(p) == n]
            h = np.zeros(len(some), np.uint64)
            for j in range(n):
                h = self.extend(h, np.array([ord(p[j]) for p in some], np.int64))
            for x, at, p in zip(h, (h >> _U(45)).tolist(), some, strict=True):
                while self.piece[at] != -2:
                    at = (at + 1) % _SLOTS
                self.key[at], self.piece[at] = x, prefixes[p]

    @staticmethod
    def pair_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 40_503 + b) & (_PAIRS - 1)

    @staticmethod
    def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mix(h * _U(0xD1342543DE82EF95) + c.astype(np.uint64) + _U(1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1: only a prefix, -2: nothing."""
        at = (h >> _U(45)).astype(np.int64)
        out = np.full(len(h), -2, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            slot = at[todo]
            used = self.piece[slot] != -2
            hit = used & (self.key[slot] == h[todo])
            out[todo[hit]] = self.piece[slot[hit]]
            todo = todo[used & ~hit]
            at[todo] = (at[todo] + 1) % _SLOTS
        return out


def load(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], special)


class Lattice:
    """The edges of all different chunks, with the probability of each edge given that a path reaches where it begins."""

    def __init__(self, vocabulary: Vocabulary, chars: np.ndarray, ends: np.ndarray):
        """chars: the chunks one after another; ends: for each character where its chunk ends."""
        n = len(chars)
        at, size, piece = [], [], []
        alive = np.arange(n)
        h = np.zeros(n, np.uint64)
        for k in range(1, vocabulary.longest + 1):
            fits = alive + k <= ends[alive]
            alive, h = alive[fits], h[fits]
            if not len(alive):
                break
            h = vocabulary.extend(h, chars[alive + k - 1])
            got = vocabulary.find(h)
            whole = got >= 0
            at.append(alive[whole]), size.append(np.full(int(whole.sum()), k, np.int32)), piece.append(got[whole])
            on = got > -2
            alive, h = alive[on], h[on]
        # A character without a piece of its own is an edge of bytes (piece -1).
        single = np.zeros(n, bool)
        if at:
            single[at[0]] = True
        lone = np.flatnonzero(~single)
        at.append(lone), size.append(np.ones(len(lone), np.int32)), piece.append(np.full(len(lone), -1, np.int32))
        # Edges by place, shorter ones first; each round above has a place once, so no sort is needed.
        count = np.zeros(n, np.int32)
        for x in at:
            count[x] += 1
        self.ptr = np.concatenate([[0], np.cumsum(count)])
        total = int(self.ptr[-1])
        self.at = np.repeat(np.arange(n, dtype=np.int32), count)
        self.size, self.piece = np.empty(total, np.int32), np.empty(total, np.int32)
        free = self.ptr[:-1].copy()
        for x, length, p in zip(at, size, piece, strict=True):
            slot = free[x]
            self.size[slot], self.piece[slot] = length, p
            free[x] = slot + 1
        logp = vocabulary.logp[self.piece]
        other = np.flatnonzero(self.piece < 0)
        c = chars[self.at[other]]
        logp[other] = vocabulary.least * np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
        # Log-sums over all ways to the end of the chunk, from its end backwards, all chunks at once; n stands for an end.
        rest = np.zeros(n + 1)
        to = self.at + self.size
        to[to == ends[self.at]] = n
        left = ends - np.arange(n)
        left = left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left
        by_left, edges = np.argsort(left, kind="stable"), np.argsort(left[self.at], kind="stable")
        levels = np.arange(1, int(left.max(initial=0)) + 2)
        bounds = np.searchsorted(left[by_left], levels).tolist()
        begin = np.concatenate([[0], np.cumsum(count[by_left])])
        own, after = logp[edges], to[edges]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            e = slice(int(begin[a]), int(begin[b]))
            v = own[e] + rest[after[e]]
            starts = begin[a:b] - begin[a]
            top = np.maximum.reduceat(v, starts)
            rest[by_left[a:b]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count[by_left[a:b]])), starts))
        self.logc = logp + rest[to] - rest[self.at]
        self.choices = np.diff(self.ptr)
        p = np.exp(self.logc)
        self.cum = np.concatenate([[0.0], np.cumsum(p)])
        # The likeliest edge of each place, which most draws take.
        self.likely = np.zeros(n, np.int64)
        if n:
            most = np.flatnonzero(p == np.repeat(np.maximum.reduceat(p, self.ptr[:-1]), self.choices))[::-1]
            self.likely[self.at[most]] = most
        self.share = p[self.likely] if n else np.zeros(0)

    def draw(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place, by the uniform numbers u."""
        out = self.likely[at]
        rare = np.flatnonzero(u >= self.share[at])
        if len(rare):
            where, best = at[rare], out[rare]
            first, last = self.ptr[where], self.ptr[where + 1]
            # The likeliest edge's share is taken out of the interval.
            x = self.cum[first] + (u[rare] - self.share[where])
            x = np.where(x >= self.cum[best], x + self.share[where], x)
            e = np.minimum(np.maximum(np.searchsorted(self.cum, x, side="right") - 1, first), last - 1)
            out[rare] = e
        return out


def uniform(key: np.ndarray, stream: int, place: np.ndarray) -> np.ndarray:
    h = mix(key ^ mix(place.astype(np.uint64) + _U((stream * 0x9E3779B97F4A7C15) & (2**64 - 1))))
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _below(mass, bound: float, u):
    """A Gumbel variable at a log-mass, given that it is below a bound."""
    x = np.minimum(mass - bound, 700.0)
    return mass - np.log(np.exp(x) - np.log(u))


class Batch:
    """A batch's texts as one array of characters, cut into chunks."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str], keys: np.ndarray):
        self.vocabulary, self.keys = vocabulary, keys
        joined = "".join("▁" + t if t else "" for t in texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars[chars == 0x20] = _MARK
        self.chars = chars
        self.start = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])]).astype(np.int64)
        n = len(chars)
        if not n:
            return
        cut = np.ones(n, bool)
        cut[1:] = ~vocabulary.pair[vocabulary.pair_cell(chars[:-1], chars[1:])]
        cut[self.start[:-1][self.start[:-1] < n]] = True
        self.begin = np.flatnonzero(cut)
        end = np.append(self.begin[1:], n)
        # Equal chunks are found by hash, and share their characters' places in the lattice.
        power, inverse = powers(0x2545F4914F6CDD1D, n), powers(pow(0x2545F4914F6CDD1D, -1, 1 << 64), n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(chars.astype(np.uint64) + _U(7)) * power, dtype=np.uint64)])
        h = mix((total[end] - total[self.begin]) * inverse[self.begin] + (end - self.begin).astype(np.uint64))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        size = end[first] - self.begin[first]
        base = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.begin[first] - base[:-1], size) + np.arange(int(base[-1]))
        self.lattice = Lattice(vocabulary, chars[source], np.repeat(base[1:], size))
        self.home = base[:-1][which]  # where a chunk's characters are in the lattice
        self.end = end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.start))[self.begin]

    def place(self, at: int) -> int:
        """Where a character of the batch is in the lattice."""
        c = int(np.searchsorted(self.begin, at, side="right")) - 1
        return int(self.home[c]) + at - int(self.begin[c])

    def walk(self, path: np.ndarray, at: np.ndarray, place: np.ndarray, end: np.ndarray, doc: np.ndarray, stream: int) -> None:
        """Forward sampling from each place to the end of its chunk; path gets the edge at each step's first character."""
        lattice = self.lattice
        key, begin = self.keys[doc], self.start[doc]
        while len(at):
            e = lattice.ptr[place]
            free = np.flatnonzero(lattice.choices[place] > 1)
            if len(free):
                e = e.copy()
                e[free] = lattice.draw(place[free], uniform(key[free], stream, at[free] - begin[free]))
            path[at] = e
            step = lattice.size[e]
            at, place = at + step, place + step
            on = at < end
            at, place, end, key, begin = at[on], place[on], end[on], key[on], begin[on]

    def sample(self, k: int):
        """For each text its paths: (edges, log-probability, perturbed value, inclusion probability), best first."""
        out: list[list] = [[] for _ in range(len(self.keys))]
        for docs, path, logp, value, score in self.rounds(k):
            for d, lp, g, q in zip(docs.tolist(), logp.tolist(), value.tolist(), score.tolist(), strict=True):
                out[d].append([path[int(self.start[d]) : int(self.start[d + 1])], lp, g, q])
        return out

    def rounds(self, k: int) -> list[tuple[np.ndarray, ...]]:
        """Each text's first path, second path and so on: (texts that have one, edges of all texts, log-probabilities, perturbed values, inclusion probabilities)."""
        n = len(self.chars)
        if not n:
            return []
        lattice, total = self.lattice, len(self.keys)
        agenda: list[list] = [[] for _ in range(total)]
        path = np.full(n, -1, np.int32)
        self.walk(path, self.begin, self.home, self.end, self.doc, 0)
        live = np.flatnonzero(np.diff(self.start) > 0)
        value = -np.log(-np.log(uniform(self.keys[live], 1 << 20, np.zeros(len(live), np.int64))))
        own, before = self.start[live], np.zeros(len(live))  # where a path's own steps begin, and its log-probability up to there
        found: list[tuple] = []
        for r in range(k):
            found.append((live, path, self._regions(agenda, path, live, own, before, value, r, k), value))
            if r + 1 == k:
                break
            # The best region of each text is taken off; what remains of it goes back.
            taken = [(d, heapq.heappop(agenda[d])) for d in live.tolist() if agenda[d]]
            if not taken:
                break
            live = np.array([d for d, _ in taken])
            begin, at = self.start[live], np.array([t[2] for _, t in taken])
            pick, rest = (uniform(self.keys[live], x + r, at - begin).tolist() for x in (1 << 22, 1 << 23))
            path, edge, before = np.full(n, -1, np.int32), [], []
            for (d, (g, _, s, p, gone, run)), a, u, v in zip(taken, begin.tolist(), pick, rest, strict=True):
                where = int(lattice.at[gone[0]])
                first = int(lattice.ptr[where])
                edges = [(first + i, x) for i, x in enumerate(lattice.logc[first : int(lattice.ptr[where + 1])].tolist()) if first + i not in gone]
                weight = [math.exp(x) for _, x in edges]
                i, left = 0, u * sum(weight)
                while i + 1 < len(edges) and left >= weight[i]:
                    left -= weight[i]
                    i += 1
                e, x = edges[i]
                if len(edges) > 1:
                    mass = run + math.log(sum(weight[:i]) + sum(weight[i + 1 :]))
                    heapq.heappush(agenda[d], (-float(_below(mass, -g, v)), r, s, p, (*gone, e), run))
                path[a:s] = found[p][1][a:s]
                path[s] = e
                edge.append(e), before.append(run + x)
            value, before = np.array([-t[0] for _, t in taken]), np.array(before)
            own = at + lattice.size[np.array(edge)]
            self._finish(path, live, own, r + 1)
        out = []
        bars = np.array([-h[0][0] if h else -math.inf for h in agenda])
        for docs, edges, logp, g in found:
            bar = bars[docs]
            with np.errstate(over="ignore"):
                score = np.where(np.isneginf(bar), 1.0, -np.expm1(-np.exp(np.minimum(700.0, logp - np.where(np.isneginf(bar), 0.0, bar)))))
            out.append((docs, edges, logp, g, score))
        return out

    def _regions(self, agenda: list[list], path: np.ndarray, docs: np.ndarray, own: np.ndarray, before: np.ndarray, value: np.ndarray, r: int, k: int) -> np.ndarray:
        """Puts the regions cut off along each text's path on its agenda and returns the paths' log-probabilities.

        A region at log-mass m has a value of at most m - log(1 - u). So beyond the first NEAR steps only those are worked
        out whose u is so near 1 that they could still be among the best; what lies deeper than DEPTH can't, as u has 53 bits.
        """
        lattice = self.lattice
        steps = np.flatnonzero(path >= 0)
        logc = lattice.logc[path[steps]]
        lo, hi = np.searchsorted(steps, own), np.searchsorted(steps, self.start[docs + 1])
        logp = before.copy()
        some = np.flatnonzero(hi > lo)
        if not len(some):
            return logp
        logp[some] += np.add.reduceat(np.append(logc, 0.0), np.stack([lo[some], hi[some]], 1).ravel())[::2]
        most = k - r + 1  # of one path's regions no more can be taken off than paths are wanted, and one gives the bar

        def push(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
            """Regions of the first steps of some texts; the value that a further one must beat and the prefix's log-probability there."""
            column = lo[t, None] + np.arange(width)
            inside = column < hi[t, None]
            column = np.where(inside, column, lo[t, None])
            c = np.where(inside, logc[column], 0.0)
            upto = before[t, None] + np.cumsum(c, axis=1)
            edges = path[steps[column]]
            row, col = np.nonzero(inside & (lattice.choices[lattice.at[edges]] > 1))
            run, c = (upto - c)[row, col], c[row, col]
            where, d = steps[column[row, col]], docs[t[row]]
            mass = run + np.log(np.maximum(-np.expm1(np.minimum(c, 0.0)), 1e-18))
            g = _below(mass, value[t[row]], uniform(self.keys[d], (1 << 21) + r, where - self.start[d]))
            order = np.lexsort((col, -g, row))
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            order = order[nth < most]
            for i, x in zip(order.tolist(), d[order].tolist(), strict=True):
                heapq.heappush(agenda[x], (-float(g[i]), r, int(where[i]), r, (int(edges[row[i], col[i]]),), float(run[i])))
            least = np.full(len(t), -np.inf)
            last = order[nth[nth < most] == most - 1]
            least[row[last]] = g[last]
            return least, upto[:, -1]

        least, end = push(some, NEAR)
        far = np.flatnonzero((hi - lo)[some] > NEAR)
        if len(far):
            t, least, end = some[far], least[far], end[far]
            count = hi[t] - lo[t] - NEAR
            edge = np.concatenate([[0], np.cumsum(count)])
            one = np.repeat(np.arange(len(t)), count)
            column = np.repeat(lo[t] + NEAR - edge[:-1], count) + np.arange(int(edge[-1]))
            upto = np.cumsum(logc[column])
            run = upto - logc[column] - np.repeat(np.concatenate([[0.0], upto[edge[1:-1] - 1]]) - end, count)
            near = np.flatnonzero(run >= np.where(np.isneginf(least), -np.inf, least - DEPTH)[one])
            one, column, run = one[near], column[near], run[near]
            d = docs[t[one]]
            u = uniform(self.keys[d], (1 << 21) + r, steps[column] - self.start[d])
            hit = np.unique(one[np.log1p(-u) < run - least[one] + 1e-6])
            if len(hit):  # rare: such a text's regions are worked out over all its steps
                for x in docs[t[hit]].tolist():
                    agenda[x] = [a for a in agenda[x] if a[1] != r]
                    heapq.heapify(agenda[x])
                for i in hit.tolist():
                    push(t[i : i + 1], int(hi[t[i]] - lo[t[i]]))
        return logp

    def _finish(self, path: np.ndarray, docs: np.ndarray, after: np.ndarray, stream: int) -> None:
        """Completes each text from a character on."""
        last = self.start[docs + 1]
        docs, after, last = docs[after < last], after[after < last], last[after < last]
        if not len(docs):
            return
        c, stop = np.searchsorted(self.begin, after, side="right") - 1, np.searchsorted(self.begin, last)
        edge = np.concatenate([[0], np.cumsum(stop - c)])
        chunk = np.repeat(c - edge[:-1], stop - c) + np.arange(int(edge[-1]))
        at, place = self.begin[chunk], self.home[chunk]
        place[edge[:-1]] += after - at[edge[:-1]]
        at[edge[:-1]] = after
        self.walk(path, at, place, self.end[chunk], np.repeat(docs, stop - c), stream)

    def pieces(self, path: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of the texts' paths one after another, and where each text's begin; characters without a piece become those of their bytes."""
        at = np.flatnonzero(path >= 0)
        got = self.lattice.piece[path[at]]
        size = np.ones(len(at), np.int64)
        lone = np.flatnonzero(got < 0)
        c = self.chars[at[lone]]
        size[lone] = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where((c < 0x10000) & ((c < 0xD800) | (c > 0xDFFF)), 3, np.where(c < 0x10000, 1, 4))))
        begin = np.concatenate([[0], np.cumsum(size)])
        if len(lone):
            raw = np.frombuffer("".join(map(chr, c.tolist())).encode("utf-8", "replace"), np.uint8)
            out = np.repeat(got, size)
            out[out < 0] = self.vocabulary.byte_id[raw]
            got = out
        return got, begin[np.searchsorted(at, np.append(self.start[docs], self.start[-1]))]


def _encoder(shared, k: int, number_copies: bool):
    names = ["id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids"]

    def encoded(ids: pa.Array, texts: list[str], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        made = Batch(shared.value, texts, keys)
        for r, (docs, path, logp, value, score) in enumerate(made.rounds(k)):
            found, at = made.pieces(path, docs)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs)), pa.array(np.full(len(docs), r + 1, np.int32)), pa.array(np.diff(at)), pa.array(logp), pa.array(value), pa.array(score), lists], names=names)
        none = np.flatnonzero([not t for t in texts])
        if len(none):
            zero, one = pa.array(np.zeros(len(none))), pa.array(np.ones(len(none)))
            lists = pa.ListArray.from_arrays(pa.array(np.zeros(len(none) + 1, np.int32)), pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(none)), pa.array(np.ones(len(none), np.int32)), pa.array(np.zeros(len(none), np.int64)), zero, zero, one, lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, copy = None, 0
        for whole in batches:
            for batch in slices(whole, 2, BATCH_ROWS, BATCH_BYTES):
                keys = mix(np.asarray(batch.column(1)).astype(np.int64).view(np.uint64))
                texts = [t or "" for t in batch.column(2).to_pylist()]
                if number_copies:
                    copies = []
                    for key, t in zip(keys.tolist(), texts, strict=True):
                        copy = copy + 1 if last == (key, t) else 0
                        last = (key, t)
                        copies.append(copy)
                    copies = np.array(copies, np.uint64)
                    keys = np.where(copies > 0, mix(keys ^ mix(copies)), keys)
                yield from encoded(batch.column(0), texts, keys)

    return run


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", number_copies: bool = False) -> DataFrame:
    """(id_col, sample, n_pieces, log_prob, perturbed, inclusion, ids): up to k different segmentations of every row's text.

    sample counts from 1 in order of the perturbed value. A text with fewer segmentations gives all it has. A null or empty text
    has one, without pieces. inclusion is the probability that a segmentation is among those found, given the next perturbed
    value; 1 if there is no next. As in the library, a space stands before the text and a literal U+2581 counts as one. Rows that share id
    and text get the same segmentations; with number_copies those that follow one another, as copies that explode() made do, get each
    its own (a copy's place in that run is part of the key). A null id is a key like another. Other columns are ignored. No shuffle.

    Texts are worked on BATCH_BYTES at a time; a longer one is taken alone, and takes about 150 bytes of memory a character.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(model))  # the vocabulary's size, whatever the input
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>"
    return map_arrow(rows, _encoder(shared, k, number_copies), schema).withColumnRenamed("id", id_col)


def _decoder(path: str, content: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        for batch in batches:
            texts = [None if x is None else sp.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return run


def decode_pieces(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """All columns but ids_col, and the text that its piece numbers stand for; null stays null, no pieces are an empty text."""
    with open(model, "rb") as f:
        content = f.read()
    kept = [c for c in encoded.columns if c not in (ids_col, out_col)]
    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    rows = encoded.select(*kept, ids_col)
    return map_arrow(rows, _decoder(model, content), f"{fields + ', ' if fields else ''}text string").withColumnRenamed("text", out_col)
