"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

The pieces of a public SentencePiece model (its path is a parameter) span a
lattice over a text; a piece of rank r weighs ``(r + RANK_SHIFT) ** -alpha``,
characters without a piece fall back to their bytes.  Segmentations are drawn
without replacement by Gumbel top-k: every segmentation has its log
probability plus Gumbel noise as its key, and the k largest keys win.  They
are found by A* search: a node is a set of segmentations that share a
beginning, its priority the largest key inside, drawn top-down and truncated
by the key of the node it was cut from; the best node is opened by drawing its
best segmentation unit by unit and cutting the rest of it at each unit.

No piece crosses the beginning of a run of spaces or a line end, so the
lattice is a row of units: the node probabilities multiply, and a unit's own
lattice is built once per slice of texts, for the draws only.  The few units
that the search opens, and units of more than ``UNIT_CHARS`` characters, have
a lattice of their own that keeps one number per character.  The noise is a
hash of the row key and the place of the draw, so that any rerun gives the
same segmentations.

Besides its log probability each sample has an inclusion score: the log of
the probability that its key exceeds the (k+1)-th, the weight of an unbiased
estimate.

Defined results: a null or empty text has one sample without pieces; a text
with fewer than k segmentations gives all of them, with inclusion 1 (what is
left of a node is summed from the ways left, in logs, so that no segmentation
is too improbable); rows that agree in key and text are sampled alike; decoding
any sample gives the text back, the space sign U+2581 included, which is
written as bytes; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from evalspark.llm import common

SAMPLES = 2
ALPHA = 0.6
RANK_SHIFT = 10
UNIT_CHARS = 256             # of a unit whose lattice is built together with others
SLICE_CHARS = 80_000         # characters whose lattice is held at a time
SEED = "segment-1"
BEGINNING, MISS = -1, -2     # of a lookup: the beginning of a piece; of none

_SPACE = "▁"
_LITERAL = "\U0010fffe"      # stands for a space sign that the text itself holds
_UNITS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_HASH = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_BELOW_ONE = np.float32(1 - 2 ** -24)


def salt(n: int) -> np.uint64:
    return np.uint64(n * int(_HASH) & _MASK)


def uniform(seed: np.ndarray, place: int) -> np.ndarray:
    """Numbers in (0, 1) fixed by seed and place (splitmix64)."""
    z = np.atleast_1d(seed) + np.uint64((place + 1) * int(_GOLDEN) & _MASK)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def one_uniform(seed: int, place: int) -> float:
    """:func:`uniform` of one seed."""
    z = (seed + (place + 1) * int(_GOLDEN)) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    z ^= z >> 31
    return ((z >> 11) + 0.5) / float(1 << 53)


def gumbel(location: np.ndarray, u: np.ndarray) -> np.ndarray:
    return location - np.log(-np.log(u))


def truncated(g: np.ndarray, top: float | np.ndarray) -> np.ndarray:
    """Gumbel draws conditioned to stay below ``top``."""
    return -np.logaddexp(-top, -g)


def log1mexp(x: np.ndarray) -> np.ndarray:
    """``log(1 - exp(x))`` for x <= 0."""
    near = x > -0.693
    out = np.empty(len(x))
    with np.errstate(divide="ignore"):
        out[near] = np.log(-np.expm1(np.minimum(x[near], 0.0)))
    out[~near] = np.log1p(-np.exp(x[~near]))
    return out


def units(text: str) -> list[str]:
    return _UNITS.findall(" " + text) if text else []


def log_sum(x: list[float]) -> float:
    if len(x) == 1:
        return x[0]
    top = max(x, default=-math.inf)
    return top if top == -math.inf else top + math.log(math.fsum([math.exp(v - top) for v in x]))


class Lattices:
    """Lattices of distinct units: per position the log chance, id and cumulative chance of each piece length.

    Positions are numbered by the characters left to their unit's end, then
    by unit, longest first; so the positions one piece further on of all
    units are a slice, and the totals are summed slice by slice.
    """

    def __init__(self, model: Segmenter, types: list[str]):
        lengths = np.fromiter(map(len, types), np.int64, len(types))
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(types), np.int64)
        rank[order] = np.arange(len(types))
        longest = int(lengths.max())
        size = np.searchsorted(-lengths[order], -np.arange(longest + 1), side="right")      # units with so many characters
        size[0] = 0
        self.offset = np.cumsum(size) - size
        n = int(size.sum())
        self.room = np.repeat(np.arange(longest + 1), size)
        self.starts = self.offset[lengths] + rank
        text = "".join(types).replace(_SPACE, _LITERAL).replace(" ", _SPACE)
        room = np.repeat(lengths, lengths) - (np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        codes = np.empty(n, np.uint64)
        codes[self.offset[room] + np.repeat(rank, lengths)] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # Pieces that begin at each position, as long as some piece goes on; a position's next one is that of one character less.
        following = np.arange(n) - np.repeat(self.offset - np.concatenate([[0], self.offset[:-1]]), size)
        at, to, h, hits = np.arange(n), np.arange(n), np.zeros(n, np.uint64), []
        for _ in range(model.longest):
            h = (h ^ codes[to]) * _HASH
            h ^= h >> np.uint64(32)
            found = model.lookup(h)
            hit = np.flatnonzero(found >= 0)
            hits.append((at[hit], found[hit]))
            on = np.flatnonzero((found != MISS) & (to >= size[1]))            # the first size[1] positions are the last of their units
            at, to, h = at[on], following[to[on]], h[on]
            if not len(at):
                break
        while len(hits) > 1 and not len(hits[-1][0]):
            hits.pop()
        width = len(hits)
        # By piece length, then by position: the positions of one slice lie side by side.
        self.weight = np.full((width, n), -np.inf, np.float32)
        self.piece = np.zeros((width, n), np.int32)
        for k, (where, found) in enumerate(hits):
            self.piece[k][where] = found
            self.weight[k][where] = model.log_weight[found]
        bare = np.flatnonzero(self.weight[0] == -np.inf)
        if len(bare):
            code = np.where(codes[bare] == ord(_LITERAL), ord(_SPACE), codes[bare]).astype(np.int32)
            self.piece[0][bare] = [model.ascii[c] if c < 0x80 else -1 - c for c in code.tolist()]      # below 0: written out later
            self.weight[0][bare] = model.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        # Total weight of all ways from a position to its unit's end, from the ends backwards.
        total = np.zeros(n, np.float32)
        self.chance = np.ones((n, width), np.float32)                  # by position: a draw reads all of one
        for r in range(1, longest + 1):
            lo, m, fits = int(self.offset[r]), int(size[r]), min(r, width)
            ways = self.weight[:fits, lo:lo + m]
            for k in range(min(r - 1, width)):
                ways[k] += total[self.offset[r - k - 1]:self.offset[r - k - 1] + m]
            top = ways.max(axis=0)
            ways -= top
            chance = np.exp(ways)
            for k in range(1, fits):
                chance[k] += chance[k - 1]
            whole = chance[-1]
            total[lo:lo + m] = top + np.log(whole)
            ways -= np.log(whole)                                      # log chance of each piece, given its start
            self.chance[lo:lo + m, :fits] = (chance / whole).T         # exactly 1 from the last piece on

    def walk(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Draw a segmentation from each position to its unit's end: pieces per walk, first piece, pieces, log chance."""
        count, log_chance = np.zeros(len(at), np.int64), np.zeros(len(at))
        live, room, steps = np.arange(len(at)), self.room[at], []
        rank, piece, weight = at - self.offset[room], self.piece.ravel(), self.weight.ravel()
        while len(live):
            place = self.offset[room] + rank
            u = np.minimum(uniform(seed, len(steps)).astype(np.float32), _BELOW_ONE)
            k = (self.chance.take(place, axis=0) > u[:, None]).argmax(axis=1)
            way = k * len(self.chance) + place
            steps.append((live, piece.take(way)))
            log_chance[live] += weight.take(way)
            count[live] = len(steps)
            room = room - k - 1
            on = np.flatnonzero(room)
            live, seed, room, rank = live[on], seed[on], room[on], rank[on]
        first = np.cumsum(count) - count
        pieces = np.empty(int(count.sum()), np.int32)
        for s, (who, piece) in enumerate(steps):
            pieces[first[who] + s] = piece
        return count, first, pieces, log_chance


Way = tuple[int, int, float]     # place behind a piece, the piece, its log chance


class UnitLattice:
    """The lattice of one unit: a number per character, the log weight of all ways from it to the end."""

    def __init__(self, model: Segmenter, unit: str):
        self.model, self.text = model, unit.replace(_SPACE, _LITERAL).replace(" ", _SPACE)
        self.total = array("d", bytes(8 * (len(unit) + 1)))
        self.kept: dict[int, list[Way]] = {}                                 # by place, of short units
        for at in range(len(unit) - 1, -1, -1):
            self.total[at] = log_sum([w + self.total[to] for to, _, w in self._weights(at)])

    def _weights(self, at: int) -> list[Way]:
        if at in self.kept:
            return self.kept[at]
        text, names, out = self.text, self.model.names, []
        for to in range(at + 1, min(at + self.model.longest, len(text)) + 1):
            found = names.get(text[at:to])
            if found is None:
                break
            if found != BEGINNING:
                out.append((to, found, self.model.weights[found]))
        if not out or out[0][0] > at + 1:                                    # no piece of one character: its bytes
            code = ord(text[at] if text[at] != _LITERAL else _SPACE)
            piece = self.model.ascii[code] if code < 0x80 else -1 - code
            out.insert(0, (at + 1, piece, self.model.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
        if len(text) <= UNIT_CHARS:
            self.kept[at] = out
        return out

    def ways(self, at: int) -> list[Way]:
        """Every way on, its log chance given the place."""
        return [(to, p, w + self.total[to] - self.total[at]) for to, p, w in self._weights(at)]

    def _pick(self, options: list[tuple[Way, float]], u: float) -> Way:
        top = log_sum([w for _, w in options])
        for way, w in options:
            u -= math.exp(w - top)
            if u <= 0:
                return way
        return max(options, key=lambda o: o[1])[0]

    def walk(self, seed: int, at: int = 0, step: int = 0) -> tuple[list[int], float]:
        """A segmentation from ``at`` to the end: pieces, log chance."""
        pieces, log_chance = [], 0.0
        while at < len(self.text):
            at, piece, w = self._pick([(way, way[2]) for way in self.ways(at)], one_uniform(seed, step))
            pieces.append(piece)
            log_chance += w
            step += 1
        return pieces, log_chance

    def _tree(self, known: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[float]]:
        """The known segmentations as a tree, by node its children by piece (-1: the end), and the log chance
        that a segmentation from the node on is none of the known ones: the sum over what is not in the tree."""
        children, places = [{}], [0]
        for pieces in known:
            node = 0
            for p in pieces:
                if p not in children[node]:
                    to = next(to for to, q, _ in self._weights(places[node]) if q == p)
                    ends = to == len(self.text)
                    children[node][p] = -1 if ends else len(children)
                    if not ends:
                        children.append({})
                        places.append(to)
                node = children[node][p]
        left = [0.0] * len(children)
        for node in range(len(children) - 1, -1, -1):
            own = children[node]
            left[node] = log_sum([w + (left[own[p]] if p in own else 0.0) for _, p, w in self.ways(places[node]) if own.get(p, 0) != -1])
        return children, left

    def left(self, known: list[tuple[int, ...]]) -> float:
        """Log chance of all segmentations but the known ones."""
        return self._tree(known)[1][0]

    def other(self, known: list[tuple[int, ...]], seed: int) -> tuple[list[int], float] | None:
        """A segmentation that is none of ``known`` and its log chance; None if there is no other."""
        children, left = self._tree(known)
        if left[0] == -math.inf:
            return None
        pieces, log_chance, at, node, step = [], 0.0, 0, 0, 0
        while True:
            own = children[node]
            options = [(way, way[2] + (left[own[way[1]]] if way[1] in own else 0.0)) for way in self.ways(at) if own.get(way[1], 0) != -1]
            at, p, w = self._pick([o for o in options if o[1] > -math.inf], one_uniform(seed, 1_000 + step))
            pieces.append(p)
            log_chance += w
            if p not in own:                              # unlike all known ones by now: the rest is free
                rest, more = self.walk(seed, at, step)
                return pieces + rest, log_chance + more
            node, step = own[p], step + 1


class Segmenter:
    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.ascii = [self.bytes.get(c, -1 - c) for c in range(128)]       # what stands for a character without a piece
        self.fallbacks: dict[int, np.ndarray] = {}
        names = [sp.id_to_piece(i) for i in plain]
        if any("\n" in p for p in names) or any(_SPACE in p.lstrip(_SPACE) for p in names):
            raise ValueError("pieces of this model cross units")
        self.longest = max(map(len, names))
        rank = np.arange(len(plain)) + RANK_SHIFT
        weight = -alpha * np.log(rank)
        weight -= np.log(np.exp(weight).sum())
        self.log_weight = np.full(size, -np.inf, np.float32)
        self.log_weight[plain] = weight
        self.byte_weight = float(weight.min()) - 2.0
        known: dict[str, int] = {}
        for i, name in zip(plain, names, strict=True):
            known[name] = i
            for k in range(1, len(name)):
                known.setdefault(name[:k], BEGINNING)
        self.names, self.weights = known, self.log_weight.tolist()
        hashes = np.zeros(len(known), np.uint64)
        by_length: dict[int, list[int]] = {}
        for n, name in enumerate(known):
            by_length.setdefault(len(name), []).append(n)
        every = list(known)
        for length, rows in by_length.items():
            codes = np.frombuffer("".join(every[n] for n in rows).encode("utf-32-le"), np.uint32).reshape(-1, length)
            h = np.zeros(len(rows), np.uint64)
            for k in range(length):
                h = (h ^ codes[:, k].astype(np.uint64)) * _HASH
                h ^= h >> np.uint64(32)
            hashes[rows] = h
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        # Tables by the low bits of the hash; what collides goes to the next one, and its place is marked.
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        self.places = 1 << (2 * len(known)).bit_length()
        ids, shift = np.array(list(known.values()), np.int32), 0
        while len(ids):
            slot = ((hashes >> np.uint64(shift)) & np.uint64(self.places - 1)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table, check = np.full(self.places, MISS, np.int32), np.zeros(self.places, np.uint64)
            table[slot[first]], check[slot[first]] = ids[first], hashes[first]
            rest = np.setdiff1d(np.arange(len(ids)), first)
            shared = np.zeros(self.places, bool)
            shared[slot[rest]] = True
            self.tables.append((table, check, shared, shift))
            ids, hashes, shift = ids[rest], hashes[rest], shift + 11
        # Bytes of every piece, for decoding.
        raw = [b""] * size
        for i, name in zip(plain, names, strict=True):
            raw[i] = name.replace(_SPACE, " ").encode()
        for byte, i in self.bytes.items():
            raw[i] = bytes([byte])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(r) for r in raw], np.int32)
        self.raw_start = np.cumsum(self.raw_length, dtype=np.int32) - self.raw_length

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces, ``BEGINNING`` for the beginning of one, else ``MISS``."""
        out, who = None, None
        for table, check, shared, shift in self.tables:
            slot = ((h >> np.uint64(shift)) & np.uint64(self.places - 1)).view(np.int64)
            hit = check[slot] == h
            found = np.where(hit, table[slot], np.int32(MISS))
            if out is None:
                out = found
            else:
                out[who] = found
            rest = np.flatnonzero(shared[slot] & ~hit)
            if not len(rest):
                break
            h, who = h[rest], rest if who is None else who[rest]
        return out

    def written(self, pieces: np.ndarray) -> np.ndarray:
        """Piece ids with byte fallbacks written out."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces
        out, done = [], 0
        for k, sign in zip(odd.tolist(), pieces[odd].tolist(), strict=True):
            if sign not in self.fallbacks:
                self.fallbacks[sign] = np.array([self.bytes[b] for b in chr(-1 - sign).encode("utf-8", "surrogatepass")], np.int32)
            if done < k:
                out.append(pieces[done:k])
            out.append(self.fallbacks[sign])
            done = k + 1
        return np.concatenate([*out, pieces[done:]])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text's bytes: those of the pieces, without the space that encoding puts in front."""
        lengths = self.raw_length.take(ids)
        ends = np.cumsum(lengths)
        at = np.repeat(self.raw_start.take(ids) - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.raw.take(at).tobytes()[1:]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def segmenter(path: str, alpha: float = ALPHA) -> Segmenter:
    return Segmenter(path, alpha)


Sample = tuple[np.ndarray, float, float]
Walks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NO_WALKS = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0))


class _Draws:
    """Independent draws for all units of a slice of texts, and the numbers that the search needs of them.

    The lattices of a part of the units are dropped once its draws are made."""

    def __init__(self, model: Segmenter, words: list[str], seed: np.ndarray, samples: int):
        self.model, self.words, self.seed = model, words, seed
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.parts = [(a, b, self._drawn(a, b, samples)) for a, b in _parts(self.lengths)]
        self.log_chance = [np.concatenate([p[2][s][3] for p in self.parts]) for s in range(samples)]
        self.before = [np.cumsum(lc) - lc for lc in self.log_chance]
        self.rest = [gumbel(log1mexp(lc), uniform(seed ^ salt(s + 1), 7)) for s, lc in enumerate(self.log_chance)]

    def _drawn(self, a: int, b: int, samples: int) -> list[Walks]:
        """Per draw of the units a to b: pieces of each unit, first piece, pieces, log chance."""
        own, seed = self.words[a:b], self.seed[a:b]
        is_long = self.lengths[a:b] > UNIT_CHARS
        if not is_long.any():
            return self._together(own, seed, samples)
        short = np.flatnonzero(~is_long)
        drawn = self._together([own[i] for i in short], seed[short], samples) if len(short) else [_NO_WALKS] * samples
        alone = [(i, UnitLattice(self.model, own[i])) for i in np.flatnonzero(is_long).tolist()]
        out = []
        for s, (count, first, pieces, log_chance) in enumerate(drawn):
            walks = {i: x.walk((int(seed[i]) + int(salt(s))) & _MASK) for i, x in alone}
            counts, chances = np.zeros(len(own), np.int64), np.zeros(len(own))
            counts[short], chances[short] = count, log_chance
            for i, (p, w) in walks.items():
                counts[i], chances[i] = len(p), w
            firsts = np.cumsum(counts) - counts
            every = np.empty(int(counts.sum()), np.int32)
            every[np.repeat(firsts[short] - first, count) + np.arange(len(pieces))] = pieces
            for i, (p, _) in walks.items():
                every[firsts[i]:firsts[i] + len(p)] = p
            out.append((counts, firsts, every, chances))
        return out

    def _together(self, own: list[str], seed: np.ndarray, samples: int) -> list[Walks]:
        number = defaultdict(itertools.count().__next__)                  # of a unit not seen yet: the next one
        kind = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        lattices = Lattices(self.model, list(number))
        at = lattices.starts[kind]
        return [lattices.walk(at, seed + salt(s)) for s in range(samples)]

    def pieces(self, s: int, lo: int, hi: int) -> np.ndarray:
        """Pieces of the units lo to hi in draw ``s``."""
        out = []
        for a, b, draws in self.parts:
            p, q = max(lo, a) - a, min(hi, b) - a
            if p < q:
                count, first, pieces, _ = draws[s]
                out.append(pieces[first[p]:first[q - 1] + count[q - 1]])
        return out[0] if len(out) == 1 else np.concatenate([np.empty(0, np.int32), *out])


def sample_text(model: Segmenter, text: str | None, seed: int, samples: int = SAMPLES) -> list[Sample]:
    return sample_texts(model, [text], [seed], samples)[0]


def sample_texts(model: Segmenter, texts: list[str | None], seeds: list[int], samples: int = SAMPLES) -> list[list[Sample]]:
    """Per text up to ``samples`` distinct segmentations: ids, log probability, log inclusion score."""
    out: list[list[Sample]] = []
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS or k == len(texts) - 1:
            out += _sample_slice(model, [units(t or "") for t in texts[begin:k + 1]], seeds[begin:k + 1], samples)
            begin, size = k + 1, 0
    return out


def _sample_slice(model: Segmenter, words: list[list[str]], seeds: list[int], samples: int) -> list[list[Sample]]:
    counts = [len(w) for w in words]
    first = np.cumsum([0, *counts])
    if not first[-1]:
        return [[(np.empty(0, np.int32), 0.0, 0.0)] for _ in words]
    place = np.arange(first[-1], dtype=np.uint64) - np.repeat(first[:-1].astype(np.uint64), counts)
    unit_seed = np.repeat(np.array(seeds, np.uint64), counts) ^ ((place + np.uint64(1)) * _GOLDEN)
    draws = _Draws(model, [u for w in words for u in w], unit_seed, samples)
    keys = gumbel(np.zeros(len(seeds)), uniform(np.array(seeds, np.uint64), 3))
    shift = -draws.before[0][np.minimum(first[:-1], first[-1] - 1)]
    bound = truncated(draws.before[0] + np.repeat(shift, counts) + draws.rest[0], np.repeat(keys, counts))
    return [_search(model, draws, a, b, key, begin, bound[a:b], samples)
            for a, b, key, begin in zip(first.tolist(), first[1:].tolist(), keys.tolist(), shift.tolist(), strict=False)]


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the units into parts of bounded size: a lattice never holds more than that of a very long text."""
    part = np.cumsum(lengths) // (2 * SLICE_CHARS)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    yield from zip(cuts, cuts[1:], strict=False)


@dataclass
class _Found:
    """A segmentation: like ``parent`` before ``unit``, ``changed`` there, and as drawn after it."""

    key: float                       # its perturbed log probability
    log_prob: float
    shift: float                     # log chance before a unit, less that of the independent draw
    bound: np.ndarray                # largest key of each node cut from it, by unit
    parent: int | None = None
    unit: int = -1
    changed: tuple[int, ...] = ()
    known: dict[int, list[tuple[int, ...]]] = field(default_factory=dict)


def _search(model: Segmenter, draws: _Draws, a: int, b: int, key: float, shift: float, bound: np.ndarray,
            samples: int) -> list[Sample]:
    """A* over nodes 'begins like a known segmentation up to unit i, where it differs from all known ones'."""
    if a == b:
        return [(np.empty(0, np.int32), 0.0, 0.0)]
    found = [_Found(key, float(draws.log_chance[0][a:b].sum()), shift, bound)]

    def before(p: int, unit: int) -> float:
        x = found[p]
        return before(x.parent, unit) if x.parent is not None and unit <= x.unit else float(draws.before[p][a + unit]) + x.shift

    while True:
        tops = [x.bound.max() for x in found]
        p = int(np.argmax(tops))
        best = float(tops[p])
        if best == -np.inf or len(found) == samples:
            break
        x, s = found[p], len(found)
        unit = int(np.argmax(x.bound))
        lattice = UnitLattice(model, draws.words[a + unit])
        if unit not in x.known:
            x.known[unit] = [tuple(draws.pieces(p, a + unit, a + unit + 1).tolist())]
        known = x.known[unit]
        drawn = lattice.other(known, int(draws.seed[a + unit] ^ salt(s)))
        if drawn is None:
            x.bound[unit] = -np.inf
            continue
        pieces, log_chance = drawn
        known.append(tuple(pieces))
        start = before(p, unit)
        after = a + unit + 1
        shift = start + log_chance - (float(draws.before[s][after]) if after < b else 0.0)
        bound = np.full(b - a, -np.inf)
        if after < b:
            bound[unit + 1:] = truncated(draws.before[s][after:b] + shift + draws.rest[s][after:b], best)
        total = start + log_chance + float(draws.log_chance[s][after:b].sum())
        found.append(_Found(best, total, shift, bound, p, unit, tuple(pieces)))
        # What is left of the node: all that differs from every known way through the unit.
        rest = lattice.left(known)
        x.bound[unit] = -np.inf
        if rest > -math.inf:
            g = start + rest - math.log(-math.log(one_uniform(int(draws.seed[a + unit] ^ salt(s)), 9)))
            x.bound[unit] = best - (math.log1p(math.exp(best - g)) if best - g < 700 else best - g)

    def pieces_of(s: int, hi: int) -> list[np.ndarray]:
        """Pieces of the units before ``hi`` of a segmentation, last ones first."""
        x = found[s]
        if x.parent is None:
            return [draws.pieces(s, a, a + hi)]
        if hi <= x.unit:
            return pieces_of(x.parent, hi)
        return [draws.pieces(s, a + x.unit + 1, a + hi), np.array(x.changed, np.int32), *pieces_of(x.parent, x.unit)]

    out = []
    for s, x in enumerate(found):
        # log(1 - exp(-exp(gap))) for the gap to the first key that was not taken; that is the gap where it is very small.
        gap = min(x.log_prob - best, 700.0)
        inclusion = 0.0 if best == -np.inf else gap if gap < -30 else math.log(-math.expm1(-math.exp(gap)))
        out.append((model.written(np.concatenate(pieces_of(s, b - a)[::-1])), x.log_prob, inclusion))
    return out


_ROW = "doc_id {}, sample int, ids array<int>, log_prob double, log_inclusion double"


def row_seed(key, seed: str = SEED) -> int:
    return xxh3_64_intdigest(f"{seed}:{key}".encode())


def _slices(batch: pa.RecordBatch, rows: int = 100) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), part.column(1).to_pylist()


def encode(docs: DataFrame, model_path: str, samples: int = SAMPLES, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """``doc_id, sample, ids, log_prob, log_inclusion``: up to ``samples`` rows per row of ``docs``."""
    slim = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_freed()
        model = segmenter(model_path, alpha)
        for batch in batches:
            for keys, texts in _slices(batch):
                drawn = sample_texts(model, texts, [row_seed(k, seed) for k in keys.to_pylist()], samples)
                rows = [(k, s, x) for k, own in enumerate(drawn) for s, x in enumerate(own)]
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array([k for k, _, _ in rows], pa.int64())), pa.array([s for _, s, _ in rows], pa.int32()),
                    pa.array([x[0] for _, _, x in rows], pa.list_(pa.int32())),
                    pa.array([x[1] for _, _, x in rows]), pa.array([x[2] for _, _, x in rows])],
                    ["doc_id", "sample", "ids", "log_prob", "log_inclusion"])

    return slim.mapInArrow(common.releasing(run), _ROW.format(slim.schema["doc_id"].dataType.simpleString()))


def digests(docs: DataFrame, model_path: str, samples: int = SAMPLES, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """As :func:`encode`, with the number and unsigned crc32 of the ids (little-endian i32) in place of the ids,
    and whether they decode to the text."""
    slim = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold_freed()
        model = segmenter(model_path, alpha)
        for batch in batches:
            for keys, texts in _slices(batch):
                drawn = sample_texts(model, texts, [row_seed(k, seed) for k in keys.to_pylist()], samples)
                rows = [(k, s, len(i), p, g, zlib.crc32(i.astype("<i4").tobytes()), model.decode_bytes(i) == (texts[k] or "").encode())
                        for k, own in enumerate(drawn) for s, (i, p, g) in enumerate(own)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64()), pa.array(columns[5], pa.int64()),
                     pa.array(columns[6], pa.bool_())],
                    ["doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids_crc32", "decodes"])

    key = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(common.releasing(run), f"doc_id {key}, sample int, n_pieces long, log_prob double, log_inclusion double, "
                                "ids_crc32 long, decodes boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (with ``doc_id, sample, ids``) as ``doc_id, sample, text``."""
    slim = encoded.select("doc_id", "sample", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = segmenter(model_path)
        for batch in batches:
            texts = [model.decode(ids) if ids is not None else None for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "sample", "text"])

    return slim.mapInArrow(common.releasing(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, sample int, text string")
