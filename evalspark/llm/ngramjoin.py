"""N-gram Jaccard join with count-vector trees.

A document is the set of its distinct n-grams of ``words`` words (one, of all
words, if it has fewer).  N-grams are hashed into groups; the counts per group make a
point, and the sum of coordinate minima of two points bounds the overlap of
the sets from above - for a tree node, the minima with its largest
coordinates bound it for all points below.  Two documents link when their
Jaccard similarity reaches ``percent``.

Steps, none of which holds more than a bounded group in one task:

1. One pass over the texts gives size, digest, a coarse point and the prefix:
   similar sets share an n-gram among their first few in a common order
   (rare ones first, by a sample; any order is exact, a good one is fast).
   Documents with equal sets are one class from here on.
2. Prefix entries that occur in one class only are dropped; the others are
   dealt to trees, one per shared n-gram, very common ones split into pairs of
   parts.  Entries that size and position allow a partner get their points;
   points whose bound allows the similarity, too, are tied to the block of
   their candidates.  Points are fine enough to tell unlike sets apart: ties
   of unlike ones would join blocks to ever larger ones as documents grow.
3. The texts of each block, split likewise when it is large, are brought
   together once; a tree of fine points proposes pairs, the sets decide, and
   pairs that are already connected are not looked at again.
4. Components of the verified links name each document's component.

Defined results: a null text, or one without words, has no n-grams and links
with nothing; rows with a null id count their n-grams but link with nothing
and have a null component; rows that agree in text are linked; ids may
repeat; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from evalspark.llm import common
from evalspark.llm.components import components

WORDS = 3                    # words per n-gram, unless asked for others
PERCENT = 90
MIN_GROUPS, MAX_FINE = 128, 1024              # coordinates of a coarse point: one for two n-grams up to MAX_FINE,
GRAMS_PER_GROUP = 16         # from there on one for so many; unlike sets of one size share 86 % by the bound then, less in finer points
SAMPLE_EVERY = 8             # one text in so many counts n-grams for the order
MAX_COMMON = 500_000         # n-grams that the order knows as common: bounds what tasks receive
SHARD_ROWS = 2048            # points of one tree in step 2
BLOCK_DOCS, BLOCK_GRAMS = 2048, 4_000_000     # of one part of a block in step 3
LEAF = 32                    # points of a tree leaf
CHUNK_ROWS = 20_000
LONG_WORD = 64               # bytes; longer words are hashed one by one
SLICE_BYTES = 1 << 17        # of texts whose words are hashed together

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)      # masks of the first bytes of eight


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in the bytes of texts that begin at the offsets ``texts`` (the last one is the end),
    and where each text's words begin and end among them.  Words are read eight bytes at a time."""
    size = len(data)
    padded = np.zeros(size + 8, np.uint8)
    padded[:size] = _LOWER[data]
    eight = np.ndarray(size + 1, "<u8", padded.data, strides=(1,))     # the eight bytes from each place on
    word = ~_SPACE[data]
    new = np.ones(size + 1, bool)                                      # a word can begin here, or has ended
    new[1:size] = ~word[:-1]
    new[texts] = True
    begin = np.flatnonzero(word & new[:-1])
    new[:size] |= ~word
    length = np.flatnonzero(word & new[1:]) + 1 - begin
    hashes = _scrambled((eight[begin] & _FIRST[np.minimum(length, 8)]) + length.astype(np.uint64) * _C)
    left = np.flatnonzero((length > 8) & (length <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        left = left[length[left] > at]
        if not len(left):
            break
        hashes[left] = _scrambled(hashes[left] * _C ^ (eight[begin[left] + at] & _FIRST[np.minimum(length[left] - at, 8)]))
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        hashes[k] = xxh3_64_intdigest(padded[begin[k]:begin[k] + length[k]].tobytes())
    return hashes, np.searchsorted(begin, texts)


def _runs_of(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = (out ^ h[k:len(h) - width + 1 + k]) * _A
        out ^= out >> np.uint64(29)
    return _scrambled(out)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes


def gram_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams, A-Z lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, first = [], 0
    while first < len(texts):                                          # some texts at a time: arrays that stay in the cache
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1)
        hashes, at = _word_hashes(data[ends[first]:ends[last]], ends[first:last + 1] - ends[first])
        runs = _runs_of(hashes, n) if len(hashes) >= n else hashes
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out.append(_distinct(runs[a:b - n + 1] if b - a >= n else _runs_of(hashes[a:b], b - a) if b > a else hashes[:0]))
        first = last
    return out


def grams(text: str | None, n: int = WORDS) -> np.ndarray:
    """:func:`gram_sets` of one text."""
    return gram_sets(pa.array([text], pa.string()), n)[0]


def needed(n, m, percent: int = PERCENT):
    """Smallest overlap of sets of n and m that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """A set similar to one of n shares one of its first so many in any common order."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int = PERCENT):
    """As above, for partners at least as large."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def point(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def coarse_point(hashes: np.ndarray) -> bytes:
    """A point with one byte per coordinate; as many coordinates as that takes."""
    groups = MIN_GROUPS
    while groups * (2 if groups < MAX_FINE else GRAMS_PER_GROUP) < len(hashes):
        groups *= 2
    while (counts := point(hashes, groups)).max(initial=0) > 255:
        groups *= 2
    return counts.astype(np.uint8).tobytes()


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Two rows: hashes (ascending) and counts of n-grams that several sampled texts hold."""
    sampled = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_EVERY)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                sets = gram_sets(part.column(0), words)
                every, count = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(count)], ["gram", "n"])

    counts = sampled.mapInArrow(common.releasing(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "gram").limit(MAX_COMMON).collect()
    known = np.array([(r["gram"], r["n"]) for r in top], np.int64).reshape(-1, 2)
    hashes = known[:, 0].copy().view(np.uint64)
    order = np.argsort(hashes)
    return np.stack([hashes[order], known[order, 1].astype(np.uint64)])


class _Order:
    """The common order of n-grams: by count, then by hash; those that are not known as common come first."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.maybe = np.zeros(1 << 22, bool)              # tells most unknown ones without a search
        self.maybe[known[0] & np.uint64(len(self.maybe) - 1)] = True

    def prefix(self, hashes: np.ndarray, percent: int) -> np.ndarray:
        """Of a set's hashes, in ascending order, the first ones that a similar set must share one of."""
        if not len(hashes):
            return hashes
        length = prefix_length(len(hashes), percent)
        look = np.flatnonzero(self.maybe[hashes & np.uint64(len(self.maybe) - 1)])
        turn = np.zeros(len(hashes), np.uint64)
        if len(look):
            at = np.minimum(np.searchsorted(self.known[0], hashes[look]), self.known.shape[1] - 1)
            turn[look] = np.where(self.known[0][at] == hashes[look], self.known[1][at], np.uint64(0))
        unknown = hashes[turn == 0]
        return unknown[:length] if len(unknown) >= length else hashes[np.lexsort((hashes, turn))[:length]]


def _describe(known, percent: int, words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(known.value)
        for batch in batches:
            for part in common.slices(batch):
                sets = gram_sets(part.column(1), words)
                prefixes = [order.prefix(s, percent) for s in sets]
                ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([coarse_point(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(ends, np.concatenate(prefixes).view(np.int64))],
                    ["doc_id", "version", "n_grams", "digest", "point", "prefix"])

    return run


def _split(count, size: int):
    return F.greatest(F.ceil(count / size), F.lit(1)).cast("int")


def _dealt(df: DataFrame, key: str, parts: str, salt) -> DataFrame:
    """Rows of a large key go to every pair of parts that holds theirs, so each two rows of a key meet once or more."""
    own = F.pmod(F.xxhash64(salt), F.col(parts)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    return df.withColumn("pair", F.explode(pairs)).withColumn("i", F.col("pair.i")).withColumn("j", F.col("pair.j")).drop("pair", parts)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, of at least ``rows`` rows each but for the last."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[n - 1] for k in keys]
        tail = 0
        for size in (64, 1024, n):                        # where the last run begins
            piece = table.slice(max(0, n - size))
            same = np.ones(piece.num_rows, bool)
            for k, v in zip(keys, last, strict=True):
                same &= piece.column(k).to_numpy() == v.as_py()
            tail = int(same.sum())
            if tail < piece.num_rows:
                break
        if tail < n:
            yield table.slice(0, n - tail)
            held, n = table.slice(n - tail).to_batches(), tail
    if n:
        yield pa.Table.from_batches(held)


def _tied(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest index connected with each index by the pairs (a, b)."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


class _Points:
    """Coarse points of several widths; a wider one is folded to meet a narrower one."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(r) for r in raw])
        self.at = {}
        self.rows = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.rows[w] = np.frombuffer(b"".join(raw[k] for k in own), np.uint8).reshape(-1, w).astype(np.int16)
            self.at[w] = np.full(len(raw), -1)
            self.at[w][own] = np.arange(len(own))

    def _folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.int16)
        for w in np.unique(self.width[rows]).tolist():
            own = self.width[rows] == w
            out[own] = self.rows[w][self.at[w][rows[own]]].reshape(-1, w // width, width).sum(axis=1)
        return out

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of coordinate minima of the pairs."""
        out = np.zeros(len(a), np.int64)
        narrow = np.minimum(self.width[a], self.width[b])
        for w in np.unique(narrow).tolist():
            pairs = np.flatnonzero(narrow == w)
            step = max(1, 4_000_000 // w)
            for k in range(0, len(pairs), step):
                own = pairs[k:k + step]
                out[own] = np.minimum(self._folded(a[own], w), self._folded(b[own], w)).sum(axis=1)
        return out


def _fitting(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of each tree whose sizes and positions allow the similarity, and the overlap they need."""
    get = lambda c: table.column(c).to_numpy()
    n, at = get("n_grams"), get("at")
    run_of = np.zeros(len(n), np.int64)
    run_of[1:] = np.cumsum(np.any([np.diff(get(c)) != 0 for c in ("gram", "i", "j")], axis=0))
    here = np.arange(len(n))
    for step in range(1, len(n)):                         # rows of a run are in the order of size
        here = here[here + step < len(n)]
        here = here[(run_of[here] == run_of[here + step]) & (100 * n[here] >= percent * n[here + step])]
        if not len(here):
            return
        there = here + step
        need = needed(n[here], n[there], percent)
        fits = (at[here] < index_length(n[here], percent)) & (np.minimum(n[here] - at[here], n[there] - at[there]) >= need)
        yield here[fits], there[fits], need[fits]


def _partners(percent: int) -> Callable:
    """The rows of each tree that size and position allow a partner: few do, and only these need their points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["gram", "i", "j"], CHUNK_ROWS):
            stay = np.zeros(table.num_rows, bool)
            for a, b, _ in _fitting(table, percent):
                stay[a] = stay[b] = True
            yield from table.filter(pa.array(stay)).combine_chunks().to_batches()

    return run


def _candidates(percent: int) -> Callable:
    """Ties between the points of each tree whose size, position and bound allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["gram", "i", "j"], CHUNK_ROWS):
            cid = table.column("cid").to_numpy()
            points = _Points(table.column("point").to_pylist())
            found_a, found_b = [], []
            for a, b, need in _fitting(table, percent):
                fits = points.bound(a, b) >= need
                found_a.append(a[fits])
                found_b.append(b[fits])
            if found_a:
                root = _tied(np.concatenate(found_a), np.concatenate(found_b), len(cid))
                tied = np.flatnonzero(root != np.arange(len(cid)))
                pairs = np.unique(np.stack([cid[tied], cid[root[tied]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return run


def link_block(cid: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect the sets of a block, found through a tree of count vectors.

    Sets are put in the order of their smallest hashes, so that alike ones
    share leaves; a leaf keeps its largest coordinates.  Only verified links
    are returned, and none between sets that are connected already.
    """
    size = np.array([len(s) for s in sets])
    order = sorted(range(len(sets)), key=lambda k: (sets[k][:2].tolist(), size[k]))
    sets, size, cid = [sets[k] for k in order], size[order], cid[order]
    groups = 1 << int(np.clip(np.ceil(np.log2(max(size.max(), 1))), 5, 11))
    points = np.stack([point(s, groups) for s in sets]).astype(np.int32)
    starts = np.arange(0, len(sets), LEAF)
    tops = np.maximum.reduceat(points, starts, axis=0)
    low, high = np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts)
    root = np.arange(len(sets))
    links = []
    for k in range(1, len(sets)):
        leaves = np.flatnonzero((starts[:k // LEAF + 1] < k) & (100 * size[k] >= percent * low[:k // LEAF + 1])
                                & (100 * high[:k // LEAF + 1] >= percent * size[k]))
        bound = np.minimum(tops[leaves], points[k]).sum(axis=1)
        leaves = leaves[bound >= needed(np.maximum(low[leaves], percent * size[k] // 100), size[k], percent)]
        if not len(leaves):
            continue
        near = (starts[leaves][:, None] + np.arange(LEAF)).ravel()
        near = near[near < k]
        near = near[root[near] != root[k]]
        bound = np.minimum(points[near], points[k]).sum(axis=1)
        need = needed(size[near], size[k], percent)
        fits = bound >= need
        near, need, bound = near[fits], need[fits], bound[fits]
        for x in np.argsort(need - bound, kind="stable"):
            other = near[x]
            if root[other] == root[k]:
                continue
            both = len(sets[k]) + len(sets[other]) - len(np.union1d(sets[k], sets[other]))
            if both >= need[x]:
                links.append((int(cid[k]), int(cid[other])))
                root[root == root[k]] = root[other]
    return links


def _verify(percent: int, words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["block", "i", "j"], 1):
            keys = np.stack([table.column(c).to_numpy() for c in ("block", "i", "j")], axis=1)
            cuts = np.flatnonzero(np.any(np.diff(keys, axis=0) != 0, axis=1)) + 1
            links: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                part = table.slice(a, b - a)
                sets = [s for c in part.column("text").chunks for s in gram_sets(c, words)]
                own = [len(s) > 0 and xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
                cid = part.column("cid").to_numpy()[own]
                if len(cid) > 1:
                    links += link_block(cid, [s for s, o in zip(sets, own, strict=True) if o], percent)
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return run


def _links(docs: DataFrame, classes: DataFrame, percent: int, words: int) -> DataFrame:
    """Verified links ``u, v`` between classes that connect all that are linked."""
    entries = classes.select("cid", "n_grams", F.posexplode("prefix").alias("at", "gram"))
    shared = entries.groupBy("gram").agg(F.count("*").alias("points")).filter("points > 1")
    shared = shared.select("gram", _split(F.col("points"), SHARD_ROWS).alias("parts"))
    tree, columns = ["gram", "i", "j"], ["gram", "i", "j", "n_grams", "at", "cid"]
    dealt = _dealt(entries.join(shared, "gram"), "gram", "parts", F.col("cid")).select(*columns)
    trees = dealt.repartition(*tree).sortWithinPartitions(*tree, "n_grams", "cid")
    live = trees.mapInArrow(common.releasing(_partners(percent)), dealt.schema)
    points = live.join(classes.select("cid", "point"), "cid").select(*columns, "point")
    trees = points.repartition(*tree).sortWithinPartitions(*tree, "n_grams", "cid")
    ties = trees.mapInArrow(common.releasing(_candidates(percent)), "u long, v long")
    blocks = common.staged(components(ties), "blocks")
    members = blocks.join(classes.select("cid", "n_grams", "digest", "doc_id"), F.col("id") == F.col("cid"))
    sizes = blocks.join(classes.select("cid", "n_grams"), F.col("id") == F.col("cid")).groupBy("root").agg(
        F.count("*").alias("docs"), F.sum("n_grams").alias("grams"))
    sizes = sizes.select(F.col("root").alias("block"),
                         F.greatest(_split(F.col("docs"), BLOCK_DOCS), _split(F.col("grams"), BLOCK_GRAMS)).alias("parts"))
    members = members.join(sizes, F.col("root") == F.col("block")).select("block", "parts", "cid", "digest", "doc_id")
    members = common.broadcast_few(common.staged(members, "members"))
    texts = docs.select(F.col("doc_id").alias("text_id"), "text")        # joined on the id; other texts of it are told by digest
    placed = _dealt(members.join(texts, F.col("doc_id") == F.col("text_id")), "block", "parts", F.col("cid"))
    groups = placed.select("block", "i", "j", "cid", "digest", "text").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "cid")
    return groups.mapInArrow(common.releasing(_verify(percent, words)), "u long, v long")


def _rooted(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """``doc_id, version, n_grams, root`` per row; ``version`` is a hash of the text, ``root`` names the component."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_common(docs, words))           # at most MAX_COMMON pairs
    id_type = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    described = common.staged(slim.mapInArrow(
        common.releasing(_describe(known, percent, words)),
        f"doc_id {id_type}, version long, n_grams long, digest binary, point binary, prefix array<long>"), "grams")
    named = described.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = common.staged(named.dropDuplicates(["digest"]).withColumn("cid", F.monotonically_increasing_id()), "classes")
    linked = components(_links(slim, classes, percent, words))
    # Every class has a root: its own, unless it is linked.
    roots = classes.select("digest", "cid").join(linked, F.col("cid") == F.col("id"), "left").select(
        "digest", F.coalesce("root", "cid").alias("root"))
    rows = described.select("doc_id", "version", "n_grams", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return common.staged(rows.join(roots, "digest", "left").select("doc_id", "version", "n_grams", "root"), "rooted")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``."""
    placed = _rooted(docs, percent, words)
    least = placed.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", F.col("n_grams").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, but of each component only that of the smallest id (and text hash)."""
    placed = _rooted(docs, percent, words).filter(F.col("root").isNotNull())
    version = common.fresh(docs, "version")
    winners = placed.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("w"))
    losers = placed.join(winners, "root").filter(F.struct("doc_id", "version") != F.col("w")).select(
        F.col("doc_id").alias("lost_id"), F.col("version").alias("lost_version")).distinct()
    losers = common.broadcast_few(common.staged(losers, "losers"))
    marked = docs.withColumn(version, F.xxhash64("text"))
    left = marked.join(losers, (marked["doc_id"] == losers["lost_id"]) & (marked[version] == losers["lost_version"]), "left_anti")
    twice = placed.groupBy("doc_id", "version").count().filter("count > 1").select(
        F.col("doc_id").alias("lost_id"), F.col("version").alias("lost_version"))
    if not twice.isEmpty():                                       # rows that repeat id and text: one of them stays
        same = (left["doc_id"] == twice["lost_id"]) & (left[version] == twice["lost_version"])
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", version]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
