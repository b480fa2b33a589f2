"""Phrase collocations by dynamic itemset counting.

Texts are dealt to ``shards`` shards, and one shard is scanned per step, in a
cycle.  Words are counted in the first cycle.  A phrase of k words becomes
active as soon as both its subphrases of k - 1 words (without its last and
without its first word) have reached the threshold; from the next step on it
is counted, beside shorter and longer ones, until it has seen every shard
once.  So lengths interleave: four-word phrases are counted while late words
still open pairs, and the scan ends when nothing is active any more.

What is active is told to the tasks by bit filters over phrase hashes, one for
the phrases that reached the threshold one step ago, two steps ago, up to one
cycle, and one for all earlier ones.  A phrase is counted if both subphrases
are in some filter, and the younger one says when its cycle began.  When that
cycle is over, the phrase has its full count and leaves the open counts, to
the result or, below the threshold, for good.  A false positive of a filter
costs time only: counts are kept per shard, so a shard that was counted early
or twice has the same count; it can make a cycle seem to begin later, never
earlier; and a phrase that comes again after its cycle ends with a count that
is no larger, of which the largest is kept.  There are no false negatives, and
no phrase is more frequent than its parts, so every phrase at or above the
threshold has its full count in the end.  Phrases are counted by their hash of
64 bits; those of one hash are counted as one, which is no less than each.  At
the end one more scan of all shards writes out the phrases whose hash reached
the threshold, counts them by their words and drops what is below it, so that
the result is exact.  The bits of a filter are a power of
two of at least ``BITS_PER_PHRASE`` times the phrases of a length and
``MAX_FILTER_BITS`` at most: what is collected and broadcast has that bound,
whatever the data.

At scale: a shard's texts are cut into words with array operations, and equal
phrases are summed within a slice of texts, within the task, and after one
shuffle by hash, together with the open counts; a frequent phrase costs one
row a task.  Open counts are written to one of two folders in turn.

Defined results: a null text is empty, a null language is ``und``; words of
one piece (between ``.,;:!?`` and line ends) form phrases, over any white
space; very long texts are cut at a word and go on with the words before it;
repeated rows all count; only ``lang`` and ``text`` are read (and ``doc_id``,
which deals the shards); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm import common
from evalspark.session import scratch_path

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2_000
SHARDS = 2
INSIDE_PERCENT = 80            # of a phrase's count that a longer one must have to drop it
SCORE_SCALE = 2_000_000

SLICE_BYTES = 4_000_000        # of texts that are cut into words at a time
BITS_PER_PHRASE = 16
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 18, 1 << 27
OLD = 0                        # stands for every age of more than a cycle

_WORD, _GAP, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _GAP
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_CLASS_OF = _CLASS.tobytes()    # as tables of ``bytes.translate``
_LOWER = bytes(range(256)).lower()
_BYTE_HASH = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BUCKET_BITS = 32_768          # of one bitmap of ``bitmap_construct_agg``

Filters = dict[tuple[int, int], bytes]       # by age in steps (0: older than a cycle) and number of words


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: pa.StringArray) -> np.ndarray:
    """A hash per word, from its bytes alone."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    if not len(words):
        return np.empty(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    length = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], length)
    power = np.multiply.accumulate(np.full(int(length.max()), _BASE | np.uint64(1), np.uint64))
    out = np.zeros(len(words), np.uint64)
    some = length > 0
    out[some] = np.add.reduceat(_BYTE_HASH[data] * power[place], (offsets[:-1] - offsets[0])[some])
    return _mix(out + length.astype(np.uint64))


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its beginning and its last word."""
    return _mix(h * _BASE + word)


def _in(bits: bytes, h: np.ndarray) -> np.ndarray:
    table, mask = np.frombuffer(bits, np.uint8), np.uint64(8 * len(bits) - 1)
    out = np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


UNKNOWN = 100                  # rank of what is in no filter; old ones rank 99, the younger the less


def _ranks(filters: Filters, k: int, h: np.ndarray) -> np.ndarray:
    """The least age at which phrases of k words are in a filter, ``UNKNOWN`` if in none; ``OLD`` counts as 99."""
    out = np.full(len(h), UNKNOWN, np.uint8)
    for age in sorted((a for a, n in filters if n == k), key=lambda a: a or UNKNOWN - 1):
        open_ = np.flatnonzero(out == UNKNOWN)
        out[open_[_in(filters[age, k], h[open_])]] = age or UNKNOWN - 1
    return out


def _numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, the number of each row's code among them, and where each occurs first (by a hash table, no sort)."""
    coded = pa.array(code, pa.int64()).dictionary_encode()
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[own[::-1]] = np.arange(len(own) - 1, -1, -1)
    return coded.dictionary.to_numpy(zero_copy_only=False), own, first


class _Words:
    """The words of a slice of texts: their types (language and word), and which of them begin a new piece."""

    def __init__(self, data: np.ndarray, row_starts: np.ndarray, langs: np.ndarray):
        raw = data.tobytes().translate(_LOWER)
        data = np.frombuffer(raw, np.uint8)
        kind = np.frombuffer(raw.translate(_CLASS_OF), np.uint8)
        is_word = kind == _WORD
        # A word begins behind a separator and at the first byte of a text; it ends where the next byte is of neither kind.
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        rows = row_starts[row_starts < len(data)]
        begins[rows] = is_word[rows]
        closes = is_word.copy()
        closes[:-1] &= ~is_word[1:] | begins[1:]
        self.at = np.flatnonzero(begins)                    # first byte of each word
        self.n = len(self.at)
        offsets = np.zeros(self.n + 1, np.int32)
        np.cumsum(np.flatnonzero(closes) + 1 - self.at, out=offsets[1:])
        flat = pa.StringArray.from_buffers(self.n, pa.py_buffer(offsets), pa.py_buffer(data[is_word])).dictionary_encode()
        row = np.searchsorted(row_starts, self.at, side="right") - 1
        # Words before which a piece ends: a break byte or a new text lies between.
        breaks = np.searchsorted(np.flatnonzero(kind == _BREAK), self.at)
        self.opens = np.ones(self.n, bool)
        self.opens[1:] = (np.diff(breaks) > 0) | (np.diff(row) > 0)
        code = langs[row].astype(np.int64) * max(1, len(flat.dictionary)) + flat.indices.to_numpy(zero_copy_only=False)
        kinds, self.type, _ = _numbered(code)
        word = kinds % max(1, len(flat.dictionary))
        self.lang = kinds // max(1, len(flat.dictionary))   # by type
        self.word = flat.dictionary.take(pa.array(word))
        self.hash = _word_hashes(flat.dictionary)[word]

    def spelled(self, where: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that begin at the given words."""
        return pc.binary_join_element_wise(*[self.word.take(pa.array(self.type[where + i])) for i in range(k)], " ")


def _starts(w: _Words, rank: np.ndarray, k: int) -> np.ndarray:
    """Where a phrase of k words begins within one piece and both its subphrases, by place, are known."""
    both = (rank[:-1] < UNKNOWN) & (rank[1:] < UNKNOWN) & ~w.opens[1:]
    both[max(0, w.n - k + 1):] = False
    for i in range(2, k):
        both[:max(0, w.n - i)] &= ~w.opens[i:]
    return np.flatnonzero(both)


Rows = tuple[int, np.ndarray, pa.Array | None, np.ndarray, np.ndarray, np.ndarray]     # words, language, phrase, hash, age, count


def count_slice(data: np.ndarray, row_starts: np.ndarray, langs: np.ndarray, lang_hash: np.ndarray, skip: int, words_too: bool,
                filters: Filters, max_words: int, spelled: bool = True) -> Iterator[Rows]:
    """Counts of the words and of the active phrases of a slice, and how many steps ago the younger subphrase of each
    reached the threshold; phrases that end within the first ``skip`` words were counted before.  Phrases of one hash
    are one here; unless ``spelled``, they are not written out."""
    w = _Words(data, row_starts, langs)
    if not w.n:
        return
    type_hash = _joined(lang_hash[w.lang], w.hash)
    if words_too:
        n = np.bincount(w.type[skip:], minlength=len(w.word))
        some = np.flatnonzero(n)
        yield 1, w.lang[some], w.word.take(pa.array(some)) if spelled else None, type_hash[some], np.zeros(len(some), np.int32), n[some]
    token = type_hash[w.type]
    h = token                                                # by place: hash of the phrase of k - 1 words that begins there
    rank = _ranks(filters, 1, type_hash)[w.type]             # and its age
    for k in range(2, max_words + 1):
        start = _starts(w, rank, k)
        if not len(start):
            return
        own_hash = _joined(h[start], token[start + k - 1])
        # The younger of both subphrases tells the cycle; a phrase of two old ones has been counted.
        age = np.minimum(rank[start], rank[start + 1])
        young = np.flatnonzero(age < UNKNOWN - 1)
        if len(young):
            kinds, own, first = _numbered(own_hash[young].view(np.int64))
            n = np.bincount(own[start[young] + k - 1 >= skip], minlength=len(kinds))
            some = np.flatnonzero(n)
            where = young[first[some]]
            yield (k, w.lang[w.type[start[where]]], w.spelled(start[where], k) if spelled else None, kinds[some].view(np.uint64),
                   age[where].astype(np.int32), n[some])
        if k == max_words or not any(length == k for _, length in filters):
            return
        rank, h = np.full(w.n, UNKNOWN, np.uint8), np.zeros(w.n, np.uint64)
        rank[start], h[start] = _ranks(filters, k, own_hash), own_hash


def spell_slice(data: np.ndarray, row_starts: np.ndarray, langs: np.ndarray, lang_hash: np.ndarray, skip: int,
                filters: Filters, max_words: int) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Words, language, phrase and exact count of the phrases of a slice that are in the filters; as phrases of no
    word, the word occurrences of each language."""
    w = _Words(data, row_starts, langs)
    if not w.n:
        return
    n = np.bincount(w.type[skip:], minlength=len(w.word))
    by_lang = np.bincount(w.lang, weights=n).astype(np.int64)
    some = np.flatnonzero(by_lang)
    yield 0, some, pa.array([""] * len(some), pa.string()), by_lang[some]
    type_hash = _joined(lang_hash[w.lang], w.hash)
    rank = _ranks(filters, 1, type_hash)
    some = np.flatnonzero((n > 0) & (rank < UNKNOWN))
    yield 1, w.lang[some], w.word.take(pa.array(some)), n[some]
    token, rank = type_hash[w.type], rank[w.type]
    h, ids = token, w.type                                   # by place: hash and id of the phrase of k - 1 words that begins there
    for k in range(2, max_words + 1):
        start = _starts(w, rank, k)
        own_hash = _joined(h[start], token[start + k - 1])
        known = np.flatnonzero(_ranks(filters, k, own_hash) < UNKNOWN)
        if not len(known):
            return
        start, own_hash = start[known], own_hash[known]
        kinds, own, first = _numbered(ids[start] * len(w.word) + w.type[start + k - 1])
        n = np.bincount(own[start + k - 1 >= skip], minlength=len(kinds))
        some = np.flatnonzero(n)
        where = start[first[some]]
        yield k, w.lang[w.type[where]], w.spelled(where, k), n[some]
        rank, ids, h = np.full(w.n, UNKNOWN, np.uint8), np.zeros(w.n, np.int64), np.zeros(w.n, np.uint64)
        rank[start], ids[start], h[start] = OLD, own, own_hash


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """A long text in parts: first byte, end, and how many of the part's first words stood in the part before."""
    a, skip, size, again = 0, 0, SLICE_BYTES, MAX_WORDS - 1
    while a + size < len(data):
        is_word = _CLASS[data[a:a + size]] == _WORD
        end = len(is_word) - int(np.argmin(is_word[::-1])) if not is_word.all() else 0      # behind the last separator
        begins = is_word[:end].copy()
        begins[1:] &= ~is_word[:max(0, end - 1)]
        at = np.flatnonzero(begins)
        if len(at) > again:
            yield a, a + end, skip
            a, skip, size = a + int(at[-again]), again, SLICE_BYTES
        else:
            size *= 2                                        # few, very long words
    yield a, len(data), skip


def _slices(batch: pa.RecordBatch, langs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, first byte of each row, its language and the words to skip, of slices of the batch's texts."""
    text = batch.column(1).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        part = data[offsets[a]:offsets[b]]
        if b == a + 1 and len(part) > SLICE_BYTES:
            for lo, hi, skip in _cuts(part):
                yield part[lo:hi], np.zeros(1, np.int64), langs[a:b], skip
        elif len(part):
            yield part, offsets[a:b] - offsets[a], langs[a:b], 0
        a = b


def _batch_slices(batch: pa.RecordBatch) -> tuple[pa.Array, Iterator[tuple]]:
    """The languages of a batch, and of each slice its bytes, first byte of each row, languages, their hashes and the words to skip."""
    lang = batch.column(0).dictionary_encode()
    hashes = _word_hashes(lang.dictionary.cast(pa.string()))
    return lang.dictionary, ((data, rows, langs, hashes, skip) for data, rows, langs, skip in
                             _slices(batch, lang.indices.to_numpy(zero_copy_only=False)))


def _counter(words_too: bool, sent, max_words: int):
    """A partition function over ``lang, text``: ``k, h, age, n`` per distinct phrase hash of a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for batch in batches:
            for part in _batch_slices(batch)[1]:
                for k, _, _, h, age, n in count_slice(*part, words_too, filters, max_words, spelled=False):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), k, np.int32)), pa.array(h.view(np.int64)), pa.array(age), pa.array(n.astype(np.int64))],
                        ["k", "h", "age", "n"])

    return run


def _speller(sent, max_words: int):
    """A partition function over ``lang, text``: ``k, lang, phrase, n`` per distinct phrase of a slice that is in the filters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for batch in batches:
            names, parts = _batch_slices(batch)
            for part in parts:
                for k, at, phrase, n in spell_slice(*part, filters, max_words):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), k, np.int32)), names.take(pa.array(at)), phrase.cast(pa.string()), pa.array(n.astype(np.int64))],
                        ["k", "lang", "phrase", "n"])

    return run


_COUNTED = "k int, h long, age int, n long"
_SPELLED = "k int, lang string, phrase string, n long"


class _Folders:
    """Two folders that are written in turn, so that superseded counts leave the disk."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths, self.turn = spark, [scratch_path(spark, f"{name}-{i}") for i in range(2)], 0

    def write(self, df: DataFrame) -> DataFrame:
        path, schema = self.paths[self.turn], df.schema
        self.turn = 1 - self.turn
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)


def _total(shards: int) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"c{s}") for s in range(shards)])


def _filters(frequent: DataFrame, step: int, shards: int) -> Filters:
    """Bit filters of what reached the threshold before ``step``, by age and length; ``frequent``: ``k, h, tau``."""
    sizes = {r["k"]: r["n"] for r in frequent.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    bits = {k: max(MIN_FILTER_BITS, min(MAX_FILTER_BITS, 1 << math.ceil(math.log2(BITS_PER_PHRASE * n)))) for k, n in sizes.items()}
    mask = reduce(lambda c, k: c.when(F.col("k") == k, F.lit(bits[k] - 1)), bits, F.when(F.lit(False), F.lit(0))).cast("long")
    spots = F.explode(F.array(F.col("h").bitwiseAND(mask) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(mask) + 1))
    age = F.when(F.col("tau") >= step - shards, step - F.col("tau")).otherwise(F.lit(OLD))
    placed = frequent.select("k", age.alias("age"), spots.alias("spot"))
    maps = placed.groupBy("k", "age", F.bitmap_bucket_number("spot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    out = {}
    for r in maps.toLocalIterator():
        table = out.setdefault((r["age"], r["k"]), bytearray(bits[r["k"]] // 8))
        at = (r["bucket"] - 1) * _BUCKET_BITS // 8
        table[at:at + _BUCKET_BITS // 8] = r["bits"]
    return {key: bytes(table) for key, table in out.items()}


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                     shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of every phrase of 1 to ``max_words`` words that occurs ``min_count`` times or more,
    and ``lang, n``, all word occurrences."""
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-shards")
    docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
                F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")).write.partitionBy("shard").parquet(path)
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)
    folders, done_path = _Folders(spark, "phrase-counts"), scratch_path(spark, "phrases")
    shard_columns = [f"c{s}" for s in range(shards)]
    spark.createDataFrame([], "k int, h long, f long, tau int").write.parquet(done_path)
    state = None
    for step in range(max_words * shards):
        done = spark.read.parquet(done_path)
        reached = [done.select("k", "h", "tau")] + ([state.filter("tau is not null").select("k", "h", "tau")] if state is not None else [])
        filters = _filters(reduce(DataFrame.unionByName, reached).filter(F.col("k") < max_words), step, shards)
        if step >= shards and not any(age != OLD for age, _ in filters):
            break                                            # nothing has been activated within the last cycle
        sent = spark.sparkContext.broadcast(filters)
        shard = step % shards
        counted = texts.filter(F.col("shard") == shard).select("lang", "text").mapInArrow(
            common.releasing(_counter(step < shards, sent, max_words)), _COUNTED)
        rows = counted.select("k", "h", *[F.lit(0).cast("long").alias(c) for c in shard_columns],
                              F.lit(None).cast("int").alias("tau"),
                              F.when(F.col("k") == 1, F.lit(0)).otherwise(step - F.col("age") + 1).alias("start"), "n")
        if state is not None:
            rows = rows.unionByName(state.withColumn("n", F.lit(0).cast("long")))
        merged = rows.groupBy("k", "h").agg(
            *[F.max(c).alias(c) for c in shard_columns], F.min("tau").alias("tau"), F.max("start").alias("start"),
            F.sum("n").alias("n"))
        merged = merged.withColumn(f"c{shard}", F.greatest(f"c{shard}", "n")).withColumn("f", _total(shards))
        merged = merged.withColumn("tau", F.coalesce("tau", F.when(F.col("f") >= min_count, F.lit(step))))
        # What has seen every shard since it became active is complete.
        over = F.col("start") + shards - 1 <= step
        written = folders.write(merged.filter(~over | (F.col("f") >= min_count)).select(
            "k", "h", *shard_columns, "tau", "start", "f", over.alias("over")))
        complete = written.filter(F.col("over") & (F.col("f") >= min_count))
        complete.select("k", "h", "f", "tau").write.mode("append").parquet(done_path)
        state = written.filter(~F.col("over")).drop("f", "over")
    if state is not None:                                    # no filter is left that could add to these
        rest = state.withColumn("f", _total(shards)).filter(F.col("f") >= min_count)
        rest.select("k", "h", "f", "tau").write.mode("append").parquet(done_path)
    # Once more over all shards: every hash that is left is spelled out and its phrases are counted exactly.
    every = spark.read.parquet(done_path).select("k", "h", "tau")
    sent = spark.sparkContext.broadcast(_filters(every, (max_words + 1) * shards, shards))
    spelled = texts.select("lang", "text").mapInArrow(common.releasing(_speller(sent, max_words)), _SPELLED)
    found = common.staged(spelled.groupBy("k", "lang", "phrase").agg(F.sum("n").alias("f")).filter(
        (F.col("f") >= min_count) | (F.col("k") == 0)), "frequent-phrases")
    return found.filter("k > 0").select("lang", "phrase", "k", "f"), found.filter("k = 0").select("lang", F.col("f").alias("n"))


def _words_between(phrase: Column, first: Column, n: Column) -> Column:
    """``n`` words of a phrase from word ``first`` (from 1) on."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def score_phrases(frequent: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two words or more that no longer one drops."""
    phrases = frequent.filter(F.col("k") >= 2).withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _words_between(F.col("phrase"), F.lit(1), F.col("cut")).alias("left"),
        _words_between(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    # Products may pass 64 bits: decimals, and their whole quotient.
    cuts = cuts.withColumn("product", _exact(F.col("a")) * F.lit(SCORE_SCALE).cast("decimal(7,0)")).withColumn(
        "sum", _exact(F.col("l")) + _exact(F.col("r"))).withColumn("score", F.expr("product div sum"))
    best = cuts.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = phrases.filter(F.col("k") >= 3).select(
        "lang", "phrase", F.col("a").alias("f"), "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("n"))
    inside = longer.select("lang", "f", "phrase", "n", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)).alias("first")).select(
        "lang", _words_between(F.col("phrase"), F.col("first"), F.col("n")).alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(most, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * _exact(F.col("most")) < percent * _exact(F.col("a"))))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, max_words: int = MAX_WORDS, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, count and phrase."""
    frequent, totals = frequent_phrases(docs, min_count, max_words, shards)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = score_phrases(frequent).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
