"""Exact token counts of a byte-level BPE tokenizer, by a dictionary of pieces.

Texts are split into pieces by the tokenizer's pattern; merges never cross a
piece, so a text's count is the sum over its pieces.  Each distinct piece is
merged once, whatever the number of texts that hold it: a short one in each
task, which remembers it, a long one in the whole job, its count joined back by
piece.

The merges of a piece depend on each other from end to end (which pair comes
next hangs on what a lower rank made of its neighbours), so a fold over columns
or rounds over rows would need as many steps as a piece has merges.  A small
function with a heap does it, n log n in the piece, over Arrow batches of
distinct pieces; splitting, summing, dealing and joining stay native.

Defined results: a null or empty text has 0 tokens; rows of equal keys are
counted together; a null key is a key; an empty table gives no rows; a text
without a space is one piece, however long.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import scratch_path

# What byte-level BPE of this family splits at (white space as Unicode has it).
PIECE_RE = ("'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\p{IsWhite_Space}\\p{L}\\p{N}]+"
            "|\\p{IsWhite_Space}+(?![^\\p{IsWhite_Space}])|\\p{IsWhite_Space}+")
# Bytes that the vocabulary file writes as themselves; the others follow from U+0100 on.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

MAX_MERGES = 1_000_000         # in the broadcast table
HOT_SHARE = 10_000             # pieces with more than one in so many rows are salted: fewer than so many pieces
SALTS = 32
SHORT_CHARS = 32               # of a piece that a task sums itself
MEMO_PIECES = 500_000          # short pieces that a task remembers (some 120 bytes each)


def _byte_letters() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


Ranks = dict[tuple[bytes, bytes], int]


def read_merges(path: str) -> Ranks:
    """The rank of each pair of symbols in a tokenizer file (read on the driver: a vocabulary, not data)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
            or spec.get("normalizer") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    if len(model["merges"]) > MAX_MERGES:
        raise ValueError(f"{path}: more than {MAX_MERGES} merges")
    letters = _byte_letters()
    pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"])
    return {tuple(bytes(letters[c] for c in x) for x in pair): rank for rank, pair in enumerate(pairs)}


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE_RE), 0)


def merged_length(piece: bytes, ranks: Ranks) -> int:
    """Number of tokens of a piece: the pair of the lowest rank is merged first, the leftmost of equal ones."""
    n = left = len(piece)
    symbols: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
            continue                                     # one of both has been merged since
        symbols[i], symbols[j] = symbols[i] + symbols[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (rank := ranks.get((symbols[a], symbols[b]))) is not None:
                heapq.heappush(heap, (rank, a))
    return left


def merge_pieces(distinct: DataFrame, ranks: Ranks) -> DataFrame:
    """``piece, n_tokens`` of a table of distinct pieces (column ``piece``)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not have the package
    sent = distinct.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [merged_length(p.as_py().encode(), sent.value) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["piece", "n_tokens"])

    return distinct.select("piece").mapInArrow(count, "piece string, n_tokens long")


def short_pieces_summed(split: DataFrame, keys: list[str], ranks: Ranks) -> DataFrame:
    """``keys, piece, known``: per row of ``split`` (``keys`` and an array ``pieces``) the tokens of its pieces of at
    most ``SHORT_CHARS`` characters, without a ``piece``; and a row, without ``known``, for each longer piece in it.

    A task merges a short piece once and remembers it, ``MEMO_PIECES`` at a time.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])      # executors need not have the package
    sent, short, room = split.sparkSession.sparkContext.broadcast(ranks), SHORT_CHARS, MEMO_PIECES

    def size(piece: str, memo: dict[str, int], table: Ranks) -> int:
        n = memo.get(piece)
        if n is None:
            if len(memo) >= room:
                memo.clear()
            n = memo[piece] = merged_length(piece.encode(), table)
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = {}, sent.value
        names = [*keys, "piece", "known"]
        for batch in batches:
            listed, own = batch.column(len(keys)), batch.columns[:len(keys)]
            coded = listed.flatten().dictionary_encode()
            is_long = pc.greater(pc.utf8_length(coded.dictionary), short).to_numpy(zero_copy_only=False)
            sizes = np.fromiter((0 if long else size(p, memo, table) for p, long in zip(coded.dictionary.to_pylist(), is_long.tolist(), strict=True)),
                                np.int64, len(coded.dictionary))
            at = coded.indices.to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(sizes[at])])
            ends = listed.offsets.to_numpy() - listed.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(listed), pa.string()), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names)
            places = np.flatnonzero(is_long[at])
            if len(places):
                row = pa.array(np.searchsorted(ends, places, side="right") - 1)
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in own], coded.dictionary.take(pa.array(at[places])),
                                                  pa.nulls(len(places), pa.int64())], names)

    types = dict(split.dtypes)
    return split.select(*keys, "pieces").mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "piece string", "known long"]))


def exact_token_counts(texts: DataFrame, keys: list[str], text: str, ranks: Ranks) -> DataFrame:
    """``keys, n_tokens``: the tokens of all texts of each key.

    Short pieces, nearly all of a text, are summed where they are read.  Long
    ones, whose merges are the costly ones, are summed by key before any
    shuffle, merged once and joined back by piece.  A piece that stands in a
    large share of the rows is salted by key, and only its row of the
    dictionary is copied per salt; which pieces that are is broadcast as
    hashes, fewer than ``HOT_SHARE`` by the way they are chosen.
    """
    spark = texts.sparkSession
    path = scratch_path(spark, "piece-counts")
    named = [f"__k{i}" for i in range(len(keys))]            # a key may have the name of a column here
    split = texts.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], pieces(F.col(text)).alias("pieces"))
    short_pieces_summed(split, named, ranks).write.parquet(path)
    found = spark.read.parquet(path)
    known = found.filter("piece is null").select(*named, F.col("known").alias("n_tokens"))
    counted = found.filter("piece is not null").groupBy(*named, "piece").agg(F.count(F.lit(1)).alias("n"))
    uses_path = scratch_path(spark, "piece-uses")
    counted.groupBy("piece").agg(F.count(F.lit(1)).alias("uses")).write.parquet(uses_path)
    uses = spark.read.schema("piece string, uses long").parquet(uses_path)
    rows = uses.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(uses.filter(F.col("uses") * HOT_SHARE > rows).select(F.xxhash64("piece").alias("hot")).distinct())
    sizes = merge_pieces(uses, ranks)
    sizes = sizes.join(hot, F.xxhash64("piece") == F.col("hot"), "left").select(
        "piece", "n_tokens", F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(*named), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = counted.join(hot, F.xxhash64("piece") == F.col("hot"), "left").withColumn("salt", salt).drop("hot")
    long = dealt.join(sizes, ["piece", "salt"]).select(*named, (F.col("n") * F.col("n_tokens")).alias("n_tokens"))
    sums = known.unionByName(long).groupBy(*named).agg(F.sum("n_tokens").cast("long").alias("n_tokens"))
    return sums.select(*[F.col(n).alias(k) for n, k in zip(named, keys, strict=True)], "n_tokens")


def counter(path: str) -> Callable[[DataFrame, list[str], str], DataFrame]:
    """A token counter for ``token_cost``, ``score`` and ``run_evaluate`` from a tokenizer file."""
    ranks = read_merges(path)
    return lambda texts, keys, text: exact_token_counts(texts, keys, text, ranks)
