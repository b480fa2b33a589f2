"""Line dedup by winnowing over line hashes, native DataFrame operations throughout.

A line is its text without outer white space; lines without words count for
nothing.  For every line the shortest window of lines from it on that holds
``min_words`` words selects its smallest hash; the selected lines are the
fingerprints.  A run of equal lines with ``min_words`` words or more holds a
whole window, so both its copies select the same fingerprint in it.

Equal fingerprints are joined on their hash.  A match is confirmed by the runs
around the fingerprint as a whole, left part, line and right part in one hash
of 128 bits (so the match is not extended line by line: a run is equal or not):
the shortest runs of ``min_words`` words whose window selects it, from a line
on or up to a line.  A run whose hash has an earlier first occurrence in the
corpus (the smallest document id, then text hash, then line) is deleted; the
first occurrence stays.  Every longer repeated run is covered by such runs.

At scale: per-line work stays inside the row of the document; what is
shuffled is a few numbers per fingerprint, and per run of the repeated ones.
First occurrences are minima, combined before the shuffle, so that a line that
a third of all documents hold costs one row per task; the joins back have a
unique side and can be split when they are skewed.  Texts are shuffled once,
to meet their kept segments.

Defined results: a null text stays null and an empty one empty; rows that
agree in id and text are one document and get one result each; null ids come
first; a text below ``min_words`` words is never changed; a text whose lines
are all deleted becomes empty; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm import common

#: Words in the shortest run that is deleted, and in a window.
MIN_WORDS = 10

_TRIM = " \t\x0b\x0c\r"
_SECOND = 1                  # seeds the second half of the 128 bits that runs are compared by


def _lines(text: Column) -> Column:
    """``pos, h, g, nw`` of the lines with words."""
    every = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        i.alias("pos"), F.xxhash64(F.btrim(line, F.lit(_TRIM))).alias("h"), F.xxhash64(F.lit(_SECOND), F.btrim(line, F.lit(_TRIM))).alias("g"),
        F.regexp_count(line, F.lit(common.WORD)).alias("nw")))
    return F.filter(every, lambda x: x["nw"] > 0)


_RUNS = "array<struct<hash:bigint,hash2:bigint,last:int>>"


def _starts(lines: Column, min_words: int) -> Column:
    """Per line: ``best``, the smallest hash (the leftmost of equal ones) of the shortest window from it on, and
    ``runs``, the shortest runs from it on: that window, and those that without this line are below ``min_words`` words.
    No runs where too few words are left."""
    empty = F.struct(F.lit(0).alias("words"), F.lit(0).cast("long").alias("hash"), F.lit(_SECOND).cast("long").alias("hash2"),
                     F.lit(None).cast("struct<h:bigint,i:int>").alias("best"), F.array().cast(_RUNS).alias("runs"))

    def of(line: Column, i: Column) -> Column:
        ahead = F.transform(F.slice(lines, i + 1, F.lit(min_words)), lambda x, k: F.struct(
            x["pos"].alias("pos"), x["h"].alias("h"), x["g"].alias("g"), (i + k).alias("i"), x["nw"].alias("nw")))

        def add(a: Column, x: Column) -> Column:
            words, grown, grown2 = a["words"] + x["nw"], F.xxhash64(a["hash"], x["h"]), F.xxhash64(a["hash2"], x["g"])
            short = a["words"] < min_words
            ends = (words >= min_words) & (short | (words - line["nw"] < min_words))
            best = F.least(a["best"], F.struct(x["h"].alias("h"), x["i"].alias("i")))
            run = F.struct(grown.alias("hash"), grown2.alias("hash2"), x["pos"].alias("last"))
            return F.struct(words.alias("words"), grown.alias("hash"), grown2.alias("hash2"), F.when(short, best).otherwise(a["best"]).alias("best"),
                            F.when(ends, F.concat(a["runs"], F.array(run))).otherwise(a["runs"]).alias("runs"))

        return F.aggregate(ahead, empty, add, lambda a: F.struct(
            line["pos"].alias("first"), line["h"].alias("h"), a["best"].alias("best"), a["runs"].alias("runs")))

    return F.transform(lines, of)


def _fingerprints(starts: Column) -> Column:
    """``h, i`` of the selected lines, in order."""
    at = F.array_distinct(F.transform(F.filter(starts, lambda s: F.size(s["runs"]) > 0), lambda s: s["best"]["i"]))     # numbers: linear
    return F.transform(at, lambda i: F.struct(F.get(starts, i)["h"].alias("h"), i.alias("i")))


def _runs(starts: Column, picked: Column, min_words: int) -> Column:
    """Per fingerprint its hash, its line and the runs around it: those whose window selects it."""
    def of(f: Column) -> Column:
        begin = F.greatest(f["i"] - min_words + 1, F.lit(0))
        near = F.filter(F.slice(starts, begin + 1, f["i"] - begin + 1), lambda s: (F.size(s["runs"]) > 0) & (s["best"]["i"] == f["i"]))
        runs = F.transform(near, lambda s: F.transform(s["runs"], lambda r: F.struct(
            r["hash"].alias("hash"), r["hash2"].alias("hash2"), s["first"].alias("first"), r["last"].alias("last"))))
        return F.struct(f["h"].alias("fingerprint"), f["i"].alias("at"), F.flatten(runs).alias("runs"))

    return F.transform(picked, of)


def _repeated(rows: DataFrame, key: list[str], place: Column) -> DataFrame:
    """Values of ``key`` at several places, with the first one."""
    ends = rows.groupBy(*key).agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"))
    return ends.filter(F.col("first_place") != F.col("last_place")).select(*key, "first_place")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, version, first, last``: runs of line numbers that occurred before (they may overlap).

    ``version`` is a hash of the text: id and version name a document.
    """
    slim = docs.select("doc_id", F.xxhash64("text").alias("version"), _lines(F.col("text")).alias("lines")).filter(F.col("text").isNotNull())
    # Settled: lambdas read lines and starts as a whole, so they must be computed once a row.
    starts = common.settled(common.settled(slim).select("doc_id", "version", _starts(F.col("lines"), min_words).alias("starts")))
    picked = starts.withColumn("picked", _fingerprints(F.col("starts")))
    # Not of the column: an inferred filter on it would be pushed below and compute the lines anew for each line.
    single = starts.select("doc_id", "version", F.inline(_fingerprints(F.col("starts")))).toDF("doc_id", "version", "fingerprint", "at")
    shared = _repeated(single, ["fingerprint"], F.struct("doc_id", "version", "at")).select("fingerprint")
    around = picked.select("doc_id", "version", F.inline(_runs(F.col("starts"), F.col("picked"), min_words)))
    runs = common.staged(around.join(shared, "fingerprint").select("doc_id", "version", F.inline("runs")), "line-runs")
    place = F.struct("doc_id", "version", "first")
    later = runs.join(_repeated(runs, ["hash", "hash2"], place), ["hash", "hash2"]).filter(place > F.col("first_place"))
    return later.select("doc_id", "version", "first", "last")


def _kept_segments(runs: DataFrame) -> DataFrame:
    """Per document the segments of line numbers between its repeated runs; the last one is open."""
    by = Window.partitionBy("doc_id", "version").orderBy("first", "last")
    covered = F.coalesce(F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gaps = runs.withColumn("covered", covered)
    return gaps.groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_list(F.when(F.col("first") > F.col("covered") + 1, F.struct(
            (F.col("covered") + 1).alias("a"), (F.col("first") - 1).alias("b"))))).alias("segments"),
        F.max("last").alias("last"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, lines_col: str | None = None, removed_col: str | None = None) -> DataFrame:
    """``docs`` with ``text`` without its repeated runs; optionally the number of lines and of removed ones."""
    names = {n: common.fresh(docs, n) for n in ("id", "version", "segments", "last", "lines", "kept")}
    kept = _kept_segments(repeated_runs(docs, min_words)).toDF(names["id"], names["version"], names["segments"], names["last"])
    marked = docs.withColumn(names["version"], F.xxhash64("text"))
    joined = marked.join(kept.withColumnRenamed(names["version"], names["version"] + "_k"),
                         F.col("doc_id").eqNullSafe(F.col(names["id"])) & (F.col(names["version"]) == F.col(names["version"] + "_k")), "left")
    lines = F.col(names["lines"])
    split = joined.withColumn(names["lines"], F.split("text", "\n"))
    inner = F.transform(F.col(names["segments"]), lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"] + 1))
    tail = F.slice(lines, F.col(names["last"]) + 2, F.size(lines))
    cut = split.withColumn(names["kept"], F.when(F.col(names["segments"]).isNotNull(), F.flatten(F.concat(inner, F.array(tail)))))
    columns = []
    for c in docs.columns:
        columns.append(F.coalesce(F.array_join(names["kept"], "\n"), F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`"))
    counts = []
    if lines_col:
        counts.append(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(lines_col))
    if removed_col:
        counts.append(F.when(F.col(names["kept"]).isNotNull(), F.size(lines) - F.size(names["kept"])).otherwise(0).cast("long").alias(removed_col))
    return cut.select(*columns, *counts)


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` deduplicated by line, with its columns; documents of which nothing is left go.

    ``n_chars``, where there is such a column, follows the text.
    """
    removed = common.fresh(docs, "removed")
    cut = dedup_lines(docs, min_words, removed_col=removed)
    stays = (F.col(removed) == 0) | F.col("text").rlike(common.WORD)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.filter(stays).select(*[F.col(f"`{c}`") for c in docs.columns])
