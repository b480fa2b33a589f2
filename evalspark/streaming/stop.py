"""Early stop over streamed model output, as keyed streaming state.

Chunks ``(request_id, seq, text)`` arrive in any order and across
micro-batches.  Per request a value state holds the next expected ``seq`` and a
resumable scan (each character is scanned once), a list state the pieces of
the output so far (a micro-batch appends its own pieces and rewrites none) and
a map state the chunks that arrived early, in blocks of ``EARLY_BLOCK`` numbers
(each call on the state is a round trip to the JVM, so a request makes few).  A request stops after the whole
chunk in which the rule first holds; its row ``(request_id, stop_seq, output)``
is emitted once.  Chunks marked ``special`` (special tokens) count in the order
but are neither scanned nor part of the output.

Rules (by suite):
  * ``text``: brace scan of the generated text itself (repair);
  * ``signature``: brace scan of ``signature + "{\\n" + text`` (complete mode
    of complete / testgen / testgenissue), the prefix scanned at first use;
  * ``chat``: chat mode of complete / testgen / testgenissue: wait for the
    signature, then brace-scan the text between its first and second
    occurrence.  The last ``len(signature) - 1`` characters are held back
    (evaluated tentatively, committed later) so that a second occurrence
    split over chunks is never scanned; once the second occurrence is seen
    the segment is frozen and, if it did not close, the request never stops.
  * ``marker``: either verdict sentence occurs (defect detection); a text
    tail of ``max(len(marker)) - 1`` characters catches sentences split over
    chunks.

Timers end what the chunks leave open.  ``idle_ms`` after a request's last
chunk, in event time (past the watermark) or in processing time, a request
that did not stop is emitted with its whole text and no ``stop_seq``, and the
state of every request, stopped or not, is removed.  A finite log ends with a
closing row (:func:`closing_row`): it moves the watermark past every timer, so
the last micro-batch empties the state.
"""

from __future__ import annotations

import re
import sys
from typing import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from evalspark.functions.defect import STREAM_STOP_MARKERS

_STRUCTURAL = re.compile(r'["{}]')

OUTPUT_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("stop_seq", T.LongType()),
    T.StructField("output", T.StringType()),
])

EARLY_BLOCK = 64              # chunk numbers that share an entry of the early ones
IDLE_MS = 3_600_000           # after a request's last chunk
LATENESS = "1 day"            # of the watermark behind the latest chunk
END_OF_STREAM = "2200-01-01 00:00:00"

_SCAN_STATE = ("next_seq long, depth long, in_quote boolean, seen boolean, tail string, phase long, done boolean, "
               "n_early long, deadline long, carry string")

SEARCHING, SCANNING, FROZEN = 0, 1, 2


def scan_braces(text: str, depth: int, in_quote: bool, seen: bool):
    """Resume the brace scan over ``text``; return the new state and whether
    the body closed inside it."""
    for m in _STRUCTURAL.finditer(text):
        ch = m.group()
        if ch == '"':
            in_quote = not in_quote
            continue
        if in_quote:
            continue
        if ch == "{":
            depth += 1
            seen = True
        else:
            depth -= 1
        if depth == 0 and seen:
            return depth, in_quote, seen, True
    return depth, in_quote, seen, False


def chat_step(text: str, sig: str, phase: int, held: str, depth: int, in_quote: bool, seen: bool):
    """Advance the chat-mode rule by one chunk.

    Returns ``(hit, phase, held, depth, in_quote, seen)``; ``held`` is the
    tail not yet known to lie before a second signature occurrence.
    """
    n = len(sig)
    if n == 0 or phase == FROZEN:
        return False, phase, held, depth, in_quote, seen
    if phase == SEARCHING:
        buf = held + text
        p = buf.find(sig)
        if p < 0:
            return False, phase, buf[-(n - 1):] if n > 1 else "", depth, in_quote, seen
        phase, held, text = SCANNING, "", buf[p + n:]
    buf = held + text
    q = buf.find(sig)
    if q >= 0:
        depth, in_quote, seen, hit = scan_braces(buf[:q], depth, in_quote, seen)
        return hit, FROZEN, "", depth, in_quote, seen
    keep = n - 1
    cut = max(len(buf) - keep, 0)
    commit, held = buf[:cut], buf[cut:]
    depth, in_quote, seen, hit = scan_braces(commit, depth, in_quote, seen)
    if not hit:
        hit = scan_braces(held, depth, in_quote, seen)[3]
    return hit, SCANNING, held, depth, in_quote, seen


class StopProcessor(StatefulProcessor):
    """The early stop of one request; rows: ``seq, text, special, prefix, carry, ms``."""

    def __init__(self, rule: str, markers: list[str], idle_ms: int, event_time: bool):
        self.rule, self.markers, self.idle_ms, self.event_time = rule, markers, idle_ms, event_time
        self.keep = max((len(m) for m in markers), default=1) - 1

    def init(self, handle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", _SCAN_STATE)
        self.pieces = handle.getListState("pieces", "piece string")
        self.early = handle.getMapState("early", "block long", "chunks array<struct<seq long, text string, special boolean>>")

    def _now(self, timers, latest: int) -> int:
        return latest if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _row(self, key, stop_seq: int | None, output: str, carry: str | None) -> Row:
        return Row(request_id=int(key[0]), stop_seq=stop_seq, output=output, carry=carry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.scan.get()
        next_seq, depth, in_quote, seen, tail, phase, done, n_early, deadline, carry = state or (0, 0, False, False, "", 0, False, 0, 0, None)
        arrived, prefix, latest, was_next, had_early = {}, None, 0, next_seq, n_early
        for seq, text, special, pre, own, ms in ((r.seq, r.text, r.special, r.prefix, r.carry, r.ms) for r in rows):
            if not done and seq >= next_seq:
                arrived[seq] = ("" if text is None else text, special)
            prefix = pre if prefix is None else prefix
            carry = own if carry is None else carry
            latest = max(latest, ms)
        if done:
            return
        blocks: dict[int, dict] = {}                 # blocks of early chunks that this call has read
        changed: set[int] = set()

        def block_of(seq: int) -> dict:
            n = seq // EARLY_BLOCK
            if n not in blocks:
                held = self.early.getValue((n,)) if had_early else None
                blocks[n] = {c[0]: (c[1], c[2]) for c in held[0]} if held else {}
            return blocks[n]

        pieces, stopped_at = [], None
        if self.rule == "signature" and next_seq == 0 and (0 in arrived or n_early):
            # The scan covers signature + "{\n" before the generated text.
            depth, in_quote, seen, _ = scan_braces(prefix or "", 0, False, False)
        while True:
            held = block_of(next_seq).pop(next_seq, None) if n_early else None
            if held is not None:
                n_early -= 1
                changed.add(next_seq // EARLY_BLOCK)
            if (chunk := arrived.pop(next_seq, held)) is None:
                break
            text, special = chunk
            next_seq += 1
            if special:
                continue
            pieces.append(text)
            if self.rule == "marker":
                window = tail + text
                hit = any(m in window for m in self.markers)
                tail = window[-self.keep:] if self.keep > 0 else ""
            elif self.rule == "chat":
                hit, phase, tail, depth, in_quote, seen = chat_step(text, prefix or "", phase, tail, depth, in_quote, seen)
            elif depth == 0 and seen:
                hit = True
            else:
                depth, in_quote, seen, hit = scan_braces(text, depth, in_quote, seen)
            if hit:
                stopped_at = next_seq - 1
                break
        first, deadline = state is None, self._now(timerValues, latest) + self.idle_ms
        if stopped_at is not None:
            before = [p for (p,) in self.pieces.get()] if was_next else []
            if was_next:
                self.pieces.clear()
            if had_early:
                self.early.clear()
            self.scan.update((next_seq, 0, False, False, "", phase, True, 0, deadline, None))
        else:
            if pieces:
                self.pieces.appendList([(p,) for p in pieces])
            for seq, chunk in arrived.items():
                block = block_of(seq)
                n_early += seq not in block
                block[seq] = chunk
                changed.add(seq // EARLY_BLOCK)
            for n in changed:
                if blocks[n]:
                    self.early.updateValue((n,), ([(seq, *chunk) for seq, chunk in blocks[n].items()],))
                else:
                    self.early.removeKey((n,))
            self.scan.update((next_seq, depth, in_quote, seen, tail, phase, False, n_early, deadline, carry))
        if first:
            self.handle.registerTimer(deadline)
        if stopped_at is not None:
            yield self._row(key, stopped_at, "".join([*before, *pieces]), carry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        next_seq, *_, done, n_early, deadline, carry = self.scan.get()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        if deadline > now:                   # chunks have come since the timer was set
            self.handle.registerTimer(deadline)
            return
        self.scan.clear()
        if done:                             # its text left the state when it stopped
            return
        parts = []
        if next_seq:
            parts += [p for (p,) in self.pieces.get()]
            self.pieces.clear()
        if n_early:
            held = sorted((c[0], c[1]) for _, (chunks,) in self.early.iterator() for c in chunks if not c[2])
            parts += [text for _, text in held]
            self.early.clear()
        yield self._row(key, None, "".join(parts), carry)

    def close(self) -> None:
        pass


def stop_stream(chunks: DataFrame, rule: str, markers: list[str] | None = None, prefix: str | None = None,
                idle_ms: int = IDLE_MS, event_time: str | None = None, carry: str | None = None) -> DataFrame:
    """Apply the early-stop rule to a streaming chunk DataFrame: ``request_id, stop_seq, output``.

    ``chunks`` needs ``request_id, seq, text`` and may have ``special``; for the
    ``signature`` rule a column named by ``prefix`` holds ``signature + "{\\n"``,
    for the ``chat`` rule the signature itself.  With ``event_time`` (a timestamp
    column) timers follow a watermark of ``LATENESS``, else processing time.
    ``carry`` names a column that is constant per request and is given back.
    """
    if rule not in ("text", "signature", "chat", "marker"):
        raise KeyError(rule)
    # Ship the processor and its helpers by value: Python workers then need
    # only the standard library and pyspark, not this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    markers = markers or (STREAM_STOP_MARKERS if rule == "marker" else [])

    def column(name: str | None, default) -> F.Column:
        return F.col(name) if name else default

    src = chunks
    if event_time:
        # The closing row ends here; a condition on the event time stays above the watermark.
        src = src.withWatermark(event_time, LATENESS).filter(F.col(event_time) < F.lit(END_OF_STREAM).cast("timestamp"))
    src = src.select(F.col("request_id").cast("long"), F.col("seq").cast("long"), "text",
                     F.coalesce(F.col("special") if "special" in chunks.columns else F.lit(False), F.lit(False)).alias("special"),
                     column(prefix, F.lit(None).cast("string")).alias("prefix"),
                     column(carry, F.lit(None)).cast("string").alias("carry"),
                     column(event_time, F.lit("1970-01-01").cast("timestamp")).alias("ts"))
    src = src.withColumn("ms", F.unix_millis("ts"))
    out = src.groupBy("request_id").transformWithState(
        StopProcessor(rule, markers, idle_ms, bool(event_time)),
        T.StructType([*OUTPUT_SCHEMA.fields, T.StructField("carry", T.StringType())]), "append",
        "EventTime" if event_time else "ProcessingTime")
    return out.select(*OUTPUT_SCHEMA.names, F.col("carry").cast(chunks.schema[carry].dataType).alias(carry)) if carry \
        else out.select(*OUTPUT_SCHEMA.names)


def closing_row(spark: SparkSession, schema: T.StructType, event_time: str) -> DataFrame:
    """The row that ends a finite log of chunks: no request, an event time after all others."""
    end = F.lit(END_OF_STREAM).cast("timestamp")
    return spark.range(1).select(*[(end if f.name == event_time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available_now(stream_df: DataFrame, sink_path: str, checkpoint: str, timeout_s: int | None = None) -> list:
    """Drain everything available into a Parquet sink, exactly once, then stop; the progress of the micro-batches.

    List and map state need the RocksDB store, off the heap.  There is no time
    limit unless the caller sets one."""
    stream_df.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    q = (stream_df.writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()
    return q.recentProgress


def rule_for(suite_name: str, mode: str) -> str:
    """The stop rule a suite uses in a generation mode."""
    from evalspark.suites import get_suite
    return get_suite(suite_name).stop_rule(mode)


def stop_stream_for_suite(chunks: DataFrame, tasks: DataFrame, suite_name: str, mode: str, **kw) -> DataFrame:
    """Early stop for a suite: ``chunks`` carry ``request_id, seq, text, task_idx``.

    The task's ``function_signature`` comes in by a stream-static join with the
    task table (broadcast if its checked size allows it).  In complete mode the
    stripped prompt is put before the output, as the generation clients do; it
    is joined to the finished requests only."""
    from evalspark.functions.text import py_strip
    from evalspark.operators.joins import lookup_join
    rule = rule_for(suite_name, mode)
    if rule in ("signature", "chat"):
        sig = F.col("function_signature")
        dim = tasks.select("task_idx", (F.concat(sig, F.lit("{\n")) if rule == "signature" else sig).alias("__sig"))
        chunks, kw = lookup_join(chunks, dim, "task_idx", "left"), kw | {"prefix": "__sig"}
    if mode != "complete":
        return stop_stream(chunks, rule, **kw)
    stopped = stop_stream(chunks, rule, carry="task_idx", **kw)
    prompts = tasks.select("task_idx", py_strip(F.col("prompt_complete")).alias("__prompt"))
    joined = lookup_join(stopped, prompts, "task_idx", "left")
    return joined.select("request_id", "stop_seq", F.concat(F.coalesce("__prompt", F.lit("")), F.col("output")).alias("output"))
