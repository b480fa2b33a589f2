"""Queries of the numbered operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from evalspark.llm import (audit, labelled, lattice, linededup, mixing, ngramjoin, phrases, pii, quality, secrets, tokenfiles, topk, toxicity,
                           warc)
from evalspark.llm.common import read_table
from evalspark.session import scratch_path


def _n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")


def _digest(spans: Column) -> Column:
    return F.sha2(F.concat_ws(",", spans), 256)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(read_table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.search(rows.select("vec_id", topk.integers(F.col("embedding")).alias("v")), every=50)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(read_table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_documents(spark, out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules)


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    base = F.col("base_spans")
    return found.select("doc_id", *[_n_of(base, k) for k in secrets.BASE_KINDS], _digest(base).alias("base_sha256"),
                        F.concat_ws(",", "spans").alias("spans"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read_table(spark, sf_dir, "documents"))
    listed = found.select("doc_id", pii.listed(F.col("spans"), pii.BASE_KINDS).alias("base"),
                          pii.listed(F.col("spans")).alias("every"),
                          F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))
    base = F.col("base")
    return listed.select("doc_id", *[_n_of(base, k) for k in pii.BASE_KINDS], _digest(base).alias("base_sha256"),
                         F.concat_ws(",", "every").alias("spans"), "top_score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, lines_col="n_lines", removed_col="n_removed")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), out)
    return warc.read_captures(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                 F.col("refers_to_page").alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_topk_search": op2_topk_search,
    "op3_source_mix": op3_source_mix,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_sampled_pieces": op7_sampled_pieces,
    "op8_secret_scan": op8_secret_scan,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc_captures": op13_warc_captures,
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op3_source_mix": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)
              AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM per_source),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS full_at,
         (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
         / CAST(nullif(sum(w) OVER () - coalesce(sum(w) OVER before, 0), 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM levels WHERE level <= full_at ORDER BY full_at LIMIT 1),
                                             CAST('infinity' AS DOUBLE)) * w) AS target
  FROM levels)
SELECT s.doc_id, s.size, t.source_size, t.target,
       CASE WHEN t.source_size > 0
            THEN s.size * CAST(floor(t.target / t.source_size)
                 + CASE WHEN s.u < t.target / t.source_size - floor(t.target / t.source_size) THEN 1 ELSE 0 END AS BIGINT)
            ELSE 0 END AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source""",
    # A line goes if it lies in a run of lines with words that holds ten words and occurred before; every such run
    # is covered by shortest windows of ten words, from each line on and up to each line.
    "op10_line_dedup": rf"""
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM (SELECT doc_id, pos, trim(raw, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS line,
               len(regexp_extract_all(raw, '{_WORD}')) AS nw FROM every) WHERE nw > 0),
ahead AS (
  SELECT doc_id, i, list(line) OVER w AS ls, list(nw) OVER w AS ns, list(pos) OVER w AS ps FROM worded
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
behind AS (
  SELECT doc_id, i, list(line) OVER w AS ls, list(nw) OVER w AS ns, list(pos) OVER w AS ps FROM worded
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
runs AS (
  SELECT doc_id, i, array_to_string(ls[1:k], chr(10)) AS run, ps[1] AS a, ps[k] AS b
  FROM (SELECT *, list_min(list_filter(range(1, len(ns) + 1), lambda k: list_sum(ns[1:k]) >= 10)) AS k FROM ahead) WHERE k IS NOT NULL
  UNION ALL
  SELECT doc_id, i - (len(ns) - k), array_to_string(ls[k:len(ls)], chr(10)), ps[k], ps[len(ps)]
  FROM (SELECT *, list_max(list_filter(range(1, len(ns) + 1), lambda k: list_sum(ns[k:len(ns)]) >= 10)) AS k FROM behind) WHERE k IS NOT NULL),
placed AS (SELECT *, CAST(doc_id AS HUGEINT) * 1000000000 + i AS place FROM runs),
first AS (SELECT run, min(place) AS first_place FROM placed GROUP BY run),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM placed JOIN first USING (run) WHERE place > first_place),
marked AS (SELECT e.doc_id, e.pos, e.raw, g.pos IS NOT NULL AS off FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos),
kept AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT off), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE off) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op11_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM scored) WHERE turn = 1),
inside AS (
  SELECT lang, f, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS n FROM counts WHERE k > 2)),
longest AS (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY ALL),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, encode(s.phrase)) AS rank, s.phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN longest g USING (lang, phrase) WHERE g.most IS NULL OR 100 * g.most < 80 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_filter_audit": rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS low FROM texts GROUP BY text),
judged AS (
  SELECT t.doc_id, t.part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 3 * length(t.text) AS c,
         regexp_matches(t.text, '[#$%&*|]') AS d, coalesce(t.doc_id > f.low, false) AS e
  FROM texts t JOIN firsts f USING (text)),
marked AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = j.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = j.doc_id AND l.toxic = 1) AS toxic FROM judged j),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
counted AS (
  SELECT m.part, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS x,
         list_filter(range(1, 6), lambda i: list_contains(m.fails, substr(s.filter_order, i, 1)))[1] AS gone_at, m.*
  FROM masks m, steps s),
summed AS (
  SELECT part, filter_order, step, x,
         sum(n) FILTER (WHERE gone_at IS NULL OR gone_at > step) AS kept, sum(n) FILTER (WHERE gone_at = step) AS removed,
         sum(n) FILTER (WHERE gone_at < step AND list_contains(fails, x)) AS redundant, sum(n) FILTER (WHERE fails = [x]) AS unique_fails,
         sum(good) FILTER (WHERE gone_at = step) AS good_lost, sum(toxic) FILTER (WHERE gone_at = step) AS toxic_lost
  FROM counted GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM summed""",
    "op13_warc_captures": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN firsts f USING (payload_digest)""",
}
