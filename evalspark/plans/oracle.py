"""DuckDB SQL oracles, one per catalog query.

The fixture views are the same definitions as :mod:`evalspark.fixtures`,
written as SQL over the driver tables.  Brace scans use a character unnest
plus running sums, an independent formulation of the fold used in Spark.
"""

from __future__ import annotations

# Fixed values of the rules, written here once more: an oracle that took them
# from the engine would be wrong together with it.
DEFECT_PHRASES = [
    'Yes, it has defect', 'Yes', 'has defect', 'has defect', 'there are potential defects',
    'is potentially flawed', 'There are defects', 'There are several issue', 'there is a potential defect',
]
DEFECT_PATTERNS = [
    'here.*?potential issue', 'here.*?potential defect', 'There.*?a few issue', 'there.*?a few issue',
]
NO_DEFECT_PHRASES = [
    'no defects', "No, it doesn't have defects", 'No', "doesn't have defect", 'do not have defect',
    'do not has defect', 'this function is not flawed',
]
NO_DEFECT_PATTERNS = [
    "doesn't has defect", 'here are no.*?defect', 'do not see.*?defect', "don't see.*?defect",
]
TRUNCATE_DEFECT_MARKERS = [
    'Yes, it has defect', 'Yes', 'has defect', 'has defect',
]
TRUNCATE_NO_DEFECT_MARKERS = [
    "No, it doesn't have defects", 'No', "doesn't have defect", 'do not have defect', 'do not has defect',
    "doesn't has defect",
]
ANSWER_ENDINGS = [
    'Yes, it has defects', "No, it doesn't have defects", 'Note: there is a potential defect',
    "this doesn't has defect", 'ERROR', '$ERROR$', 'here is a potential issue', 'there are no real defects',
    'I cannot determine', 'no defects. Yes?', 'There are quite a few issues', 'this function is not flawed',
    '',
]
MISSING_FUNCTION_PREFIX = "Can not find target function in answer!\n\n"
K_GRID_COMPLETE = [1, 5, 10, 20, 50, 100]
T_GRID = [1000, 5000, 10000, 20000, 500000, 1000000]

# White space as the reference's language has it, and classes made of it.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_SPACE_CODES = "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE)
TOKEN_RE = f"[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}{_SPACE_CODES}]"
COMPILER_ERROR_RE = f"[^\n]*:[{_SPACE_CODES.replace(chr(92) + 'x{a}', '')}]error:[{_SPACE_CODES}][^\n]*"

FLAGS = ["pass_syntax", "pass_compile", "pass_trigger", "pass_all"]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS = q(PY_WHITESPACE)
TOK = q(TOKEN_RE)
SEP = "chr(30)"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, {TOK}))"


def passk(n: str, c: str, k: str) -> str:
    return (f"(CASE WHEN {n} - {c} < {k} THEN 1.0::DOUBLE WHEN {c} = 0 THEN 0.0::DOUBLE "
            f"ELSE 1.0::DOUBLE - list_reduce(list_transform(range({n} - {c} + 1, {n} + 1), "
            f"lambda i: 1.0::DOUBLE - {k} / i), lambda a, b: a * b) END)")


VIEWS = {
    "V_tasks": """SELECT CAST(item_id AS INT) AS task_idx, concat('task-', lpad(CAST(item_id AS VARCHAR), 6, '0')) AS task_id,
       concat('  ', text, chr(10)) AS prompt_complete, concat('Q: ', text) AS prompt_chat,
       concat('P', CAST(item_id % 5 AS VARCHAR)) AS project, CAST(item_id + 1 AS INT) AS bug_id,
       item_id % 2 = 0 AS defective
FROM benchmark""",
    "V_samples": """SELECT CAST(doc_id % n AS INT) AS task_idx, CAST(floor(doc_id / n) AS INT) AS sample_idx, doc_id,
       text AS output, lang, n_chars
FROM documents CROSS JOIN (SELECT count(*) AS n FROM benchmark) b""",
    "V_verdicts": """SELECT task_idx, sample_idx, quality = 1 OR n_chars >= 600 AS pass_syntax, quality = 1 AS pass_compile,
       quality = 1 AND toxic = 0 AS pass_trigger, quality = 1 AND toxic = 0 AND lang = 'fr' AS pass_all,
       n_chars >= 5000 AS timed_out
FROM V_samples JOIN labels USING (doc_id)""",
    "V_scored": """SELECT task_idx, sample_idx, doc_id, output, quality = 1 OR n_chars >= 600 AS pass_syntax,
       quality = 1 AS pass_compile, quality = 1 AND toxic = 0 AS pass_trigger,
       quality = 1 AND toxic = 0 AND lang = 'fr' AS pass_all, n_chars >= 5000 AS timed_out
FROM V_samples JOIN labels USING (doc_id)""",
    "V_answers": "SELECT task_idx, sample_idx, doc_id, concat(replace(output, 'No', 'no'), ' ', CASE doc_id % 13 "
                 + " ".join(f"WHEN {i} THEN {q(e)}" for i, e in enumerate(ANSWER_ENDINGS[:-1]))
                 + f" ELSE {q(ANSWER_ENDINGS[-1])} END) AS output FROM V_samples",
    "V_code": """SELECT page_id, concat('public int f', CAST(page_id AS VARCHAR), '(int a)') AS sig,
  concat(CASE WHEN page_id % 6 = 0 THEN 'Sure: ' ELSE concat('Sure: public int f', CAST(page_id AS VARCHAR)) END,
   CASE page_id % 7 WHEN 0 THEN '(int a) no body ' WHEN 1 THEN '(int a) { return 1; } tail }'
    WHEN 2 THEN '(int a) { s = "}"; { x(); } } tail' WHEN 3 THEN '} { y }' WHEN 4 THEN '(int a) { open '
    WHEN 5 THEN concat('(int a) { c = ''"''; } public int f', CAST(page_id AS VARCHAR), '(int b) { }')
    ELSE '{}' END, html) AS answer,
  CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'return 1; }' ELSE 'absent-text' END AS pure
FROM pages""",
    "V_signatures": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'public int f(int a)' WHEN 1 THEN concat('@Override', chr(10), 'public void g(String s)')
  WHEN 2 THEN concat('int h( // first', chr(10), ' int b)') WHEN 3 THEN '@Test public void t()'
  ELSE concat('static T k', CAST(page_id AS VARCHAR), ' (T x) // end') END || chr(10) || coalesce(html, '') AS sig
FROM pages""",
    "V_steps": """SELECT user_id, run_day, step_no, CASE WHEN step_no = n_steps THEN 'suite' ELSE 'trigger' END AS kind,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code, event_type <> 'error' AND value >= 140 AS timed_out,
  CASE WHEN event_type = 'view' THEN 'Failing tests: 2' ELSE 'Failing tests: 0' END AS last_line, value
FROM (SELECT user_id, CAST(ts AS DATE) AS run_day, event_type, value,
        row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS step_no,
        count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n_steps FROM events) e""",
    "V_twin": """SELECT CAST(floor(event_id / 2) AS BIGINT) AS sample_idx, CASE WHEN event_id % 2 = 0 THEN 'fixed' ELSE 'buggy' END AS version,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code, event_type <> 'error' AND value >= 140 AS timed_out,
  CASE WHEN event_type IN ('view', 'signup') THEN 'Failing tests: 1' ELSE 'Failing tests: 0' END AS last_line, value
FROM events""",
    "V_cov": """SELECT CAST(l_partkey % 100 AS INT) AS task_idx, l_orderkey AS sample_key, concat('C', CAST(l_suppkey AS VARCHAR)) AS class,
  concat('C', CAST(l_suppkey AS VARCHAR), '.java') AS file, CAST(l_linenumber AS VARCHAR) AS number,
  l_quantity > 30 AS hit, l_linestatus = 'O' AS cond_hit
FROM lineitem""",
    "V_cov_log": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('x', chr(10), 'Line coverage: ', CAST(o_orderkey % 101 AS VARCHAR), '.5%', chr(10), 'Condition coverage: 40.0%')
  WHEN 2 THEN 'Condition coverage: 7.0%' ELSE concat('Line coverage: 0.0%', chr(10), 'other') END AS log
FROM orders""",
    "V_err_log": """SELECT event_id, CASE WHEN event_type = 'error' THEN concat('note', chr(10), 'A', CAST(user_id % 7 AS VARCHAR), '.java:3: error: bad', chr(10), 'B.java:9: error: later') ELSE 'warn' END AS stderr,
  event_type = 'error' AS failed
FROM events""",
    "V_partials": "SELECT conv_id AS task_id, turn AS ord, text AS output, role AS gen_mode FROM conversations",
    "V_turns": "SELECT conv_id, turn, role, text FROM conversations",
    "V_chunks": """SELECT conv_id AS request_id, turn AS seq, CASE WHEN role = 'system' THEN ''
   ELSE CASE turn % 4 WHEN 0 THEN concat('f() { a', text) WHEN 1 THEN concat(text, '{ b } Yes, it has')
   WHEN 2 THEN concat(' defects } done', text) ELSE concat(' }', text) END END AS text
FROM conversations""",
    "V_chat_samples": """SELECT * REPLACE (CASE doc_id % 3 WHEN 1 THEN concat('Sure: public int f', task_idx, '(int a) { return 1; } ', output)
   WHEN 2 THEN concat('Sure: public int f', task_idx, '(int a) { ', output) ELSE output END AS output)
FROM V_samples""",
    "V_sample_lines": """SELECT task_idx, sample_idx, concat('C', task_idx) AS class, CAST(n_chars % 17 AS VARCHAR) AS number, doc_id % 2 = 0 AS hit FROM V_samples
UNION ALL SELECT task_idx, sample_idx, concat('C', task_idx), CAST(doc_id % 13 AS VARCHAR), n_chars % 2 = 0 FROM V_samples""",
    "V_classes": "SELECT p_partkey, concat(p_brand, ',', p_type, ',', p_brand) AS names FROM part",
    "V_docs": "SELECT doc_id, text, lang, n_chars FROM documents",
}

DEPS = {"V_verdicts": ["V_samples"], "V_scored": ["V_samples"], "V_answers": ["V_samples"], "V_chat_samples": ["V_samples"],
        "V_sample_lines": ["V_samples"]}


def with_views(names: list[str], ctes: list[tuple[str, str]], body: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({s})" for n, s in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def stop_ctes(src: str, keys: list[str], txt: str, name: str) -> list[tuple[str, str]]:
    """CTEs ending in ``name(keys, stop_pos)``: 1-based position of the
    character closing the first body (absent when it never closes)."""
    k = ", ".join(keys)
    chars = (f"SELECT {k}, unnest(string_split({txt}, '')) AS ch, "
             f"generate_subscripts(string_split({txt}, ''), 1) AS i FROM {src}")
    struct = f"SELECT * FROM {name}_c WHERE ch IN ('\"', '{{', '}}')"
    quotes = (f"SELECT *, sum(CASE WHEN ch = '\"' THEN 1 ELSE 0 END) OVER "
              f"(PARTITION BY {k} ORDER BY i ROWS UNBOUNDED PRECEDING) AS nq FROM {name}_s")
    delta = "CASE WHEN ch = '{' AND nq % 2 = 0 THEN 1 WHEN ch = '}' AND nq % 2 = 0 THEN -1 ELSE 0 END"
    depth = (f"SELECT *, sum({delta}) OVER (PARTITION BY {k} ORDER BY i ROWS UNBOUNDED PRECEDING) AS depth, "
             f"min(CASE WHEN ch = '{{' AND nq % 2 = 0 THEN i END) OVER (PARTITION BY {k}) AS first_open "
             f"FROM {name}_q")
    stop = f"SELECT {k}, min(i) AS stop_pos FROM {name}_d WHERE i >= first_open AND depth = 0 GROUP BY {k}"
    return [(f"{name}_c", chars), (f"{name}_s", struct), (f"{name}_q", quotes), (f"{name}_d", depth), (name, stop)]


def cut_at_stop(txt: str, stop: str) -> str:
    return f"(CASE WHEN {stop} IS NOT NULL THEN substring({txt}, 1, {stop}) ELSE {txt} END)"


def clean_sig_sql(sig: str) -> tuple[str, str]:
    """(pre, sub) expressions over a column of comment-free signatures."""
    s = sig
    blank = (f"least(CASE WHEN strpos({s}, ' ') > 0 THEN strpos({s}, ' ') END, "
             f"CASE WHEN strpos({s}, chr(10)) > 0 THEN strpos({s}, chr(10)) END)")
    cut = f"coalesce({blank} - 1, length({s}) - 1)"
    pre = f"(CASE WHEN starts_with({s}, '@') THEN concat(substring({s}, 1, {cut}), chr(10)) ELSE '' END)"
    sub = (f"(CASE WHEN starts_with({s}, '@') THEN {strip(f'split_part({strip(f'substring({s}, {cut} + 1)')}, ' + q('(') + ', 1)')} "
           f"ELSE split_part({s}, '(', 1) END)")
    return pre, sub


def strip_comments_sql(x: str) -> str:
    return f"regexp_replace({x}, '//[^\\n]*(\\n|$)', '', 'g')"


def truncate_sql(x: str) -> str:
    out = x
    for m in reversed(TRUNCATE_DEFECT_MARKERS + TRUNCATE_NO_DEFECT_MARKERS):
        out = (f"(CASE WHEN strpos({x}, {q(m)}) > 0 THEN concat(substring({x}, 1, strpos({x}, {q(m)}) - 1), {q(m)}) "
               f"ELSE {out} END)")
    return out


def duck_pattern(p: str) -> str:
    return p.replace(".", "[^\\n]")


def classify_sql(t: str) -> str:
    rules = ([(f"strpos({t}, {q(s)}) > 0", "defect") for s in DEFECT_PHRASES]
             + [(f"regexp_matches({t}, {q(duck_pattern(p))})", "defect") for p in DEFECT_PATTERNS]
             + [(f"strpos({t}, {q(s)}) > 0", "nodefect") for s in NO_DEFECT_PHRASES]
             + [(f"regexp_matches({t}, {q(duck_pattern(p))})", "nodefect") for p in NO_DEFECT_PATTERNS])
    return "(CASE " + " ".join(f"WHEN {c} THEN '{lab}'" for c, lab in rules) + " ELSE 'error' END)"


def status_sql(timed_out: str, exit_code: str, last_line: str) -> str:
    return (f"(CASE WHEN coalesce({timed_out}, false) THEN 'timeout' WHEN {exit_code} <> 0 THEN 'compile_fail' "
            f"WHEN coalesce({last_line} = 'Failing tests: 0', false) THEN 'ok' ELSE 'failed' END)")


COUNTS = ("SELECT task_idx, count(*) AS total, count(*) FILTER (WHERE pass_syntax) AS c_syntax, "
          "count(*) FILTER (WHERE pass_compile) AS c_compile, count(*) FILTER (WHERE pass_trigger) AS c_trigger, "
          "count(*) FILTER (WHERE pass_all) AS c_all, count(*) FILTER (WHERE timed_out) AS timed_out FROM {src} GROUP BY task_idx")

COUNTS_TOKENS = ("SELECT task_idx, count(*) AS total, count(*) FILTER (WHERE pass_syntax) AS c_syntax, "
                 "count(*) FILTER (WHERE pass_compile) AS c_compile, count(*) FILTER (WHERE pass_trigger) AS c_trigger, "
                 "count(*) FILTER (WHERE pass_all) AS c_all, count(*) FILTER (WHERE timed_out) AS timed_out, "
                 f"CAST(sum({ntok('output')}) AS BIGINT) AS output_tokens FROM V_scored GROUP BY task_idx")

TOKENS_JOIN = ("SELECT c.*, CAST(coalesce(p.prompt_tokens, 0) * c.total AS DOUBLE) * 0.5::DOUBLE + c.output_tokens AS total_tokens "
               "FROM counts0 c LEFT JOIN (SELECT task_idx, " + ntok(strip("prompt_complete")) +
               " AS prompt_tokens FROM V_tasks) p USING (task_idx)")


def flags_long(src: str, extra: str = "", flags=FLAGS) -> str:
    return " UNION ALL ".join(
        f"SELECT task_idx, total{extra}, '{f}' AS flag, CAST(c_{f.removeprefix('pass_')} AS BIGINT) AS c FROM {src}"
        for f in flags)


def grid(values) -> str:
    return "(VALUES " + ", ".join(f"({v})" for v in values) + ")"


def passk_rows(src: str, k_grid, flags=FLAGS) -> str:
    return (f"SELECT task_idx, flag, 'pass@k' AS metric, CAST(k AS DOUBLE) AS param, total AS n, c, "
            f"{passk('total', 'c', 'CAST(k AS DOUBLE)')} AS value FROM ({flags_long(src, flags=flags)}) f, {grid(k_grid)} g(k) "
            f"WHERE total >= k")


def passt_rows(src: str, t_grid, flags=FLAGS) -> str:
    kk = "(CAST(t AS DOUBLE) / (total_tokens / total))"
    return (f"SELECT task_idx, flag, 'pass@t' AS metric, CAST(t AS DOUBLE) AS param, total AS n, c, "
            f"{passk('total', 'c', kk)} AS value FROM ({flags_long(src, ', total_tokens', flags)}) f, {grid(t_grid)} g(t) "
            f"WHERE total_tokens >= t")


def suite_rows(rows: str, by: str = "") -> str:
    return (f"SELECT {by}flag, metric, param, count(*) AS n_tasks, round(avg(value), 9) AS value "
            f"FROM ({rows}) m GROUP BY {by}flag, metric, param")


def merged_sql(n: int) -> str:
    return with_views(["V_partials"], [], f"""SELECT CAST(task_id AS VARCHAR) AS task_id, string_agg(output, {SEP} ORDER BY ord) AS outputs,
  arg_min(gen_mode, ord) AS gen_mode, count(*) AS n_outputs
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ord) AS rn FROM V_partials) WHERE rn <= {n} GROUP BY task_id""")


def detail_sql() -> str:
    cols = ["task_idx", "total", "timed_out", "round(total_tokens, 9) AS total_tokens"]
    for f in FLAGS:
        c = f"c_{f.removeprefix('pass_')}"
        cols.append(f"{c} AS {f}__count")
        for k in K_GRID_COMPLETE:
            cols.append(f"round(CASE WHEN total >= {k} THEN {passk('total', c, f'{k}.0::DOUBLE')} END, 9) AS {f}__pass_at_k_{k}")
        for t in T_GRID:
            kk = f"({t}.0::DOUBLE / (total_tokens / total))"
            cols.append(f"round(CASE WHEN total_tokens >= {t} THEN {passk('total', c, kk)} END, 9) AS {f}__pass_at_t_{t}")
    return with_views(["V_scored", "V_tasks"], [("counts0", COUNTS_TOKENS), ("counts", TOKENS_JOIN)],
                      "SELECT " + ", ".join(cols) + " FROM counts")


def confusion_sql(group: str) -> str:
    lab = ("SELECT a.task_idx, a.sample_idx, t.defective, " + classify_sql("tr") + " AS label FROM (SELECT *, "
           + truncate_sql("output") + " AS tr FROM V_answers) a JOIN V_tasks t USING (task_idx)")
    conf = ("count(*) AS total, count(*) FILTER (WHERE label = 'error') AS error, "
            "count(*) FILTER (WHERE (label = 'defect' AND defective) OR (label = 'nodefect' AND NOT defective)) AS correct, "
            "count(*) FILTER (WHERE label = 'defect' AND defective) AS tp, "
            "count(*) FILTER (WHERE label = 'nodefect' AND NOT defective) AS tn, "
            "count(*) FILTER (WHERE label = 'defect' AND NOT defective) AS fp, "
            "count(*) FILTER (WHERE label = 'nodefect' AND defective) AS fn")
    if group == "none":
        return with_views(["V_answers", "V_tasks"], [("lab", lab)], f"SELECT {conf} FROM lab")
    var = ("SELECT *, 'all' AS variant FROM lab UNION ALL SELECT *, 'one' AS variant FROM lab WHERE sample_idx = 0")
    return with_views(["V_answers", "V_tasks"], [("lab", lab), ("var", var)],
                      f"SELECT variant, {conf} FROM var GROUP BY variant")


def scores_sql(conf_sql: str, keys: str) -> str:
    p = "(CAST(tp AS DOUBLE) / nullif(tp + fp, 0))"
    r = "(CAST(tp AS DOUBLE) / nullif(tp + fn, 0))"
    return (f"SELECT {keys}total, error, correct, tp, tn, fp, fn, "
            f"round(CAST(correct AS DOUBLE) / nullif(total - error, 0), 9) AS acc, "
            f"round(CAST(correct AS DOUBLE) / nullif(total, 0), 9) AS acc_w_error, "
            f"round({p}, 9) AS precision, round({r}, 9) AS recall, "
            f"round(2 * {p} * {r} / nullif({p} + {r}, 0), 9) AS f1 FROM ({conf_sql}) c")


def _screen_sql() -> str:
    """Well-formed strings, char literals and comments are taken out, leftmost first; what is left must hold no opening of
    one, and its braces must be balanced."""
    whole = r"""'\"(?s:[^"\\]|\\.)*"|''(?s:[^''\\]|\\.)*''|//[^\n]*|/\*(?s:[^*]|\*+[^*/])*\*+/'"""
    bare = f"SELECT page_id, regexp_replace(answer, {whole}, ' ', 'g') AS t FROM V_code"
    chars = ("SELECT page_id, i, CASE ch WHEN '{' THEN 1 ELSE -1 END AS d FROM (SELECT page_id, unnest(string_split(t, '')) AS ch, "
             "generate_subscripts(string_split(t, ''), 1) AS i FROM bare) WHERE ch IN ('{', '}')")
    depth = "SELECT page_id, d, sum(d) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS depth FROM chars"
    fin = "SELECT page_id, sum(d) AS depth, min(depth) AS least FROM depths GROUP BY page_id"
    return with_views(["V_code"], [("bare", bare), ("chars", chars), ("depths", depth), ("fin", fin)],
                      "SELECT page_id, NOT regexp_matches(t, '[\"'']|/\\*') AND coalesce(depth, 0) = 0 AND coalesce(least, 0) >= 0 AS structurally_ok "
                      "FROM bare LEFT JOIN fin USING (page_id)")


def _stream_function_sql(prefix: str = "", prompt: bool = False) -> str:
    """Stop chunk = the chunk holding the first closing character of the scan
    over ``prefix + all chunks``; output = the chunks up to it."""
    n = len(prefix)
    full = (f"SELECT request_id, string_agg(text, '' ORDER BY seq) AS txt, "
            f"concat({q(prefix)}, string_agg(text, '' ORDER BY seq)) AS scanned FROM V_chunks GROUP BY request_id")
    cum = ("SELECT request_id, seq, sum(length(text)) OVER (PARTITION BY request_id ORDER BY seq "
           "ROWS UNBOUNDED PRECEDING) AS cum_end FROM V_chunks")
    ss = ("SELECT c.request_id, min(c.seq) AS stop_seq, min(c.cum_end) AS stop_end FROM cum c JOIN st USING (request_id) "
          f"WHERE c.cum_end + {n} >= st.stop_pos GROUP BY c.request_id")
    output = "CASE WHEN stop_seq IS NULL THEN txt ELSE substring(txt, 1, CAST(stop_end AS BIGINT)) END"
    source = "full_text LEFT JOIN ss USING (request_id)"
    if prompt:
        output = f"concat({strip('prompt_complete')}, {output})"
        source += " JOIN V_tasks ON task_idx = request_id % (SELECT count(*) FROM benchmark)"
    return with_views(["V_chunks", "V_tasks"], [("full_text", full), ("cum", cum)] + stop_ctes("full_text", ["request_id"], "scanned", "st")
                      + [("ss", ss)], f"SELECT request_id, stop_seq, {output} AS output FROM {source}")


def _stream_chat_sql(sig: str) -> str:
    """After each chunk: the text between the first and second signature
    occurrence of everything so far must close a body."""
    cum = ("SELECT request_id, seq, string_agg(text, '' ORDER BY seq) OVER (PARTITION BY request_id ORDER BY seq "
           "ROWS UNBOUNDED PRECEDING) AS so_far FROM V_chunks")
    seg = f"SELECT request_id, seq, split_part(so_far, {q(sig)}, 2) AS segment FROM cum WHERE strpos(so_far, {q(sig)}) > 0"
    st = "SELECT request_id, min(seq) AS stop_seq FROM sp GROUP BY request_id"
    last = "SELECT request_id, max(seq) AS last_seq FROM V_chunks GROUP BY request_id"
    return with_views(["V_chunks"], [("cum", cum), ("seg", seg)] + stop_ctes("seg", ["request_id", "seq"], "segment", "sp")
                      + [("st", st), ("lastseq", last)],
                      "SELECT l.request_id, st.stop_seq, c.so_far AS output FROM lastseq l LEFT JOIN st USING (request_id) "
                      "JOIN cum c ON c.request_id = l.request_id AND c.seq = coalesce(st.stop_seq, l.last_seq)")


def _stream_marker_sql() -> str:
    cum = ("SELECT request_id, seq, string_agg(text, '' ORDER BY seq) OVER (PARTITION BY request_id ORDER BY seq "
           "ROWS UNBOUNDED PRECEDING) AS so_far FROM V_chunks")
    st = ("SELECT request_id, min(seq) AS stop_seq FROM cum WHERE strpos(so_far, 'Yes, it has defects') > 0 "
          "OR strpos(so_far, 'No, it doesn''t have defects') > 0 GROUP BY request_id")
    last = "SELECT request_id, max(seq) AS last_seq FROM V_chunks GROUP BY request_id"
    return with_views(["V_chunks"], [("cum", cum), ("st", st), ("lastseq", last)],
                      "SELECT l.request_id, st.stop_seq, c.so_far AS output FROM lastseq l LEFT JOIN st USING (request_id) "
                      "JOIN cum c ON c.request_id = l.request_id AND c.seq = coalesce(st.stop_seq, l.last_seq)")


def _postprocessed_ctes() -> list[tuple[str, str]]:
    """CTEs ending in ``pp(task_idx, sample_idx, input, output, raw_output)``:
    complete-mode post-processing of V_samples against V_tasks."""
    j = ("SELECT s.task_idx, s.sample_idx, s.output, t.prompt_complete, "
         "substring(s.output, length(t.prompt_complete) + 1) AS cut FROM V_samples s JOIN V_tasks t USING (task_idx)")
    pure = "SELECT j.*, " + cut_at_stop("cut", "sp.stop_pos") + " AS pure FROM j LEFT JOIN sp USING (task_idx, sample_idx)"
    pp = (f"SELECT task_idx, sample_idx, {strip('prompt_complete')} AS input, pure AS output, "
          "CASE WHEN length(pure) = 0 THEN '' WHEN strpos(output, pure) > 0 "
          "THEN substring(output, 1, strpos(output, pure) - 1 + length(pure)) ELSE output END AS raw_output FROM p")
    return [("j", j)] + stop_ctes("j", ["task_idx", "sample_idx"], "cut", "sp") + [("p", pure), ("pp", pp)]


def _postprocessed_sql() -> str:
    return with_views(["V_samples", "V_tasks"], _postprocessed_ctes(),
                      "SELECT task_idx, sample_idx, input, output, raw_output FROM pp")


def _evaluate_complete_sql(where: str = "true") -> str:
    """One population: the selected samples that have a verdict, for counts and tokens alike."""
    sel = f"SELECT * FROM pp JOIN (SELECT * FROM V_verdicts WHERE {where}) v USING (task_idx, sample_idx)"
    tc = (f"SELECT task_idx, CAST(sum({ntok('raw_output')}) AS BIGINT) AS output_tokens, "
          f"CAST({ntok('any_value(input)')} AS BIGINT) * count(*) AS input_tokens FROM sel GROUP BY task_idx")
    counts = ("SELECT vc.*, CAST(input_tokens AS DOUBLE) * 0.5::DOUBLE + output_tokens AS total_tokens "
              "FROM vc LEFT JOIN tc USING (task_idx)")
    rows = passk_rows("counts", K_GRID_COMPLETE) + " UNION ALL " + passt_rows("counts", T_GRID)
    return with_views(["V_samples", "V_tasks", "V_verdicts"],
                      _postprocessed_ctes() + [("sel", sel), ("tc", tc), ("vc", COUNTS.format(src="sel")), ("counts", counts)],
                      suite_rows(rows))


def _chat_ctes(strip_sig: bool) -> list[tuple[str, str]]:
    """CTEs ending in ``pp``: chat-mode post-processing of V_chat_samples."""
    sig = "concat('public int f', task_idx, '(int a)')"
    pre, sub = clean_sig_sql("s")
    base = f"SELECT *, {strip_comments_sql(strip(sig) if strip_sig else sig)} AS s FROM V_chat_samples JOIN V_tasks USING (task_idx)"
    parts = f"SELECT *, {pre} AS pre, {sub} AS sub FROM base"
    seg = "SELECT task_idx, sample_idx, split_part(output, sub, 2) AS part FROM parts WHERE strpos(output, sub) > 0"
    pure = ("SELECT parts.*, CASE WHEN strpos(output, sub) > 0 THEN concat(pre, sub, " + cut_at_stop("part", "x.stop_pos")
            + f") ELSE concat({q(MISSING_FUNCTION_PREFIX)}, output) END AS pure FROM parts LEFT JOIN seg USING (task_idx, sample_idx) "
            "LEFT JOIN x USING (task_idx, sample_idx)")
    pp = (f"SELECT task_idx, sample_idx, {strip('prompt_chat')} AS input, pure AS output, CASE WHEN length(pure) = 0 THEN '' "
          "WHEN strpos(output, pure) > 0 THEN substring(output, 1, strpos(output, pure) - 1 + length(pure)) ELSE output END AS raw_output FROM p")
    return [("base", base), ("parts", parts), ("seg", seg)] + stop_ctes("seg", ["task_idx", "sample_idx"], "part", "x") + [("p", pure), ("pp", pp)]


def _step(code: str, late: str, failing: str) -> str:
    """Status of a test step from what its facts are made of."""
    return f"(CASE WHEN {late} THEN 'timeout' WHEN {code} THEN 'compile_fail' WHEN {failing} = 0 THEN 'ok' ELSE 'failed' END)"


_STATUS = ("SELECT task_idx, sample_idx, n_chars % 17 <> 0 AS syn, " + _step("doc_id % 7 = 0", "n_chars >= 5000", "doc_id % 3") + " AS one, "
           + _step("doc_id % 11 = 0", "n_chars % 13 = 0", "doc_id % 2") + " AS two, " + _step("doc_id % 5 = 0", "false", "doc_id % 4") + " AS buggy, "
           "doc_id % 11 <> 0 AND n_chars % 13 <> 0 AS covered, (n_chars % 101) / 100.0::DOUBLE AS lines, (doc_id % 101) / 100.0::DOUBLE AS conds FROM V_samples")
_PATCH = ("SELECT task_idx, sample_idx, syn AS pass_syntax, syn AND one <> 'compile_fail' AS pass_compile, "
          "syn AND one = 'ok' AND two NOT IN ('timeout', 'compile_fail') AS pass_trigger, syn AND one = 'ok' AND two = 'ok' AS pass_all, "
          "syn AND one = 'timeout' AS timed_out FROM st")


def _covered(passed: str, compile_fail: str, late: str) -> str:
    return (f"SELECT task_idx, sample_idx, syn AS pass_syntax, syn AND NOT {compile_fail} AS pass_compile, "
            f"syn AND {passed} AND covered AND lines <> 0 AS pass_trigger, false AS pass_all, syn AND {late} AS timed_out, "
            f"CASE WHEN syn AND {passed} AND covered THEN lines ELSE 0.0::DOUBLE END AS line_coverage, "
            f"CASE WHEN syn AND {passed} AND covered THEN conds ELSE 0.0::DOUBLE END AS condition_coverage FROM st")


_TEST = _covered("one = 'ok'", "one = 'compile_fail'", "one = 'timeout'")
_ISSUE = _covered("one = 'ok' AND buggy <> 'ok'", "(one = 'compile_fail' OR buggy = 'compile_fail')", "(one = 'timeout' OR buggy = 'timeout')")
K_GRID_DEFAULT = [1, 5, 10, 20, 100]


def _evaluate_sql(samples: list[tuple[str, str]], verdict: str, flags: list[str], k_grid: list[int], coverage: bool, where: str = "true") -> str:
    """Suite metrics, and per task the triggered samples and the coverage, of the selected samples."""
    sel = f"SELECT * FROM pp JOIN vd USING (task_idx, sample_idx) WHERE {where}"
    cover = ", avg(line_coverage) AS line_coverage, avg(condition_coverage) AS condition_coverage" if coverage else ""
    counts = (f"SELECT v.*, t.* EXCLUDE (task_idx) FROM ({COUNTS.format(src='sel')}) v JOIN (SELECT task_idx, "
              f"CAST({ntok('any_value(input)')} AS BIGINT) * count(*) * 0.5::DOUBLE + CAST(sum({ntok('raw_output')}) AS BIGINT) AS total_tokens{cover} "
              "FROM sel GROUP BY task_idx) t USING (task_idx)")
    ctes = samples + [("st", _STATUS), ("vd", verdict), ("sel", sel), ("counts", counts)]
    rows = passk_rows("counts", k_grid, flags) + " UNION ALL " + passt_rows("counts", T_GRID, flags)
    out = [f"SELECT 'suite' AS level, CAST(NULL AS INT) AS task_idx, flag, metric, param, n_tasks AS n, value FROM ({suite_rows(rows)})",
           "SELECT 'task', task_idx, 'pass_trigger', 'count', 0.0::DOUBLE, total, CAST(c_trigger AS DOUBLE) FROM counts"]
    if coverage:
        ratio = ("SELECT task_idx, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS diff_coverage FROM (SELECT DISTINCT task_idx, class, "
                 "number, hit FROM V_sample_lines JOIN (SELECT task_idx, sample_idx FROM sel) USING (task_idx, sample_idx)) GROUP BY task_idx")
        ctes.append(("ratio", ratio))
        out += [f"SELECT 'task', task_idx, 'coverage', '{c}', 0.0::DOUBLE, total, round({c}, 9) FROM counts LEFT JOIN ratio USING (task_idx)"
                for c in ("line_coverage", "condition_coverage", "diff_coverage")]
    return with_views(["V_samples", "V_tasks", "V_chat_samples", "V_sample_lines"], ctes, " UNION ALL ".join(out))


def _extract_sql() -> str:
    s0 = strip_comments_sql(strip("sig"))
    pre, sub = clean_sig_sql("s")
    base = f"SELECT page_id, answer, {s0} AS s FROM V_code"
    parts = f"SELECT page_id, answer, {pre} AS pre, {sub} AS sub FROM base"
    seg = "SELECT page_id, answer, pre, sub, split_part(answer, sub, 2) AS part FROM parts WHERE length(sub) > 0"
    body = (f"SELECT p.page_id, CASE WHEN length(p.sub) = 0 THEN NULL WHEN strpos(p.answer, p.sub) > 0 "
            f"THEN concat(p.pre, p.sub, {cut_at_stop('g.part', 'x.stop_pos')}) "
            f"ELSE concat({q(MISSING_FUNCTION_PREFIX)}, p.answer) END AS function FROM parts p "
            "LEFT JOIN seg g USING (page_id) LEFT JOIN x USING (page_id)")
    return with_views(["V_code"], [("base", base), ("parts", parts), ("seg", seg)] + stop_ctes("seg", ["page_id"], "part", "x"),
                      body)


def _coverage_summary_sql() -> str:
    lines = (f"SELECT o_orderkey, CASE WHEN log = '' THEN []::VARCHAR[] ELSE string_split(CASE WHEN ends_with(log, {NL}) "
             f"THEN substring(log, 1, length(log) - 1) ELSE log END, {NL}) END AS l FROM V_cov_log")

    def val(line, label):
        raw = "replace(" + strip("regexp_extract(" + line + ", " + q("[^:]*$") + ")") + ", '%', '')"
        return (f"coalesce(CASE WHEN strpos({line}, {q(label)}) > 0 THEN coalesce(TRY_CAST({raw} AS DOUBLE) / 100.0::DOUBLE, 0.0::DOUBLE) "
                f"ELSE 0.0::DOUBLE END, 0.0::DOUBLE)")

    sl = "(CASE WHEN len(l) >= 2 THEN l[len(l) - 1] END)"
    la = "(CASE WHEN len(l) >= 1 THEN l[len(l)] END)"
    return with_views(["V_cov_log"], [("ls", lines)],
                      f"SELECT o_orderkey, round({val(sl, 'Line coverage:')}, 9) AS line_coverage, "
                      f"round({val(la, 'Condition coverage:')}, 9) AS condition_coverage FROM ls")


def _testgen_sql() -> str:
    st = (f"SELECT user_id, run_day, step_no, exit_code, timed_out, value >= 1.0 AS syntax_ok, "
          f"{status_sql('timed_out', 'exit_code', 'last_line')} AS status, CAST(floor(value) AS BIGINT) AS vf FROM V_steps")
    lc = "TRY_CAST(concat(CAST(vf % 100 AS VARCHAR), '.5') AS DOUBLE) / 100.0::DOUBLE"
    cc = "TRY_CAST(concat(CAST(vf % 7 AS VARCHAR), '.0') AS DOUBLE) / 100.0::DOUBLE"
    r = (f"SELECT user_id, run_day, max(CASE WHEN step_no = 1 THEN status END) AS test, "
         f"max(CASE WHEN step_no = 2 AND exit_code = 0 AND NOT timed_out THEN {lc} END) AS cl, "
         f"max(CASE WHEN step_no = 2 AND exit_code = 0 AND NOT timed_out THEN {cc} END) AS cc, "
         f"bool_and(syntax_ok) AS syn FROM st GROUP BY user_id, run_day")
    line = "(CASE WHEN syn AND coalesce(test = 'ok', false) THEN coalesce(cl, 0.0::DOUBLE) ELSE 0.0::DOUBLE END)"
    cond = "(CASE WHEN syn AND coalesce(test = 'ok', false) THEN coalesce(cc, 0.0::DOUBLE) ELSE 0.0::DOUBLE END)"
    return with_views(["V_steps"], [("st", st), ("r", r)],
                      f"SELECT user_id, CAST(run_day AS VARCHAR) AS run_day, syn AS pass_syntax, "
                      f"syn AND NOT coalesce(test = 'compile_fail', false) AS pass_compile, "
                      f"syn AND coalesce(test = 'ok', false) AND cl IS NOT NULL AND {line} <> 0 AS pass_trigger, "
                      f"round({line}, 9) AS line_coverage, round({cond}, 9) AS condition_coverage, "
                      f"syn AND coalesce(test = 'timeout', false) AS timed_out FROM r")


def _issue_sql() -> str:
    p = ("SELECT sample_idx, "
         "max(CASE WHEN version = 'fixed' THEN exit_code END) AS fe, max(CASE WHEN version = 'fixed' THEN timed_out END) AS ft, "
         "max(CASE WHEN version = 'fixed' THEN last_line END) AS fl, max(CASE WHEN version = 'buggy' THEN exit_code END) AS be, "
         "max(CASE WHEN version = 'buggy' THEN timed_out END) AS bt, max(CASE WHEN version = 'buggy' THEN last_line END) AS bl, "
         "max(CASE WHEN version = 'fixed' AND CAST(floor(value) AS BIGINT) % 9 <> 0 THEN (CAST(floor(value) AS BIGINT) % 20) / 20.0::DOUBLE END) AS cl, "
         "max(CASE WHEN version = 'fixed' AND CAST(floor(value) AS BIGINT) % 9 <> 0 THEN (CAST(floor(value) AS BIGINT) % 7) / 7.0::DOUBLE END) AS cc, "
         "bool_and(value >= 1.0) AS syn FROM V_twin GROUP BY sample_idx")
    s = (f"SELECT *, {status_sql('ft', 'fe', 'fl')} AS fs, {status_sql('bt', 'be', 'bl')} AS bs FROM p")
    passed = "(fs = 'ok' AND bs <> 'ok')"
    line = f"(CASE WHEN syn AND {passed} THEN coalesce(cl, 0.0::DOUBLE) ELSE 0.0::DOUBLE END)"
    cond = f"(CASE WHEN syn AND {passed} THEN coalesce(cc, 0.0::DOUBLE) ELSE 0.0::DOUBLE END)"
    return with_views(["V_twin"], [("p", p), ("s", s)],
                      f"SELECT sample_idx, syn AS pass_syntax, syn AND NOT (fs = 'compile_fail' OR bs = 'compile_fail') AS pass_compile, "
                      f"syn AND {passed} AND cl IS NOT NULL AND {line} <> 0 AS pass_trigger, round({line}, 9) AS line_coverage, "
                      f"round({cond}, 9) AS condition_coverage, syn AND (fs = 'timeout' OR bs = 'timeout') AS timed_out FROM s")


def _patch_verdict_sql() -> str:
    st = (f"SELECT *, {status_sql('timed_out', 'exit_code', 'last_line')} AS status, value >= 1.0 AS syntax_ok FROM V_steps")
    r = ("SELECT user_id, run_day, arg_min(status, step_no) FILTER (WHERE kind = 'trigger' AND status <> 'ok') AS first_fail, "
         "arg_max(status, step_no) FILTER (WHERE kind = 'suite') AS suite, bool_and(syntax_ok) AS syn FROM st GROUP BY user_id, run_day")
    return with_views(["V_steps"], [("st", st), ("r", r)],
                      "SELECT user_id, CAST(run_day AS VARCHAR) AS run_day, syn AS pass_syntax, "
                      "syn AND NOT coalesce(first_fail = 'compile_fail', false) AS pass_compile, "
                      "syn AND NOT (first_fail IS NOT NULL OR coalesce(suite IN ('timeout', 'compile_fail'), false)) AS pass_trigger, "
                      "syn AND first_fail IS NULL AND coalesce(suite = 'ok', false) AS pass_all, "
                      "syn AND coalesce(first_fail = 'timeout', false) AS timed_out FROM r")


def _leaderboard_sql() -> str:
    return with_views(["V_verdicts"], [("counts", COUNTS.format(src="V_verdicts"))],
                      suite_rows(passk_rows("counts", K_GRID_COMPLETE)))


def _token_cost_sql() -> str:
    pt = f"SELECT task_idx, CAST({ntok(strip('prompt_complete'))} AS BIGINT) AS prompt_tokens FROM V_tasks"
    st = f"SELECT task_idx, count(*) AS n_samples, CAST(sum({ntok('output')}) AS BIGINT) AS output_tokens FROM V_samples GROUP BY task_idx"
    return with_views(["V_samples", "V_tasks"], [("pt", pt), ("st", st)],
                      "SELECT task_idx, n_samples, coalesce(prompt_tokens, 0) * n_samples AS input_tokens, output_tokens, "
                      "round(CAST(coalesce(prompt_tokens, 0) * n_samples AS DOUBLE) * 0.5::DOUBLE + output_tokens, 9) AS total_tokens "
                      "FROM st LEFT JOIN pt USING (task_idx)")


def _level_sql(views, ctes, per_task_sql, cols):
    avg_cols = ", ".join(f"round(avg({c}), 9) AS {c}" for c in cols)
    rnd = ", ".join(f"round({c}, 9) AS {c}" for c in cols)
    return with_views(views, ctes + [("pt", per_task_sql)],
                      f"SELECT 'task' AS level, task_idx, {rnd} FROM pt UNION ALL "
                      f"SELECT 'suite' AS level, CAST(NULL AS INT) AS task_idx, {avg_cols} FROM pt")


def oracle_sql() -> dict[str, str]:
    qs: dict[str, str] = {}
    qs["load_tasks"] = with_views(["V_tasks"], [], "SELECT task_idx, task_id, prompt_complete, prompt_chat, project, bug_id, defective FROM V_tasks")
    qs["load_generations"] = with_views(["V_samples"], [], "SELECT task_idx, sample_idx, output FROM V_samples")
    partials = with_views(["V_partials"], [], "SELECT CAST(task_id AS VARCHAR) AS task_id, ord, gen_mode, output FROM V_partials")
    qs["load_partials"] = partials
    qs["load_coverage_xml"] = (
        "WITH base AS (SELECT l_orderkey, l_linenumber, concat('C', CAST(l_suppkey AS VARCHAR)) AS class, "
        "concat('C', CAST(l_suppkey AS VARCHAR), '.java') AS file, CAST(l_linenumber AS VARCHAR) AS number, "
        "CAST(l_quantity AS INT) % 3 > 0 AS hit FROM lineitem) "
        "SELECT l_orderkey, l_linenumber, class, file, number, hit FROM base UNION ALL "
        "SELECT l_orderkey, l_linenumber, class, file, number, hit FROM base UNION ALL "
        "SELECT l_orderkey, l_linenumber, class, file, '99' AS number, false AS hit FROM base")
    qs["load_run_steps"] = with_views(["V_steps"], [], "SELECT user_id, CAST(run_day AS VARCHAR) AS run_day, CAST(step_no AS INT) AS step_no, "
                                      "kind, exit_code, timed_out, last_line FROM V_steps")
    qs["write_partials"] = partials
    qs["write_merged"] = merged_sql(5)
    qs["write_postprocessed"] = _postprocessed_sql()
    qs["write_results"] = _leaderboard_sql()
    qs["select_prompt"] = with_views(["V_tasks"], [], f"SELECT task_idx, {strip('prompt_complete')} AS complete_prompt, "
                                     f"{strip('prompt_chat')} AS chat_prompt FROM V_tasks")
    qs["filter_generate_range"] = with_views(["V_samples"], [], "SELECT task_idx, sample_idx, doc_id FROM V_samples WHERE task_idx >= 2 AND task_idx < 30")
    qs["filter_evaluate_range"] = with_views(["V_samples"], [], "SELECT task_idx, sample_idx, doc_id FROM V_samples WHERE task_idx >= 2 AND task_idx <= 30")
    req = with_views(["V_tasks"], [], f"SELECT task_idx, task_id, CAST(copy_no AS INT) AS copy_no, {strip('prompt_complete')} AS prompt "
                     "FROM V_tasks, (SELECT unnest(range(1, 8)) AS copy_no) c")
    qs["expand_requests"] = req
    qs["flatten_samples"] = qs["load_generations"]
    qs["first_n_samples"] = with_views(["V_samples"], [], "SELECT task_idx, sample_idx, doc_id FROM (SELECT *, row_number() OVER "
                                       "(PARTITION BY task_idx ORDER BY sample_idx) AS rn FROM V_samples) WHERE rn <= 3")
    qs["flag_error_outputs"] = with_views(["V_answers"], [], "SELECT task_idx, sample_idx, (CASE WHEN ends_with(output, ' $ERROR$') THEN '$ERROR$' "
                                          "WHEN ends_with(output, ' ERROR') THEN 'ERROR' ELSE output END) IN ('$ERROR$', 'ERROR') AS is_error FROM V_answers")
    qs["attach_task"] = with_views(["V_samples", "V_tasks"], [], "SELECT task_idx, sample_idx, project, bug_id, defective FROM V_samples LEFT JOIN V_tasks USING (task_idx)")
    qs["attach_prompt"] = with_views(["V_samples", "V_tasks"], [], f"SELECT task_idx, sample_idx, {strip('prompt_chat')} AS input "
                                     "FROM V_samples LEFT JOIN V_tasks USING (task_idx)")
    qs["pair_twin_runs"] = with_views(["V_twin"], [], "SELECT sample_idx, "
                                      + ", ".join(f"max(CASE WHEN version = '{s}' THEN {f} END) AS {s}_{f}"
                                                  for s in ("fixed", "buggy") for f in ("exit_code", "timed_out", "last_line"))
                                      + " FROM V_twin GROUP BY sample_idx")
    qs["merge_partials"] = merged_sql(5)
    qs["task_verdict_counts"] = with_views(["V_verdicts"], [], COUNTS.format(src="V_verdicts"))
    qs["pass_at_k_task"] = with_views(["V_verdicts"], [("counts", COUNTS.format(src="V_verdicts"))],
                                      "SELECT task_idx, flag, metric, param, n, c, round(value, 9) AS value FROM ("
                                      + passk_rows("counts", K_GRID_COMPLETE) + ")")
    tok_ctes = [("counts0", COUNTS_TOKENS), ("counts", TOKENS_JOIN)]
    qs["pass_at_t_task"] = with_views(["V_scored", "V_tasks"], tok_ctes,
                                      "SELECT task_idx, flag, metric, param, n, c, round(value, 9) AS value FROM ("
                                      + passt_rows("counts", T_GRID) + ")")
    qs["suite_pass_metrics"] = with_views(["V_scored", "V_tasks"], tok_ctes,
                                          suite_rows(passk_rows("counts", K_GRID_COMPLETE) + " UNION ALL " + passt_rows("counts", T_GRID)))
    qs["suite_solved_counts"] = with_views(["V_verdicts"], [("counts", COUNTS.format(src="V_verdicts"))],
                                           "SELECT count(*) AS total, count(*) FILTER (WHERE c_syntax > 0) AS solved_syntax, "
                                           "count(*) FILTER (WHERE c_compile > 0) AS solved_compile, count(*) FILTER (WHERE c_trigger > 0) AS solved_trigger, "
                                           "count(*) FILTER (WHERE c_all > 0) AS solved_all, CAST(sum(timed_out) AS BIGINT) AS timed_out FROM counts")
    qs["task_detail_report"] = detail_sql()
    qs["token_cost"] = _token_cost_sql()
    qs["reduce_patch_verdict"] = _patch_verdict_sql()
    qs["reduce_testgen_verdict"] = _testgen_sql()
    qs["reduce_issue_verdict"] = _issue_sql()
    qs["defect_confusion"] = confusion_sql("none")
    qs["defect_scores"] = scores_sql(confusion_sql("none"), "")
    qs["defect_variants"] = scores_sql(confusion_sql("variant"), "variant, ")
    qs["coverage_means"] = _level_sql(["V_cov"], [("ps", "SELECT task_idx, sample_key, avg(CAST(hit AS DOUBLE)) AS line_coverage, "
                                                         "avg(CAST(cond_hit AS DOUBLE)) AS condition_coverage FROM V_cov GROUP BY task_idx, sample_key")],
                                      "SELECT task_idx, avg(line_coverage) AS line_coverage, avg(condition_coverage) AS condition_coverage "
                                      "FROM ps GROUP BY task_idx", ["line_coverage", "condition_coverage"])
    qs["diff_coverage"] = _level_sql(["V_cov"], [
        ("tup", "SELECT DISTINCT task_idx, class, file, number, hit FROM V_cov"),
        ("tasks", "SELECT DISTINCT CAST(p_partkey % 100 AS INT) AS task_idx FROM part"),
        ("r", "SELECT task_idx, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS ratio FROM tup GROUP BY task_idx")],
        "SELECT task_idx, coalesce(ratio, 0.0::DOUBLE) AS diff_coverage FROM tasks LEFT JOIN r USING (task_idx)", ["diff_coverage"])
    qs["diff_coverage_incremental"] = qs["diff_coverage"]
    qs["target_classes"] = with_views(["V_classes"], [], "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(names, ','))), ',') AS classes FROM V_classes")
    qs["order_by_task"] = "SELECT task_id, n_outputs FROM (" + merged_sql(5) + ")"
    qs["shard_requests"] = with_views(["V_tasks"], [("req", "SELECT task_idx, CAST(copy_no AS INT) AS copy_no FROM V_tasks, (SELECT unnest(range(1, 8)) AS copy_no) c")],
                                      "SELECT task_idx, copy_no, CAST((row_number() OVER (ORDER BY md5(concat('42', '-', CAST(task_idx AS VARCHAR), '-', "
                                      "CAST(copy_no AS VARCHAR))), task_idx, copy_no) - 1) % 8 AS INT) AS shard_id FROM req")
    qs["strip_line_comments"] = with_views(["V_signatures"], [], f"SELECT page_id, {strip_comments_sql('sig')} AS sig FROM V_signatures")
    pre, sub = clean_sig_sql("s")
    qs["clean_signature"] = with_views(["V_signatures"], [("cs", f"SELECT page_id, {strip_comments_sql('sig')} AS s FROM V_signatures")],
                                       f"SELECT page_id, {pre} AS pre, {sub} AS sub FROM cs")
    qs["drop_prompt_prefix"] = with_views(["V_samples", "V_tasks"], [], "SELECT task_idx, sample_idx, substring(output, length(prompt_complete) + 1) AS output "
                                          "FROM V_samples JOIN V_tasks USING (task_idx)")
    qs["stop_at_function"] = with_views(["V_code"], stop_ctes("V_code", ["page_id"], "answer", "sp"),
                                        f"SELECT page_id, {cut_at_stop('answer', 'stop_pos')} AS function FROM V_code LEFT JOIN sp USING (page_id)")
    qs["extract_chat_function"] = _extract_sql()
    hits = ", ".join(f"CASE WHEN strpos(text, {q(t)}) > 0 THEN strpos(text, {q(t)}) END" for t in ["\n", "public", "/**"])
    qs["stop_at_stop_token"] = with_views(["V_docs"], [("h", f"SELECT doc_id, text, least({hits}) AS p FROM V_docs")],
                                          "SELECT doc_id, CASE WHEN p IS NULL THEN text ELSE substring(text, 1, p - 1) END AS text FROM h")
    qs["truncate_defect_answer"] = with_views(["V_answers"], [], f"SELECT task_idx, sample_idx, {truncate_sql('output')} AS truncated FROM V_answers")
    qs["classify_defect_answer"] = with_views(["V_answers"], [("t", f"SELECT task_idx, sample_idx, {truncate_sql('output')} AS tr FROM V_answers")],
                                              f"SELECT task_idx, sample_idx, {classify_sql('tr')} AS label FROM t")
    qs["reconstruct_raw_output"] = with_views(["V_code"], [], "SELECT page_id, CASE WHEN length(pure) = 0 THEN '' WHEN strpos(answer, pure) > 0 "
                                              "THEN substring(answer, 1, strpos(answer, pure) - 1 + length(pure)) ELSE answer END AS raw_output FROM V_code")
    qs["splice_patch"] = with_views(["V_samples", "V_tasks"], [("j", f"SELECT s.task_idx, s.sample_idx, string_split(s.output, {NL}) AS l, t.prompt_complete, "
                                                                     "CAST(s.n_chars % 7 AS INT) AS st, CAST(s.n_chars % 7 AS INT) + CAST(s.n_chars % 3 AS INT) AS en "
                                                                     "FROM V_samples s JOIN V_tasks t USING (task_idx)")],
                                    f"SELECT task_idx, sample_idx, array_to_string(list_concat(list_concat(list_slice(l, 1, st), "
                                    f"string_split(prompt_complete, {NL})), list_slice(l, en + 2, len(l))), {NL}) AS spliced FROM j")
    qs["parse_test_log"] = with_views(["V_steps"], [], "SELECT user_id, CAST(run_day AS VARCHAR) AS run_day, CAST(step_no AS INT) AS step_no, "
                                      "last_line = 'Failing tests: 0' AS tests_ok FROM V_steps")
    qs["parse_coverage_summary"] = _coverage_summary_sql()
    qs["first_compiler_error"] = with_views(["V_err_log"], [], f"SELECT event_id, CASE WHEN failed THEN nullif(split_part(regexp_extract(stderr, "
                                            f"{q(COMPILER_ERROR_RE)}, 0), {NL}, 1), '') END AS first_error FROM V_err_log")
    def first(pieces: str, n: str) -> str:
        return f"coalesce(list_sum(list_transform(list_slice({pieces}, 1, {n}), lambda x: length(x))), 0)"

    qs["truncate_prompt_tokens"] = with_views(["V_docs"], [(
        "t", f"SELECT doc_id, text, regexp_extract_all(text, {TOK}) AS toks, string_split_regex(text, {TOK}) AS gaps FROM V_docs")],
        f"SELECT doc_id, CASE WHEN len(toks) <= 64 THEN text ELSE substring(text, CAST({first('gaps', 'len(toks) - 63')} + {first('toks', 'len(toks) - 64')} AS BIGINT) + 1) END "
        f"AS complete_kept, CASE WHEN len(toks) <= 64 THEN text ELSE substring(text, 1, CAST({first('gaps', '64')} + {first('toks', '64')} AS BIGINT)) END AS chat_kept FROM t")
    raw = "concat(CASE role WHEN 'system' THEN '###' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END, '<s>', text, ' ###tail</s>')"
    c1 = "CASE WHEN strpos(raw, '###') > 1 THEN substring(raw, 1, strpos(raw, '###') - 1) ELSE raw END"
    c2 = strip(f"replace(replace(replace({c1}, '<s>', ''), '</s>', ''), '<unk>', '')")
    qs["clean_chat_output"] = with_views(["V_turns"], [("r", f"SELECT conv_id, turn, {raw} AS raw FROM V_turns"),
                                                       ("c", f"SELECT conv_id, turn, {c2} AS t FROM r")],
                                         f"SELECT conv_id, turn, CASE WHEN starts_with(t, 'Assistant:') THEN {strip('substring(t, 11)')} ELSE t END AS cleaned FROM c")
    qs["render_chat_prompt"] = with_views(["V_turns"], [], "SELECT conv_id, concat('SYS' || chr(10), string_agg(concat(CASE role WHEN 'user' THEN 'USER' "
                                          "WHEN 'assistant' THEN 'ASSISTANT' WHEN 'system' THEN 'SYSTEM' ELSE role END, ': ', text, chr(10)), '' ORDER BY turn), "
                                          "'ASSISTANT:') AS prompt FROM V_turns GROUP BY conv_id")
    qs["count_tokens"] = with_views(["V_docs"], [], f"SELECT doc_id, CAST({ntok('text')} AS BIGINT) AS n_tokens FROM V_docs")
    qs["syntax_screen"] = _screen_sql()
    qs["stream_stop_function"] = _stream_function_sql()
    qs["stream_stop_marker"] = _stream_marker_sql()
    qs["stream_stop_signature"] = _stream_function_sql("f(){\n", prompt=True)
    qs["stream_stop_chat"] = _stream_chat_sql("f()")
    qs["stream_collect_partials"] = merged_sql(5)
    two = ("SELECT 'complete' AS suite, * FROM (" + passk_rows("counts", K_GRID_COMPLETE) + ") UNION ALL "
           "SELECT 'complete_k3' AS suite, * FROM (" + passk_rows("counts", [1, 3]) + ")")
    qs["register_suite"] = with_views(["V_verdicts"], [("counts", COUNTS.format(src="V_verdicts"))], suite_rows(two, "suite, "))
    qs["evaluate_complete"] = _evaluate_complete_sql()
    qs["evaluate_complete_range"] = _evaluate_complete_sql("task_idx BETWEEN 2 AND 30 AND sample_idx < 7")
    qs["reorg_partials"] = """
WITH o AS (
  SELECT concat('model-', CAST(doc_id % 2 AS VARCHAR)) AS model_id, concat('task-', source) AS task_id, doc_id, pos,
         concat(CASE pos WHEN 0 THEN '' ELSE 'again ' END, coalesce(text, '')) AS output
  FROM documents CROSS JOIN (SELECT unnest([0, 1]) AS pos) p),
r AS (SELECT *, row_number() OVER (PARTITION BY model_id, task_id ORDER BY doc_id, pos) AS n FROM o)
SELECT model_id, task_id, md5(string_agg(output, chr(30) ORDER BY n)) AS outputs_md5, count(*) AS n_outputs
FROM r WHERE n <= 25 GROUP BY model_id, task_id"""
    test_flags = FLAGS[:3]
    qs["evaluate_repair"] = _evaluate_sql(_postprocessed_ctes(), _PATCH, FLAGS, K_GRID_DEFAULT, False)
    qs["evaluate_complete_chat"] = _evaluate_sql(_chat_ctes(True), _PATCH, FLAGS, K_GRID_COMPLETE, False)
    qs["evaluate_testgen"] = _evaluate_sql(_postprocessed_ctes(), _TEST, test_flags, K_GRID_DEFAULT, True,
                                           "task_idx BETWEEN 1 AND 30 AND sample_idx < 9")
    qs["evaluate_testgenissue"] = _evaluate_sql(_chat_ctes(False), _ISSUE, test_flags, K_GRID_DEFAULT, True)
    runs = [_evaluate_sql(_postprocessed_ctes(), _PATCH, FLAGS, K_GRID_DEFAULT, False, f"sample_idx % 2 = {i}") for i in range(2)]
    qs["evaluate_runs"] = " UNION ALL ".join(
        f"SELECT 'model-{i}' AS model_id, count(*) FILTER (WHERE level = 'task') OVER () AS run_total, level, flag, metric, param, n, value "
        f"FROM ({sql}) r" for i, sql in enumerate(runs))
    qs["evaluate_runs"] = ("SELECT model_id, run_total, flag, metric, param, n AS n_tasks, value FROM (" + qs["evaluate_runs"]
                           + ") WHERE level = 'suite'")
    qs["evaluate_defectdetection"] = scores_sql(confusion_sql("variant"), "variant, ")
    qs["leaderboard"] = _leaderboard_sql()
    return qs
