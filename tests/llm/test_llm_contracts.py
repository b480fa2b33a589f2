"""Every ``opN_`` query on the smallest tables: column names, types and values of its contract; SQL where there is some."""

import hashlib
import re
import struct
import zlib

import duckdb
import public_tokenizers
import pytest

from evalspark.llm import catalog
from paths import SF_SMALL

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def run(spark, name, **types):
    """Rows by the given columns, whose names and types must be as stated."""
    df = catalog.QUERIES[name](spark, SF_SMALL)
    have = dict(df.dtypes)
    assert {c: have.get(c) for c in types} == types
    return [tuple(r[c] for c in types) for r in df.collect()]


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((rounded(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(map(rounded, cur.fetchall()), key=repr) and got


def test_types_of_the_queries_with_sql(spark):
    run(spark, "op2_topk_search", query_id="bigint", rank="int", vec_id="bigint", score="bigint")
    run(spark, "op3_source_mix", doc_id="bigint", size="bigint", source_size="bigint", target="double", taken="bigint")
    run(spark, "op11_phrase_collocations", lang="string", rank="bigint", phrase="string", a="bigint", l="bigint", r="bigint", n="bigint", score="bigint")
    counts = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    run(spark, "op12_filter_audit", part="string", filter_order="string", step="int", **counts)
    run(spark, "op13_warc_captures", page_id="bigint", payload_bytes="bigint", payload_digest="string", record_type="string", refers_to="bigint")


def test_op1(spark, documents):
    def shingles(text):
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} - {()}

    sets = {i: shingles(t) for i, t in documents.items()}
    least = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((least[a], least[b]))
                least = {i: low if r == high else r for i, r in least.items()}
    assert sorted(run(spark, "op1_ngram_jaccard", doc_id="bigint", n_shingles="bigint", component_id="bigint")) == [
        (i, len(sets[i]), least[i]) for i in ids]


def test_op4(spark, documents):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, start = [], 0
    for i in sorted(documents):
        ids = tokenizer.encode(documents[i] or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(run(spark, "op4_token_files", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")) == expected


def test_op5(spark, documents):
    rows = run(spark, "op5_toxicity", doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert sorted(r[0] for r in rows) == sorted(documents)
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p in rows)


def test_op6(spark, documents):
    rows = run(spark, "op6_quality_rules", doc_id="bigint", n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint",
               n_repeat_words="bigint", base_failed="boolean", kept="boolean")
    expected = {}
    for i, text in documents.items():
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        seen = {}
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k:k + 3]), []).append(k)
        repeats = len({k + d for at in seen.values() if len(at) > 1 for k in at for d in range(3)})
        expected[i] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats,
                       len(words) < 50 or 100 * repeats > 50 * len(words))
    assert {r[0]: r[1:7] for r in rows} == expected and len(rows) == len(documents)
    assert not any(r[6] and r[7] for r in rows) and any(r[7] for r in rows)


def test_op7(spark, documents):
    rows = run(spark, "op7_sampled_pieces", doc_id="bigint", sample="int", n_pieces="bigint", decodes="boolean", log_prob="double", log_inclusion="double")
    assert {r[0] for r in rows} == set(documents) and all(r[3] and r[5] <= 1e-9 for r in rows)
    assert {r[1] for r in rows} == {0, 1}


def listed(spans, kinds):
    return [f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2])))]


def digests(documents, base, kinds):
    out = {}
    for i, text in documents.items():
        spans = listed(base(text or ""), kinds)
        out[i] = (*[sum(s.startswith(k + ":") for s in spans) for k in kinds], hashlib.sha256(",".join(spans).encode()).hexdigest())
    return out


def test_op8(spark, documents):
    def base(t):
        assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
        out = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 12]
        out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        return out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]

    rows = run(spark, "op8_secret_scan", doc_id="bigint", n_assign="bigint", n_access="bigint", n_hex="bigint", base_sha256="string", spans="string")
    expected = digests(documents, base, ["assign", "access", "hex"])
    assert {r[0]: r[1:5] for r in rows} == expected and len(rows) == len(expected) and any(r[5] for r in rows)
    for r in rows:
        found = r[5].split(",") if r[5] else []
        assert hashlib.sha256(",".join(s for s in found if s.split(":")[0] in ("assign", "access", "hex")).encode()).hexdigest() == r[4]


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_op9(spark, documents):
    def base(t):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        return out + [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    rows = run(spark, "op9_personal_data", doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base_sha256="string", spans="string")
    expected = digests(documents, base, ["email", "ip", "card", "phone"])
    assert {r[0]: r[1:6] for r in rows} == expected and len(rows) == len(expected) and any(r[6] for r in rows)
