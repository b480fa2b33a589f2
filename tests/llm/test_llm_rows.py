"""Mixing, token files, toxicity, quality rules, sampled pieces, secret and personal data scans."""

import base64
import glob
import json
import math
import random
import re
import struct
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.llm import labelled, lattice, mixing, pii, quality, secrets, tokenfiles, toxicity
from evalspark.session import scratch_path

SF, SF_LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- mixing

def brute_targets(sizes, weights=mixing.WEIGHTS, budget=1.5, top=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > top * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = float(top * sizes[s])
        left -= sum(top * sizes[s] for s in over)
        free -= set(over)
    return out


def test_targets_share_the_excess(spark):
    for sizes in ({"a": 100, "b": 1, "c": 50, None: 7}, {"x": 10}, {"a": 0, "b": 5}, {"a": 1, "b": 1, "c": 1, "é": 1000, "z": 3}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(brute_targets(sizes))
        assert all(got[s] <= 2 * n for s, n in sizes.items())


def test_mix_meets_targets_and_reruns_agree(make_docs, prose):
    rows = [(k, prose(k, 5 + k % 40), ["a", "b", "c", None][k % 4] if k % 3 else "a") for k in range(900)]
    rows += [(9000, None, "a"), (9001, "", "d"), (None, prose(1, 9), "b"), (5, rows[5][1], rows[5][2])]
    docs = make_docs(rows)
    plan = mixing.mix_plan(docs).collect()
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    assert len(plan) == len(rows) and all(r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in plan)
    by = {}
    for r in plan:
        t = by.setdefault(r["source_size"], [r["target"], 0])
        t[1] += r["taken"]
    assert all(abs(got - target) <= 0.15 * target + 100 for target, got in by.values())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in plan if r["size"])
    assert mixing.mix_plan(make_docs([])).collect() == [] and mixing.mix_documents(make_docs([])).collect() == []


# ---- token files

def test_token_files_round_trip(spark, make_docs, prose):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    texts = ["", None, "a\r\n\tb  c   d\n\n\ne's don't  'LL x", "<|endoftext|>hi", "é…☃ ­ x\xa0y  z\x85q\x1cw", "½²x 12ab³", "   ", "\n \n",
             "naïve Ünïcode ǅ 漢字 🙂", "_under__score_ 9_9", prose(1, 20_000), "x" * 5000, prose(2, 300)]
    rows = [(len(texts) - k, x) for k, x in enumerate(texts)] + [(None, "no id"), (3, "again")]
    out = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(make_docs(rows), out, BPE)
    got = [tuple(r) for r in tokenfiles.read_documents(spark, out).orderBy("start").collect()]
    expected, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == expected


def test_ids_of_few_documents_by_the_block_index(spark, make_docs, prose):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    rows = [(k, prose(k, 40 if k % 7 else 9000)) for k in range(60)] + [(None, "no id"), (None, None), (5, "again"), (61, "")]
    out = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(make_docs(rows), out, BPE)
    asked = [0, 5, 13, 14, 14, 59, 61, 1000, -1, None]
    got = tokenfiles.read_ids(spark, out, asked).collect()
    expected = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows if i in asked]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=order) == sorted(expected, key=order)
    # a document of n ids lies in at most n / BLOCK + 2 blocks, a short one mostly in one; the files hold many more
    assert all(-(-len(r.ids) // tokenfiles.BLOCK) <= r.n_blocks <= len(r.ids) // tokenfiles.BLOCK + 2 for r in got)
    assert max(r.n_blocks for r in got) > 1
    ids_in_all = sum(r.n_tokens for r in tokenfiles.read_documents(spark, out).collect())
    assert sum(r.n_blocks for r in got if r.doc_id in (5, 13, 59)) < ids_in_all // tokenfiles.BLOCK
    assert tokenfiles.read_ids(spark, out, []).collect() == []
    empty = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(make_docs([]), empty, BPE)
    assert tokenfiles.read_ids(spark, empty, [1, None]).collect() == []


def test_token_files_of_an_empty_table(spark, make_docs):
    out = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(make_docs([]), out, BPE)
    assert tokenfiles.read_documents(spark, out).collect() == []


def test_blocks_round_trip_with_outliers():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 63, tokenfiles.BLOCK, 3 * tokenfiles.BLOCK + 17):
        for high in (1, 2, 1 << 12, 1 << 32):
            ids = rnd.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[rnd.random(n) < 0.03] = (1 << 32) - 1
            back = [tokenfiles.unpack_block(memoryview(b)) for b in tokenfiles.pack_blocks(ids)]
            assert np.array_equal(np.concatenate([np.empty(0, np.uint32), *back]), ids)


# ---- toxicity

LEXICON = toxicity.Model({"idiot": 6.0, "scum": 5.0})


def kinds(text, model=LEXICON):
    return sorted(k for k, _ in toxicity.matches(text, model))


def test_grammar_reads_clauses():
    assert kinds("what an idiot") == ["plain"]
    assert kinds("you are an idiot") == ["aimed"] and kinds("idiot, that is you") == ["aimed"]
    assert kinds("the scum floats. you see") == ["plain"]
    assert kinds("not an idiot") == ["negated"] and kinds("not for a very long time an idiot") == ["plain"]
    assert kinds("they said idiot") == ["reported"] and kinds('a "scum" b') == ["reported"]
    assert kinds("i will kill you") == ["menace"] and kinds("kill the lights") == [] and kinds("said kill you") != ["menace"]
    assert kinds("") == []


def test_scores_order_clauses():
    def score(text):
        return float(toxicity.features(text, LEXICON) @ np.array(LEXICON.link))

    assert score("you are an idiot") > score("here goes an idiot") > score("is not an idiot") >= score("an apple")
    assert score(None) == score("") == score("an apple")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(labelled.held_out(F.col("doc_id"))).collect()
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows)
    assert right >= 0.95 * len(rows)
    clean = [r["score"] for r in rows if not r["toxic"]]
    assert sum(s >= 0.5 for s in clean) <= 0.02 * len(clean)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score(docs, model).filter("score < 0.5").count()


def test_toxic_held_out_rows_of_the_larger_table_are_caught(spark):
    docs, labels = (spark.read.parquet(f"{SF_LARGE}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    held = docs.join(labels.filter(labelled.held_out(F.col("doc_id"))), "doc_id")
    rows = toxicity.score(held, model).join(labels, "doc_id").collect()
    toxic = [r["score"] >= 0.5 for r in rows if r["toxic"]]
    clean = [r["score"] >= 0.5 for r in rows if not r["toxic"]]
    assert len(toxic) >= 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_edges(spark, make_docs, prose):
    docs = make_docs([(1, None), (2, ""), (None, "idiot you"), (3, "x" * 100_000), (3, "you idiot " * 20_000), (4, prose(1, 50))])
    got = toxicity.score(docs, LEXICON).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int, size long")
    assert toxicity.fit(docs, none).weights == {} and toxicity.score(make_docs([]), LEXICON).collect() == []
    assert toxicity.keep_clean(docs, LEXICON).columns == docs.columns


# ---- quality rules

def brute_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_quality_counts_match_brute_force(make_docs, prose):
    texts = ["", None, " \n\t", "a", "a b", "a b c a b c", "a a a a a", "x | y | z #*$%&|<>", "l\nl\n\nl \nm", prose(1, 200),
             prose(2, 60) + "\n" + prose(2, 60), "é é é é", "p q r s p q r t p q r"]
    rows = list(enumerate(texts)) + [(None, "a b c"), (5, texts[5])]
    got = quality.judge(make_docs(rows), []).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = sorted((str(i), brute_counts(t), brute_counts(t)[0] < 50 or 2 * brute_counts(t)[4] > brute_counts(t)[0]) for i, t in rows)
    assert sorted((str(r["doc_id"]), tuple(r[n] for n in names), r["base_failed"]) for r in got) == expected
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.judge(make_docs([]), []).collect() == []


def test_covering_learns_separable_rules():
    rows = []
    for k in range(600):
        junk = k % 3 == 0
        row = {n: (k * 37 % 101) / 101 for n in quality.STATISTICS}
        row |= {"symbol_rate": (2.0 if k % 2 else 0.0) if junk else (k % 7) / 10, "upper_rate": (0.9 if k % 2 == 0 else 0.0) if junk else 0.1}
        rows.append(row | {"junk": int(junk), "fold": k % 4 % 3})
    rules = quality.learn_rules(rows)
    assert rules and all(any(all(c.holds(r) for c in rule) for rule in rules) == bool(r["junk"]) for r in rows)
    assert quality.learn_rules([r | {"junk": 0} for r in rows]) == [] and quality.learn_rules([]) == []


def test_quality_on_held_out_rows_and_native(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    judged = quality.judge(docs, quality.fit(docs, labels))
    assert "Python" not in judged._jdf.queryExecution().toString()
    rows = judged.join(labels, "doc_id").filter(labelled.held_out(F.col("doc_id")) & ~F.col("base_failed")).collect()
    good = [r["kept"] for r in rows if r["quality"]]
    assert sum(good) >= 0.94 * len(good)


def test_long_good_documents_are_kept(spark):
    """Labels of the larger table: good documents of 3000 words and more stay, held out or not."""
    docs, labels = (spark.read.parquet(f"{SF_LARGE}/{n}.parquet") for n in ("documents", "labels"))
    judged = quality.judge(docs, quality.fit(docs, labels)).filter(~F.col("base_failed")).join(labels, "doc_id")
    rows = judged.filter((F.col("n_words") >= 3000) | labelled.held_out(F.col("doc_id"))).collect()
    good = [r["kept"] for r in rows if r["quality"] and r["n_words"] >= 3000]
    assert len(good) >= 10 and sum(good) >= 0.98 * len(good)
    junk = [r["kept"] for r in rows if r["quality"] == 0 and labelled.held_out_id(r["doc_id"])]
    assert len(junk) >= 50 and sum(junk) <= 0.1 * len(junk)


# ---- sampled pieces

def test_segmentations_decode_and_differ(make_docs, prose):
    texts = ["", None, "a", "hello world", "  x\n\n y  ", "日本語 ▁ a​ \x00é", "the cat sat", prose(3, 4000), "y" * 3000, prose(4, 40)]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, texts[3])]
    encoded = lattice.encode(make_docs(rows), PIECES, samples=3)
    got = {}
    for r in encoded.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[0]) == len(got[1]) == 1 and got[0][0]["ids"] == [] and len(got[2]) == 2
    for i, own in got.items():
        if i != 3:
            assert len({tuple(r["ids"]) for r in own}) == len(own)
        assert all(r["log_inclusion"] <= 1e-9 for r in own)
    assert sorted(r["ids"] for r in got[3][:3]) == sorted(r["ids"] for r in got[3][3:]) or len(got[3]) == 6
    back = lattice.decode(encoded, PIECES).collect()
    by_id = dict(rows)
    assert all(r["text"] == (by_id[r["doc_id"]] or "") for r in back)
    assert sorted(map(str, lattice.encode(make_docs(rows), PIECES, samples=3).collect())) == sorted(map(str, encoded.collect()))
    assert lattice.encode(make_docs([]), PIECES).collect() == []


def every_segmentation(model, text):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if math.isfinite(model.log_weight[i])}
    body, out = (" " + text).replace(" ", "▁"), {}

    def go(at, ids, log):
        if at == len(body):
            out[tuple(ids)] = log
        for n in range(1, min(model.longest, len(body) - at) + 1):
            if (i := plain.get(body[at:at + n])) is not None:
                go(at + n, [*ids, i], log + float(model.log_weight[i]))

    go(0, [], 0.0)
    whole = math.log(sum(map(math.exp, out.values())))
    return {k: v - whole for k, v in out.items()}


def test_samples_follow_the_lattice_without_replacement():
    model = lattice.segmenter(PIECES, 0.2)
    every = every_segmentation(model, "on it")
    few = lattice.sample_text(model, "on it", 7, len(every) + 1)
    assert {tuple(i.tolist()) for i, _, _ in few} == set(every)
    assert all(p == pytest.approx(every[tuple(i.tolist())], abs=1e-4) and g == 0.0 for i, p, g in few)
    runs, seen, unbiased = 3000, {}, {}
    for k in range(runs):
        for i, p, g in lattice.sample_text(model, "on it", lattice.row_seed(k), 2):
            key = tuple(i.tolist())
            seen[key] = seen.get(key, 0) + 1 / runs
            unbiased[key] = unbiased.get(key, 0) + math.exp(p - g) / runs
    chance = {k: math.exp(v) for k, v in every.items()}
    for k, p in chance.items():
        both = p + sum(q * p / (1 - q) for o, q in chance.items() if o != k)       # first, or second after another
        assert seen.get(k, 0) == pytest.approx(both, abs=0.04)
        assert unbiased.get(k, 0) == pytest.approx(p, abs=0.05)


def pieces_of(model, text):
    """The lattice of a text as a table: weight of all ways from each place, by definition, cut nowhere."""
    body = ("▁" + text).replace(" ", "▁")
    total = [0.0] * (len(body) + 1)
    for at in range(len(body) - 1, -1, -1):
        ways = []
        for n in range(1, min(model.longest, len(body) - at) + 1):
            i = model.names.get(body[at:at + n])
            if i is not None and i >= 0:
                ways.append(model.weights[i] + total[at + n])
        if body[at] not in model.names or model.names[body[at]] < 0:
            ways.append(model.byte_weight * len(body[at].encode()) + total[at + 1])
        top = max(ways)
        total[at] = top + math.log(sum(math.exp(w - top) for w in ways))
    return total


def test_a_long_unit_is_not_cut():
    """An unbroken unit of 2000 characters: log chances are those of the uncut lattice, in draws and in the search."""
    model = lattice.segmenter(PIECES)
    text = "".join("abcdefghijklmnopqrstuvwxyz"[(k * k + k // 7) % 26] for k in range(2000))
    total = pieces_of(model, text)
    assert lattice.UnitLattice(model, " " + text).total[0] == pytest.approx(total[0], rel=1e-9)
    drawn = lattice.sample_text(model, text, 5, 3)
    assert len({tuple(i.tolist()) for i, _, _ in drawn}) == 3
    for ids, log_prob, _ in drawn:
        assert model.decode(ids) == text
        assert log_prob == pytest.approx(sum(model.weights[i] for i in ids.tolist()) - total[0], abs=1e-6)


def test_short_and_long_units_are_drawn_alike():
    """The lattices built together and the one built alone have the same chances."""
    model = lattice.segmenter(PIECES)
    words = [" segmentation", " ▁x", "\n", " " + "ab" * 100, " 日本語é"]
    both = lattice.Lattices(model, words)
    for k, word in enumerate(words):
        alone = lattice.UnitLattice(model, word)
        count, first, pieces, log_chance = both.walk(both.starts[[k] * 50], np.arange(50, dtype=np.uint64))
        for c, f, w in zip(count.tolist(), first.tolist(), log_chance.tolist(), strict=True):
            at, total = 0, 0.0
            for p in pieces[f:f + c].tolist():
                to, _, lw = next(way for way in alone.ways(at) if way[1] == p)
                at, total = to, total + lw
            assert at == len(word) and w == pytest.approx(total, abs=1e-4)


def test_improbable_segmentations_are_still_drawn():
    """Pieces whose other segmentation has a chance far below 1e-13: it is drawn second, with its own log chance."""
    class Fake:
        longest, byte_weight = 2, -100.0
        names = {"a": 0, "aa": 1}
        weights = [-40.0, 0.0]

    x = lattice.UnitLattice(Fake(), "aa")
    first = (1,)
    assert x.left([first]) == pytest.approx(-80.0, abs=1e-6)
    assert x.other([first], 3) == ([0, 0], pytest.approx(-80.0, abs=1e-6))
    assert x.left([first, (0, 0)]) == -math.inf and x.other([first, (0, 0)], 3) is None


def test_a_text_of_five_million_characters(make_docs, prose):
    """Bounded memory: lattices are held part by part."""
    import resource
    model = lattice.segmenter(PIECES)
    text = prose(9, 20_000) * 40
    text = text[:5_000_000] if len(text) > 5_000_000 else text * (5_000_000 // len(text) + 1)
    text = text[:5_000_000]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (a, b) = lattice.sample_text(model, text, 1, 2)
    assert model.decode(a[0]) == text == model.decode(b[0]) and a[0].tobytes() != b[0].tobytes()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000


def test_lookups_answer_as_the_names_and_few_go_on():
    """A look into the first table settles nearly all prefixes, known or not; later tables are asked for places that names share."""
    model = lattice.segmenter(PIECES)
    asked = [*list(model.names)[::7], *(n + "\x01" for n in list(model.names)[::7]), "\x02", "日本語だ"]
    h = np.zeros(len(asked), np.uint64)
    for row, name in enumerate(asked):
        for c in name:
            x = ((int(h[row]) ^ ord(c)) * int(lattice._HASH)) & lattice._MASK
            h[row] = x ^ (x >> 32)
    expected = [model.names.get(name, lattice.MISS) for name in asked]
    assert model.lookup(h).tolist() == expected and model.lookup(h[:0]).tolist() == []
    (_, check, shared, _), *later = model.tables
    slot = (h & np.uint64(model.places - 1)).astype(np.int64)
    assert later and np.count_nonzero(shared[slot] & (check[slot] != h)) < 0.2 * len(asked)


def test_ascii_characters_without_a_piece_are_bytes_at_once():
    """Only characters of several bytes are left to be written out after the draws."""
    model = lattice.segmenter(PIECES)
    odd = [chr(c) for c in range(128) if chr(c) not in model.names and chr(c) != " "]
    assert odd
    both = lattice.Lattices(model, [*odd, "\U0001f9ff"])
    assert both.piece[0][both.starts].tolist() == [*(model.bytes[ord(c)] for c in odd), -1 - 0x1F9FF]
    assert [lattice.UnitLattice(model, c).ways(0)[0][1] for c in odd] == [model.bytes[ord(c)] for c in odd]
    text = "".join(odd) + "\U0001f9ff"
    for ids, _, _ in lattice.sample_text(model, text, 3, 3):
        assert model.decode(ids) == text


def test_freed_memory_is_held_until_given_back():
    """Arrays taken again and again are mapped once: few page faults, where each array had all of its own."""
    code = """
import resource
import numpy as np
from evalspark.llm import common
common.hold_freed()
np.ones(1 << 20)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(20):
    a, b = np.ones(1 << 20), np.ones(1 << 19)
    del a, b
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
common.give_back()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(lattice.__file__).parents[2])
    assert int(done.stdout) < 6_000                                # 20 times 12 MB are 61,440 pages


# ---- secrets

def der(tag, body):
    head = bytes([len(body)]) if len(body) < 128 else (lambda n: bytes([0x80 | len(n)]) + n)(len(body).to_bytes(2, "big"))
    return bytes([tag]) + head + body


def rsa_key():
    return der(0x30, der(2, b"\x00") + b"".join(der(2, bytes([k + 1]) * 64) for k in range(8)))


def test_structures_are_confirmed():
    key = rsa_key()
    assert secrets.is_der_key(key) and not secrets.is_der_key(key[:-1]) and not secrets.is_der_key(key + b"x")
    assert not secrets.is_der_key(der(0x30, b"")) and not secrets.is_der_key(b"")
    plain = base64.b64encode(key).decode()
    jwt = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"
    fake = "eyJhbGciOiJIUzI1NiIs." + "e" * 20 + ".x"
    body = "A" * 30
    n, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        check = secrets._BASE62[d] + check
    text = f"é {jwt} and {fake} and {plain} and {key.hex()} and ghp_{body}{check} ghp_{body}AAAAAA\n" \
           f"-----BEGIN RSA PRIVATE KEY-----\n{plain}\n-----END RSA PRIVATE KEY-----"
    found = [(text[a:b], k) for a, b, k in secrets.method_spans(text)]
    assert (jwt, "jwt") in found and not any(fake in t for t, k in found)
    assert (plain, "der") in found and (key.hex(), "der") in found and (f"ghp_{body}{check}", "checksum") in found
    assert sum(k == "checksum" for _, k in found) == 1 and sum(k == "pem" for _, k in found) == 1
    openssh = b"openssh-key-v1\0" + b"".join(struct.pack(">I", len(x)) + x for x in (b"none", b"none", b"")) + struct.pack(">I", 1) \
        + b"".join(struct.pack(">I", len(x)) + x for x in (b"pub", b"priv"))
    assert secrets.is_openssh_key(openssh) and not secrets.is_openssh_key(openssh[:-1])


OID = {"rsa": "2a864886f70d010101", "ec": "2a8648ce3d0201", "ed25519": "2b6570", "other": "2a0304"}


def curve_key():
    return der(0x30, der(2, b"\x01") + der(4, bytes(range(1, 33))) + der(0xA0, der(6, b"\x2a\x03")))


def wrapped(name, inner):
    return der(0x30, der(2, b"\x00") + der(0x30, der(6, bytes.fromhex(OID[name])) + der(5, b"")) + der(4, inner))


def encrypted(tag=0x30):
    return der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(tag, der(4, b"salt"))) + der(4, b"e" * 64))


def test_nested_keys_are_parsed():
    good = [wrapped("rsa", rsa_key()), wrapped("ec", curve_key()), wrapped("ed25519", der(4, b"k" * 32)), wrapped("other", der(4, b"k" * 32)),
            curve_key(), rsa_key()]
    bad = [wrapped("rsa", b"junk" * 40), wrapped("rsa", curve_key()), wrapped("ec", rsa_key()), wrapped("ed25519", der(4, b"k" * 31)),
           wrapped("other", b"j" * 64), wrapped("rsa", rsa_key()[:-1]), der(0x30, der(2, b"\x00") + der(0x30, der(2, b"x")) + der(4, rsa_key()))]
    assert all(map(secrets.is_der_key, good)) and not any(map(secrets.is_der_key, bad))
    assert secrets.is_encrypted_key(encrypted()) and not secrets.is_encrypted_key(encrypted(4)) and not secrets.is_encrypted_key(good[0])


def found_in(text):
    return [(k, text[a:b]) for a, b, k in secrets.method_spans(text)]


def test_wrapped_escaped_and_encrypted_bodies():
    plain = base64.b64encode(wrapped("rsa", rsa_key())).decode()
    lines = [plain[k:k + 64] for k in range(0, len(plain), 64)]
    for end in ("\n", "\r\n", "\\n", "\n    ", " \n\t"):
        body = end.join(lines)
        assert found_in(f"key: {body}\nNext words follow\nhere") == [("der", body)]
        armour = f"-----BEGIN PRIVATE KEY-----{end}{body}{end}-----END PRIVATE KEY-----"
        assert found_in(f'x "{armour}" y') == [("pem", armour)]
    assert found_in("\n".join([*lines[:3], "not base64 !", *lines[3:]])) == []
    assert found_in("\n".join(lines[:-1])) == [] and found_in(plain + "abc") == []
    secret = base64.b64encode(encrypted()).decode()
    for label, kinds in (("ENCRYPTED ", ["pem"]), ("", [])):
        assert [k for k, _ in found_in(f"-----BEGIN {label}PRIVATE KEY-----\n{secret}\n-----END {label}PRIVATE KEY-----")] == kinds
    blocks = base64.b64encode(bytes(range(64))).decode()
    for head, n in (("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n", 1), ("Proc-Type: 4,ENCRYPTED\n\n", 0),
                    ("DEK-Info: AES-128-CBC,0011223344556677\n\n", 0)):
        assert len(found_in(f"-----BEGIN RSA PRIVATE KEY-----\n{head}{blocks}\n-----END RSA PRIVATE KEY-----")) == n
    odd = base64.b64encode(bytes(63)).decode()
    assert found_in(f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-CBC,0011223344556677\n\n{odd}\n-----END RSA PRIVATE KEY-----") == []
    assert found_in("-----BEGIN RSA PRIVATE KEY-----\n" * 3 + plain[:40]) == []
    raw = base64.b64encode(b"openssh-key-v1\0" + b"".join(struct.pack(">I", len(x)) + x for x in (b"none", b"none", b"")) + struct.pack(">I", 1)
                           + b"".join(struct.pack(">I", len(x)) + x for x in (b"pub" * 20, b"priv" * 20))).decode()
    body = "\n".join(raw[k:k + 70] for k in range(0, len(raw), 70))
    assert found_in(f"see\n{body}\nand more text") == [("openssh", body)]


def test_both_parts_of_a_token_are_parsed():
    def part(x):
        return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")

    good, alg = part({"sub": 1}), part({"alg": "HS256"})
    assert [t for _, t in found_in(f"a {alg}.{good}.{part(b'sig')}. b")] == [f"{alg}.{good}.{part(b'sig')}"]
    for bad in (f"{alg}.{part(b'not json, only text')}.{part(b's')}", f"{alg}.{part([1])}.{part(b's')}", f"{part({'x': 1})}.{good}.{part(b's')}",
                f"{alg}.{good}.", f"{part({'alg': 'none'})}.{good}.{part(b's')}"):
        assert found_in(bad) == []
    assert len(found_in(f"{part({'alg': 'none'})}.{good}.")) == 1
    five = ".".join([part({"alg": "dir", "enc": "A128GCM"}), "", part(b"iv" * 6), part(b"text"), part(b"tag" * 5)])
    assert [t for _, t in found_in(f"x {five} y")] == [five] and found_in(five.rsplit(".", 1)[0]) == []


def test_planted_keys_are_found_and_nothing_else(make_docs, prose):
    """Generated texts with keys in every form at random places, against where they were put."""
    import random
    rnd = random.Random(4)
    rows, planted = [], {}
    for k in range(200):
        text, spans = prose(k, rnd.randint(0, 60)) + "\n", []
        for _ in range(rnd.randint(0, 3)):
            key = rnd.choice([rsa_key(), curve_key(), wrapped("ec", curve_key()), wrapped("ed25519", der(4, bytes(rnd.randbytes(32))))])
            form = rnd.choice(["hex", "line", "wrapped"])
            body = key.hex() if form == "hex" else base64.b64encode(key).decode()
            if form == "wrapped":
                body = "\n".join(body[i:i + 48] for i in range(0, len(body), 48))
            spans.append(f"der:{len(text)}:{len(text) + len(body)}")
            text += body + rnd.choice([" ", "\n\n", ", "]) + prose(rnd.randint(0, 99), rnd.randint(1, 30)) + rnd.choice(["\n", " "])
        rows.append((k, text))
        planted[k] = spans
    got = {r["doc_id"]: r for r in secrets.scan(make_docs(rows)).collect()}
    for k, spans in planted.items():
        assert [s for s in got[k]["spans"] if s.startswith("der:")] == spans
        assert all(s.split(":")[0] in ("der", *secrets.BASE_KINDS) for s in got[k]["spans"])


def test_secret_scan_edges(make_docs):
    base = {"password=abcdefghijkl": ["assign:0:21"], "pass word: x": [], "API_KEY :  'abc.def-ghi_jkl'": ["assign:0:27"],
            "ſecret=abcdefghijklmn": [], "token=short token=abcdefabcdef": ["assign:12:30"], "AKIA12345678901234": ["access:0:18"],
            "AKIA1234567890123": [], "0123456789abcdef": ["hex:0:16"], "0123456789abcde": [], "é secret=0123456789abcdef": ["assign:2:25", "hex:9:25"]}
    rows = [(k, t) for k, t in enumerate(base)] + [(90, None), (91, ""), (None, "x"), (92, "a" * 300_000), (1, "pass word: x")]
    got = secrets.scan(make_docs(rows))
    assert got.columns == ["doc_id", "base_spans", "spans"]
    assert sorted((str(r["doc_id"]), r["base_spans"]) for r in got.collect()) == sorted(
        (str(i), base.get(t, ["hex:0:300000"] if t and len(t) > 99_999 else [])) for i, t in rows)
    assert secrets.scan(make_docs([])).collect() == []


# ---- personal data

def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_personal(t):
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    out += [(m.start(), 3, f"phone:{m.start()}:{m.end()}") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [s for _, _, s in sorted(out)]


TEXTS = ["", "a@b.c", "x a.b+c@d-e.f.gh i@j k@l.m_n@o.p", "@@a@b.c@d.e", "é 1.2.3.4 256.1.1.1 1.2.3.400.5.6.7.8 1.2.3.4.5.6.7.8 007.1.1.1 1.2.3",
         "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 4111  1111 1111 1111", "0" * 12 + " " + "0" * 20 + " 000000000000-0000000",
         "+1 (953) 555-9811 +49 30 1234 +1234567890123456 ++12 345 678 9", "🙂 a@b.co 🙂 10.0.0.1 +1 234 567 890", "1 2 3 4 5 6 7 8 9 0 1 2 8",
         "a" * 3000, "1" * 3000, "1 " * 3000, "a@" * 3000, "x@y.z " * 500, "+1" + "(" * 3000]


def test_personal_data_matches_brute_force(make_docs):
    rows = list(enumerate(TEXTS)) + [(90, None), (None, "a@b.c"), (1, "a@b.c")]
    found = pii.scan(make_docs(rows))
    assert "Python" not in found._jdf.queryExecution().toString()
    got = found.select("doc_id", pii.listed(F.col("spans"), pii.BASE_KINDS).alias("s")).collect()
    assert sorted((str(r["doc_id"]), r["s"]) for r in got) == sorted((str(i), brute_personal(t or "")) for i, t in rows)
    assert pii.scan(make_docs([])).collect() == []


def test_checksums_and_context(make_docs):
    rows = [(1, "my IBAN is GB82 WEST 1234 5698 7654 32 ok"), (2, "GB83WEST12345698765432"), (3, "DE89370400440532013000"),
            (4, "ssn 123-45-6789"), (5, "number 123-45-6789"), (6, "call +1 234 567 8901"), (7, "+1 234 567 8901")]
    got = {r["doc_id"]: r["spans"] for r in pii.scan(make_docs(rows)).collect()}
    assert [(s["kind"], s["start"], s["end"], s["score"]) for s in got[1]] == [("iban", 11, 38, 1.0)]
    assert got[2] == [] and [s["kind"] for s in got[3]] == ["iban"]
    assert [s["kind"] for s in got[4]] == ["ssn"] and got[5] == []
    assert got[6][0]["score"] > got[7][0]["score"]


def test_many_matches_take_time_in_proportion(make_docs):
    """50,000 addresses in one text, every span as brute force has it, within a bound."""
    text = "".join(f"u{k}@x{k % 7}.org, " for k in range(50_000))
    began = time.time()
    spans = pii.scan(make_docs([(1, text)])).select(pii.listed(F.col("spans"), pii.BASE_KINDS).alias("s")).first()["s"]
    assert time.time() - began < 20
    assert spans == [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[^ ,]+", text)]


def test_token_files_are_read_block_by_block(spark, make_docs, prose, monkeypatch):
    """A worker that reads holds the ids of a block, not of a file, and none of the pieces that it wrote with."""
    docs = make_docs([(None if i == 3 else i, prose(i, 900 if i % 5 else 9_000)) for i in range(40)])
    out = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(docs.coalesce(1), out, BPE)
    want = {r["doc_id"]: zlib.crc32(np.array([*r["ids"]], "<u4").tobytes()) for r in tokenfiles.read_ids(
        spark, out, [None, *range(40)]).collect()}
    sizes, unpack = [], tokenfiles.unpack_block
    monkeypatch.setattr(tokenfiles, "unpack_block", lambda block: sizes.append(len(block)) or unpack(block))
    monkeypatch.setattr(tokenfiles.np, "concatenate", None)              # no file is put together
    tokenfiles.encoder(BPE)
    got = {}
    for file in sorted(glob.glob(f"{out}/part-*")):
        with open(file, "rb") as f:
            for batch in tokenfiles._read_documents(iter([pa.RecordBatch.from_arrays([pa.array([f.read()])], ["content"])])):
                got |= dict(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True))
    assert got == want and len(got) == 40 and len(sizes) > 10
    assert tokenfiles.encoder.cache_info().currsize == 0


def test_pieces_are_cut_and_looked_up_together(monkeypatch):
    from tokenizers import Tokenizer
    whole, rnd = Tokenizer.from_file(BPE), random.Random(3)
    signs = ["'s", "'re", "'ll", "'t", "'", "''", " ", "  ", "\n", "\t", "\r\n", "\xa0", "é", "Ünd", "a", "foo", "S", "12", "_", "-", ".", "ɏ",
             "×", "ª", "s", "re", "€", "日本", "\x85", "²", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs[:rnd.choice([8, 18, 26, len(signs)])]) for _ in range(rnd.randint(0, 30))) for _ in range(4_000)]
    texts.append(" ".join(t for t in texts if tokenfiles._PLAIN.fullmatch(t)) + " and so it goes on" * 100)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    calls, codec = [], tokenfiles.PieceEncoder(BPE)
    cut = tokenfiles._piece_starts
    monkeypatch.setattr(tokenfiles, "_piece_starts", lambda *args: calls.append(1) or cut(*args))
    assert list(codec.encode(texts)) == want
    plain = [(t, w) for t, w in zip(texts, want, strict=True) if t.isascii() and "|" not in t]
    calls.clear()
    assert list(codec.encode([t for t, _ in plain])) == [w for _, w in plain]
    assert len(calls) == 1                               # not one by one
    monkeypatch.setattr(tokenfiles, "SLICE_CHARS", 500)
    monkeypatch.setattr(tokenfiles, "MEMO_PIECES", 40)
    assert list(codec.encode(texts)) == want and len(calls) > 2


def test_ways_of_a_short_unit_are_found_once():
    model = lattice.segmenter(PIECES)
    short, long = lattice.UnitLattice(model, " sitting"), lattice.UnitLattice(model, " " + "sitting" * 50)
    assert short._weights(2) is short._weights(2)
    assert long._weights(2) is not long._weights(2) and not long.kept                      # one number per character
