"""Phrase mining against counting everything; the scan of slices and long texts by itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from evalspark.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_counts(rows, max_words=4):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    return counts, totals


def brute(rows, min_count=30, top=2000):
    counts, totals = brute_counts(rows)
    candidates = {p: a for p, a in counts.items() if a >= min_count and len(p[1]) > 1}
    dropped = {(lang, q[i:i + k]) for (lang, q), f in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
               if 100 * f >= 80 * candidates[lang, q[i:i + k]]}
    out = defaultdict(list)
    for (lang, q), a in candidates.items():
        if (lang, q) not in dropped:
            score, _, left, right = min((2_000_000 * a // (counts[lang, q[:k]] + counts[lang, q[k:]]), k, counts[lang, q[:k]], counts[lang, q[k:]])
                                        for k in range(1, len(q)))
            out[lang].append((-score, -a, " ".join(q).encode(), left, right))
    return {(lang, i + 1, q.decode(), -a, left, right, totals[lang], -s)
            for lang, found in out.items() for i, (s, a, q, left, right) in enumerate(sorted(found)[:top])}


def made_up(seed, n=300):
    rnd = random.Random(seed)
    words = [*"abcdefgh", "Ünd", "x\x00y", "naïve", "WORD", "the", "of", " ", "w\u0085w"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b", "; "]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words[:rnd.choice([4, 16])]) + rnd.choice(ends) for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), (None, " . , "), *[("de", "in the end of all days we go home")] * 40]


def test_collocations_equal_counting_everything(spark):
    for seed, shards, least in ((1, 3, 6), (2, 1, 30)):
        rows = made_up(seed, 600)
        docs = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (lang, t) in enumerate(rows)],
                                     "doc_id long, text string, lang string, phrase string, n long, k long").repartition(3)
        got = {tuple(r) for r in phrases.collocations(docs, least, shards=shards).collect()}
        assert got == brute(rows, least)
        assert len(got) > 20


def test_top_and_ties(spark):
    rows = [("en", f"{a} {b}") for a in "abcdef" for b in "uvw" for _ in range(3)]
    docs = spark.createDataFrame([(None, t, lang) for lang, t in rows], "doc_id long, text string, lang string")
    got = {tuple(r) for r in phrases.collocations(docs, min_count=3, top=7).collect()}
    assert got == brute(rows, 3, 7) and len(got) == 7


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    df = phrases.collocations(docs)
    assert df.collect() == [] and df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def _all_filters():
    return {(1, k): b"\xff" * (phrases.MIN_FILTER_BITS // 8) for k in range(1, 4)}


def _scan(batch, filters, words_too=True):
    lang = batch.column(0).dictionary_encode()
    hashes = phrases._word_hashes(lang.dictionary)
    found = Counter()
    for data, rows, langs, skip in phrases._slices(batch, lang.indices.to_numpy(zero_copy_only=False)):
        for k, at, phrase, _, _, n in phrases.count_slice(data, rows, langs, hashes, skip, words_too, filters, 4):
            for a, p, m in zip(lang.dictionary.take(pa.array(at)).to_pylist(), phrase.to_pylist(), n.tolist(), strict=True):
                assert len(p.split(" ")) == k
                found[a, tuple(p.split(" "))] += m
    return found


def test_every_slice_size_counts_alike(monkeypatch):
    rows = [(lang or "und", t or "") for lang, t in made_up(7, 120)]
    rows.append(("en", " ".join(t for _, t in rows) + "longword" * 500 + " and a tail, of some words"))
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    want = brute_counts(rows)[0]
    for size in (16, 64, 257, 5_000, 10_000_000):
        monkeypatch.setattr(phrases, "SLICE_BYTES", size)
        assert _scan(batch, _all_filters()) == want


def test_only_active_phrases_are_counted():
    batch = pa.record_batch([pa.array(["en"] * 3), pa.array(["a b c d", "a b", "c d a b"])], ["lang", "text"])
    assert _scan(batch, {}) == Counter({("en", (w,)): n for w, n in {"a": 3, "b": 3, "c": 2, "d": 2}.items()})
    # Filters that know a and b (young), c (old) but not d.
    lang = phrases._word_hashes(pa.array(["en"]))
    h = phrases._joined(lang, phrases._word_hashes(pa.array(["a", "b", "c"])))
    bits = {}
    for kind, own in ((phrases.OLD, h[2:]), (2, h[:2])):
        table = np.zeros(phrases.MIN_FILTER_BITS // 8, np.uint8)
        for x in own.tolist():
            for at in (x % phrases.MIN_FILTER_BITS, (x >> 32) % phrases.MIN_FILTER_BITS):
                table[at // 8] |= 1 << at % 8
        bits[kind, 1] = table.tobytes()
    assert _scan(batch, bits, words_too=False) == Counter({("en", ("a", "b")): 3, ("en", ("b", "c")): 1})


def test_filters_hold_what_is_frequent(spark):
    rows = [(k, (k * 1_000_003 + i) * 7_919_777_777 % (1 << 63) - (1 << 62), i % 4) for k in (1, 2) for i in range(500)]
    filters = phrases._filters(spark.createDataFrame(rows, "k int, h long, tau int"), 4, 2)
    for k in (1, 2):
        h = np.array([r[1] for r in rows if r[0] == k], np.int64).view(np.uint64)
        tau = np.array([r[2] for r in rows if r[0] == k])
        for age, own in ((1, tau == 3), (2, tau == 2), (phrases.OLD, tau < 2)):
            assert phrases._in(filters[age, k], h[own]).all() and phrases._in(filters[age, k], h[~own]).mean() < 0.05
        assert (phrases._ranks(filters, k, h) <= np.where(tau == 3, 1, np.where(tau == 2, 2, 99))).all()


def test_phrases_of_one_hash_are_counted_apart_in_the_end(monkeypatch):
    rows = [(lang or "und", t or "") for lang, t in made_up(11, 80)]
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    counts, totals = brute_counts(rows)
    filters = {(phrases.OLD, k): b"\xff" * (phrases.MIN_FILTER_BITS // 8) for k in range(1, 5)}
    monkeypatch.setattr(phrases, "_joined", lambda h, word: np.full(len(word), 5, np.uint64))
    for size in (64, 10_000_000):
        monkeypatch.setattr(phrases, "SLICE_BYTES", size)
        names, parts = phrases._batch_slices(batch)
        found, words = Counter(), Counter()
        for part in parts:
            for k, at, phrase, n in phrases.spell_slice(*part, filters, 4):
                for lang, p, m in zip(names.take(pa.array(at)).to_pylist(), phrase.to_pylist(), n.tolist(), strict=True):
                    (found if k else words)[(lang, tuple(p.split(" "))) if k else lang] += m
        assert found == counts and words == Counter({lang: n for lang, n in totals.items() if n})


def test_steps_shuffle_numbers_only(spark):
    class Sent:
        value = _all_filters()

    batch = pa.record_batch([pa.array(["en"] * 3), pa.array(["a b c", "a b", "b c"])], ["lang", "text"])
    rows = [r for b in phrases._counter(True, Sent, 4)(iter([batch])) for r in b.to_pylist()]
    assert all(isinstance(v, int) for r in rows for v in r.values())
    assert Counter((r["k"], r["n"]) for r in rows) == Counter({(1, 2): 2, (1, 3): 1, (2, 2): 2, (3, 1): 1})
