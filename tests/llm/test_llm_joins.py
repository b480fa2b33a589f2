"""N-gram Jaccard join, line dedup and top-k search against brute force."""

import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.llm import common, components, linededup, ngramjoin, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- N-gram Jaccard join

def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i:i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())


def brute_components(rows):
    """(id, text) -> component by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least[find(k)] if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(prose, seed=3):
    rnd = random.Random(seed)
    rows = [(k, prose(k, rnd.randint(1, 120))) for k in range(30)]
    for k in range(60):
        words = rnd.choice(rows)[1].split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(["zz", "qq", words[0]])
        rows.append((100 + k, " ".join(words)))
    return rows


def test_components_match_all_pairs(make_docs, prose):
    rows = near_copies(prose)
    rows += [(900, None), (901, ""), (902, "  \t\n"), (903, "a b"), (904, "A  B"), (905, "b a"), (906, "É b c"), (907, "é b c"),
             (None, rows[0][1]), (0, rows[0][1]), (5, rows[7][1]), (950, prose(1, 6000)), (951, prose(1, 6000) + " x")]
    got = ngramjoin.jaccard_components(make_docs(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_components_with_split_trees_and_blocks(make_docs, prose, monkeypatch):
    for name, value in (("SHARD_ROWS", 4), ("BLOCK_DOCS", 3), ("BLOCK_GRAMS", 200), ("SAMPLE_EVERY", 1)):
        monkeypatch.setattr(ngramjoin, name, value)
    rows = near_copies(prose, 5)
    got = ngramjoin.jaccard_components(make_docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_jaccard_at_the_border(make_docs):
    words = [f"w{k}" for k in range(21)]                 # 19 shingles
    same = " ".join(words)
    rows = [(1, same), (2, " ".join(words[:-1])), (3, " ".join(words[:-2])), (4, " ".join(["x", *words[1:]]))]
    # 18/19 links, 17/19 < 0.9 does not, but 17/18 does; the changed first word costs one shingle each way: 18/20.
    assert sorted(map(tuple, ngramjoin.jaccard_components(make_docs(rows)).collect())) == brute_components(rows)


def test_empty_table_and_keep_one(make_docs, prose):
    assert ngramjoin.jaccard_components(make_docs([])).collect() == []
    a = prose(1, 80)
    docs = make_docs([(3, a), (2, a), (2, a), (7, prose(9, 50)), (8, None), (9, ""), (None, a), (10, a + " more")])
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["2", "7", "8", "9", "None"]


def test_bounds_never_exclude_a_link():
    rnd = random.Random(1)
    for _ in range(200):
        base = rnd.sample(range(10_000), rnd.choice([1, 5, 60, 200, 955, 965, 2000]))
        other = base[: len(base) - rnd.randint(0, len(base) // 10)] + [20_000 + k for k in range(rnd.randint(0, 3))]
        a, b = (np.unique(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for x in (base, other))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert both >= ngramjoin.needed(len(a), len(b))
            assert ngramjoin._Points([ngramjoin.coarse_point(a), ngramjoin.coarse_point(b)]).bound(np.array([0]), np.array([1]))[0] >= both
            small, large = sorted((a, b), key=len)
            assert set(small[:ngramjoin.index_length(len(small))]) & set(large[:ngramjoin.prefix_length(len(large))])


@pytest.mark.parametrize("n", [1, 3, 5])
def test_sets_of_many_texts_at_once(n, monkeypatch):
    """As many n-grams as there are distinct runs of words, the same ones alone and among other texts."""
    rnd = random.Random(n)
    texts = [None, "", " \t\x0b\x0c", "a", "A B", "a  b\n", "\x00 a\x00 a", "é É ß", "a\x1cb\x85c\xa0d", "x" * 5000 + " y " + "x" * 5001]
    texts += ["".join(rnd.choice("aAbB \t\né\x00") * rnd.choice([1, 1, 1, 9]) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += [" ".join("".join(rnd.choices("ab", k=rnd.randint(60, 68))) for _ in range(20)) for _ in range(5)]
    monkeypatch.setattr(ngramjoin, "SLICE_BYTES", 700)

    def runs(text):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        width = min(n, len(words))
        return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()

    sets = ngramjoin.gram_sets(pa.array(texts).slice(2), n)
    assert [len(s) for s in sets] == [len(runs(t)) for t in texts[2:]]
    name = {}
    for t, s in zip(texts[2:], sets, strict=True):
        assert np.array_equal(s, ngramjoin.grams(t, n)) and np.all(s[1:] > s[:-1])
        name.setdefault(frozenset(runs(t)), s.tobytes())
        assert name[frozenset(runs(t))] == s.tobytes()
    assert len(set(name.values())) == len(name)              # other sets have other hashes
    assert ngramjoin.gram_sets(pa.array([], pa.string()), n) == []


def test_prefix_is_the_first_of_the_common_order():
    draw = np.random.default_rng(4)
    hashes = np.unique(draw.integers(0, 2 ** 63, 300, dtype=np.uint64))
    for share in (0, 40, 280, 300):
        known = np.stack([np.sort(draw.permutation(hashes)[:share]), draw.integers(3, 9, share, dtype=np.uint64)])
        turn = dict(zip(*known.tolist(), strict=True))
        expected = sorted(hashes.tolist(), key=lambda h: (turn.get(h, 0), h))  # noqa: B023
        for percent in (80, 90):
            got = ngramjoin._Order(known).prefix(hashes, percent)
            assert got.tolist() == expected[:ngramjoin.prefix_length(len(hashes), percent)]
    assert len(ngramjoin._Order(known).prefix(hashes[:0], 80)) == 0


def test_few_rows_are_broadcast_and_many_are_not(spark):
    few = spark.range(5)
    plan = lambda t: spark.range(9).join(t, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(common.broadcast_few(few, 5)) and "strategy=broadcast" not in plan(common.broadcast_few(few, 4))


def tree_of(sets, at=0):
    """One tree of sets, as rows of a batch in the order of size."""
    sets = sorted(sets, key=len)
    n = len(sets)
    return pa.RecordBatch.from_arrays([
        *[pa.array([k] * n, t) for k, t in ((7, pa.int64()), (0, pa.int32()), (0, pa.int32()))],
        pa.array([len(s) for s in sets]), pa.array([at] * n, pa.int32()), pa.array(range(n)),
        pa.array([ngramjoin.coarse_point(s) for s in sets], pa.binary())], ["gram", "i", "j", "n_grams", "at", "cid", "point"])


@pytest.mark.parametrize("size", [150, 470, 950, 1900, 3800, 7600, 30_000])
def test_unlike_sets_of_a_tree_are_not_tied(size):
    """Sets that share a rare n-gram and nothing else: each tie of theirs would make blocks of unlike documents grow."""
    draw = np.random.default_rng(size)
    sets = [np.unique(draw.integers(0, 2 ** 63, size, dtype=np.uint64)) for _ in range(12)]
    found = list(ngramjoin._candidates(80)(iter([tree_of(sets)])))
    assert sum(b.num_rows for b in found) <= 1
    near = [*sets, np.concatenate([sets[0][size // 10:], sets[1][:size // 20]])]       # and a set like one of them is
    found = list(ngramjoin._candidates(80)(iter([tree_of(near)])))
    assert 1 <= sum(b.num_rows for b in found) <= 2


def test_only_entries_with_a_partner_get_points():
    draw = np.random.default_rng(1)
    sizes = [100, 124, 126, 400, 900, 901]                   # 100 and 124, 126 and 124 may be alike at 0.8, and 900 and 901
    batch = tree_of([draw.integers(0, 2 ** 63, n, dtype=np.uint64) for n in sizes]).drop_columns(["point"])
    stay = list(ngramjoin._partners(80)(iter([batch])))
    assert [n for b in stay for n in b.column(3).to_pylist()] == [100, 124, 126, 900, 901] and stay[0].schema == batch.schema
    assert not list(ngramjoin._partners(80)(iter([batch.slice(3, 2)])))
    late = tree_of([draw.integers(0, 2 ** 63, 900, dtype=np.uint64)] * 2, at=150).drop_columns(["point"])
    assert not list(ngramjoin._partners(80)(iter([late])))   # too few n-grams are left behind their places


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---- line dedup

def brute_lines(rows, least=linededup.MIN_WORDS):
    """Kept text per row: every run of lines that holds ``least`` words and occurred before is removed."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    first, out, done = {}, {}, {}
    for k in order:
        text = rows[k][1]
        if text is None or rows[k] in done:
            out[k] = None if text is None else out[done[rows[k]]]
            continue
        done[rows[k]] = k
        every = text.split("\n")
        lines = [(i, x.strip(" \t\x0b\x0c\r"), len(WORD.findall(x))) for i, x in enumerate(every) if WORD.search(x)]
        gone = set()

        def look(i, j, k=k, lines=lines, gone=gone):
            run = tuple(x[1] for x in lines[i:j + 1])
            if first.setdefault(run, (k, i)) != (k, i):
                gone.update(range(lines[i][0], lines[j][0] + 1))

        for step in (1, -1):
            for i in range(len(lines)):
                n, j = 0, i
                while 0 <= j < len(lines):
                    n += lines[j][2]
                    if n >= least:
                        look(min(i, j), max(i, j))
                        break
                    j += step
        out[k] = "\n".join(x for i, x in enumerate(every) if i not in gone)
    return [out[k] for k in range(len(rows))]


def test_line_dedup_matches_definition(make_docs, prose):
    rnd = random.Random(4)
    pool = [prose(k, rnd.choice([1, 2, 3, 5, 9, 12, 30])) for k in range(25)]
    rows = [(k, "\n".join(rnd.choice([*pool, "", "  "]) if rnd.random() < 0.7 else prose(1000 + k * 50 + j, 4)
                          for j in range(rnd.randint(1, 14)))) for k in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, pool[3]), (5, rows[5][1]), (None, rows[9][1])]
    got = linededup.dedup_lines(make_docs(rows), removed_col="n_removed")
    assert [c for c in got.columns if c != "n_removed"] == make_docs([]).columns
    expected = sorted(((i, t) for (i, _), t in zip(rows, brute_lines(rows), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == expected


def test_line_dedup_of_frequent_short_lines(make_docs):
    """Many small sets of documents, each of a few short lines of its own that meet in ever new orders."""
    rows = []
    for seed in range(60):
        rnd = random.Random(seed)
        pool = [" ".join(f"s{seed}l{k}w{j}" for j in range(rnd.randint(1, 7))) for k in range(rnd.randint(5, 12))]
        rows += [(100 * seed + k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(3, 9)))) for k in range(10)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(make_docs(rows)).collect()}
    expected = dict(zip([i for i, _ in rows], brute_lines(rows), strict=True))
    assert [i for i in expected if got[i] != expected[i]] == []


def test_line_dedup_of_planted_passages(make_docs, prose):
    passage = "\n".join(prose(500 + k, 20) for k in range(3))
    rows = [(k, f"{prose(k, 15)}\n{passage}\n{prose(100 + k, 15)}") for k in range(6)] + [(9, prose(77, 30))]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(make_docs(rows)).collect()}
    assert got[0] == rows[0][1] and got[9] == rows[6][1]
    assert all(got[k] == f"{prose(k, 15)}\n{prose(100 + k, 15)}" for k in range(1, 6))


def test_line_dedup_edges(make_docs, prose):
    assert linededup.dedup_lines(make_docs([])).collect() == []
    long = "\n".join(prose(k, 6) for k in range(3000))
    docs = make_docs([(1, long), (2, long), (3, prose(5, 9)), (4, prose(5, 9))])
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: long, 2: "", 3: prose(5, 9), 4: prose(5, 9)}     # nine words are below the shortest run
    kept = linededup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_many_lines_take_time_in_proportion(make_docs):
    """200,000 lines in one text, of which a passage stood in an earlier document."""
    passage = "\n".join(f"a passage of words that is shared, line {k}" for k in range(50))
    long = "\n".join(f"line {k} of the long text {k * 7 % 1000}" for k in range(100_000))
    rows = [(1, passage), (2, long + "\n" + passage + "\n" + long.replace("line", "row"))]
    began = time.time()
    got = linededup.dedup_lines(make_docs(rows), removed_col="gone").filter("doc_id = 2").select("gone", F.length("text").alias("n")).first()
    assert time.time() - began < 20
    assert got["gone"] == 50 and got["n"] == len(rows[1][1]) - len(passage) - 1


def test_line_dedup_is_native(make_docs):
    plan = linededup.dedup_lines(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))


# ---- top-k search

def brute_topk(rows, every, k):
    out = []
    for q, a in rows:
        if q is not None and q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in rows if c not in (None, q) and len(a) == len(b))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 2048])
def test_topk_matches_brute_force(spark, block):
    rnd = np.random.default_rng(1)
    rows = [(k, rnd.integers(-40, 40, 24).tolist()) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(300, [1] * 5), (310, [2] * 5), (320, [])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, v array<long>"), every=10, k=5, block_rows=block)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 10, 5)


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>, v long, score long"
    rows = [(0, [0.5, -0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]),
            (5, [0.5, -0.25]), (5, [0.5, -0.25]), (6, [-1.0, 0.003])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    got = topk.search(frame.select("vec_id", topk.integers(F.col("embedding")).alias("v")), every=6).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 5, 128 * 128 + 64 * 64), (0, 2, 6, 128 * -256),
                                       (6, 1, 0, -256 * 128), (6, 2, 5, -256 * 128)]
    empty = frame.filter("vec_id < 0").select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    assert topk.search(empty, every=6).collect() == []


def test_segment_bound_is_a_bound():
    rnd = np.random.default_rng(2)
    for n in (1, 3, 17, 64):
        a, b = rnd.integers(-300, 300, (50, n)), rnd.integers(-300, 300, (50, n))
        for segments in topk.SEGMENTS:
            bound = (topk.segment_statistics(a, segments) * topk.segment_statistics(b, segments)).sum(axis=1)
            assert (bound + 1e-6 >= (a * b).sum(axis=1)).all()
