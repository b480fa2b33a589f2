"""The filter audit against replaying every order; WARC archives written, read and assembled."""

import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evalspark.llm import audit, warc
from evalspark.session import scratch_path


def replay(rows, labels):
    """Every order applied filter by filter to sets of rows."""
    good, toxic = ({i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None})
    low = {}
    for i, text, _ in rows:
        if i is not None:
            low[text or ""] = min(i, low.get(text or "", i))
    fails = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({c for c, f in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > low[t]), strict=True) if f})
    out = []
    for part in {p or "" for _, _, p in rows}:
        own = [n for n, r in enumerate(rows) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = set(own)
            for step, c in enumerate(order, 1):
                gone = {n for n in left if c in fails[n]}
                redundant = sum(c in fails[n] for n in own) - len(gone)
                left -= gone
                removed_by[c] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), redundant, sum(fails[n] == {c} for n in own),
                              sum(rows[n][0] in good for n in gone), sum(rows[n][0] in toxic for n in gone)))
        out += [(*x, removed_by[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def test_audit_equals_replaying_every_order(spark):
    rnd = random.Random(5)
    texts = [None, "", " ", "a " * 250, "UPPER " * 3, "sign # here"]
    for k in range(40):
        words = [f"w{rnd.randint(0, rnd.choice([50, 900]))}" for _ in range(rnd.choice([20, 199, 200, 400]))]
        texts.append(" ".join(words) + rnd.choice(["", " $", " THE LAST WORDS ARE SHOUTED OUT HERE", "\tx"]))
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(150)]
    rows += rows[:5] + [(7, "sign # here", "de"), (None, texts[-1], "en"), (None, None, None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 9, "x", 3) for r in rows], "doc_id long, text string, lang string, mask long, part string, n int")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    df = audit.filter_audit(docs, labelled)
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(df.dtypes)["step"] == "int" and {t for c, t in df.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert sorted(tuple(r) for r in df.collect()) == replay(rows, labels)


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_intervals_cover_every_order_once():
    assert [audit.lehmer_rank(o) for o in audit.ORDERS] == list(range(120))
    table = audit.intervals()
    for mask in range(32):
        seen = {}
        for m, step, a, b in table:
            if m == mask:
                assert a < b
                for r in range(a, b):
                    assert seen.setdefault(r, step) == step
        for r, order in enumerate(audit.ORDERS):
            first = next((i for i, c in enumerate(order, 1) if mask >> "ABCDE".index(c) & 1), None)
            assert seen.get(r) == first
        assert len(seen) == (120 if mask else 0)


def expected(rows):
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        refers = first[b] if i is not None and len(b) >= 100 and i > first[b] else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def made_pages():
    rnd = random.Random(3)
    separator = "\r\n\r\nWARC/1.1\r\n"
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nhi"
    htmls = [None, "", "x", "é" * 50, "y" * 99, "\r\n\r\n", "line\n\n" * 30, "\x00\r\n" * 60, "end\r\n\r\n" * 20, "z" * 200_000]
    htmls += ["<p>" + "".join(rnd.choice("ab\r\n") for _ in range(300)) for _ in range(30)]
    plain = [(i, rnd.choice([None, "http://a.example/x y?q=ü#top", "https://b.example", "odd\r\nurl"]), rnd.choice(htmls)) for i in range(120)]
    hard = [(500, "http://c.example/", "a" * 90 + separator + "b" * 30), (501, None, separator + inner + "\r\n\r\n" + inner), (502, "u", separator * 9),
            (499, None, "a" * 90 + separator + "b" * 30)]
    return plain, hard


def read(spark, rows, **conf):
    pages = spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id long, url string, html string, digest string, main int").repartition(3)
    path, table = scratch_path(spark, "warc-test"), scratch_path(spark, "pages-test")
    pages.write.parquet(table)
    warc.write_archives(spark.read.parquet(table), path)
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return warc.read_captures(spark, path, with_payload=True).collect(), path
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("hard", [False, True])
def test_round_trip(spark, hard):
    """Also with payloads that hold record separators and whole records."""
    rows = made_pages()[0] + (made_pages()[1] if hard else [])
    got, path = read(spark, rows)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_page"]) for r in got), key=repr) == expected(rows)
    for r in got:
        assert r["n_requests"] == r["n_metadata"] == 1 and r["request"]["info"] is not None
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
        assert r["target_uri"] is None or not re.search(r"[\x00-\x20]", r["target_uri"])


def test_splits_of_any_size_read_alike(spark):
    rows = [r for r in made_pages()[0][:40] if len(r[2] or "") < 10_000]
    for size in ("1009", "4k", "64k"):
        got, _ = read(spark, rows, **{"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"})
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_page"]) for r in got), key=repr) == expected(rows)


def test_repeated_rows_have_one_response(spark):
    rows = [(4, "u", "t" * 100)] * 3 + [(5, "u", "t" * 100)] + [(9, "u", "s")] * 2 + [(None, "u", "t" * 100)] * 2
    got, _ = read(spark, rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to_page"]) for r in got)
    assert kinds == [("4", "response", None), ("4", "revisit", 4), ("4", "revisit", 4), ("5", "revisit", 4),
                     ("9", "response", None), ("9", "response", None), ("None", "response", None), ("None", "response", None)]


def test_foreign_archives(spark, tmp_path):
    """Links in either direction and over one record, several metadata records, records without a capture."""
    def record(kind, name, block, **fields):
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items()],
                 f"Content-Length: {len(block)}"]
        return "WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"

    (tmp_path / "a.warc").write_bytes("".join([
        record("warcinfo", "i", "software: x"), record("request", "q1", "GET /"), record("response", "r1", "body", Concurrent_To="<q1>"),
        record("metadata", "m1", "page-id: 8\r\n", Concurrent_To="<q1>"), record("metadata", "m0", "page-id: 7\r\n", Concurrent_To="<r1>"),
        record("response", "r2", "x"), record("metadata", "lost", "page-id: 1", Concurrent_To="<nowhere>")]).encode())
    got = {r["capture"]: r for r in warc.read_captures(spark, str(tmp_path)).collect()}
    assert set(got) == {"<r1>", "<r2>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and got["<r1>"]["n_metadata"] == 2 and got["<r1>"]["metadata"]["record_id"] == "<m0>"
    assert got["<r1>"]["page_id"] == 7 and got["<r2>"]["request"] is None and got["<r2>"]["payload_bytes"] == 1


def test_broken_and_altered_archives_fail(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\n"
    for name, text, message in (("short", head + "Content-Length: 9\r\n\r\nbody\r\n\r\n", "not a WARC file"),
                                ("other", "nothing of the kind", "not a WARC file"),
                                ("altered", head + f"WARC-Payload-Digest: sha256:{'0' * 64}\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n", "does not fit")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(text.encode())
        with pytest.raises(Exception, match=message):
            warc.read_captures(spark, str(tmp_path / name)).collect()


def test_empty_tables(spark):
    assert read(spark, [])[0] == []


def test_staged_headers_are_packed(spark):
    """Identifiers are hexadecimal, so what is staged of an archive has a codec that packs them."""
    import pyarrow.parquet as pq
    path, table = scratch_path(spark, "warc-test"), scratch_path(spark, "pages-test")
    spark.createDataFrame(made_pages()[0], "page_id long, url string, html string").write.parquet(table)
    warc.write_archives(spark.read.parquet(table), path)
    found = warc.read_records(spark, path)
    files = [f.removeprefix("file:") for df in (found, warc.read_captures(spark, path)) for f in df.inputFiles()]
    metadata = [pq.ParquetFile(re.sub("^/+", "/", f)).metadata for f in files]
    assert {m.row_group(0).column(0).compression for m in metadata if m.num_row_groups} == {"ZSTD"}
