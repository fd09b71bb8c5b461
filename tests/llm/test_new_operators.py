"""Operators 11 to 13 against brute force, with nulls, empties, long texts, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate, infill, queries, whitening
from tidepanel.llm.sql import SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
terms = lambda s: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))


# --- operator 11 ---------------------------------------------------------------------------------


def plain_infill(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = LINE.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def lined() -> list[tuple]:
    draw = random.Random(5)
    line = lambda: "".join(draw.choice(["a", "é", "日", "😀", "$1", "\\", "{2}", " ", "\r", "\t"]) for _ in range(draw.randrange(9)))
    rows = [(k, "\n".join(line() for _ in range(draw.randrange(8)))) for k in range(150)]
    rows += [(200, ""), (201, None), (None, "x\ny\n"), (202, "\n"), (203, "\n\n\n"), (204, "no end"), (205, "has <P> inside\nand more"), (206, "<S>"), (207, "a<M>\n")]
    rows += [(208, "\n".join(map(str, range(200_000)))), (209, "y" * 300_000), (3, rows[3][1]), (3, rows[4][1]), (210, " \x85\n\x00z")]
    return rows


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (100, 100)])
def test_infill_equals_plain_python(spark, rate, spm):
    rows = lined()
    docs = spark.createDataFrame([(*r, "clash", 9, "form") for r in rows], "doc_id long, text string, output string, n int, form string").repartition(3)
    made = infill.transform(docs, rate, spm)
    got = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = [(i, *plain_infill(i, t, rate, spm), t or "") for i, t in rows]
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["back"])) for r in got)
    assert {r["form"] for r in got} >= ({"plain"} | ({"spm"} if spm else {"psm"}))
    assert infill.transform(docs.limit(0)).count() == 0


def test_infill_takes_other_units(spark):
    docs = spark.createDataFrame([(k, "one two  three four ") for k in range(9)], "doc_id long, text string")
    got = infill.transform(docs, unit=r"\S++\s*+|\s++").withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert {r["n"] for r in got} == {4} and {r["back"] for r in got} == {"one two  three four "}


# --- operator 12 ---------------------------------------------------------------------------------


def plain_hits(rows, items, size=10):
    wanted = defaultdict(set)
    for item, text in items:
        w = terms(text)
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            wanted[tuple(w[k : k + size])].add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = terms(text), set(), set()
        for n in {len(k) for k in wanted}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    found |= wanted[tuple(w[k : k + n])]
        out.append((str(doc_id), len(w), sorted(hit), sorted(found)))
    return sorted(out)


def leaked() -> tuple[list[tuple], list[tuple]]:
    draw = random.Random(11)
    vocab = [a + b for a in "bdlmst" for b in ("a", "é", "io", "日", "7")]
    text = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    items = [(k, text(draw.choice([10, 14, 40, 300]))) for k in range(30)]
    items += [(100, "only three words"), (101, "solo"), (102, ""), (103, None), (104, "!!"), (5, text(25)), (105, items[0][1]), (None, text(12)), (106, " ".join(["rept"] * 30))]
    rows = []
    for k in range(90):
        t = text(draw.choice([0, 1, 9, 40, 600]))
        if k % 3 == 0:
            words = items[draw.randrange(30)][1].split(" ")
            a = draw.randrange(len(words))
            t += "\n" + "--".join(words[a : a + draw.choice([9, 10, 11, 60])]).upper() + ". " + text(3)
        rows.append((k, t))
    rows += [(200, " ".join(["rept"] * 700)), (201, None), (202, ""), (203, "Only, three\nWORDS only three"), (204, "Solo. SOLO"), (205, text(4000) + " " + items[2][1] + " " + text(600)), (None, items[1][1]), (206, "x" * 200_000), (0, rows[0][1]), (0, "solo"), (207, ". ,")]
    rows += [(300 + k, rows[3][1]) for k in range(8)]
    return rows, items


@pytest.mark.parametrize(("shard", "block", "located"), [(decontaminate.SHARD, decontaminate.BLOCK, decontaminate.LOCATED), (700, 150, 37)])
def test_decontamination_equals_plain_python(spark, monkeypatch, shard, block, located):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("LOCATED", located)):
        monkeypatch.setattr(decontaminate, name, value)
    rows, items = leaked()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_words int, items string").repartition(3)
    bench = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, words string").repartition(2)
    got = decontaminate.decontaminate(docs, bench).collect()
    hits = lambda r: [p for s in r["spans"] for p in range(s["start"], s["stop"])]
    assert sorted((str(r["doc_id"]), r["n_words"], hits(r), r["items"]) for r in got) == plain_hits(rows, items)
    for r in got:  # maximal spans in order
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert {(len(r["spans"]), len(r["items"])) for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {(0, 0)}


def test_an_index_is_searched_again(spark):
    rows, items = leaked()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    made = decontaminate.written(decontaminate.index(docs), "kept")
    for part, size in ((items[:12], 10), (items[12:], 6)):
        got = decontaminate.search(made, decontaminate.phrases(spark.createDataFrame(part, "item_id long, text string"), size)).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], [p for s in r["spans"] for p in range(s["start"], s["stop"])], r["items"]) for r in got) == plain_hits(rows, part, size)
    with pytest.raises(ValueError, match="10 words"):
        decontaminate.phrases(docs, 11)


def test_suffix_order_and_ranks_are_exact():
    draw = np.random.default_rng(2)
    for n, v in ((1, 1), (60, 2), (900, 5), (900, 400)):
        hashes = draw.integers(0, v, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        counts = np.array([n])
        shard = decontaminate.Shard.build(hashes, np.zeros(1, int), np.zeros(1, int), counts)
        shard = decontaminate.Shard.load(shard.dump())
        ids = np.append(np.searchsorted(shard.alphabet, hashes) + 1, 0)
        order = sorted(range(n + 1), key=lambda k: ids[k:].tolist())
        assert decontaminate.suffix_order(ids).tolist() == order
        row, word = shard.locate(np.array([k for k, p in enumerate(order) if p < n]))
        assert word.tolist() == [p for p in order if p < n] and not row.any()


def test_spans_that_meet_are_merged():
    row, start, stop = (np.array(x) for x in ([1, 0, 1, 1, 0], [5, 0, 0, 3, 10], [7, 10, 3, 4, 12]))
    assert [x.tolist() for x in decontaminate.merged(row, start, stop)] == [[0, 1, 1], [0, 0, 5], [12, 4, 7]]


# --- operator 13 ---------------------------------------------------------------------------------


def plain_covariance(xs):
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    z = [[n * x[i] - s[i] for i in range(d)] for x in xs]
    return n, s, [[Fraction(sum(r[i] * r[j] for r in z), n**3) for j in range(d)] for i in range(d)]


def vectors(scale: float, d: int = 6, n: int = 60) -> list[tuple]:
    draw = np.random.default_rng(4)
    base = draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) * scale
    rows = [(k, base[k].tolist()) for k in range(n)]
    rows += [(100 + k, rows[0][1]) for k in range(40)]  # copies count once
    rows += [(200, None), (201, []), (202, [None] * d), (203, [float("nan")] + [0.0] * (d - 1)), (204, [float("inf")] * d), (205, [1.0]), (None, rows[1][1]), (0, rows[0][1])]
    return rows


@pytest.mark.parametrize("scale", [0.3, 5e5, 1e10])
def test_whitening_equals_exact_arithmetic(spark, scale):
    given = [(i, v) for i, v in vectors(scale)]
    frame = spark.createDataFrame([(*r, "clash", 3) for r in given], "vec_id long, embedding array<double>, x string, n int").repartition(3)
    used = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in given if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    rows = whitening.integers(frame)
    assert sorted((str(r["vec_id"]), list(r["x"])) for r in rows.collect()) == sorted((str(i), x) for i, x in used)
    model, seen = whitening.fit(rows)
    n, s, cov = plain_covariance([list(t) for t in sorted({tuple(x) for _, x in used})])
    assert (model.n, model.sums) == (n, s)
    plain = np.array([[float(c) for c in r] for r in cov])
    e, v = np.linalg.eigh(plain)
    assert np.allclose(model.variances, e[::-1], rtol=1e-10)
    assert np.allclose(np.abs(model.axes), np.abs(v[:, ::-1]), atol=1e-9)
    assert np.allclose(model.explained, e[::-1] / float(sum(cov[i][i] for i in range(6))), rtol=1e-10)
    assert whitening.identity_error(seen, model) < 1e-9
    got = whitening.whiten(rows, model).collect()
    want = sorted((str(i), sum((n * x[k] - s[k]) ** 2 for k in range(6)), x) for i, x in used)
    assert [(str(r["vec_id"]), int(r["deviation"])) for r in sorted(got, key=lambda r: (str(r["vec_id"]), r["deviation"]))] == [w[:2] for w in want]
    for r, (_, _, x) in zip(sorted(got, key=lambda r: (str(r["vec_id"]), r["deviation"])), want, strict=True):
        centre = np.array([float(Fraction(n * x[k] - s[k], n)) for k in range(6)])
        assert np.allclose(np.abs(r["whitened"]), np.abs(centre @ v[:, ::-1] / np.sqrt(e[::-1])), atol=1e-8)


def test_squares_are_exact_at_any_size():
    draw = np.random.default_rng(1)
    for most in (1 << 20, 1 << 40, 1 << 61):
        u = draw.integers(-most, most, (500, 3))
        assert whitening.squares(u).tolist() == [sum(int(x) ** 2 for x in c) for c in u.T]


def test_components_without_variance_are_null(spark):
    frame = spark.createDataFrame([(k, [float(k % 3), 2.0, -1.0]) for k in range(9)], "vec_id int, embedding array<float>")
    rows = whitening.integers(frame)
    model, seen = whitening.fit(rows)
    assert (model.n, model.explained[0], model.live.tolist()) == (3, 1.0, [True, False, False])
    assert all(r["whitened"][1:] == [None, None] and r["whitened"][0] is not None for r in whitening.whiten(rows, model).collect())
    assert whitening.identity_error(seen, model) < 1e-12
    one = whitening.integers(frame.limit(1))
    model, seen = whitening.fit(one)
    assert (model.n, whitening.identity_error(seen, model), whitening.whiten(one, model).first()["whitened"]) == (1, 0.0, [None] * 3)
    assert whitening.fit(whitening.integers(frame.limit(0)))[0] is None


# --- the queries on a folder of odd tables --------------------------------------------------------


def test_the_queries_on_odd_tables(spark, tmp_path):
    import duckdb

    rows, items = leaked()
    rows = [r for r in rows if r[0] is not None and r[0] != 0] + [(-5, "a\nb <P>\n"), (-6, "Ça\n\nva\n")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, form string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([r for r in items if r[0] is not None], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op11_fill_in_middle", "op12_decontamination"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = db.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES["op13_whitening"](spark, str(tmp_path)).count() == 0


def test_terms_are_those_of_the_pattern():
    texts = ["", "a", "A-b_c", "É1\x00é", "  x  ", "\x7fq\x80", "日本 語", None, "z"]
    found = decontaminate.Terms(pa.array(texts))
    cut = [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends, strict=True)]
    assert [cut[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)] == [terms(t) for t in texts]
