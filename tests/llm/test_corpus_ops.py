"""Whitening, line deduplication and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import filter_audit, line_dedup, whitening
from tests.llm.test_ops import docs, odd

# whitening ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("side", [1, 2, 3, 8, 33, 64])
def test_jacobi(side):
    r = np.random.default_rng(side)
    q, _ = np.linalg.qr(r.normal(size=(side, side)))
    want = np.sort(10.0 ** r.uniform(-6, 6, side))[::-1]
    m = (q * want) @ q.T
    m = (m + m.T) / 2
    values, vectors = whitening.jacobi(m)
    assert np.allclose(vectors.T @ vectors, np.eye(side), atol=1e-13)
    assert np.abs(m @ vectors - vectors * values).max() <= 1e-13 * want[0] * side and (np.diff(values) <= 0).all()


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix: eigenvalues twelve orders apart, each right to rounding."""
    scale = 10.0 ** -np.arange(0, 7.0)
    core = np.eye(7) + 0.1 * (np.ones((7, 7)) - np.eye(7))
    values, _ = whitening.jacobi(core * np.outer(scale, scale))
    exact = 1 / whitening.jacobi(np.linalg.inv(core) / np.outer(scale, scale))[0][::-1]
    assert np.allclose(values, exact, rtol=1e-11)


def test_jacobi_of_odd_matrices():
    for m in (np.zeros((4, 4)), np.ones((5, 5)), np.eye(6), np.diag([1.0, 0.0, -0.0])):
        values, vectors = whitening.jacobi(m)
        assert np.allclose(vectors * values @ vectors.T, m, atol=1e-12)
    v = np.random.default_rng(0).normal(size=(5, 40))  # rank 5 of 40
    values, _ = whitening.jacobi(v.T @ v)
    assert np.allclose(values[:5], np.linalg.eigvalsh(v @ v.T)[::-1]) and np.abs(values[5:]).max() < 1e-11


def plain_whitening(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    d = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, own = np.linalg.eigh(d.T @ d / n)
    return n, deviation, (d @ own / np.sqrt(values))[:, ::-1], (values / values.sum())[::-1]


def test_whitening_matches_brute_force(spark):
    r = np.random.default_rng(3)
    v = (r.normal(size=(700, 12)) * r.uniform(0.01, 2, 12) + r.normal(size=12)).astype(np.float32)
    df = spark.createDataFrame([(k, v[k].tolist()) for k in range(700)], "vec_id long, embedding array<float>").repartition(7)
    out = whitening.whitening_digest(df).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = plain_whitening(v)
    assert (out.n == n).all() and out.component.tolist() == list(range(1, 9)) * 700
    assert out.deviation.tolist() == [d for d in deviation for _ in range(8)]
    assert np.allclose(out.explained.to_numpy().reshape(700, 8), explained[:8], rtol=1e-10)
    got = out.whitened.to_numpy().reshape(700, 8)
    assert np.allclose(np.abs(got), np.abs(whitened[:, :8]), atol=1e-8)
    assert out.identity_error.nunique() == 1 and abs(out.identity_error.iloc[0] - np.abs(np.cov(got.T, bias=True) - np.eye(8)).max()) < 1e-9 and out.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    """Nulls, non-finite entries, other lengths, repeated rows, null ids, huge entries, clashing names, an empty table."""
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, -1.0]), (None, [0.0, 0.5]), (3, None), (4, []), (5, [1.0, None]), (6, [inf, 1.0]), (7, [nan, 1.0]), (8, [1.0]), (9, [1e300, 0.0])]
    df = spark.createDataFrame([(*x, 5, "y", 1.0) for x in rows], "vec_id long, embedding array<double>, n int, x string, whitened double")
    out = whitening.whitening_digest(df).orderBy("vec_id", "component").collect()
    assert [r.vec_id for r in out] == [None, None, 1, 1, 1, 1, 2, 2] and {r.n for r in out} == {4} and len(set(map(tuple, out))) == 6
    n, deviation, whitened, _ = plain_whitening([[0.0, 0.5], [1.0, 2.0], [1.0, 2.0], [2.0, -1.0]])
    assert sorted({r.deviation for r in out}) == sorted(set(deviation))
    assert whitening.whitening_digest(df.limit(0)).count() == 0
    # one row has no variance at all
    one = whitening.whitening_digest(df.filter("vec_id = 2")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, 0.0, 0.0, 1.0)] * 2


def test_deviations_are_exact_or_null():
    model = whitening.Whitening(3, (3 << 51, 0), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1 << 51, 0], [0, 1], [(1 << 51) - 1_000_000_000, 7]])
    assert model.deviations(x) == [0, None, 9 * 10**18 + 21**2]


# lines ----------------------------------------------------------------------------------------------


def plain_lines(rows, least=10):
    """(doc_id, n_lines, n_dropped, sha) of (doc_id, text) rows."""
    last = lambda k: (k is None, k or 0)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for k, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), last(k)), last(k))
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == last(k)]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, line_dedup.line_digest(df).collect()), key=repr)


def test_lines_match_brute_force(spark):
    r = np.random.default_rng(1)
    pool = [f"Common line {k}" for k in range(40)] + ["short", "", " \t", "ÉÀ éà accents", "éÀ éà accents", "KELVIN K sign", "kelvin k sign"]
    rows = []
    for k in range(400):
        lines = [r.choice(pool) if r.random() < 0.5 else f"own line {k} {j}" for j in range(r.integers(0, 90))]
        rows.append((int(k) * 3 - 50, "\n".join(x if r.random() < 0.7 else f" {x.upper()}\t\r" for x in lines)))
    assert digest(spark, rows) == plain_lines(rows)


def test_a_hot_line_fills_many_ranges(spark):
    """One line in all documents, and it alone in many: ranges begin and end inside its run."""
    rows = [(k, "the same hot line\n" * (k % 3) + "The Same Hot Line " + ("\nfew others here" if k % 50 == 0 else "")) for k in range(3000, 0, -1)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        lines = line_dedup.sorted_lines(df, 10)
        hot = lines.groupBy("h1").agg(F.countDistinct("part").alias("parts")).agg(F.max("parts")).first()[0]
        assert hot >= 8 and line_dedup.carried(lines).count() >= hot - 1
        assert digest(spark, rows) == plain_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_lines_of_odd_rows(spark):
    """Null ids last, rows that share an id, repeated rows, null and long texts, clashing names, an empty table."""
    long = "\n".join(f"line number {k % 700}" for k in range(5000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (4, "line number 1\nline number 1"), (None, long + "\nfresh at the end"), (None, "fresh at the end"), (5, "\n\n"), (-1, "line number 3\r")]
    df = spark.createDataFrame([(*x, "z", 1, 2, "q") for x in rows], "doc_id long, text string, mark string, pos int, part int, lines string")
    assert sorted(map(tuple, line_dedup.line_digest(df).collect()), key=repr) == plain_lines(rows)
    assert line_dedup.line_digest(df.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).filter("doc_id < 4").collect()}
    assert texts == {1: None, 2: "", 3: "\n".join(x for x in long.split("\n") if x != "line number 3"), -1: "line number 3\r"}
    words = {r.doc_id: r.words for r in line_dedup.keep_bitmaps(df).filter("doc_id = 3").collect()}[3]
    gone = sorted(w.word * 64 + b for w in words for b in range(64) if not (w.kept >> b) & 1)
    assert gone == list(range(3, 5000, 700))


# filter audit ---------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    """The audit's rows, one document, order and step at a time."""
    good, bad = ({k for k, *x in labels if k is not None and x[c] == 1} for c in (0, 1))
    last = lambda k: (k is None, k or 0)
    first = {}
    for k, text, _ in rows:
        first[text or ""] = min(first.get(text or "", last(k)), last(k))
    fails = []
    for k, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {x for x, yes in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), first[t] < last(k)), strict=True) if yes}
        fails.append((source or "", k, failed))
    out = []
    for part in {p for p, *_ in fails}:
        own = [(k, f) for p, k, f in fails if p == part]
        removed_by, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, stay = [d for d in left if x in d[1]], [d for d in left if x not in d[1]]
                before = sum(x in f for _, f in own) - len(gone)
                found.append([part, order, step, len(stay), len(gone), before, sum(f == {x} for _, f in own), sum(k in good for k, _ in gone), sum(k in bad for k, _ in gone), x])
                removed_by[x] += len(gone)
                left = stay
        out += [(*r[:-1], removed_by[r[-1]]) for r in found]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(df, labels):
    return sorted(tuple(r[c] for c in AUDIT) for r in filter_audit.audit(df, labels).collect())


def texts_for_audit(n, seed=2):
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        words = [f"w{r.integers(0, 30 if r.random() < 0.3 else 9000)}" for _ in range(r.integers(20, 120))]
        if r.random() < 0.2:
            words = [w.upper() if r.random() < 0.3 else w for w in words]
        if r.random() < 0.2:
            words[3] = "#$é"
        out.append(" ".join(words))
        if k and r.random() < 0.3:
            out[-1] = out[r.integers(0, k)]
    return out


def test_audit_matches_brute_force(spark):
    texts = texts_for_audit(300)
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 300, 2)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(docs(spark, texts), said) == plain_audit(rows, labels)


def test_copies_that_fill_many_ranges(spark):
    """One text in nine of ten rows: ranges begin and end inside its run."""
    texts = ["hot copy " * 60 if k % 10 else f"text {k} " * 60 for k in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = filter_audit.judged(docs(spark, texts, lambda _: "s").orderBy(F.col("doc_id").desc()))
        clean = sorted(r.doc_id for r in got.filter(F.col("mask").bitwiseAND(16) == 0).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert clean == sorted([1, *range(0, 2000, 10)])


def test_audit_of_odd_rows(spark):
    """Null texts, sources, ids and labels, repeated rows and labels, clashing names, an empty table."""
    df = odd(spark).withColumns({"mask": F.lit("x"), "part": F.lit(1), "range": F.lit("r"), "quality": F.lit(0)})
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    labels = [(3, 1, None), (3, None, 1), (None, 1, 1), (5, 1, 0), (7, None, None), (8, 0, 1)]
    said = spark.createDataFrame([(*x, "k") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert audited(df, said) == plain_audit(rows, labels)
    assert audited(df, said.limit(0)) == plain_audit(rows, [])
    assert filter_audit.audit(df.limit(0), said).count() == 0


def test_text_mask():
    assert filter_audit.text_mask(b"") == 1 and filter_audit.text_mask("É É".encode()) & 4 == 0
    assert filter_audit.text_mask(("A" + "é" * 19).encode()) & 4 == 0 and filter_audit.text_mask(("A" + "é" * 18).encode()) & 4
    assert filter_audit.text_mask("x y z".encode() * 1) & 2 == 0 and filter_audit.text_mask(b"a|b") & 8
