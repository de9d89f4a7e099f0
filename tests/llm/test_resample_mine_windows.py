"""Importance resampling, hard negatives and shared windows against brute force, with odd rows, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as hn
from corpusloom.llm import resample, shared_windows

from .test_operators import DOCS, LOW, corpus, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.mark.parametrize("widths", [range(1, 2), range(1, 4), range(3, 4)])
def test_crcs_of_runs_from_prefixes(widths):
    rng = random.Random(3)
    texts = [None, "", " .,; ", "One", "TWO words", "ünï-cödé 日本語,x", words(rng, 300), "a" * 100_000 + " b", "1 2 3 4 5", "é" * 70 + "!" + "Z" * 131]
    got = {n: [[] for _ in texts] for n in widths}
    for n, (text, crc, many) in zip(widths, resample.run_crcs(pa.array(texts), widths), strict=True):
        assert many.tolist() == [len(WORD.findall((t or "").translate(LOW))) for t in texts]
        for t, c in zip(text.tolist(), crc.tolist(), strict=True):
            got[n][t].append(c)
    for n in widths:
        for k, t in enumerate(texts):
            w = WORD.findall((t or "").translate(LOW))
            assert got[n][k] == [zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, words_, buckets, percent, least):
    def feats(t):
        w = WORD.findall((t or "").translate(LOW))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, words_ + 1) for i in range(len(w) - n + 1))

    found = [(d, *feats(t)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, c in found:
        s.update(c)
    for x in target:
        t.update(feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, n, c in found:
        k = sum(c.values())
        weight = sum(gain(b) * m for b, m in c.items()) // k if k else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, k, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted((repr((*r, ranks.get(id(r)))) for r in out))


@pytest.mark.parametrize("n", [1, 2])
def test_importance_resample(spark, docs, n):
    rng = random.Random(9)
    target = [words(rng, 30), None, "", corpus()[0][1], corpus()[5][1]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    clash = docs.withColumns({"score": F.lit("x"), "weight": F.lit(1), "part": F.lit(2), "buckets": F.lit(3)})
    got = resample.importance_resample(clash, frame, words=n, buckets=500, percent=30, least=5).collect()
    want = plain_resample([(r[0], r[1]) for r in corpus()], target, n, 500, 30, 5)
    assert sorted(repr(tuple(r)) for r in got) == want


def test_importance_resample_of_nothing(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, words(random.Random(1), 40), None, None, None)], DOCS)
    assert resample.importance_resample(none, none).count() == 0
    (r,) = resample.importance_resample(one, none, percent=100).collect()
    assert r["n_features"] == 40 and r["rank"] == 1


def test_places_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), (F.col("id") * 7919 % 5000).alias("doc_id")).repartition(6)
    got = {(r["score"], r["doc_id"]): r["rank"] for r in resample.numbered(resample.written(rows, "rows"), [F.desc("score"), F.asc("doc_id")], "rank").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got, key=lambda k: (-k[0], k[1])))} and len(got) == 5000


def plain_negatives(rows, is_anchor, positives, negatives):
    out = []
    rows = [(k, d, y, v) for k, (d, y, v) in enumerate(rows)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    for k, d, y, v in rows:
        if is_anchor(d):
            s = [(-dot(v, w), e, z) for j, e, z, w in rows if j != k]
            for p, e, _ in sorted(x for x in s if x[2] == y)[:positives]:
                fit = sorted(x for x in s if x[2] != y and 30 * -p <= 100 * -x[0] <= 90 * -p)[:negatives]
                out += [(d, e, i + 1, f, -p, -q) for i, (q, f, _) in enumerate(fit)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
VECTORS = "vec_id long, label int, v array<double>"


@pytest.mark.parametrize("shape", ["spread", "clusters", "ties", "hot"])
def test_hard_negatives(spark, monkeypatch, shape):
    rng = np.random.default_rng(5)
    n, d = 700, {"clusters": 3}.get(shape, 12)
    v = rng.integers(-90, 90, (n, d))
    label = rng.integers(0, 4, n)
    if shape == "clusters":
        v = v // 12 + np.array([[200, 0, 0], [0, 220, 40], [150, 150, 10]])[rng.integers(0, 3, n)]
    if shape == "ties":
        v = rng.integers(0, 2, (n, d))
    if shape == "hot":
        label[: n // 2], v[: n // 3] = 0, v[0]
    ids = [int(x) for x in rng.permutation(n)]
    rows = [(i, int(y), [float(x) for x in r]) for i, y, r in zip(ids, label, v, strict=True)]
    rows += [rows[3], rows[3], (20, 1, [5.0, 7.0]), (9000, 2, [])]  # repeated rows, a short and an empty vector
    odd = [(9001, None, [1.0] * d), (9002, 1, None), (9003, 1, [1.0, None]), (9004, 1, [float("nan")] * d), (9005, 1, [float("inf")] * d), (None, 1, [1.0] * d)]
    for name, value in (("ROWS", 32), ("HELD", 16), ("PACK", 4)):
        monkeypatch.setattr(hn, name, value)
    frame = spark.createDataFrame(rows + odd, VECTORS).withColumns({"block": F.lit("x"), "score": F.lit(1), "key": F.lit(2)}).repartition(3)
    got = hn.hard_negatives(frame, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == plain_negatives(rows, lambda i: i % 20 == 0, 5, 10)


def test_zones_prune_and_lose_nothing(spark, monkeypatch):
    """Far clusters aren't read: fewer pairs of group and block than there are."""
    monkeypatch.setattr(hn, "ROWS", 32)
    monkeypatch.setattr(hn, "HELD", 8)
    rng = np.random.default_rng(6)
    at = np.repeat(np.arange(16), 64)
    v = np.rint(np.stack([1000 * np.cos(at / 16 * 6.28), 1000 * np.sin(at / 16 * 6.28)], axis=1) + rng.normal(0, 8, (1024, 2)))
    rows = [(k, int(rng.integers(0, 3)), [float(x) for x in r]) for k, r in enumerate(v)]
    pairs, blocks = [], []
    plain = hn._search

    def counted(anchors, b, zones, *args, **more):
        blocks.append(b.count())
        return plain(anchors, b, zones, *args, **more)

    made = hn._chosen

    def chosen(same, nearest):
        f = made(same, nearest)
        pairs.append(f)
        return f

    monkeypatch.setattr(hn, "_search", counted)
    monkeypatch.setattr(hn, "_chosen", chosen)
    got = hn.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == plain_negatives(rows, lambda i: i % 100 == 0, 5, 10)
    a = hn._Group({"uids": np.arange(1).tobytes(), "vs": np.array([1000.0, 0.0]).tobytes(), "labels": ["0"], "tops": np.zeros(1, np.int64).tobytes(), "lows": np.zeros(1, np.int64).tobytes()})
    low, high = a.bounds(np.array([[-10.0, -5.0]]), np.array([[20.0, 5.0]]))
    assert low[0, 0] <= -10_000 <= low[0, 0] + 2 and high[0, 0] - 2 <= 20_000 <= high[0, 0]
    assert len(pairs) == len(blocks) == 3


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hn.hard_negatives(none, F.col("vec_id") % 2 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], VECTORS)
    assert hn.hard_negatives(alone, F.col("vec_id") % 2 == 0).count() == 0
    same = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], VECTORS)
    assert hn.hard_negatives(same, F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_takes_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    keys = hn.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << dims * bits))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_products_are_exact():
    a, b = np.array([[3e7, -2e7]]), np.array([[2.0**31, 7.0]])
    assert hn.products(a, b)[0, 0] == 30_000_000 * 2**31 - 140_000_000
    with pytest.raises(OverflowError):
        hn.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def plain_windows(rows, width):
    first = {}
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t) in enumerate(rows)}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            for i in range(len(split[k]) - width + 1):
                key = tuple(split[k][i : i + width])
                first[key] = min(d, first.get(key, d))
    out = []
    for k, (d, _) in enumerate(rows):
        w, gone = split[k], set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] < d:
                    gone.update(range(i, i + width))
        out.append((repr(d), len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def got_windows(frame, width):
    out = shared_windows.shared_windows(frame, width).collect()
    for r in out:
        assert sum(s.stop - s.start for s in r["spans"]) == r["n_removed"] and all(a.stop < b.start for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out)


@pytest.mark.parametrize("width", [8, 13, 20])
def test_shared_windows(spark, docs, width):
    clash = docs.withColumns({"h": F.lit("x"), "places": F.lit(1), "shared": F.lit(2), "th": F.lit(3)})
    assert got_windows(clash, width) == plain_windows([(r[0], r[1]) for r in corpus()], width)


@pytest.mark.parametrize("step", [1, 1 << 12, 8 << 20])
def test_shared_windows_at_every_shift(spark, monkeypatch, step):
    """Passages of 12 to 15 words and long ones at all places modulo the period, within a step and across steps, and words that repeat."""
    monkeypatch.setattr(shared_windows, "STEP", step)
    rng = random.Random(12)
    parts = [words(rng, n) for n in (12, 13, 14, 15, 40)]
    rows = []
    for k in range(60):
        lead = words(rng, rng.randint(0, 15))
        rows.append((k * 3 % 61, f"{lead} {parts[k % 5]}\n{words(rng, k % 4)} {parts[(k + 2) % 5]}"))
    rows += [(70, "ha " * 300), (71, "x " + "ha " * 40), (72, "ho " * 12), (73, "ho " * 14), (5, rows[0][1]), (80, rows[1][1]), (80, rows[1][1]), (81, rows[1][1] + " and more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_windows(frame, 13) == plain_windows(rows, 13)


def test_shared_windows_of_nothing(spark):
    assert shared_windows.shared_windows(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="width"):
        shared_windows.shared_windows(spark.createDataFrame([], DOCS), 7)


def test_rule_hosts_lower_like_urls(spark):
    from corpusloom.llm.url_filter import judge_urls

    pages = spark.createDataFrame([(1, "http://\u0130.ORG/a"), (2, "http://x.example/")], "page_id long, url string")
    rules = spark.createDataFrame([("\u0130.Org", "/", "block")], "host string, path string, verdict string")
    got = judge_urls(pages, rules, spark.createDataFrame([], "url string")).collect()
    assert {r["page_id"]: (r["verdict"], r["rule"]) for r in got} == {1: ("block", "\u0130.org/"), 2: ("allow", None)}
