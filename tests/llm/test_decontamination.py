"""Decontamination against brute-force edit distance: recall at all edit rates and item sizes, short, long and odd items."""

import random

import numpy as np
import pytest

from corpusloom.llm import decontaminate

SIZES = [12, 20, 26, 40, 60, 80, 95, 150, 300, 1000, 3000]
#: Items up to this size are held against brute force; edits of longer ones are counted as made.
BRUTE = 150


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def item_of(rng, size):
    t = words(rng, size // 3 + 2)[:size]
    return t[:-1] + "x" if t.endswith(" ") else t


def edited(rng, text, rate, even):
    """int(rate * size) edits, at random places or evenly spread."""
    k = int(rate * len(text))
    places = [int((i + 0.5) * len(text) / k) for i in range(k)] if even else rng.sample(range(len(text)), k)
    out = list(text)
    for p in sorted(places, reverse=True):
        out[p : p + 1] = rng.choice([[rng.choice("uvwxyz")], [], [rng.choice("uvwxyz"), out[p]]])
    return "".join(out)


def brute(item: str, text: str) -> int:
    """Least edit distance of item to any part of text, column by column."""
    a, place = np.frombuffer(item.encode(), np.uint8), np.arange(len(item) + 1)
    col = place.copy()
    best = int(col[-1])
    for c in text.encode():
        new = np.empty_like(col)
        new[0] = 0
        new[1:] = np.minimum(col[1:] + 1, col[:-1] + (a != c))
        new = np.minimum.accumulate(new - place) + place  # from above, one more for each step
        best, col = min(best, int(new[-1])), new
    return best


@pytest.fixture(scope="module")
def planted(spark):
    """Cells (size, rate, even) of planted items, and which pairs were found."""
    rng, items, docs, cells = random.Random(5), [], [], []
    for size in SIZES:
        for rate in (0.02, 0.05, 0.08, 0.10):
            for even in (False, True):
                for _ in range(20 if size < 1000 else 6):
                    n = len(items)
                    text = item_of(rng, size)
                    body = edited(rng, text, rate, even)
                    items.append((n, text))
                    docs.append((n, f"{words(rng, rng.randint(2, 30))} {body} {words(rng, 30)}"))
                    cells.append((size, rate, even, n))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return items, docs, cells, {(r["doc_id"], r["item_id"]): r["distance"] for r in got}


@pytest.mark.parametrize("size", SIZES)
def test_recall_in_every_cell(planted, size):
    items, docs, cells, got = planted
    for rate in (0.02, 0.05, 0.08, 0.10):
        for even in (False, True):
            due = [n for s, r, e, n in cells if (s, r, e) == (size, rate, even)]
            due = [n for n in due if size > BRUTE or brute(items[n][1], docs[n][1]) <= 0.1 * len(items[n][1])]
            hit = sum((n, n) in got for n in due)
            assert hit >= 0.9 * len(due), (size, rate, even, hit, len(due))


def test_distances_are_exact(planted):
    items, docs, _, got = planted
    assert all(a == b or len(items[b][1]) < 20 for a, b in got)
    for (d, i), distance in random.Random(1).sample(sorted(got.items()), 40):
        if len(items[i][1]) <= BRUTE:
            assert distance == brute(items[i][1], docs[d][1])


def test_short_and_odd_items(spark):
    items = [(1, "ab"), (2, "q"), (3, "seven b"), (4, " \n "), (5, "日本語の文章がここにあります、とても長い文です。"), (6, "x" * 50), (7, "UPPER  case\ttext here"), (7, "a second text under this id, told apart")]
    docs = [(1, "cab"), (2, ""), (3, None), (4, "say Seven  B now"), (5, "前文。日本語の文章がここにありません、とても長い文です。後"), (6, "x" * 5000), (7, "an upper case text here."), (7, "a second text under this id, told apart"), (8, "nothing of it")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, items[0]], "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]): r["distance"] for r in got}
    assert len(pairs) == len(got)
    assert pairs == {(1, 1): 0, (4, 3): 0, (6, 6): 0, (7, 7): 0} | {k: v for k, v in pairs.items() if k == (5, 5)}
    long_one = [(1, words(random.Random(3), 60_000) + " upper case text here")]
    assert [r["item_id"] for r in decontaminate.leaks(spark.createDataFrame(long_one, "doc_id long, text string"), spark.createDataFrame(items[6:7], "item_id long, text string")).collect()] == [7]


def test_more_items_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 64)
    rng = random.Random(8)
    items = [(i, item_of(rng, 90)) for i in range(10)]
    docs = [(i, f"{words(rng, 20)} {edited(rng, t, 0.05, True)} end") for i, t in items]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(10)}
