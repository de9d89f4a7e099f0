"""Decontamination with items longer than the walks' moves reach."""

import random

import pytest

from corpusloom.llm import decontaminate


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, text, rate):
    out = list(text)
    for _ in range(int(rate * len(text))):
        at, c = rng.randrange(len(out)), rng.choice("uvwxyz")
        out[at : at + rng.choice([0, 1])] = [c] if rng.random() < 0.7 else []
    return "".join(out)


@pytest.mark.parametrize("size", [1365, 1366, 3000, 6000])
def test_long_items_are_found(spark, size):
    rng = random.Random(size)
    items = [(i, words(rng, size // 4)[:size].strip()) for i in range(12)]
    docs = [(i, f"{words(rng, 60)} {edited(rng, t, 0.095)} {words(rng, 60)}") for i, t in items] + [(100 + i, words(rng, 2 * size // 5)) for i in range(5)]
    # The start and the end of an item that differs in between are no item.
    docs += [(200, f"{items[0][1][: size // 2]} {words(rng, size // 5)}"), (201, items[1][1])]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in range(12)} | {(201, 1)}
    assert all(r["distance"] <= 0.1 * size for r in got)
