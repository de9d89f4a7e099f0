"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import components, decontaminate, html_text, line_dedup, media, near_dedup, packing, quality, repeats, url_filter, vectext, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1, n=40):
    """Texts with exact and near copies, shared passages and lines, and odd ones."""
    rng = random.Random(seed)
    passage, line = words(rng, 60), "A shared LINE of text " + words(rng, 4)
    texts = []
    for i in range(n):
        t = words(rng, rng.randint(5, 120))
        if i % 5 == 0:
            t += "\n" + passage
        if i % 4 == 0:
            t += "\n  " + (line if i % 8 else line.upper().lower()) + "\t\n" + line
        texts.append(t)
    near = texts[3].split()
    for k in range(8):
        c = list(near)
        c[(k * 7) % len(c)] = f"edit{k}"
        texts.append(" ".join(c))
    texts += [texts[7], texts[7], "", None, " \n\t ", "one two", "One TWO", "ünï cödé 日本語 " * 30, "a" * 400, "ab" * 300, "\n\n\n", words(rng, 4000)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, texts[7], None, None, None)]  # a repeated row, and one without an id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}


def test_line_dedup(docs, none):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    texts, holders = texts_of(docs), defaultdict(set)
    for d, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(d)
    gone = lambda d, line: len(key(line)) >= 10 and min(holders[key(line)]) < d
    want = {d: (t.count("\n") + 1, sum(gone(d, x) for x in t.split("\n")), "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in texts.items()}
    clash = docs.withColumns({"n_lines": F.lit("x"), "pos": F.lit(1), "h1": F.lit(2)})
    out = line_dedup.line_dedup(clash).collect()
    assert len(out) == docs.count() and out[0]["pos"] == 1
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in out if r["doc_id"] is not None} == want
    assert [r["n_dropped"] for r in out if r["doc_id"] is None] == [0]
    assert line_dedup.line_dedup(none).count() == 0


def test_line_bitmaps_are_run_lengths(spark):
    d = spark.createDataFrame([(1, "shared line one\nshared line two\nshared line six"), (2, "mine alone here\nshared line one\nshared line two\nother own line\nshared line six")], "doc_id long, text string")
    (r,) = line_dedup.keep_bitmaps(d).collect()
    assert (r["doc_id"], r["starts"], r["ends"], r["keep_rle"]) == (2, [1, 4], [2, 4], [1, 2, 1, 1])


def test_hot_lines_take_the_other_path(spark):
    rows = [(i, f"the very same long line\nown line number {i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup._hot_keys(line_dedup._keyed_lines(d, 10)).count() == 1
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(d).collect()}
    assert out == {i: int(i > 0) for i in range(300)}


def test_media(docs, none):
    def want(t):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])

    out = media.media_columns(docs.withColumn("chunks", F.lit(1))).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == Counter((d, *want(t)) for d, t in texts)
    by_payload = defaultdict(set)
    for r in out:
        by_payload[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_payload.values())
    assert media.media_columns(none).count() == 0


def test_chunks_follow_content_and_are_stored_once(spark):
    rng = random.Random(4)
    a, b = words(rng, 6000), words(rng, 6000)
    d = spark.createDataFrame([(1, a + b), (2, "x" + a + b), (3, a)], "doc_id long, text string")
    lists, store = media.store_media(d)
    refs = [c["digest"] for r in lists.collect() for c in r["chunks"]]
    assert len(set(map(bytes, refs))) < 0.7 * len(refs)
    assert store.count() == store.select("digest").distinct().count()
    for m in (b"", b"x" * 100, (a + b).encode()):
        cuts = media.chunk_cuts(m)
        assert cuts[-1] == len(m) and all(z - s <= media.CHUNK_MOST for s, z in zip([0, *cuts], cuts))


def test_damaged_chunks_are_noticed(spark):
    lists, store = media.store_media(spark.createDataFrame([(1, "hello")], "doc_id long, text string"))
    bad = lists.withColumn("media_sha256", F.unhex(F.lit("00")))
    with pytest.raises(Exception, match="differs"):
        media.read_media(bad, store).collect()


def shingles(t, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts):
    sets, parent = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in texts}


def test_near_dedup(docs, none):
    out = near_dedup.near_components(docs.withColumns({"key": F.lit(1), "rep": F.lit("r"), "n": F.lit(0)})).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None} == brute_components(texts_of(docs))
    assert len(out) == docs.count() and all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert near_dedup.near_components(none).count() == 0


@pytest.mark.parametrize("turn", [1, -1])
def test_near_dedup_of_two_texts_under_one_id(spark, turn):
    rng = random.Random(3)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, words(rng, 30)), (1, None)][::turn]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(d, c, k) for d, n, c, k in got if n} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_near_dedup_in_buckets_of_many_blocks(spark, monkeypatch):
    """Rows outside the main component meet each other and all of it, over many blocks and centres of many members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "MEMBERS", 5)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rng = random.Random(12)
    base = words(rng, 70).split()
    rows = []
    for i in range(150):
        c = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            c[rng.randrange(len(c))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(dict(rows))


def test_near_dedup_in_a_large_loose_group(spark):
    """Edits of one text, many of them past the threshold: links through third texts must not be lost."""
    rng = random.Random(9)
    base = words(rng, 90).split()
    rows = []
    for i in range(260):
        c = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6])):
            c[rng.randrange(len(c))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(dict(rows))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (20, 20), (3, 1), (30, 31), (30, 31)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 30: 30, 31: 30}
    chain = [(i, i + 1) for i in range(200)]
    assert {r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def brute_repeats(texts):
    seen, want = set(), {}
    for d, t in sorted(texts.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        want[d] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return want


def test_exact_repeats(docs, none):
    want = brute_repeats(texts_of(docs))
    out = repeats.remove_repeats(docs.withColumns({"th": F.lit(1), "spans": F.lit(2)}).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out if r["doc_id"] is not None} == want
    assert [r["n_removed"] for r in out if r["doc_id"] is None] == [0] and len(out) == docs.count()
    assert repeats.remove_repeats(none).count() == 0


def test_exact_repeats_with_a_passage_in_every_document(spark):
    """The anchors at the passage's ends see other windows in each document, over many Arrow batches."""
    rng = random.Random(11)
    passage, key = words(rng, 40), "spark.sql.execution.arrow.maxRecordsPerBatch"
    texts = {i: f"{words(rng, rng.randint(0, 12))} {passage} {words(rng, rng.randint(0, 12)) if i % 3 else 'one tail that some of them share'}" for i in range(150)}
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        out = repeats.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    finally:
        spark.conf.set(key, before)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == brute_repeats(texts)


def test_exact_repeats_shuffle_texts_once(docs):
    """The join with runs and the join with spans read one shuffle of the texts."""
    out = repeats.remove_repeats(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange \[doc_id#\d+L, th#\d+L, text#\d+\]", plan)


def test_sorted_runs_hold_what_was_put():
    import numpy as np

    rng, runs, held = np.random.default_rng(3), [], set()
    for _ in range(300):
        keys = np.unique(rng.integers(0, 5000, rng.integers(0, 60)).astype(np.uint64))
        old = repeats.holds(runs, keys)
        assert old.tolist() == [k in held for k in keys.tolist()]
        repeats.put(runs, keys[~old])
        held.update(keys.tolist())
    assert len(runs) <= 14 and sum(map(len, runs)) == len(held)


def test_window_runs_cover_every_window_once():
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 100, 100, 199, 350, 5000])
    first, n, _ = repeats.window_runs(data, offsets, 100)
    covered = sorted(x for a, k in zip(first, n) for x in range(a, a + k))
    assert covered == [x for a, z in zip(offsets, offsets[1:]) for x in range(a, z - 99)]


@pytest.fixture(scope="module")
def bpe():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_packing(docs, none, bpe):
    from tokenizers import Tokenizer

    size = 64
    odd = [(500 + i, t) for i, t in enumerate(["<|endoftext|>", "a<|endoftext|> b <|endoftext|", "x's y'll  z\u00a0\u0085\t\n 12½ ǅ", "\x1c\x1f \x00", "кот 日本 é" * 9])]
    docs = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    rows = packing.pack(docs.withColumns({"piece": F.lit(1), "block": F.lit(2), "rank": F.lit(3), "blocks": F.lit(4)}), bpe, size).collect()
    tok = Tokenizer.from_file(bpe)
    ids = [[*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()]
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    want = Counter()
    for x in ids:
        cuts = [0, *range(len(x) % size or size, len(x) + 1, size)]
        want.update((k, a, z - a, crc(x[a:z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= size and len(at) <= sum(map(len, ids)) / size * 1.1 + 1
    assert packing.pack(none, bpe).count() == 0


def odd_texts(seed, n):
    """Texts of signs that splits turn on, some with code points that splitting does not know."""
    rng = random.Random(seed)
    signs = ["'", "s", "t", "ll", "ve", "re", "m", "d", "'s", "'LL", "'re", " ", " ", "  ", "\n", "\t", "\u00a0", "\u0085", "é", "Ł", "ª", "²", "½", "1", "23", "abc", "L", "?", "...", "\0", "\x1c", "ǅ", "ɏ", "_", "x" * 14, "x" * 17, "\r\n"]
    far = ["кот", "日", "<|endoftext|>", "<|endoftext|", "\u2009", "😀", "ɐ"]
    texts = ["".join(rng.choice(signs if rng.random() < 0.995 else far) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return [*texts, None, "'", "s", "'l", "l", " ", "a", "é", "<|endoft", "ext|>", ""]


def ids_of(encoder, texts):
    return list(encoder.ids(pa.array(texts, pa.string())))


def test_splits_are_the_tokenizers_own(bpe, monkeypatch):
    """Also with a small table, in which splits crowd each other out and are forgotten, and looked up a few at a time."""
    for kept, slots, step in ((packing.KEPT_WORDS, packing.SLOTS, packing.STEP_WORDS), (300, 64, 50)):
        for name, value in (("KEPT_WORDS", kept), ("SLOTS", slots), ("STEP_WORDS", step)):
            monkeypatch.setattr(packing, name, value)
        encoder = packing.Encoder(bpe)
        for k in range(10):
            texts = odd_texts(k, 1000)
            assert ids_of(encoder, texts) == [encoder.plain(t or "").tobytes() for t in texts]
        assert ids_of(encoder, []) == [] and ids_of(encoder, [None]) == [b""]


def test_tokenizers_with_other_splits_get_texts_whole(bpe, tmp_path):
    import json

    with open(bpe) as f:
        plain = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"use_regex": False}}):
        path = tmp_path / "tokenizer.json"
        path.write_text(json.dumps(plain | change))
        encoder = packing.Encoder(str(path))
        texts = ["Two WORDS", "it's", *odd_texts(3, 50)]
        assert ids_of(encoder, texts) == [encoder.plain(t or "").tobytes() for t in texts]


def test_known_splits_cost_a_tenth_of_tokenizing(spark, bpe):
    """CPU time, the least of three runs each; before splits were found and looked up in numpy it was about a fifth."""
    import time

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder = packing.Encoder(bpe)

    def least(run):
        run()
        times = []
        for _ in range(3):
            before = time.thread_time()
            run()
            times.append(time.thread_time() - before)
        return min(times)

    column = pa.array(texts, pa.string())
    assert least(lambda: list(encoder.ids(column))) < 0.1 * least(lambda: [encoder.plain(t or "") for t in texts])


def test_packing_the_documents_table_at_full_length(spark, bpe, monkeypatch):
    """Ids are the tokenizer's own; as few sequences as a plain best-fit packing of the same pieces at most, close to the bound."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)  # many blocks of a length
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, bpe).collect()
    tok = Tokenizer.from_file(bpe)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])) for r in rows)
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    rooms = []
    for w in sorted((r["length"] for r in rows), reverse=True):
        best = min((x for x in rooms if x >= w), default=None)
        if best is not None:
            rooms.remove(best)
        rooms.append((2048 if best is None else best) - w)
    used = len({r["sequence_id"] for r in rows})
    assert used <= len(rooms) and used <= -(-sum(map(len, ids.values())) // 2048) * 1.02 + 1


def test_reduction_goes_on_past_a_length_it_cannot_settle():
    fixed, rest = packing.reduce_instance({1500: 1000, 700: 1, 400: 1000, 130: 3000, 2000: 5, 48: 5}, 2048)
    assert ((2000, 48), 5) in fixed and 2000 not in rest
    assert packing.reduce_instance({60: 4, 25: 4, 15: 4}, 100)[0] == [((60, 25, 15), 4)]


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_an_optimum(seed):
    """On small instances the fixed bins and an exact packing of the rest need no more bins than an exact packing."""
    rng = random.Random(seed)
    items = sorted(rng.randint(1 + seed % 3, 12) for _ in range(9))

    def best(ws, size=12):
        ws, least = sorted(ws, reverse=True), [len(ws)]

        def go(i, bins):
            if len(bins) >= least[0]:
                return
            if i == len(ws):
                least[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] >= ws[i]:
                    bins[k] -= ws[i]
                    go(i + 1, bins)
                    bins[k] += ws[i]
            go(i + 1, [*bins, size - ws[i]])

        go(0, [])
        return least[0]

    fixed, rest = packing.reduce_instance(Counter(items), 12)
    left = [w for w, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (best(left) if left else 0) == best(items)
    used = Counter(w for ws, n in packing.plan(Counter(items), 12) for w in ws for _ in range(n))
    assert used == Counter(items)


def test_decontamination(spark, docs, none):
    rng = random.Random(2)
    items = [(i, words(rng, 30 + i)) for i in range(12)] + [(90, "tiny"), (91, None), (92, ""), (None, words(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = []
    for i, t in items[:12]:
        edited = t.split()
        edited[3], edited[11] = "zz", edited[11] + "q"
        body = words(rng, 80)
        planted += [(1000 + i, f"{body}\n{t.upper() if i % 2 else t} {body}"), (2000 + i, f"{body} {' '.join(edited)}  {body}"), (3000 + i, t)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*planted, planted[0], (None, items[0][1])], "doc_id long, text string")).withColumn("key", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(d, bench.withColumn("size", F.lit(0))).collect()}
    assert set(got) == {(k + i, i) for i in range(12) for k in (1000, 2000, 3000)}
    assert all(v == 0 for (a, _), v in got.items() if a < 2000 or a >= 3000) and all(1 <= v <= 12 for (a, _), v in got.items() if 2000 <= a < 3000)
    left = {r["doc_id"] for r in decontaminate.decontaminate(d, bench).collect()}
    assert left == {r["doc_id"] for r in docs.collect()}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(d, bench.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_edit_distance(seed):
    rng = random.Random(seed)
    p, t = ("".join(rng.choice("ab c") for _ in range(n)).encode() for n in (rng.randint(1, 12), rng.randint(0, 30)))
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, e in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    assert decontaminate.edit_distance_within(p, t)[0] == min(row)


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.example.net/de/2?q=/en/", "http://notnet/", "http://net", "http://net/", "https://example.com/de/", "http://badexample.com/de/x", "ftp://a.b.org/fr/y#z", "http://a.org/frx", "no url", "", None, "http://Listed.io/p?x=1", "http://listed.io/q", "http://h/" + "a/" * 500, "://", "http://a.example.com/de/x", "http://example.com/de"]
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)] + [(0, urls[0], "keep")], "page_id long, url string, rule string").withColumn("suffix", F.lit(9))
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://LISTED.io/p",), (None,), ("nothing",)], "url string")
    out = url_filter.judge_urls(pages, rules, listed).collect()
    assert len(out) == len(urls) + 1 and out[0]["suffix"] == 9
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in out}

    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0].translate(LOW)
        path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0]
        fit = [(len(h + p), h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")) if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, best and best[1], best[2] if best else ("block" if (host, path) == ("listed.io", "/p") else "allow")

    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.where("false"), listed.where("false")).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.where("false"), rules, listed).count() == 0


def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    probes = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    hits = {r["key"] for r in url_filter.bloom_hits(probes, keys).collect()}
    assert {f"k{i}" for i in range(2000)} <= hits and len(hits) < 2000 + 0.05 * 18000


def test_html_text(spark):
    crf = html_text.fit_sample([])
    page = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div><article><h1>Big &amp; small</h1><p>The river   rose in the night,
    and the <b>lower</b> road was closed.</p><p>Members voted on the plan &lt;late&gt;.<p>Nobody had seen it.</article>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>First! What a story this is, thanks.</p></div></section><footer>&copy; Paper</footer></body></html>"""
    want = "Big & small The river rose in the night, and the lower road was closed. Members voted on the plan <late>. Nobody had seen it."
    assert html_text.main_text(crf, page) == want
    assert html_text.main_text(crf, None) == html_text.main_text(crf, "") == html_text.main_text(crf, "<p> </p><!-- x") == ""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (1, "u", page), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert Counter((r["page_id"], r["text"]) for r in html_text.extract(df).collect()) == Counter([(1, want), (1, want), (2, ""), (None, "")])
    assert html_text.extract(df.where("false")).count() == 0


def test_html_on_composed_pages_not_seen_in_fitting():
    rng = random.Random(99)
    crf = html_text.fit_sample([])
    right = total = 0
    for _ in range(80):
        page, kept = html_text.compose(rng, html_text.STOCK, [x[:30] for x in html_text.STOCK])
        blocks = html_text.leaf_blocks(page)
        labels = [int(any(m in b.text for m in kept)) for b in blocks]
        for b in blocks:
            b.text = re.sub("⁣[0-9]+⁣", "", b.text) or "x"
        right += sum(a == b for a, b in zip(labels, crf.viterbi(html_text.block_features(blocks)), strict=True))
        total += len(labels)
    assert right / total > 0.95


def test_quality(spark, none):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        kind = i % 6
        t = words(rng, rng.randint(20, 90))
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if kind == 1:
            t += " " + " ".join(rng.choice(["vile", "nasty", "rotten"]) for _ in range(3))
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        if i % 2 or kind == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    rows += [(None, None, None, None, None), (901, "", "", "", 0), (0, rows[0][1], "en", "s0", 1)]
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), labels[0]], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(rows, DOCS).withColumns({"y": F.lit(1), "score": F.lit(0.0), "keep": F.lit(True)})
    out = quality.quality_scores(d, lab).collect()
    assert len(out) == len(rows)
    hit = Counter()
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            hit[r["doc_id"] % 6 > 1, r["keep"]] += 1
    assert hit[True, True] / (hit[True, True] + hit[True, False]) > 0.97 and hit[False, False] / (hit[False, True] + hit[False, False]) > 0.9
    kept = quality.accepted(d, lab)
    assert kept.columns == d.columns and kept.count() < len(rows)
    assert quality.accepted(d, lab.where("false")).count() == len(rows) and quality.quality_scores(none, lab).count() == 0


def test_quality_on_documents_kept_out_of_fitting(spark):
    """Labelled documents of the given tables: those that neither fitted a view, nor calibrated it, nor joined the two."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.fit(docs, labels).held_out
    assert found["documents"] >= 200 and found["good_kept"] >= 0.97 and found["bad_rejected"] >= 0.9, found


def test_quality_with_few_or_rare_labels(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(w.upper() + "!!" for w in words(rng, 40).split()) if i % 10 == 0 else words(rng, 40), "en", "s", 0) for i in range(300)] + [(7, "two texts under one id", "en", "s", 0), (400, words(rng, 300_000), "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    for few in ([(0, 0, 0), (1, 1, 0)], [(i, int(i % 10 != 0), 0) for i in range(60)]):
        out = quality.quality_scores(d, spark.createDataFrame(few, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    bad = [r["keep"] for r in out if r["doc_id"] % 10 == 0 and r["doc_id"] < 300]
    assert sum(bad) <= 0.1 * len(bad)
    y = __import__("numpy").array([1] * 40 + [0] * 3 + [-1] * 5)
    parts = quality.parts_of(y)
    assert all({0, 1} <= set(y[p]) for p in parts[:3]) and not set(parts[0]) & set(parts[3])


def test_warc(spark):
    htmls = [(5, "u5", "<p>x</p>"), (3, "u3", "<p>x</p>"), (7, None, None), (8, "u8", ""), (9, "a\r\nb", "é" * 1000), (10, "u", "z" * 600_000), (3, "u3", "<p>x</p>"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame(htmls, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "refers_to": F.lit(4)})
    bundles = warc.write_warc(pages.repartition(2))
    out = warc.read_warc(bundles).collect()
    assert len(out) == len(htmls)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in out}
    digest = lambda t: warc.sha1_base32((t or "").encode())
    x = digest("<p>x</p>")
    assert got == {(5, "revisit", 3, 8, x), (3, "response", None, 8, x), (3, "revisit", 3, 8, x), (None, "response", None, 8, x), (7, "response", None, 0, digest("")), (8, "revisit", 7, 0, digest("")), (9, "response", None, 2000, digest("é" * 1000)), (10, "response", None, 600000, digest("z" * 600_000))}
    assert [bytes(r["payload"]) for r in warc.read_record(bundles, "urn:page:9").collect()] == [("é" * 1000).encode()]
    for b in bundles.collect():
        frames = warc.seek_table(bytes(b["bundle"]))
        assert {x["frame"] for x in b["index"]} == set(range(len(frames)))
    ids = [x["record_id"] for b in bundles.collect() for x in b["index"]]
    assert len(set(ids)) == len(htmls) and {f"urn:page:{i}" for i in (3, 5, 7, 8, 9, 10)} <= set(ids)
    assert {r["page_id"]: r["url"] for r in out}[7] is None
    small = {r["page_id"]: r["record_type"] for r in warc.read_warc(warc.write_warc(pages, min_payload=9)).collect()}
    assert small[5] == small[8] == "response"
    assert warc.read_warc(warc.write_warc(pages.where("false"))).count() == 0
    # Two payloads under one page, each repeated: the later records name the record that holds their payload.
    twice = [(4, u, h) for u in "ab" for h in ("<p>x</p>", "<p>y</p>")] + [(6, "c", "<p>y</p>")]
    bundles = warc.write_warc(spark.createDataFrame(twice, "page_id long, url string, html string").repartition(3))
    found = [f for b in bundles.collect() for f, _, _ in strict_records(zstandard.ZstdDecompressor().stream_reader(bytes(b["bundle"]), read_across_frames=True).read())]
    ids = {f["WARC-Record-ID"]: f for f in found}
    later = [f for f in found if f["WARC-Type"] == "revisit"]
    assert len(ids) == 5 and len(later) == 3
    for f in later:
        first = ids[f["WARC-Refers-To"]]
        assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
    assert [r["refers_to"] for r in warc.read_warc(bundles).where("record_type = 'revisit'").collect()] == [4, 4, 4]


def strict_records(data: bytes):
    """A reader of its own, by the text of the WARC 1.1 standard: yields (fields, HTTP head, payload)."""
    import http.client
    import io

    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(re.fullmatch(r"([A-Za-z-]+): (.*)", x).groups() for x in lines[1:])
        assert len(fields) == len(lines) - 1 and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Target-URI"} <= set(fields)
        assert re.fullmatch(r"<[a-z]+:[^<> ]+>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n" and fields["Content-Type"].startswith("application/http")
        status, _, rest = block.partition(b"\r\n")
        assert status == b"HTTP/1.1 200 OK"
        stream = io.BytesIO(rest)
        yield fields, http.client.parse_headers(stream), stream.read()
        at = end + 8 + n


def test_warc_bundles_by_another_reader(spark):
    rows = [(i, f"http://h/{i}", ["<p>a</p>", "<p>b</p>", "é" * (i + 1), None][i % 4]) for i in range(40)]
    bundles = warc.write_warc(spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")).collect()
    found = [r for b in bundles for r in strict_records(zstandard.ZstdDecompressor().stream_reader(bytes(b["bundle"]), read_across_frames=True).read())]
    assert len(found) == 41 and len({f["WARC-Record-ID"] for f, _, _ in found}) == 41
    ids = {f["WARC-Record-ID"]: f for f, _, _ in found}
    for fields, head, payload in found:
        page = int(fields["WARC-Record-ID"].split(":")[2].rstrip(">"))
        want = (rows[page][2] or "").encode()
        assert int(head["Content-Length"]) == len(want) and fields["WARC-Payload-Digest"] == "sha1:" + warc.sha1_base32(want)
        assert payload == (want if fields["WARC-Type"] == "response" else b"")
        if fields["WARC-Type"] == "revisit":
            assert ids[fields["WARC-Refers-To"]]["WARC-Type"] == "response" and ids[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]


def test_shingles_equal_plain_ones():
    import pyarrow as pa

    texts = [r[1] for r in corpus(3, 20)]
    hashed = vectext.shingle_sets(pa.array(texts, pa.string()))
    assert [len(h) for h in hashed] == [len(shingles(t)) for t in texts]
    for i in range(0, len(texts), 5):
        for j in range(0, len(texts), 7):
            assert len(set(hashed[i].tolist()) & set(hashed[j].tolist())) == len(shingles(texts[i]) & shingles(texts[j]))
