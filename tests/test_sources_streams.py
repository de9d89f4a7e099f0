"""Readers on small files, writers, and the streams on files that arrive one after another."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import pages, transcripts
from corpusloom.sources import readers
from corpusloom.streaming import live_pages, live_status


def test_scraped_sites(spark, tmp_path):
    site = {"source_url": "http://s", "scraped_at": "now", "total_pages": 3, "pages": [{"page": 1, "url": "http://s/a", "title": "A", "text": "one"}, {"page": 2, "url": "http://s/b", "title": None, "text": " \n"}, {"page": 3, "url": "http://s/c", "title": "C", "text": "three"}]}
    (tmp_path / "a.json").write_text(json.dumps(site, indent=2))
    got = readers.read_scraped_json(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["page"], r["text"]) for r in got] == [(0, 1, "one"), (2, 3, "three")]
    numbered = pages.number_pages(readers.read_scraped_json(spark, str(tmp_path)).withColumnRenamed("source_url", "site")).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in numbered] == [(1, "Title: A\n\nURL: http://s/a\n\none"), (2, "Title: C\n\nURL: http://s/c\n\nthree")]


def test_vtt_files(spark, tmp_path):
    (tmp_path / "t.vtt").write_bytes(b"WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nbad byte \xff here\n")
    (tmp_path / "empty.vtt").write_bytes(b"")
    files = readers.read_vtt(spark, str(tmp_path))
    assert {r["transcript_id"] for r in files.collect()} == {"t.vtt"}
    (cue,) = transcripts.parse_vtt(files).collect()
    assert cue["text"].startswith("bad byte") and cue["end_s"] == 1.0


def test_outputs_get_an_expiry(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    for _ in range(2):
        readers.append_outputs(df, str(tmp_path / "o"), "2024-01-20")
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == 4 and str(got.first()["expires_at"])[:10] == "2024-01-27"


class Store:
    """A value, a list and timers in memory, as the processor's handle gives them."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], set()

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return self.Rows(self)

    class Rows:
        def __init__(self, store):
            self.store = store

        def get(self):
            return iter(self.store.rows)

        def put(self, rows):
            self.store.rows = list(rows)

        def appendList(self, rows):
            self.store.rows += rows

        def clear(self):
            self.store.rows = []

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0

    def getExpiryTimeInMs(self):
        return min(self.timers)


def live(store, starts, first=0):
    """Rows that a transcript sends for cues at these starts."""
    pages_ = live_pages.Pages()
    pages_.init(store)
    frame = pd.DataFrame({"start_s": starts, "idx": range(first, first + len(starts)), "line": [f"l{first + i}" for i in range(len(starts))], "event_ms": [0 if x is None else int(1000 * x) for x in starts]})
    return [r for f in pages_.handleInputRows((7,), iter([frame]), store) for r in f.to_dict("records")]


def idle(store):
    pages_ = live_pages.Pages()
    pages_.init(store)
    return [r for f in pages_.handleExpiredTimer((7,), store, store) for r in f.to_dict("records")]


@pytest.mark.parametrize("split", [1, 2, 4])
def test_live_pages_equal_the_batch(split):
    starts = [0.0, 100.0, 130.0, 240.0, 260.0, 500.0]
    store = Store()
    out = live(store, starts[:split]) + live(store, starts[split:], split) + live(store, [5.0], 9)
    assert store.timers == {620000}
    out += idle(store)
    assert [(r["page"], r["cues"]) for r in out if r["state"] == "closed"] == [(1, 2), (2, 2), (3, 1), (4, 1)]
    assert [r["text"] for r in out if r["state"] == "late"] == ["l9"]
    out = live(store, [510.0, 700.0], 10)
    assert [(r["page"], r["text"], r["state"]) for r in out] == [(5, "l10", "late"), (5, "l11", "open")]


def test_live_cues_out_of_order_stand_by_start_and_those_without_one_are_rejected():
    store = Store()
    live(store, [0.0, 90.0])
    out = live(store, [60.0, None, 130.0, 60.0, -1.0], 2)
    assert [(r["text"], r["state"]) for r in out] == [("l3", "late"), ("l6", "late"), ("l0\nl2\nl5\nl1", "closed"), ("l4", "open")]
    assert store.rows == [(130.0, 4, "l4")] and store.value[:3] == (2, 130.0, 1)
    out = live(store, [200.0], 7)
    assert out[0]["text"] == "l4\nl7" and len(store.rows) == 2 and store.timers == {320000}
    assert live(store, [None], 8)[0]["state"] == "late" and live(store, []) == [] and len(store.rows) == 2


def test_live_pages_over_files_that_arrive_one_after_another(spark, tmp_path):
    """Pages of the stream alone equal the batch operator's; a cue that comes too late is returned, so no cue is lost."""
    turns = [(c, t) for c in (1, 2, 3) for t in range(11 + c)]
    late = (2, 0)
    parts = [[x for x in turns if x[1] < 4 and x != late], [x for x in turns if 4 <= x[1] < 8], [x for x in turns if x[1] >= 8] + [late]]
    src, folder = str(tmp_path / "cues"), str(tmp_path / "live")
    for part in parts:
        spark.createDataFrame([(c, t, "user" if t % 2 else None, f"said {t}") for c, t in part], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(src)
        sent = live_pages.run(spark, src, folder)
    on_time = spark.read.parquet(src).where("not (conv_id = 2 and turn = 0)").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("idx"), (F.col("turn") * 45).cast("double").alias("start_s"))
    want = {(r["transcript_id"], r["page"]): r["count"] for r in transcripts.window_numbers(on_time).groupBy("transcript_id", "page").count().collect()}
    got = live_pages.newest_pages(sent).collect()
    assert {(r["transcript_id"], r["page"]): r["cues"] for r in got} == want
    assert all(len(r["text"].split("\n")) == r["cues"] for r in got)
    assert [(r["transcript_id"], r["text"]) for r in live_pages.rejected(sent).collect()] == [(2, "[]: said 0")]
    assert sum(want.values()) + 1 == len(turns)


def test_latest_status_wins(spark):
    rows = spark.sql("select * from values (1L, 1L, 'failed', timestamp_ntz'2024-01-01'), (1L, 1L, 'complete', timestamp_ntz'2024-01-02'), (1L, 2L, 'failed', timestamp_ntz'2024-01-01') as v(batch_id, idx, status, seen)")
    got = {r["idx"]: r["status"] for r in live_status.latest(rows).collect()}
    assert got == {1: "complete", 2: "failed"}
