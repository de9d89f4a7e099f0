"""Live transcript pages: time-window pages over cues that arrive as a stream.

State for each transcript is the open page: a value with its number, its start and its timer, and a list of its cues, a row
each. A page is sent closed when a cue opens the next one or when it stays idle on event time, and sent open, as it stands,
at the end of each batch that adds to it. So what was sent names every page: its fullest row counts. Cues before the open
page's start, and cues without a start, go to a reject row. A page's cues stand by start, then by idx, in whatever order
they came; of repeated cues each counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: When the given conversations began, 2024-01-01 UTC. Not the epoch: a stream's first watermark is, and what is not after it is dropped.
STARTED = 1704067200
OUT = "transcript_id long, page int, cues int, text string, state string"
COLUMNS = ["transcript_id", "page", "cues", "text", "state"]
CLOSED, OPEN, LATE = "closed", "open", "late"
#: least: where the open page starts or, if none is open, the earliest start that the next one may have. timer: when it is idle, -1 without one.
PLACE, CUES = "page int, least double, cues int, seen long, timer long", "start_s double, idx long, line string"
#: Lists and timers need this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _text(cues: list[tuple]) -> str:
    return "\n".join(line for _, _, line in cues)


class Pages(StatefulProcessor):
    """Cues (start_s, idx, line, event_ms) of a transcript to its pages of ``seconds``."""

    def __init__(self, seconds: float = 120.0) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.place, self.cues = handle, handle.getValueState("place", PLACE), handle.getListState("cues", CUES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        page, least, count, seen, timer = self.place.get() or (1, float("-inf"), 0, 0, -1)  # each call on state is a round trip
        batch = pd.concat(list(rows))
        late = ~(batch["start_s"] >= least)
        out = [(key[0], page, 1, line, LATE) for line in batch["line"][late]]
        batch = batch[~late]
        if len(batch):
            fresh = list(zip(batch["start_s"].astype(float).tolist(), batch["idx"].fillna(-1).astype("int64").tolist(), batch["line"].tolist(), strict=True))
            cues = sorted([*(self.cues.get() if count else ()), *fresh], key=lambda c: c[:2])
            starts = np.array([c[0] for c in cues])
            begun, moved = 0, False
            least = least if count else cues[0][0]
            while (end := int(np.searchsorted(starts, least + self.seconds))) < len(cues):  # one step a page
                out.append((key[0], page, end - begun, _text(cues[begun:end]), CLOSED))
                page, begun, least, moved = page + 1, end, cues[end][0], True
            kept = cues[begun:]
            if count and not moved:
                self.cues.appendList(fresh)
            else:
                self.cues.put(kept)
            out.append((key[0], page, len(kept), _text(kept), OPEN))
            seen = max(seen, int(batch["event_ms"].max()))
            idle = max(int(timerValues.getCurrentWatermarkInMs()) + 1, seen + int(1000 * self.seconds))
            if idle != timer:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(idle)
            self.place.update((page, float(least), len(kept), seen, idle))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        page, least, count, seen, timer = self.place.get()
        out = []
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], page, count, _text(sorted(self.cues.get(), key=lambda c: c[:2])), CLOSED))
            self.cues.clear()
            # Numbers go on where they were if the transcript is taken up again.
            self.place.update((page + 1, least + self.seconds, 0, seen, -1))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def page_stream(cues: DataFrame, seconds: float = 120.0, lateness: str = "10 minutes") -> DataFrame:
    """cues: a stream of transcript_id, idx, start_s, line, event_time. Cues behind the watermark never get here: Spark drops
    and counts them, so lateness has to cover how late a cue may come. The query has to start with the state store of STORE."""
    rows = cues.withWatermark("event_time", lateness).select("transcript_id", "idx", "start_s", "line", F.unix_millis("event_time").alias("event_ms"), "event_time")
    return rows.groupBy("transcript_id").transformWithStateInPandas(Pages(seconds), OUT, "append", "eventTime")


def newest_pages(sent: DataFrame) -> DataFrame:
    """(transcript_id, page, cues, text) of all rows sent: each page as it last stood."""
    last = sent.where(F.col("state") != LATE).groupBy("transcript_id", "page").agg(F.max(F.struct("cues", "text")).alias("x"))
    return last.select("transcript_id", "page", "x.cues", "x.text")


def rejected(sent: DataFrame) -> DataFrame:
    """(transcript_id, text) of the cues that came too late."""
    return sent.where(F.col("state") == LATE).select("transcript_id", "text")


def run(spark: SparkSession, source: str, folder: str, seconds: float = 120.0) -> DataFrame:
    """Rows sent for all cues of conversations there are now, 45 s apart. Run again on the same folder, it takes in new files."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")  # a pattern, so a table may be a file or a folder
    start = (F.col("turn") * 45).cast("double")
    cues = stream.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("idx"), start.alias("start_s"), F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]: "), F.coalesce("text", F.lit(""))).alias("line"), F.timestamp_seconds(start + STARTED).alias("event_time"))
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # read when the query starts, then put back
    try:
        query = page_stream(cues, seconds).writeStream.format("parquet").option("path", f"{folder}/pages").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/pages")
