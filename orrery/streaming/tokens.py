"""Pieces of text as a stream: the text of each thread as it grows, up to a marker, by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the stream of a thread gives: its text so far, the pieces in it, and why it has ended (marker, silence) or null.
GROWN = "thread string, pieces long, text string, ended string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Growing(StatefulProcessor):
    """Keeps the pieces of a thread (thread, seq from 0, piece, ts) and gives its text whenever a batch brings more of it.

    Pieces count in order of seq: those that come early wait, and ones that come again are left out. The text ends behind the
    first marker, which may be cut between pieces: as many characters of the text's end as it may begin in are kept
    beside the pieces, so that only new text is searched. Without a marker it ends when event time passes `silence` milliseconds
    after the thread's last piece. What comes after the end is left out; of an ended thread one flag remains.
    """

    def __init__(self, marker: str, silence: int):
        self.marker, self.silence = marker, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "piece string")
        self.early = handle.getMapState("early", "seq long", "piece string")
        self.place = handle.getValueState("place", "next long, tail string, timer long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, tail, timer, ended = self.place.get() if self.place.exists() else (0, "", -1, False)
        if ended:
            return
        latest = -1
        for row in rows:
            latest = max(latest, int(row.ts.timestamp() * 1000) if row.ts is not None else -1)
            if row.seq is not None and row.seq >= at:
                self.early.updateValue((row.seq,), (row.piece or "",))
        fresh = []
        while not ended and self.early.containsKey((at,)):
            (piece,) = self.early.getValue((at,))
            self.early.removeKey((at,))
            at += 1
            found = (tail + piece).find(self.marker) if self.marker else -1
            if found >= 0:
                piece, ended = piece[: found + len(self.marker) - len(tail)], True
            tail = (tail + piece)[-(len(self.marker) - 1) :] if len(self.marker) > 1 else ""
            fresh.append((piece,))
        if fresh:
            self.pieces.appendList(fresh)
        if ended:
            yield self._grown(key, at, "marker")
            self._close(timer)
            return
        if latest >= 0:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = max(timer, latest + self.silence)
            self.handle.registerTimer(timer)
        self.place.update((at, tail, timer, False))
        if fresh:
            yield self._grown(key, at, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.place.exists():
            at, _, _, ended = self.place.get()
            if not ended:
                yield self._grown(key, at, "silence")
                self._close(-1)

    def _grown(self, key, at: int, ended: str | None) -> Row:
        return Row(thread=key[0], pieces=at, text="".join(p for (p,) in self.pieces.get()), ended=ended)

    def _close(self, timer: int) -> None:
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.pieces.clear()
        self.early.clear()
        self.place.update((0, "", -1, True))

    def close(self) -> None:
        pass


def growing_texts(pieces: DataFrame, marker: str, silence: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """GROWN of a stream of pieces (thread, seq, piece, ts): a row for each thread and batch that brings more of its text, and one
    when it ends. Shuffled by thread; the state is in RocksDB, which the session has to name (rocks). Null threads are one thread."""
    number, unit = silence.split()
    per = {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
    stream = pieces.select(F.col("thread").cast("string").alias("thread"), F.col("seq").cast("long").alias("seq"), "piece", "ts").withWatermark("ts", late)
    return stream.groupBy("thread").transformWithState(Growing(marker, int(number) * per), GROWN, "Update", "EventTime")


def rocks(spark) -> None:
    """Names RocksDB as the session's state store, which keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
