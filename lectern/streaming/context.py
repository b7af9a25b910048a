"""Streams of segments (an extension): per-document context and quality counts, resumable through the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def speaker_windows(segments: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """A stream of segments (ts, doc_id, speaker, confidence) -> rows and doubtful rows by window; late rows count until the
    watermark passes."""
    w = segments.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "speaker")
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.5).alias("doubtful")).select("w.start", "w.end", "speaker", "n", "doubtful")


CONTEXT = "doc_id long, chunks int, known array<string>, active array<string>, closed boolean"
#: State with timers is kept by this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(idle_ms: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Context(StatefulProcessor):
        """One document: how many chunks, who spoke last, and the names with their places; a timer that closes it."""

        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", "chunks int, names int, active array<string>, seen long")
            self.names = handle.getMapState("names", "name string", "place int")

        def _row(self, key, chunks, active, closed):
            known = [name for _, name in sorted((place[0], name[0]) for name, place in self.names.iterator())] if self.names.exists() else []
            return pd.DataFrame({"doc_id": [key[0]], "chunks": [chunks], "known": [known], "active": [list(active)], "closed": [closed]})

        def handleInputRows(self, key, rows, timerValues):
            chunks, names, active, seen = self.last.get() if self.last.exists() else (0, 0, [], 0)
            active = list(active)
            pdf = pd.concat(list(rows)).sort_values(["chunk_idx", "seq"])
            seen = max(seen, int(pdf.ms.max()))
            for name in pdf.speaker:
                if name and name not in ("旁白", "UNKNOWN"):
                    if not self.names.containsKey((name,)):
                        self.names.updateValue((name,), (names,))
                        names += 1
                    active = [name, *[a for a in active if a != name]][:3]
            chunks = max(chunks, int(pdf.chunk_idx.max()) + 1)
            self.last.update((chunks, names, active, seen))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(seen, timerValues.getCurrentWatermarkInMs()) + idle_ms)
            yield self._row(key, chunks, active, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.last.exists():
                chunks, _, active, _ = self.last.get()
                yield self._row(key, chunks, active, True)
                self.last.clear()
                self.names.clear()

        def close(self):
            pass

    return Context()


def track_context(segments: DataFrame, idle_seconds: int = 86_400, delay: str = "10 minutes") -> DataFrame:
    """A stream of segments (ts, doc_id, chunk_idx, seq, speaker) -> the document's context after each batch: characters in
    order of first appearance, and up to three that spoke last.

    A document whose last segment lies idle_seconds behind the watermark is reported once more as closed and forgotten, so state
    follows the documents at work, not all that ever came. A restart goes on from the checkpoint. Rows of later batches are
    taken as they come, if they are no later than `delay`; within a batch they are put in order.
    """
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    slim = segments.withWatermark("ts", delay).select("ts", "doc_id", "chunk_idx", "seq", "speaker", F.unix_millis("ts").alias("ms"))
    return slim.groupBy("doc_id").transformWithStateInPandas(_processor(idle_seconds * 1000), CONTEXT, "Update", "EventTime")
