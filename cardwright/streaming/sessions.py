"""Sign-in sessions and upserts as streams: state that runs out, and batches that count once however often they are given."""

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardwright.sources.bucketed import Tables

#: How long a session lasts after it was written. Fixed value.
LASTS = timedelta(days=7)
ANSWERS = "sid string, at timestamp, valid boolean, sess string"
_STATE = "sess string, expire timestamp"


class Sessions(StatefulProcessor):
    """The session of each key: written with an expiry, read while it lasts, gone once it is read later or was not touched for so long."""

    def __init__(self, lasts: timedelta = LASTS):
        self.lasts = lasts

    def init(self, handle: StatefulProcessorHandle) -> None:
        # sessions that nobody reads any more leave the state by the store's own clock
        self.session = handle.getValueState("session", _STATE, ttlDurationMs=int(self.lasts / timedelta(milliseconds=1)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))  # of one session and one batch
        events["rank"] = events["action"].map({"write": 0, "delete": 1}).fillna(2)
        held = self.session.get() if self.session.exists() else None
        before, out = held, []
        for e in events.sort_values(["at", "rank"], kind="stable").itertuples():
            if e.action == "write":
                held = (e.sess, e.at + self.lasts)
            elif e.action == "delete":
                held = None
            else:
                valid = held is not None and pd.Timestamp(held[1]) >= e.at
                out.append((key[0], e.at, valid, held[0] if valid else None))
                held = held if valid else None
        if held is None:
            self.session.clear()
        elif held is not before:
            self.session.update((held[0], pd.Timestamp(held[1]).to_pydatetime()))
        if out:
            yield pd.DataFrame(out, columns=["sid", "at", "valid", "sess"])

    def close(self) -> None:
        pass


def session_reads(events: DataFrame, lasts: timedelta = LASTS) -> DataFrame:
    """(sid, at, valid, sess): an answer to each read, from a stream of (sid, at, action, sess), action being write, read or delete.

    A session is valid up to ``lasts`` after it was last written; a read after that deletes it. Events of a batch are taken in order of time, at one time writes before deletes before reads. The session has to be
    prepared (``prepare``).
    """
    kept = events.where("sid IS NOT NULL AND at IS NOT NULL").select("sid", "at", "action", "sess")
    return kept.groupBy("sid").transformWithStateInPandas(statefulProcessor=Sessions(lasts), outputStructType=ANSWERS, outputMode="append", timeMode="ProcessingTime")


def prepare(spark: SparkSession) -> None:
    """Settings that ``session_reads`` needs: the RocksDB state store, and no batches without data, which would go on for ever where all that is there is read once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def upserts(stream: DataFrame, tables: Tables, name: str, checkpoint: str, query: str = "upserts") -> StreamingQuery:
    """Append each batch of a stream to a table, tagged with its number, so a batch that is given again changes nothing; ``current`` tells the newest row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        tables.insert({name: batch.withColumn("version", F.lit(number).cast("long"))}, tag=f"{query}-{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(tables: Tables, name: str, order: str) -> DataFrame:
    """The row of each key from the newest batch, within a batch the last by ``order``."""
    newest = Window.partitionBy(tables.keys[name]).orderBy(F.desc("version"), F.desc(order))
    return tables.scan(name).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "version")
