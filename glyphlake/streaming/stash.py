"""The stash: blobs by key for five minutes, each read once. As a batch join and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import formats as K


def accepted(bytes_: "F.Column") -> "F.Column":
    """Empty and oversized blobs are refused."""
    return (bytes_ > 0) & (bytes_ <= K.STASH_CAP)


def served(traffic: DataFrame, seconds: int = K.STASH_SECONDS) -> DataFrame:
    """traffic(key, event_id, ts, op put|get, and what is put): each put that a get reads, with that get.

    A put is read by the next get of its key, if that comes in time and before another put.
    """
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    rows = traffic.withColumn("next_op", F.lead("op").over(order)).withColumn("next_ts", F.lead("ts").over(order)).withColumn("next_id", F.lead("event_id").over(order))
    rows = rows.where("op = 'put' and next_op = 'get'").where(F.unix_micros("next_ts") - F.unix_micros("ts") <= seconds * 1_000_000)
    blob = [c for c in traffic.columns if c not in ("key", "event_id", "ts", "op")]
    return rows.select("key", F.col("event_id").alias("put_id"), F.col("next_id").alias("get_id"), *blob)


class _Stash(StatefulProcessor):
    """Holds a key's last put; a get answers and forgets it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blob = handle.getValueState("blob", "put_id long, ts timestamp, bytes binary, name string, mime string", ttlDurationMs=K.STASH_SECONDS * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out, text = [], lambda v: v if isinstance(v, str) else None
        for r in frame.itertuples():
            if r.op == "put":
                size = len(r.bytes) if isinstance(r.bytes, (bytes, bytearray)) else 0
                if 0 < size <= K.STASH_CAP:  # others are refused
                    self.blob.update((int(r.event_id), r.ts.to_pydatetime(), bytes(r.bytes), text(r.name), text(r.mime)))
            else:
                held = self.blob.get() if self.blob.exists() else None
                alive = held is not None and r.ts - pd.Timestamp(held[1]) <= pd.Timedelta(seconds=K.STASH_SECONDS)
                out.append((key[0], held[0], int(r.event_id), *held[2:], 200) if alive else (key[0], None, int(r.event_id), None, None, None, 404))
                self.blob.clear()
        yield pd.DataFrame(out, columns=["key", "put_id", "get_id", "bytes", "name", "mime", "status"])

    def close(self) -> None:
        pass


def stream(traffic: DataFrame) -> DataFrame:
    """traffic(key, event_id, ts, op, bytes, name, mime): answers to the gets: key, put_id, get_id, the blob, status 200 or 404."""
    schema = "key string, put_id long, get_id long, bytes binary, name string, mime string, status int"
    return traffic.groupBy("key").transformWithStateInPandas(_Stash(), outputStructType=schema, outputMode="append", timeMode="ProcessingTime")
