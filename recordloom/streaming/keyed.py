"""The fold as keyed state of a stream: a micro-batch costs its own rows, however many records there are.

Each URI has its record, its time and whether it is deleted in Spark's state store; a batch brings each
URI its mutations in order of arrival and gives the changes that they make. Batches arrive in the order of the
stream, so the state is what ``fold`` gives for all of them. The state can be read as a table with the ``statestore``
source, and a stream that starts from records that are there takes them as its first state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recordloom.operators import fold
from recordloom.schema import FEED, RECORDS

#: What a URI holds beside its name.
STATE = "cid string, did string, collection string, rkey string, record_json string, indexed_at long, is_deleted boolean"
_CONTENT = ["cid", "did", "collection", "rkey", "record_json"]
#: A change of the feed. Rows go to Python and back as they are: a frame for each URI would cost far more than its mutations.
_CHANGE = Row(*[f.split()[0] for f in FEED.split(", ")])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _arrival(m: Row) -> tuple:
    """The order of ``fold.ARRIVAL``, nulls first."""
    return tuple(x for c in fold.ARRIVAL for x in (m[c] is not None, m[c]))


def step(state: tuple | None, op: str, content: tuple, time: int) -> tuple[tuple | None, str | None]:
    """The state (content, time, is_deleted) after one mutation, and the change it makes, if any."""
    if op == "U":
        return ((content, time, False), "Upsert") if state is None or time >= state[1] else (state, None)
    if state is None or time < state[1]:
        return state, None
    return (state[0], time, True), None if state[2] else "Delete"


class Fold(StatefulProcessor):
    """Mutations of one URI against its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", STATE)

    def _read(self) -> tuple | None:
        held = self.state.get()  # one call to the state store: None where there is nothing
        if held is None:
            return None
        *content, time, deleted = held
        return tuple(content), time, deleted

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = state = self._read()
        for m in sorted(rows, key=_arrival):
            content = tuple(m[c] for c in _CONTENT)
            state, change = step(state, m["op"], content, m["indexed_at"])
            if change:
                cid, did, collection, rkey, payload = content
                upsert = change == "Upsert"
                yield _CHANGE(m["seq"], change, key[0], did, collection, rkey, cid if upsert else None, payload if upsert else None, m["indexed_at"] if upsert else None)
        if state is not None and state != before:
            self.state.update((*state[0], state[1], state[2]))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.state.update((*(initialState[c] for c in _CONTENT), initialState["indexed_at"], initialState["is_deleted"]))

    def close(self) -> None:
        pass


def changes(mutations: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """The change feed (schema FEED) of a stream of ``mutations``, whose seq grows along the stream.

    ``records`` are there before its first batch. Mutations out of range or without a URI are skipped. The
    session's state store must be RocksDB (STORE), which Spark asks for here.
    """
    rows = fold.in_range(mutations).where("uri is not null")
    first = None if records is None else records.groupBy("uri")
    return rows.groupBy("uri").transformWithState(Fold(), outputStructType=FEED, outputMode="Append", timeMode="None", initialState=first)


def state_of(spark, checkpoint: str) -> DataFrame:
    """The records (schema RECORDS) that a stream of ``changes`` has come to, read from its checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "record").load(checkpoint)
    names = [f.split()[0] for f in RECORDS.split(", ")]
    return rows.select(F.col("key.uri").alias("uri"), "value.*").select(*names)
