"""Keys a stream has met, as keyed state in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Gives each key once, at its first row; keys of the initial state never."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._met = handle.getValueState("met", "met boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._met.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self._met.exists():
            self._met.update((True,))
            yield Row(message_id=key[0])

    def close(self) -> None:
        pass


def first_seen(keys: DataFrame, known: DataFrame) -> DataFrame:
    """`(message_id)` of a stream, each at its first announcement only, without null and `known(message_id)` ones.

    The state lies in RocksDB on the executors' disks, spread by key, and in the stream's checkpoint, so that it outlives
    both executors and restarts; it holds every key ever met, and a batch touches the keys it names. `known`
    is read once, by the first batch of a new checkpoint. Of a key named many times in a batch one row is kept
    before the rest of the plan, whichever it is: they are equal.
    """
    named = keys.filter("message_id IS NOT NULL").select("message_id")
    seed = known.filter("message_id IS NOT NULL").select("message_id").groupBy("message_id")
    return named.groupBy("message_id").transformWithState(FirstSeen(), "message_id string", "append", "none", seed)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside use the state store that keyed state needs; the session's setting stays as it was."""
    before = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_CONF)
        else:
            spark.conf.set(PROVIDER_CONF, before)
