"""A keyed collection as state: versions, conditional writes, partial updates, deletions that are remembered for a while."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What this needs of a session: state in RocksDB.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _plain(value: Any, kind: T.DataType) -> Any:
    """A cell of a pandas column as a value of its kind; pandas' marks for what is missing are None."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return value
    if value is None or value is pd.NaT or value != value:
        return None
    return int(value) if isinstance(kind, WHOLE) else bool(value) if isinstance(kind, T.BooleanType) else value


class _Documents(StatefulProcessor):
    def __init__(self, keys: T.StructType, fields: T.StructType, keep: int):
        self.keys, self.fields, self.keep = keys, fields, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("document", T.StructType().add("version", "long").add("at", "long").add("deleted", "boolean").add("doc", self.fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        version, at, deleted, doc = 0, None, True, [None] * len(self.fields)
        if self.stored.exists():
            version, at, deleted, doc = self.stored.get()
            doc = list(doc)
        out = []
        changes = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        columns = [changes[f.name].tolist() for f in self.fields]
        for i, (op, ts, seq, expected) in enumerate(zip(changes["op"], changes["ts"], changes["seq"], changes["if_version"])):
            new = [_plain(c[i], f.dataType) for c, f in zip(columns, self.fields)]
            now = ts.value // 1000
            expected = _plain(expected, T.LongType())
            if expected is not None and expected != (0 if deleted else version):
                said = "stale"
            elif expected is None and at is not None and now < at:
                said = "late"
            elif op not in ("set", "update", "delete"):
                said = "unknown"
            elif op != "set" and deleted:
                said = "missing"
            else:
                said, version, at = "applied", version + 1, now if at is None else max(now, at)
                if op == "set":
                    doc = new
                elif op == "update":
                    doc = [o if n is None else n for n, o in zip(new, doc)]
                deleted = op == "delete"
                if deleted:
                    doc = [None] * len(self.fields)
            out.append((*key, _plain(seq, T.LongType()), said, version, deleted, *doc))
        if at is not None:
            self.stored.update((version, at, deleted, tuple(doc)))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if deleted:
                self.handle.registerTimer(at // 1000 + self.keep)
        names = [*self.keys.names, "seq", "outcome", "version", "deleted", *self.fields.names]
        yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.stored.exists() and self.stored.get()[2]:
            self.stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def documents(changes: DataFrame, keys: list[str], fields: list[str], late: str = "10 minutes", keep: int = 24 * 3600 * 1000) -> DataFrame:
    """What became of each change of a stream: keys, seq, outcome, the version and whether it's deleted, and the document.

    changes: keys, fields, op (set, update: only fields that aren't null, delete), ts (timestamp), seq (long; the order of
    equal ts) and if_version (long). A change with if_version counts if that is the stored version, 0 for a key that isn't
    there, else it is `stale`; one without counts unless a later ts has been stored (`late`), so the order in which files
    come doesn't matter. Updates and deletions of what isn't there are `missing`, other ops `unknown`.

    A deletion is remembered for `keep` milliseconds of event time, by a timer, and its state is given back then. Changes that
    are over `late` behind the stream are left out by Spark; `keep` must not be shorter, else an old change could bring a key
    back. State is one document a key. Needs STORE among the session's settings; write the outcomes in update mode.
    """
    own, doc = (T.StructType([changes.schema[c] for c in names]) for names in (keys, fields))
    amount, unit = late.split()
    seconds = int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    if keep < 1000 * seconds:
        raise ValueError("deletions must be remembered for as long as changes may be late")
    clash = set(keys + fields) & {"op", "ts", "seq", "if_version", "outcome", "version", "deleted"}
    if clash or set(keys) & set(fields):
        raise ValueError(f"names that have another meaning here: {sorted(clash | set(keys) & set(fields))}")
    d = changes.select(*keys, *fields, "op", "ts", F.col("seq").cast("long").alias("seq"), F.col("if_version").cast("long").alias("if_version")).withWatermark("ts", late)
    schema = T.StructType([*own, *T.StructType().add("seq", "long").add("outcome", "string").add("version", "long").add("deleted", "boolean"), *doc])
    return d.groupBy(*keys).transformWithStateInPandas(_Documents(own, doc, keep), schema, "update", "eventTime")
