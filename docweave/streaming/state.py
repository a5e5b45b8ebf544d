"""Keyed state of the streaming jobs. Every key keeps a few values in a RocksDB store; nothing of earlier batches is read again."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TYPES = ("invoice", "eft_receipt", "e-way-bill")
BETWEEN = "\x02"


def use_store(spark: SparkSession) -> None:
    """Keyed state needs this store; a session that has chosen one keeps it."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


#: Pages of the state by document and by fingerprint. A page is read and written as a whole, so more of them make small batches cheaper and large ones dearer.
PAGES = 8192


def _load(value) -> list:
    """What a page's state holds: one compressed text of JSON."""
    return json.loads(zlib.decompress(value.get()[0])) if value.exists() else []


def _store(value, rows: list) -> None:
    value.update((zlib.compress(json.dumps(rows).encode(), 1),))


DOCUMENT = ["id", "user_id", "document_type", "at", "business_fingerprint"]


class FirstOfFingerprint(StatefulProcessor):
    """Of a fingerprint's rows the first ever is kept, and of later ones those that are no invoice, for a page of fingerprints at a time. The state of a page is the fingerprints it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "fingerprints binary")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        if key[0] >= PAGES:  # rows that only pass
            yield from (part[DOCUMENT] for part in rows)
            return
        seen, best, out = set(_load(self.page)), {}, []
        for part in rows:
            for row in zip(*[part[c].tolist() for c in DOCUMENT], strict=True):
                order, loser = (row[3], row[0] is not None, row[0]), row
                if row[4] not in seen:
                    old = best.get(row[4])
                    if old is None or order < old[0]:
                        best[row[4]], loser = (order, row), old and old[1]
                if loser is not None and loser[2] != "invoice":
                    out.append(loser)
        if best:
            _store(self.page, [*seen, *best])
        out += [row for _, row in best.values()]
        if out:
            yield pd.DataFrame(out, columns=DOCUMENT)

    def close(self) -> None:
        pass


class DocumentVersions(StatefulProcessor):
    """What each document's newest event adds to and takes from groups, for a page of documents at a time.

    The state of a page has of each of its documents the newest event's number and the groups the document is in. A call and a few messages to the store for
    every document would take far longer than the work. ``places`` are the group and region of each number, joined by ``BETWEEN``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "documents binary")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        newest: dict = {}
        for part in rows:
            part["event_id"] = part["event_id"].astype("int64")
            for user, i, *event in zip(*[part[c].tolist() for c in ("user_id", "id", "event_id", "gone", "at", "document_type", "places")], strict=True):
                old = newest.get((user, i))
                if old is None or event[:2] > old[:2]:
                    newest[user, i] = event
        known = {(user, i): (event_id, places) for user, i, event_id, places in _load(self.page)}
        out = []
        for (user, i), (event_id, gone, at, kind, places) in newest.items():
            old = known.get((user, i))
            if old is not None and old[0] >= event_id:
                continue
            before = set(old[1]) if old is not None else set()
            after = {f"{p}\x01{kind or ''}" for p in places.split(BETWEEN)} if places and not gone else set()
            out += [(user, p, -1, at) for p in sorted(before - after)] + [(user, p, 1, at) for p in sorted(after - before)]
            known[user, i] = (event_id, sorted(after))
        _store(self.page, [(*k, *v) for k, v in known.items()])
        if out:
            yield pd.DataFrame(out, columns=["user_id", "place", "change", "at"])

    def close(self) -> None:
        pass


class GroupCounts(StatefulProcessor):
    """A group's documents by region and type. Once every class is complete and ``close_after_ms`` of event time pass without a change, the
    counts go, the group is reported as closed and later changes are ignored."""

    def __init__(self, close_after_ms: int | None) -> None:
        self.close_after = close_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "place string", "documents long")
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.closed.exists():
            return
        latest = None
        for r in rows:
            place = (f"{r['region']}\x01{r['document_type']}",)
            n = (self.counts.getValue(place)[0] if self.counts.containsKey(place) else 0) + r["change"]
            if n:
                self.counts.updateValue(place, (n,))
            elif self.counts.containsKey(place):
                self.counts.removeKey(place)
            if r["ts"] is not None:
                latest = max(latest, r["ts"]) if latest else r["ts"]
        classes = region_classes({place[0]: n[0] for place, n in self.counts.iterator()})
        if self.close_after is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if classes and all(c["complete"] for c in classes):
                at = max(int(latest.timestamp() * 1000) if latest else 0, timerValues.getCurrentWatermarkInMs())
                self.handle.registerTimer(at + self.close_after)
        yield Row(user_id=key[0], group_key=key[1], classes=classes, closed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        classes = region_classes({place[0]: n[0] for place, n in self.counts.iterator()})
        self.counts.clear()
        self.closed.update((True,))
        yield Row(user_id=key[0], group_key=key[1], classes=classes, closed=True)

    def close(self) -> None:
        pass


def region_classes(counts: dict[str, int]) -> list[Row]:
    """The classes of one group from counts by region and type: documents without a region belong to the least region that has any."""
    by: dict[str, dict[str, int]] = {}
    for place, n in counts.items():
        region, kind = place.split("\x01")
        by.setdefault(region, {})[kind] = n
    if "" in by and len(by) > 1:
        first = min((r for r in by if r), key=str.encode)
        for kind, n in by.pop("").items():
            by[first][kind] = by[first].get(kind, 0) + n
    return [Row(region=region or None, documents=sum(c.values()), **{t.replace("-", "_"): c.get(t, 0) for t in TYPES}, complete=all(c.get(t) for t in TYPES)) for region, c in sorted(by.items())]


CLASSES = "array<struct<region: string, documents: bigint, invoice: bigint, eft_receipt: bigint, e_way_bill: bigint, complete: boolean>>"


def candidates(rows: DataFrame, pages: int = PAGES, salts: int = 1024) -> DataFrame:
    """``rows`` (of ``DOCUMENT``) with ``page``: that of its fingerprint for the first row of each fingerprint in a task; other invoices of the task are gone, other rows get any page past ``PAGES``.

    So of a fingerprint that a third of all rows share, a task sends one row to its page.
    """

    def run(batches):
        import pyarrow as pa

        first: dict = {}
        kind = None
        for batch in batches:
            kind, out = batch.schema, []
            for i, row in enumerate(zip(*[batch.column(n).to_pylist() for n in DOCUMENT], strict=True)):
                order = (row[3], row[0] is not None, row[0])
                best = first.get(row[4])
                if best is None or order < best[0]:
                    first[row[4]] = (order, row)
                    row = best and best[1]
                if row is not None and row[2] != "invoice":
                    out.append((*row, PAGES + i % salts))
            if out:
                yield _batch(out, kind, pa)
        if first:
            yield _batch([(*row, zlib.crc32((row[4] or "").encode()) % pages) for _, row in first.values()], kind, pa)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("page", IntegerType())]))


def _batch(rows: list[tuple], kind, pa):
    fields = [*kind, pa.field("page", pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], [f.name for f in fields])
