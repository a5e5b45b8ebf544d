"""Streaming jobs over many batches: they equal the batch result, and read only what a batch touches."""

import collections
import datetime
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docweave.operators import grouping
from docweave.sources import tables
from docweave.streaming import jobs

PARSED = tables.SCHEMAS["parsed_documents"]
FEED = f"event_id long, ts timestamp, op string, {PARSED}"
TYPES = ["invoice", "eft_receipt", "e-way-bill"]
START = datetime.datetime(2025, 1, 1)


def feed(rng, events=240, documents=30):
    """Events over few documents and numbers, regions and placeholders among them."""
    names = ["MAT/UP/24-25/1", "MAT/MH/24-25/1", "MAT/24-25/1", "mat-up-24-25-001", "N/A", "", None, "MAT/24-25/2"]
    out = []
    for n in range(events):
        i, kind = rng.randrange(documents), rng.choice(TYPES)
        body = {"invoice": rng.choice(names), "second_invoice": rng.choice(names), "third_invoice": rng.choice([None, "X/24-25/9"])}
        out.append((n, START + datetime.timedelta(minutes=n), rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), str(i), f"u{i % 2}", kind, rng.choice([None, "MAT/UP/24-25/1"]), json.dumps(body), "url", None))
    return out


def brute_groups(spark, events):
    """The groups of the surviving documents, from parts that the library parses."""
    from docweave.functions import scalars as S

    last = {}
    for e in events:
        if e[3] not in last or last[e[3]][0] < e[0]:
            last[e[3]] = e
    places = set()
    for e in last.values():
        if e[2] == "DELETE":
            continue
        body = json.loads(e[7])
        names = [e[6] or body["invoice"], *([body["second_invoice"], body["third_invoice"]] if e[5] == "eft_receipt" else [])]
        places |= {(e[4], e[3], e[5], n) for n in names if n}
    if not places:
        return {}
    df = spark.createDataFrame(sorted(places), "u string, i string, t string, n string").select("u", "i", "t", S.parse_invoice_number(F.col("n")).alias("p"))
    each = {(r["u"], "-".join([r["p"]["prefix"], r["p"]["year"], r["p"]["period"], r["p"]["number"]]), r["p"]["region"] or "", r["i"], r["t"]) for r in df.collect()}
    regions = collections.defaultdict(set)
    for u, k, region, _, _ in each:
        regions[u, k].add(region)
    out = collections.defaultdict(collections.Counter)
    for u, k, region, _, t in each:
        out[u, k, region or min((r for r in regions[u, k] if r), default="")][t] += 1
    return {k: tuple(c[t] for t in TYPES) for k, c in out.items()}


def found_groups(df):
    return {(r["user_id"], r["group_key"], r["region"] or ""): (r["invoice"], r["eft_receipt"], r["e_way_bill"]) for r in df.collect()}


@pytest.mark.parametrize("cuts", [1, 6])
def test_group_changes_equal_the_survivors(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    events = feed(rng)
    parts = [events[i * len(events) // cuts : (i + 1) * len(events) // cuts] for i in range(cuts)]
    if cuts > 1:  # an older event that comes late changes nothing
        parts[3].append((0, START, "INSERT", events[-1][3], events[-1][4], "invoice", "LATE/24-25/1", "{}", "url", None))
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    stream = lambda: spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
    for n, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(source)
        if n in (0, cuts - 1):  # in between, several files wait for the next call
            got = jobs.stream_group_changes(stream(), path)
    seen = [e for p in parts for e in p]
    want = brute_groups(spark, [e for e in seen if e[6] != "LATE/24-25/1"])
    assert found_groups(got) == want and want
    assert all(r["complete"] == all((r["invoice"], r["eft_receipt"], r["e_way_bill"])) and r["documents"] == r["invoice"] + r["eft_receipt"] + r["e_way_bill"] for r in got.collect())
    assert found_groups(jobs.stream_group_changes(stream(), path)) == want  # nothing new


def test_documents_share_pages_of_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "PAGES", 8)
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    events = feed(random.Random(3), 900, 300)
    for part in (events[:500], events[500:]):
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(source)
    got = jobs.stream_group_changes(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source), path)
    assert found_groups(got) == brute_groups(spark, events)
    pages = spark.read.format("statestore").option("path", f"{path}/checkpoint-changes").option("stateVarName", "page").load()
    assert pages.count() == 8


def test_complete_groups_close_and_leave_the_state(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    at = lambda hours: START + datetime.timedelta(hours=hours)
    row = lambda n, hours, i, kind, name, op="INSERT": (n, at(hours), op, i, "u", kind, name, "{}", "url", None)
    parts = [
        [row(1, 0, "1", "invoice", "A/24-25/1"), row(2, 0, "2", "eft_receipt", "A/24-25/1"), row(3, 1, "3", "e-way-bill", "A/24-25/1"), row(4, 1, "4", "invoice", "B/24-25/1")],
        [row(5, 9, "5", "invoice", "C/24-25/1")],
        [row(6, 10, "6", "invoice", "A/24-25/1"), row(7, 10, "1", "invoice", "A/24-25/1", "DELETE"), row(8, 10, "7", "invoice", "B/24-25/1")],
    ]
    for part in parts:
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
        got = jobs.stream_group_changes(stream, path, close_after="'5' HOUR")
    rows = {r["group_key"]: (r["documents"], r["complete"], r["closed"]) for r in got.collect()}
    assert rows == {"A-24-25-001": (3, True, True), "B-24-25-001": (2, False, False), "C-24-25-001": (1, False, False)}
    # The closed group's counts are gone; what stays is one flag.
    counts = spark.read.format("statestore").option("path", f"{path}/checkpoint-groups").option("stateVarName", "counts").load()
    assert {r["key"]["group_key"] for r in counts.collect()} == {"B-24-25-001", "C-24-25-001"}


def test_twenty_batches_read_only_their_own_rows(spark, tmp_path):
    kind = "id string, user_id string, document_type string, created_at timestamp, business_fingerprint string"
    rng, rows = random.Random(7), []
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    for b in range(20):
        part = [(f"{b}-{i}", "u", rng.choice(TYPES), None, rng.choice(["hot", "hot", None, f"f{rng.randrange(60)}"])) for i in range(30)]
        rows.append(part)
        spark.createDataFrame(part, kind).repartition(3).coalesce(1).write.mode("append").parquet(source)
    inputs = []

    class Listen(StreamingQueryListener):
        def onQueryStarted(self, event):  # noqa: N802
            pass

        def onQueryProgress(self, event):  # noqa: N802
            inputs.append(event.progress.numInputRows)

        def onQueryIdle(self, event):  # noqa: N802
            pass

        def onQueryTerminated(self, event):  # noqa: N802
            pass

    listener = Listen()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        kept = {r["id"] for r in jobs.stream_deduplicate(stream, path).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    seen, want = set(), set()
    order = {f"{b}-{i}": b for b in range(20) for i in range(30)}
    for b in range(20):
        fresh = {}
        for r in rows[b]:
            fresh[r[4]] = min(fresh.get(r[4], r[0]), r[0])
        for r in rows[b]:
            if r[2] != "invoice" or (r[4] not in seen and fresh[r[4]] == r[0]):
                want.add(r[0])
        seen |= set(fresh)
    assert kept == want and len(order) == 600
    assert sorted(n for n in inputs if n) == [30] * 20


def test_fingerprints_share_pages_of_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "PAGES", 8)
    kind = "id string, user_id string, document_type string, created_at timestamp, business_fingerprint string"
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    at = lambda n: None if n % 5 == 0 else datetime.datetime(1600 if n % 7 == 0 else 2025, 1, 1, n % 24)
    parts = [[(f"{b}-{n}", "u", TYPES[n % 3], at(n * 31 + b), None if n == 9 else f"f{n * 7 % 200}") for n in range(600)] for b in range(2)]
    for part in parts:
        spark.createDataFrame(part, kind).repartition(3).coalesce(1).write.mode("append").parquet(source)
    got = jobs.stream_deduplicate(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), path)
    want = {r for part in parts for r in part if r[2] != "invoice"}
    order = lambda r: (r[3] is not None, r[3], r[0])
    seen = {r[4] for r in parts[0]}
    for n, part in enumerate(parts):
        for key in {r[4] for r in part} - (seen if n else set()):
            want.add(min((r for r in part if r[4] == key), key=order))
    assert {tuple(r) for r in got.collect()} == want
    pages = spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", "page").load()
    assert pages.count() == 8


def test_moved_documents_leave_their_old_group(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    rules = grouping.business_rules(spark)
    doc = lambda i, name, kind="invoice", at=0: (i, "u", kind, name, json.dumps({"document_type": kind}), "url", START + datetime.timedelta(hours=at))
    parts = [
        [doc("1", "A/24-25/1"), doc("2", "A/24-25/1", "eft_receipt"), doc("3", "B/24-25/1")],
        [doc("1", "C/24-25/1", at=1), doc("3", None, at=1), doc("2", "B/24-25/1", "eft_receipt", 1), doc("2", "A/24-25/1", "eft_receipt", 2)],
        [doc("1", "A/24-25/1", at=2), doc("4", "N/A")],
        [doc(None, "N/A"), doc(None, "N/A"), doc("4", "N/A", at=3)],
    ]
    wants = [
        {"A/24-25/1": ["1", "2"], "B/24-25/1": ["3"]}, {"A/24-25/1": ["2"], "C/24-25/1": ["1"]}, {"A/24-25/1": ["1", "2"], "N/A": ["4"]}, {"A/24-25/1": ["1", "2"], "N/A": ["4", None, None]},
    ]
    for part, want in zip(parts, wants, strict=True):
        spark.createDataFrame(part, PARSED).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PARSED).option("maxFilesPerTrigger", 1).parquet(source)
        got = jobs.stream_upsert(stream, path, rules, buckets=8)
        assert {r["invoice_number"]: sorted(r["present_document_ids"], key=lambda x: (x is None, x)) for r in got.collect()} == want


def test_texts_of_documents_are_not_stored(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    rows = [(str(i), "u", "invoice", f"A/24-25/{i % 50}", json.dumps({"text": random.Random(i).randbytes(2000).hex()}), "url", START) for i in range(300)]
    spark.createDataFrame(rows, PARSED).coalesce(1).write.parquet(source)
    got = jobs.stream_upsert(spark.readStream.schema(PARSED).parquet(source), path, grouping.business_rules(spark), buckets=4)
    assert got.count() == 50
    size = lambda top: sum(f.stat().st_size for f in pathlib.Path(top).rglob("*.parquet"))
    assert size(f"{tmp_path}/state") < size(source) / 2
