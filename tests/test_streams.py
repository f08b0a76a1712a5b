"""Streams with state, paged sources, committed files, bucketed tables: expiry, restarts, failures."""

import datetime as dt
import json
import os
import random

import pytest

from lexloom.sources import pages
from lexloom.streaming import buckets, ingest, state

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


class Feed:
    """A folder of Parquet files as a stream, a file a batch, in the order in which they were put."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.n = spark, root, schema, 0
        (root / "in").mkdir()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.root}/in/{self.n:03d}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.root}/in")

    def run(self, f):
        state.run_to_table(f(self.stream()), f"{self.root}/out", f"{self.root}/check")
        return self.spark.read.parquet(f"{self.root}/out").collect()


CACHE = "cache string, key string, event_id long, ts timestamp, op string, value string"


def test_cache_expires_by_kind_and_goes_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, CACHE)
    feed.put([("answer", "a", 1, at(0), "get", None), ("answer", "a", 2, at(1), "put", "x"), ("answer", "a", 3, at(12.9), "get", None), ("answer", "a", 4, at(13), "get", None), ("search", "a", 5, at(1), "put", "y"), ("embedding", "a", 6, at(1), "put", "z"), ("search", "b", 7, at(1), "put", "w"), ("search", "b", 8, at(2), "drop", None), ("search", "b", 9, at(3), "get", None)])
    got = {r.event_id: (r.hit, r.value) for r in feed.run(state.cached)}
    assert got == {1: (False, None), 3: (True, "x"), 4: (False, None), 9: (False, None)}
    # Another run from the checkpoint: what lives a day is gone after 30 hours, what lives a week is not; a store replaces.
    feed.put([("search", "a", 20, at(30), "get", None), ("embedding", "a", 21, at(30), "get", None), ("embedding", "a", 22, at(31), "put", "zz"), ("embedding", "a", 23, at(31.5), "get", None)])
    got = {r.event_id: (r.hit, r.value) for r in feed.run(state.cached) if r.event_id >= 20}
    assert got == {20: (False, None), 21: (True, "z"), 23: (True, "zz")}
    feed.put([("embedding", "a", 30, at(31 + 24 * 7 - 0.1), "get", None), ("embedding", "a", 31, at(31 + 24 * 7), "get", None)])
    got = {r.event_id: r.hit for r in feed.run(state.cached) if r.event_id >= 30}
    assert got == {30: True, 31: False}


def test_entries_nobody_asks_for_leave_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, CACHE)
    feed.put([("answer", f"k{i}", i, at(0), "put", "v") for i in range(50)])
    feed.run(state.cached)
    for k in (1, 2):  # the second batch sees the watermark of the first
        feed.put([("search", "late", 100 + k, at(100 + k), "get", None)])
    query = state.cached(feed.stream()).writeStream.outputMode("append").format("noop").option("checkpointLocation", f"{tmp_path}/check2").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 50 and rows[-1] < 10


STATUS = "entity_id long, event_id long, ts timestamp, status string"


def test_status_machine_times_out_and_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, STATUS)
    feed.put([(1, 1, at(0), "pending"), (1, 2, at(0.2), "consolidated"), (1, 3, at(0.3), "ocr_completed"), (1, 4, at(0.4), "segmentation_processing"), (2, 5, at(0), "pdf_downloaded"), (2, 6, at(0.1), "ocr_processing"), (3, 7, at(0), "ocr_processing"), (3, 8, at(0.5), "ocr_completed"), (4, 9, at(0), "entity_extraction"), (4, 10, at(2), "consolidated")])
    rows = feed.run(state.status_changes)
    steps = lambda e, rows: [(r.before, r.status, r.outcome) for r in sorted((r for r in rows if r.entity_id == e), key=lambda r: (r.ts, r.outcome))]
    assert steps(1, rows)[:4] == [(None, "pending", "moved"), ("pending", "consolidated", "refused"), ("pending", "ocr_completed", "moved"), ("ocr_completed", "segmentation_processing", "moved")]
    assert steps(3, rows) == [(None, "ocr_processing", "moved"), ("ocr_processing", "ocr_completed", "moved")]
    assert steps(4, rows) == [(None, "entity_extraction", "moved"), ("entity_extraction", "segmented", "expired"), ("segmented", "consolidated", "moved")]
    # A restart, hours later: stages under way went back or failed at their limits, once.
    for k, h in enumerate((8, 9, 10)):
        feed.put([(9, 50 + k, at(h), "failed")])
    rows = feed.run(state.status_changes)
    assert steps(1, rows)[4:] == [("segmentation_processing", "ocr_completed", "expired")] and steps(2, rows)[2:] == [("ocr_processing", "failed", "expired")]
    assert [r.ts for r in rows if r.entity_id == 2 and r.outcome == "expired"] == [at(1.1)]
    assert len(steps(4, rows)) == 3


def write_page(folder, year, page, ids, count=None):
    (folder / f"{year}-{page}.json").write_text(json.dumps({"count": count or len(ids), "results": [{"id": i, "tipo": {"descricao": "Lei"}, "numero": i, "ano": year, "ementa": "e"} for i in ids]}))


def test_paged_stream_resumes_and_keeps_failures(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    write_page(folder, 2000, 0, [1, 2, 3])
    write_page(folder, 2000, 1, [3, 4, 5])
    (folder / "2001-0.json").write_text("{broken")
    run = lambda: state.run_to_table(pages.page_stream(spark, str(folder), 2000, 2001, 3), f"{tmp_path}/sink", f"{tmp_path}/check")
    run()
    read = lambda: spark.read.parquet(f"{tmp_path}/sink").collect()
    assert sorted(r.id for r in read() if r.id) == [1, 2, 3, 3, 4, 5]
    assert [(r.year, r.page) for r in read() if r.error] == [(2001, 0)]
    # More pages, in a year that was read already too; nothing is read twice.
    write_page(folder, 2000, 2, [6])
    write_page(folder, 2001, 1, [7])
    run()
    assert sorted(r.id for r in read() if r.id) == [1, 2, 3, 3, 4, 5, 6, 7]
    run()
    assert len(read()) == 9
    rows, report = pages.fetched(spark.read.parquet(f"{tmp_path}/sink"), 4)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 3, 4, 5, 7]  # whole pages until four were fetched
    assert sorted(map(tuple, report.collect())) == [(2000, 2, 6, 1, 0), (2001, 2, 1, 0, 1)]


def test_years_that_fail_are_passed_over_with_a_record(spark, tmp_path):
    write_page(tmp_path, 1999, 0, [1, 2])
    (tmp_path / "2000-0.json").write_text("{broken")
    write_page(tmp_path, 2001, 0, [2, 3])
    rows, failed = pages.of_years(spark, str(tmp_path), 1999, 2002)
    assert sorted((r.id, r.asked) for r in rows.collect()) == [(1, 1999), (2, 1999), (3, 2001)]
    assert [(r.year, r.page) for r in failed.collect()] == [(2000, 0)] and failed.first().error.startswith("JSONDecodeError")


def test_a_stopped_stream_goes_on_page_by_page(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for p in range(6):
        write_page(folder, 2010, p, range(10 * p, 10 * p + 10))
    stream = lambda: pages.page_stream(spark, str(folder), 2010, 2010, 10, pages_per_batch=2)
    start = lambda: stream().writeStream.format("parquet").option("path", f"{tmp_path}/sink").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="0 seconds").start()
    query = start()
    try:
        query.processAllAvailable()
        first = spark.read.parquet(f"{tmp_path}/sink").count()
    finally:
        query.stop()
    assert first in (20, 40, 60)
    query = start()
    try:
        for _ in range(4):
            query.processAllAvailable()
    finally:
        query.stop()
    ids = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/sink").collect())
    assert ids == list(range(60))


def test_a_year_that_does_not_answer_is_one_row(spark):
    def get(url, turn):
        if "ano=2001" in url:
            raise OSError("down")
        return {"count": 3, "results": [{"id": 1}, {"id": 2}]} if "offset=0" in url else {"count": 3, "results": [{"id": 3}]}

    listing = pages.Listing({"endpoint": "http://x/", "from_year": "2000", "to_year": "2001", "page_size": "2"}, get)
    assert listing.lengths() == {"2000": 2, "2001": 1}
    rows = [r for y, n in listing.lengths().items() for p in range(n) for r in listing.rows(int(y), p)]
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(2000, 0, 0, 1), (2000, 0, 1, 2), (2000, 1, 0, 3), (2001, 0, 0, None)]
    assert rows[-1][-1] == "OSError: down"
    reader = pages.PageStream({"endpoint": "http://x/", "from_year": "2000", "to_year": "2001", "page_size": "2", "pages_per_batch": "2"}, get)
    end = reader.latestOffset()
    assert end == {"2000": 2} and [p.value for p in reader.partitions({}, end)] == [(2000, 0), (2000, 1)]
    assert reader.latestOffset() == {"2000": 2, "2001": 1}


def test_files_are_committed_whole_or_not_at_all(spark, tmp_path):
    folder = tmp_path / "files"
    rows = [(f"n{i}", f"body {i}") for i in range(40)]
    pages.write_files(spark.createDataFrame(rows, "name string, body string").repartition(4), str(folder), suffix=".txt")
    names = lambda: sorted(n for n in os.listdir(folder) if not n.startswith("_"))
    assert names() == sorted(f"n{i}.txt" for i in range(40)) and (folder / "n7.txt").read_text() == "body 7"
    assert not [n for n in os.listdir(folder) if n.startswith("_staging")]
    with pytest.raises(Exception, match="not a name"):
        pages.write_files(spark.createDataFrame([("m1", "x"), ("a/b", "y")], "name string, body string").repartition(2), str(folder))
    assert len(names()) == 40 and not [n for n in os.listdir(folder) if n.startswith("_staging")]
    pages.write_files(spark.createDataFrame(rows, "name string, body string").repartition(7), str(folder), suffix=".txt")
    assert len(names()) == 40 and len((folder / "_COMMITTED").read_text().split("\n")) == 40
    pages.write_files(spark.createDataFrame([("only", b"\x00\x01")], "name string, body binary"), str(folder), mode="overwrite")
    assert names() == ["only"] and (folder / "only").read_bytes() == b"\x00\x01"


def test_two_attempts_of_a_task_leave_one_file(tmp_path):
    writer = pages.FileWriter({"path": str(tmp_path)}, overwrite=False)
    first, second = (writer.write(iter([{"name": "a", "body": b}])) for b in ("one", "two"))
    writer.commit([second])  # the first attempt was lost
    assert (tmp_path / "a").read_text() == "two" and sorted(os.listdir(tmp_path)) == ["_COMMITTED", "a"]
    assert first.names == ["a"]


EVENT = "event_id long, ts timestamp, event_type string, value double"


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), EVENT, "event_id", "ts", buckets=8)
    first = spark.createDataFrame([(i, at(0), "a", float(i)) for i in range(400)], EVENT)
    table.upsert(first, 0)
    before = files_of(tmp_path / "t")
    table.upsert(spark.createDataFrame([(3, at(1), "b", 0.0), (3, at(-1), "old", 0.0)], EVENT), 1)
    hit = table.manifest(1)["".join(k for k, v in table.manifest(1).items() if v != table.manifest(0)[k])]
    assert sum(a != b for a, b in zip(table.manifest(0).values(), table.manifest(1).values())) == 1
    assert before <= files_of(tmp_path / "t") and len({f for f in files_of(tmp_path / "t") if f.startswith(hit)}) == 1
    rows = {r.event_id: r.event_type for r in table.read().collect()}
    assert len(rows) == 400 and rows[3] == "b"
    # A redelivery of a batch changes nothing; old versions and their files go, those still named stay.
    table.upsert(first, 1)
    assert {r.event_id: r.event_type for r in table.read().collect()} == rows
    for n in range(2, 5):
        table.upsert(spark.createDataFrame([(3, at(n), f"v{n}", 0.0)], EVENT), n)
    assert table.manifests() == [3, 4] and {r.event_type for r in table.read().collect()} == {"a", "v4"}
    named = {f"{folder}/bucket={b}" for v in (3, 4) for b, folder in table.manifest(v).items()}
    assert {os.path.dirname(f) for f in files_of(tmp_path / "t")} == named


def test_a_batch_that_was_not_published_does_not_count(spark, tmp_path, monkeypatch):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), EVENT, "event_id", "ts", buckets=4)
    table.upsert(spark.createDataFrame([(i, at(0), "a", 0.0) for i in range(20)], EVENT), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame([(1, at(1), "b", 0.0)], EVENT), 1)
    assert {r.event_type for r in table.read().collect()} == {"a"}
    table.upsert(spark.createDataFrame([(1, at(1), "b", 0.0)], EVENT), 1)
    assert sorted(r.event_type for r in table.read().collect()) == ["a"] * 19 + ["b"]
    table.upsert(spark.createDataFrame([], EVENT), 2)
    assert table.manifest() == table.manifest(1) and table.read().count() == 20


def test_bucketed_upsert_as_a_stream(spark, tmp_path):
    rng = random.Random(2)
    feed, want = Feed(spark, tmp_path, EVENT), {}
    table = buckets.BucketTable(spark, str(tmp_path / "t"), EVENT, "event_id", "ts", buckets=4)
    for _ in range(3):
        rows = [(rng.randrange(30), at(rng.randrange(100)), rng.choice("ab"), float(rng.randrange(5))) for _ in range(40)]
        feed.put(rows)
        for r in rows:
            want[r[0]] = max(want.get(r[0], r), r, key=lambda x: (x[1], x[2], x[3]))
        ingest.run_available(feed.stream(), table.upsert, f"{tmp_path}/check")
        assert {r.event_id: tuple(r) for r in table.read().collect()} == want


def test_many_pages_are_few_partitions():
    n = 90_000
    listing = lambda o: pages.PageStream({"endpoint": "http://x/", "from_year": "2000", "to_year": "2001", **o}, lambda url, turn: {"results": [{"id": int(url.split("offset=")[1].split("&")[0])}]})
    reader = listing({"page_size": "1"})
    parts = reader.partitions({"2000": 10}, {"2000": n, "2001": 7})
    assert len(parts) <= pages.TASKS + 2
    covered = [(p.value[0], k) for p in parts for k in range(p.value[1], p.end)]
    assert covered == [(2000, k) for k in range(10, n)] + [(2001, k) for k in range(7)]
    assert [r[:4] for r in reader.read(parts[1])] == [(2000, k, 0, k) for k in range(parts[1].value[1], parts[1].end)]
