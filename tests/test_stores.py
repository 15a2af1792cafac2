"""Stores of scan records and checkpoints."""

from mirrorfall.sources import stores


def test_history_skips_what_it_cannot_read(spark, tmp_path):
    path = f"{tmp_path}/history"
    record = lambda *rows: spark.createDataFrame(list(rows), "scan_id bigint, started_at_unix bigint, state string, attempts int")
    stores.append_history(record((1, 10, "pending", 0), (2, 20, "done", 1)), path)
    stores.append_history(record((1, 30, "pending", 1)), path)
    (tmp_path / "history" / "damaged.json").write_text('{"scan_id": 5, "sta\n\n{"schema_version": 9, "scan_id": 6}\n')
    found = {r.scan_id: (r.started_at_unix, r.attempts) for r in stores.read_history(spark, path).collect()}
    assert found == {1: (30, 1), 2: (20, 1)}
    assert {r.reason: r.lines for r in stores.history_faults(spark, path).collect()} == {"unparsable": 1, "later-version": 1}
    stores.delete_scans(spark, path, spark.createDataFrame([(2,)], "scan_id bigint"), f"{tmp_path}/after")
    assert [r.scan_id for r in stores.read_history(spark, f"{tmp_path}/after").collect()] == [1]


def test_outcomes(spark):
    history = spark.createDataFrame([(1, "pending", 0, None), (2, "pending", 2, 5), (3, "pending", None, None), (4, "done", 1, 7)], "scan_id bigint, state string, attempts int, last_attempt_unix bigint")
    outcomes = spark.createDataFrame([(1, False, 8), (1, True, 9), (2, False, 9), (3, False, 9)], "scan_id bigint, accepted boolean, at_unix bigint")
    found = {r.scan_id: (r.state, r.attempts, r.last_attempt_unix) for r in stores.record_outcomes(history, outcomes).collect()}
    assert found == {1: ("done", 1, 9), 2: ("failed", 3, 9), 3: ("pending", 1, 9), 4: ("done", 1, 7)}


def test_checkpoint_resumes_the_same_roots_only(spark, tmp_path):
    path = f"{tmp_path}/checkpoint"
    assert stores.load_checkpoint(spark, path, ["/a"]) is None
    summary = spark.createDataFrame([(["/b", "/a"], "head", 5, 3, 300, 1)], "roots array<string>, stage string, saved_at_unix bigint, done_files bigint, done_bytes bigint, groups bigint")
    stores.save_checkpoint(summary, spark.createDataFrame([("/a/x", 1), ("/b/y", 1)], "path string, size bigint"), path)
    rows, survivors = stores.load_checkpoint(spark, path, ["/a", "/b", "/a"])
    assert rows.first().stage == "head" and survivors.count() == 2
    assert stores.load_checkpoint(spark, path, ["/a"]) is None
