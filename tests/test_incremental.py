from quillspark.operators import incremental as I

FILES = "file_id string, size_bytes long, modified_unix_ms long, hash_blake3 string, indexed_at string, run_id string"
LEDGER = "file_id string, run_id long, size_bytes long, modified_unix_ms long, hash_blake3 string, recorded_at string"
RUNS = "run_id long, started_unix_ms long, finished_unix_ms long, status string"


def files(spark, rows):
    return spark.createDataFrame([(f, s, 0, h, t, "clash") for f, s, h, t in rows], FILES)


def ledger(spark, rows):
    return spark.createDataFrame([(f, r, s, 0, h, t) for f, r, s, h, t in rows], LEDGER)


RUN_ROWS = [(1, 1000, 1100, "succeeded"), (2, 2000, None, "crashed"), (3, 3000, 3100, "succeeded"), (4, 4000, 4100, "failed")]


def test_only_new_and_changed(spark):
    f = files(spark, [("same", 1, "h", "1"), ("new", 1, "h", "1"), ("size", 2, "h", "1"), ("hash", 1, "g", "1"), ("failed", 1, "h", "1"), ("old", 9, "x", "1"), ("old", 1, "h", "2"), ("nulls", None, None, "1"), (None, 1, "h", "1")] * 2)
    led = ledger(
        spark,
        [
            ("same", 1, 7, "z", "a"),
            ("same", 3, 1, "h", "a"),
            ("size", 3, 1, "h", "a"),
            ("hash", 1, 1, "g", "a"),
            ("hash", 3, 1, "h", "a"),
            ("failed", 4, 1, "h", "a"),
            ("failed", 2, 1, "h", "a"),
            ("failed", 99, 1, "h", "a"),
            ("old", 3, 1, "h", "a"),
            ("nulls", 3, None, None, "a"),
            ("deleted", 3, 1, "h", "a"),
        ]
        * 2,
    )
    runs = spark.createDataFrame(RUN_ROWS, RUNS)
    got = {r["file_id"] for r in I.to_process(f, led, runs).collect()}
    assert got == {"new", "size", "hash", "failed"}


def test_run_then_nothing_is_left_and_failure_repeats(spark):
    f = files(spark, [(f"f{i}", i, f"h{i}", "2023-01-01T00:00:00.000Z") for i in range(20)])
    led, runs = spark.createDataFrame([], LEDGER), spark.createDataFrame(RUN_ROWS, RUNS)
    todo = I.to_process(f, led, runs)
    assert todo.count() == 20
    done = led.unionByName(I.commit(todo, 7, "t"))
    assert I.to_process(f, done, runs).count() == 20  # the run isn't known to have succeeded
    ok = runs.union(spark.createDataFrame([(7, 7000, 7100, "succeeded")], RUNS))
    assert I.to_process(f, done, ok).count() == 0


def test_reread_from(spark):
    assert I.reread_from(spark.createDataFrame(RUN_ROWS, RUNS)) == 2000  # crashed, so still open at run 3
    assert I.reread_from(spark.createDataFrame(RUN_ROWS[:1], RUNS)) == 1000
    assert I.reread_from(spark.createDataFrame([], RUNS)) is None


def test_window_and_late_files(spark):
    """Low is 2000 ms after the epoch, as run 2 crashed. What is before it and in the ledger is not reread."""
    at = lambda ms, zone="Z": f"1970-01-0{1 + ms // 86_400_000}T00:00:0{ms // 1000 % 10}.000{zone}"
    f = files(
        spark,
        [("old", 1, "h", at(1000)), ("late", 1, "h", at(1000)), ("late", 9, "g", at(0)), ("in", 1, "h", at(5000)), ("done", 1, "h", at(6000)), ("both", 1, "h", at(0)), ("both", 2, "h", at(7000)), ("zone", 1, "h", "1970-01-02T00:00:01.000+23:00"), ("odd", 1, "h", "no time"), ("null", 1, "h", None)],
    )
    led = ledger(spark, [("old", 3, 1, "h", "a"), ("done", 3, 1, "h", "a"), ("both", 3, 1, "h", "a")])
    runs = spark.createDataFrame(RUN_ROWS, RUNS)
    inside, late = I.reread_and_late(f, I.processed_ledger(led, runs), runs)
    assert {r["file_id"] for r in inside.collect()} == {"in", "done", "both", "zone", "odd", "null"}
    assert {r["file_id"] for r in late.collect()} == {"late"}
    got = {r["file_id"]: (r["size_bytes"], r["in_reread"]) for r in I.to_process(f, led, runs).collect()}
    assert got == {"late": (1, False), "in": (1, True), "both": (2, True), "zone": (1, True), "odd": (1, True), "null": (1, True)}


def test_window_reaches_the_scan(spark, tmp_path):
    files(spark, [("a", 1, "h", "2024-01-01T00:00:00.000Z")]).write.parquet(str(tmp_path / "f"))
    plan = I.window(spark.read.parquet(str(tmp_path / "f")), 1_700_000_000_000)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(indexed_at,2023-11-13)" in plan


def test_empty(spark):
    f = files(spark, [("a", 1, "h", "bad time")])
    none = [spark.createDataFrame([], s) for s in (FILES, LEDGER, RUNS)]
    assert I.to_process(none[0], none[1], none[2]).collect() == []
    assert [r["file_id"] for r in I.to_process(f, none[1], none[2]).collect()] == ["a"]
