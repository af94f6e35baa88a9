"""Keyed streams on small tables: order, late rows, expiry, size of what is held and written."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import chains
from tracewarden.streaming import runner, trackers, windows

S = 1_000_000
ROWS = "user string, us bigint, id bigint, phase string"
PHASES = chains.CHAIN_PHASES
STATE = "user string, us bigint, id bigint, phase string, furthest int"


def tracked(spark, parts, idle=1800, delay=60, buckets=8):
    tables = [spark.createDataFrame(p, ROWS) for p in parts]
    step = trackers.chain_tracker("user", "us", "id", "phase", idle=idle * S)
    return runner.run_keyed(runner.Arrivals(tables), "chain", step, STATE, ["user"], time="us", delay=delay * S, expire=F.col("us") + idle * S, buckets=buckets)


def chain_brute(rows, idle):
    last, out = {}, []
    for user, us, i, phase in sorted(rows, key=lambda r: (r[1], r[2])):
        p = last.get(user)
        if p is None or us - p[0] > idle * S:
            p = None
        k = PHASES.index(phase)
        top = k if p is None else max(k, p[2])
        if p is None or p[1] != phase:
            out.append((user, i, top))
        last[user] = (us, phase, top)
    return sorted(out)


def test_rows_out_of_order_and_late_rows(spark):
    rng = random.Random(3)
    rows = [(f"u{0 if rng.random() < 0.7 else rng.randrange(5)}", k * 40 * S, k, rng.choice(PHASES[:4])) for k in range(150)]
    moved = sorted(rows, key=lambda r: r[1] + rng.randrange(-50, 50) * S)
    parts = [moved[:60], moved[60:110], moved[110:]]
    late = [("u0", 5 * S, 900, PHASES[3]), ("u1", None, 901, PHASES[0])]
    parts[1] = parts[1] + late
    got = tracked(spark, parts, delay=120)
    top = max(r[1] for r in rows) - 120 * S
    want = chain_brute([r for r in rows if r[1] <= top], 1800)
    assert sorted((r["user"], r["id"], r["furthest"]) for r in got.rows.collect()) == want
    assert {r["batch"]: r["late"] for r in got.late.collect()} == {0: 0, 1: 2, 2: 0}


def test_idle_keys_leave_the_state(spark):
    """New keys in every batch: what is held stays as it is, and files of left versions go."""
    parts = [[(f"b{b}k{k}", (b * 2000 + k) * S, b * 100 + k, PHASES[0]) for k in range(20)] for b in range(6)]
    got = tracked(spark, parts, delay=0, idle=1000)
    held = [sum(e.rows for e in listed.values()) for listed in got.lists]
    assert max(held) <= 20 and got.state.filter("user LIKE 'b5%'").count() == 20
    assert got.state.count() == 20


def test_a_key_starts_anew_after_idling(spark):
    parts = [[("a", 0, 1, PHASES[2])], [("a", 1801 * S, 2, PHASES[0]), ("b", 1700 * S, 3, PHASES[1])], [("b", 3500 * S, 4, PHASES[0]), ("z", 9999 * S, 5, PHASES[0])]]
    got = {(r["id"], r["furthest"]) for r in tracked(spark, parts, delay=0).rows.collect()}
    assert got == {(1, 2), (2, 0), (3, 1), (4, 1), (5, 0)}


def bans_brute(rows, steps=(86_400, 604_800, 2_592_000), after=86_400):
    ends, out = {}, []
    for user, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        live = [e for e in ends.get(user, []) if e >= us]
        n = len(live) + 1
        ban = steps[n - 1] if n <= len(steps) else 0
        ends[user] = live + [us + (ban + after) * S if ban else 1 << 62]
        out.append((user, i, n, ban))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_bans_lapse_and_escalate(spark, seed):
    rng = random.Random(seed)
    day = 86_400
    rows = [("seldom", k * 3 * day * S, k, ) for k in range(9)]  # each ban lapses before the next
    rows += [("hot", (5 * day + k * 60) * S, 100 + k) for k in range(60)]
    rows += [(f"u{rng.randrange(3)}", rng.randrange(60 * day) * S, 1000 + k) for k in range(60)]
    rows.sort(key=lambda r: r[1])
    cuts = [0, 30, 31, 90, len(rows)]
    parts = [spark.createDataFrame(rows[a:b], "user string, us bigint, id bigint") for a, b in zip(cuts, cuts[1:])]
    got = runner.run_keyed(runner.Arrivals(parts), "ban", trackers.ban_tracker("user", "us", "id"), "user string, ends array<bigint>, lasting bigint", ["user"], time="us", delay=0, expire=trackers.ban_end())
    assert sorted((r["user"], r["id"], r["offence"], r["ban_s"]) for r in got.rows.collect()) == bans_brute(rows)


def test_a_repeat_after_a_minute_is_none(spark):
    schema = "user string, us bigint, id bigint, path string, q string"
    parts = [[("a", 0, 1, "/pay", "x"), ("a", S // 2, 2, "/pay", "x")], [("a", 61 * S, 3, "/pay", "x"), ("b", 400 * S, 4, "/", "y")]]
    step = trackers.race_tracker("user", "us", "id", "path", "q", F.lit(True), F.lit(True), 60 * S, S, 60 * S)
    got = runner.run_keyed(runner.Arrivals([spark.createDataFrame(p, schema) for p in parts]), "race", step, schema, ["user"], time="us", expire=F.col("us") + 60 * S)
    assert {r["id"]: r["same_url"] for r in got.rows.collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert {r["id"] for r in got.state.collect()} == {4}


def test_equal_rows_count_each(spark):
    schema = "user string, us bigint, id bigint, value double"
    parts = [[("a", S, 1, 30.0), ("a", S, 1, 30.0)], [("a", 2 * S, 2, 30.0)]]
    step = trackers.baseline_tracker("user", "us", "id", "value", F.col("value") >= 20, 3600 * S, 3600 * S)
    got = runner.run_keyed(runner.Arrivals([spark.createDataFrame(p, schema) for p in parts]), "base", step, schema, ["user"], time="us")
    assert got.state.count() == 3
    assert round(got.rows.filter("id = 2").first()["accumulated"], 2) == 9.0


def test_file_changes_rewrite_touched_buckets_only(spark):
    schema = "path string, us bigint, md5 string"
    parts = [[(f"f{k}", 1, "x") for k in range(300)], [("f7", 2, "y"), ("f7", 1, "w"), ("f8", 0, "old"), ("new", 2, None)], [("f7", 3, "y")]]
    got = runner.run_keyed(runner.Arrivals([spark.createDataFrame(p, schema) for p in parts]), "files", trackers.change_tracker("path", "md5", "us"), schema, ["path"], buckets=64)
    last = got.lists[-1]
    assert sum(e.version == 2 for e in last.values()) == 1 and sum(e.version == 1 for e in last.values()) <= 3
    assert sum(e.rows for e in last.values()) == 301
    rows = {(r["path"], r["status"]) for r in got.rows.filter("path IN ('f7', 'f8', 'new')").collect()}
    assert rows == {("f7", "added"), ("f8", "added"), ("f7", "changed"), ("new", "added"), ("f7", "same")}


def test_frozen_spans_teach_nothing(spark):
    control = spark.createDataFrame([(0, False), (100, True), (200, False)], "since bigint, frozen boolean")
    parts = [spark.createDataFrame([("/a", 50), ("/a", 150), ("/b", 199)], "path string, us bigint"), spark.createDataFrame([("/a", 200), ("/c", 100)], "path string, us bigint")]
    got = runner.run_keyed(runner.Arrivals(parts), "learn", trackers.path_learner("path", "us", control), "path string, seen bigint, first_seen bigint, last_seen bigint", ["path"])
    assert [tuple(r) for r in got.state.collect()] == [("/a", 2, 50, 200)]


def test_duplicates_by_window(spark, tmp_path):
    for i, rows in enumerate(([(1, "a"), (5, "a"), (9, "b"), (11, "a")], [(12, "a"), (13, "a"), (100, "z")], [(200, "z")], [(300, "z")])):
        spark.createDataFrame(rows, "s bigint, sig string").select("sig", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        time.sleep(0.05)
    s = runner.file_stream(spark, str(tmp_path), spark.createDataFrame([], "sig string, ts timestamp").schema, per_trigger=1)
    out, progress = runner.run_to_table(windows.duplicate_counts(s, "ts", ["sig"], "10 seconds", "10 seconds"), "dup")
    got = {r["start_us"] // S: (r["n"], r["signatures"], r["duplicates"]) for r in out.collect()}
    assert got[0] == (3, 2, 1) and got[10] == (3, 1, 2)
    assert max(op["numRowsTotal"] for p in progress[2:] for op in p["stateOperators"]) <= 3


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_file_or_of_a_folder_arrive(spark, tmp_path, files):
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, f"{'ab' if k % 2 else 'c'}d text {k % 3}", "user" if k % 3 else "bot") for k in range(12)]
    folder = tmp_path / "conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, text string, role string").repartition(files).write.parquet(str(folder))
    if files == 1:
        (part,) = folder.glob("*.parquet")
        folder = tmp_path / "one" / "conversations.parquet"
        folder.parent.mkdir()
        folder.write_bytes(part.read_bytes())
    got = entry.queries()["r10_token_learner"](spark, str(folder.parent))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}{'' if files == 1 else '/*.parquet'}'")
    want = con.execute(entry.oracle_sql()["r10_token_learner"]).fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["r7_baseline_tracker", "r9_race_tracker"])
def test_rows_of_the_last_hour_get_their_result(spark, tmp_path, name):
    import __spark_entry__ as entry

    days = ["2024-01-02 00:00:00", "2024-01-15 00:00:00", "2024-01-29 23:10:00", "2024-01-29 23:30:00", "2024-01-30 00:00:00"]
    rows = [(k, d, 1, "purchase", 25.0, '{"k": 1}') for k, d in enumerate(days)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    if name.startswith("r9"):
        assert [got[k]["same_url"] for k in range(5)] == [0, 0, 0, 1, 2]
    else:
        assert got[0]["base_value"] is None or got[0]["base_value"] == 0.0
        assert got[4]["base_value"] == 25.0 and got[4]["accumulated"] > got[3]["accumulated"] > got[2]["accumulated"] == 0.0


def test_chain_step_reads_its_rows_few_times(spark):
    """Each table that the step writes reads the batch and the state twice at most; one plan for all of it had 24 reads."""
    rows = [("u0", k * 40 * S, k, PHASES[k % 3]) for k in range(20)]
    state = spark.createDataFrame([("u0", -10 * S, -1, PHASES[1], 2)], STATE)
    read = []

    def keep(df):
        read.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return df.localCheckpoint()

    step = trackers.chain_tracker("user", "us", "id", "phase", idle=1800 * S)
    out, new = step(spark.createDataFrame(rows, ROWS), state, runner.Context(None, keep))
    assert max(read) <= 4
    assert out.count() == 20 and new.select("id", "furthest").collect() == [(19, 2)]
