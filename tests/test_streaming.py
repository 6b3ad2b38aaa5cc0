import json

from tessera.session import Engine
from tessera.streaming import runner


def clicks(path, n=20):
    path.mkdir()
    rows = [{"time": f"2024-01-01T00:{i:02d}:00Z", "user": "ab"[i % 2], "v": i} for i in range(n)]
    (path / "clicks.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return path


def run(spark, tmp_path, text, **more):
    got = []
    q = runner.start(Engine(spark), text, lambda df, _: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "checkpoint"), once=True, **more)
    q.awaitTermination(120)
    assert q.exception() is None
    return got


def test_windows_append_when_the_watermark_passes(spark, tmp_path):
    d = clicks(tmp_path / "in")
    text = f"""WITH w AS (SELECT * FROM max_diff_watermark(source=>TABLE({d}/clicks.json?tail=true), max_diff=>INTERVAL 1 MINUTE, time_field=>DESCRIPTOR(time)) c),
      t AS (SELECT * FROM tumble(source=>TABLE(w), window_length=>INTERVAL 5 MINUTES) c)
      SELECT window_end, user, COUNT(*) AS n FROM t GROUP BY window_end, user TRIGGER ON WATERMARK"""
    got = run(spark, tmp_path, text)
    assert sorted((r[0].minute, r[1], r[2]) for r in got) == [(5, "a", 3), (5, "b", 2), (10, "a", 2), (10, "b", 3), (15, "a", 3), (15, "b", 2)]


def test_counting_retracts(spark, tmp_path):
    d = clicks(tmp_path / "in")
    got = run(spark, tmp_path, f"SELECT user, COUNT(*) AS n, SUM(v) AS s FROM {d}/clicks.json?tail=true c GROUP BY user TRIGGER COUNTING 4")
    a = [r[1:] for r in got if r[0] == "a"]
    # the last two records of the ten come at the end of the stream
    assert a == [(4, 12.0, False, 1), (4, 12.0, True, 1), (8, 56.0, False, 2), (8, 56.0, True, 2), (10, 90.0, False, 3)]


def test_several_triggers_as_in_the_bounded_change_stream(spark, tmp_path):
    """The stream's emissions are those of the replay over the same records."""
    d = clicks(tmp_path / "in", 40)
    query = "SELECT user, COUNT(*) AS n, SUM(v) AS s, AVG(v) AS mean, MIN(v) AS least, MAX(v) AS most FROM {} c GROUP BY user TRIGGER {}"
    for i, trigger in enumerate(("COUNTING 3", "COUNTING 4, COUNTING 6", "COUNTING 7, ON END OF STREAM", "COUNTING 50")):
        (tmp_path / str(i)).mkdir()
        got = run(spark, tmp_path / str(i), query.format(f"{d}/clicks.json?tail=true", trigger))
        log = Engine(spark).query(query.format(f"{d}/clicks.json", trigger)).changelog().collect()
        assert sorted(r[:-1] for r in got) == sorted(tuple(r)[:7] for r in log), trigger


def test_counting_and_the_watermark(spark, tmp_path):
    d = clicks(tmp_path / "in", 20)
    text = f"""WITH w AS (SELECT * FROM max_diff_watermark(source=>TABLE({d}/clicks.json?tail=true), max_diff=>INTERVAL 1 MINUTE, time_field=>DESCRIPTOR(time)) c),
      t AS (SELECT * FROM tumble(source=>TABLE(w), window_length=>INTERVAL 10 MINUTES) c)
      SELECT window_end, COUNT(*) AS n FROM t GROUP BY window_end TRIGGER ON WATERMARK, COUNTING 4"""
    got = run(spark, tmp_path, text)
    for minute in (10, 20):
        assert [r[1:3] for r in got if r[0].minute == minute] == [(4, False), (4, True), (8, False), (8, True), (10, False)]


def test_a_growing_file_is_followed(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"v": 1}\n{"v": 2}\n{"v"')
    text = f"SELECT v FROM {path}?tail=true c"
    got = []
    for more in ("", ': 3}\n', '{"v": 4}\n{"v": 5}\n'):
        with path.open("a") as f:
            f.write(more)
        got.append([r[0] for r in run(spark, tmp_path, text)])
    assert got == [[1.0, 2.0], [3.0], [4.0, 5.0]]
    lines = tmp_path / "log.txt"
    lines.write_text("a\nb\nc")
    (tmp_path / "second").mkdir()
    assert run(spark, tmp_path / "second", f"SELECT number, text FROM {lines}?tail=true l") == [(0, "a"), (1, "b")]
    table = tmp_path / "log.csv"
    table.write_text("k,name\n1,x\n2,y\n")
    (tmp_path / "third").mkdir()
    assert run(spark, tmp_path / "third", f"SELECT k, name FROM {table}?tail=true l") == [(1, "x"), (2, "y")]


def test_filter_streams_as_it_is(spark, tmp_path):
    d = clicks(tmp_path / "in")
    assert len(run(spark, tmp_path, f"SELECT v FROM {d}/clicks.json?tail=true c WHERE v >= 15.0")) == 5


def test_poll(spark):
    seen = []
    n = runner.poll(Engine(spark), "SELECT * FROM poll(source=>TABLE(range(start=>0, end=>3) r), poll_interval=>INTERVAL 10 MILLISECONDS) p", lambda df, k: seen.append((k, df.count())), rounds=2)
    assert n == 2 and seen == [(0, 3), (1, 3)]
    assert Engine(spark).query("SELECT * FROM poll(source=>TABLE(range(start=>0, end=>3) r), poll_interval=>INTERVAL 10 MILLISECONDS) p").poll_us == 10_000


def test_poll_retracts_the_snapshot_before(spark, tmp_path):
    seen = []

    def look(df, turn):
        seen.append(sorted((r["k"], r["__retraction"]) for r in df.collect()))
        spark.range(5 + turn).selectExpr("id AS k").filter("k > 2").write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))

    spark.range(2).selectExpr("id AS k").write.parquet(str(tmp_path / "t.parquet"))
    text = f"SELECT p.k FROM poll(source=>TABLE({tmp_path}/t.parquet), poll_interval=>INTERVAL 10 MILLISECONDS) p"
    assert runner.poll(Engine(spark), text, look, rounds=3, changes=True) == 3
    assert seen == [[(0, False), (1, False)], [(0, True), (1, True), (3, False), (4, False)], [(3, False), (3, True), (4, False), (4, True), (5, False)]]


def test_command_line_follows_growing_tables(spark, tmp_path, capsys):
    from tessera import cli

    d = clicks(tmp_path / "in", 9)
    grouped = f"SELECT user, COUNT(*) AS n FROM {d}/clicks.json?tail=true c GROUP BY user TRIGGER COUNTING 2"
    # of the five records of a, the last comes at the end of the stream
    want = {
        "json": ['{"user":"a","n":2}', '{"user":"a","n":4}', '{"user":"a","n":5}', '{"user":"b","n":2}', '{"user":"b","n":4}'],
        "csv": ["a,2", "a,4", "a,5", "b,2", "b,4", "user,n"],
        "stream_native": sorted(f"{{{sign}0001-01-01T00:00:00Z| '{u}', {n} |}}" for u, more in (("a", (("-", 4), ("+", 5))), ("b", ())) for sign, n in (("+", 2), ("-", 2), ("+", 4), *more)),
    }
    for kind, lines in want.items():
        assert cli.main([grouped, "-o", kind, "--once", "--checkpoint", str(tmp_path / kind)]) == 0
        assert sorted(capsys.readouterr().out.splitlines()) == lines
    assert cli.main([f"SELECT user, SUM(v) AS s FROM {d}/clicks.json?tail=true c GROUP BY user", "--once"]) == 0
    assert capsys.readouterr().out.splitlines()[3:5] == ["| 'a'  | 20 |", "| 'b'  | 16 |"]
    assert cli.main(["SELECT p.i FROM poll(source=>TABLE(range(start=>0, end=>2) r)) p", "--once"]) == 0
    assert capsys.readouterr().out.splitlines()[3:5] == ["| 0 |", "| 1 |"]


def test_live_table_prints_the_whole_result(spark, tmp_path):
    import io

    d, out = clicks(tmp_path / "in"), io.StringIO()
    runner.live_table(Engine(spark), f"SELECT user, SUM(v) AS s FROM {d}/clicks.json?tail=true c GROUP BY user", out, str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    assert out.getvalue().splitlines()[3:5] == ["| 'a'  |  90 |", "| 'b'  | 100 |"]
