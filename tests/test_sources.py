"""The text log's odd lines, and the sinks."""

from __future__ import annotations

import pytest

from sittings.operators import ranking
from sittings.runtime import scratch_path
from sittings.sources import plays, sinks


def write_log(tmp_path, text):
    path = tmp_path / "log.tsv"
    path.write_text(text, encoding="utf-8")
    return str(path)


LINES = "\n".join(
    [
        "u1\t2009-05-04T23:08:57Z\tid1\tCake\tid2\tJolene",
        "u1\tbad\tid1\tCake\tid2\tJolene",
        "u1\t2009-05-04T23:10:00Z\t\tCake\t\tNo ids",
        "u1\t2009-05-04T23:11:00Z\tid1\t\tid2\tNo artist",
        "u1\t2009-05-04T23:12:00Z\tid1",
        "u1\t2009-05-04T23:13:00Z\tid1\tCake\tid2\tExtra\tfield\tmore",
        "",
        'u1\t2009-05-04T23:14:00Z\tid1\tBowie\tid2\t"Heroes"',
        'u1\t2009-05-04T23:15:00Z\tid1\t"Foo\tid2\tUnclosed',
        "u1\t2009-05-04T23:16:00Z\tid1\tCake\tid2\tback\\slash ",
    ]
)


def test_odd_lines(spark, tmp_path):
    got = plays.read_plays_tsv(spark, write_log(tmp_path, LINES)).orderBy("timestamp").collect()
    assert [r.track_name for r in got] == [
        "Jolene", "No ids", "Extra", '"Heroes"', "Unclosed", "back\\slash ",
    ]
    assert got[0].timestamp.isoformat() == "2009-05-04T23:08:57"
    assert got[1].artist_id is None and got[1].track_id is None
    assert got[4].artist_name == '"Foo'


def test_quoting_changes_names(spark, tmp_path):
    path = write_log(tmp_path, LINES)
    got = [r.track_name for r in plays.read_plays_tsv(spark, path, quote='"').collect()]
    assert "Heroes" in got and "Unclosed" not in got


def test_bad_time_is_null_not_an_error(spark, tmp_path):
    raw = plays.with_parsed_timestamp(plays.read_raw_tsv(spark, write_log(tmp_path, LINES)))
    assert raw.filter("timestamp IS NULL").count() == 1


def test_only_needed_columns_and_filters_reach_the_scan(spark, tmp_path):
    df = ranking.top_songs(plays.read_plays_tsv(spark, write_log(tmp_path, LINES)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    for scan in scans:
        assert "IsNotNull(user_id)" in scan and "IsNotNull(track_name)" in scan
        assert "artist_id" not in scan and "track_id" not in scan


def test_report_sink(spark, tmp_path):
    out = str(tmp_path / "top")
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.5)], "rank int, name string, x double")
    sinks.write_report(df, out, ["rank"])
    (part,) = (tmp_path / "top").glob("part-*")
    assert part.read_bytes() == b"rank\tname\tx\n1\ta\t1.5\n2\tb\t\n"


def test_empty_report_fails(spark, tmp_path):
    df = spark.createDataFrame([], "rank int, name string")
    with pytest.raises(RuntimeError):
        sinks.write_report(df, str(tmp_path / "none"), ["rank"])


def test_partitioned_sink(spark, tmp_path):
    rows = [("m1", 'say "hi"', 1.0), ("m2", "b", None)]
    df = spark.createDataFrame(rows, "model string, a string, x double")
    sinks.write_tsv(df, str(tmp_path / "fc"), partition_by=["model"])
    (part,) = (tmp_path / "fc" / "model=m1").glob("part-*")
    assert part.read_text() == 'a\tx\nsay "hi"\t1.0\n'


EDGES = [
    "  pad ", "a\tb", "x\ny", "x\r\ny", "cr\rmid", "back\\slash", "end\\", 'quote"in', '"q"', "", None,
    "a,b", "nul\0x", "\\n literal", "\\\\n", "#c", "\\e", "tail\n", " ",
]


@pytest.mark.parametrize("kind", ["tsv", "csv", "report"])
def test_texts_come_back_as_they_were(spark, tmp_path, kind):
    df = spark.createDataFrame(list(enumerate(EDGES)), "i int, v string")
    path = str(tmp_path / kind)
    if kind == "tsv":
        sinks.write_tsv(df, path)
        back = sinks.read_tsv(spark, path, df.schema)
    elif kind == "csv":
        sinks.write_csv(df, path)
        back = sinks.read_back(spark, path, df.schema, ",")
    else:
        sinks.write_report(df, path, ["i"])
        back = sinks.read_back(spark, path, df.schema)
    assert [r.v for r in back.orderBy("i").collect()] == EDGES


def test_report_of_too_many_rows_fails(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(11).toDF("i"), str(tmp_path / "many"), ["i"], max_rows=10)


def test_scratch_is_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "a"), scratch_path(spark, "a")
    assert first.startswith(root) and first != second


def test_rejected_lines_keep_their_reason(spark, tmp_path):
    path = write_log(tmp_path, LINES + "\n   \n\t\t\t\t\t\n\t2009-05-04T23:10:00Z\tx\tCake\ty\tz")
    checked = plays.read_checked_tsv(spark, path)
    plays.write_checked(checked, str(tmp_path / "out"))
    kept, rejects = plays.read_checked(spark, str(tmp_path / "out"))
    columns = [f.name for f in plays.PLAYS_SCHEMA]
    assert sorted(map(str, kept.select(columns).collect())) == sorted(
        map(str, plays.read_plays_tsv(spark, path).select(columns).collect())
    )
    assert kept.count() + rejects.count() == spark.read.text(path).count() == 13
    got = {r.line: r.reasons for r in rejects.collect()}
    assert got == {
        "u1\tbad\tid1\tCake\tid2\tJolene": "unreadable timestamp",
        "u1\t2009-05-04T23:11:00Z\tid1\t\tid2\tNo artist": "no artist_name",
        "u1\t2009-05-04T23:12:00Z\tid1": "wrong number of fields; no artist_name; no track_name",
        "": "empty line",
        "   ": "empty line",
        "\t\t\t\t\t": "empty line",
        "\t2009-05-04T23:10:00Z\tx\tCake\ty\tz": "no user_id",
    }


def test_checked_log_without_lines(spark, tmp_path):
    plays.write_checked(plays.read_checked_tsv(spark, write_log(tmp_path, "")), str(tmp_path / "out"))
    kept, rejects = plays.read_checked(spark, str(tmp_path / "out"))
    assert kept.count() == rejects.count() == 0


def test_checked_log_with_quotes(spark, tmp_path):
    path = write_log(tmp_path, 'u1\t2009-05-04T23:14:00Z\t\tBowie\t\t"Heroes"\n"u2"\tnever\t\ta\t\tb')
    got = plays.read_checked_tsv(spark, path, quote='"').orderBy("user_id").collect()
    assert [(r.user_id, r.track_name, r.reasons) for r in got] == [
        ("u1", "Heroes", None), ("u2", "b", "unreadable timestamp"),
    ]


def test_one_scan_serves_plays_and_rejects(spark, tmp_path):
    path = write_log(tmp_path, LINES)
    plan = plays.read_checked_tsv(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan


def test_a_bucketed_log_needs_no_shuffle(spark, tmp_path):
    from sittings.operators.ranking import user_session_counts
    from sittings.operators.sessions import session_table
    from sittings.sources import bucketed

    rows = [(f"u{i % 13}", f"2024-01-0{1 + i % 7} 0{i % 10}:{i % 60:02}:00", "a", "t") for i in range(900)]
    log = spark.createDataFrame(rows, "user_id string, t string, artist_name string, track_name string")
    log = log.selectExpr("user_id", "CAST(t AS TIMESTAMP) AS timestamp", "artist_name", "track_name")
    bucketed.write_bucketed(log, "bucketed_test", str(tmp_path / "table"), 4)
    try:
        laid = bucketed.read_bucketed(spark, "bucketed_test")
        table = session_table(laid)
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 0 and "Bucketed: true" in plan
        assert sorted(table.collect()) == sorted(session_table(log).collect())
        assert session_table(log)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
        assert user_session_counts(laid)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    finally:
        spark.sql("DROP TABLE bucketed_test")
