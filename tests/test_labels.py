import pytest
from pyspark.sql import functions as F

from sonoshelf.functions import arguments, labels
from sonoshelf.functions import text as tx


def values(spark, kind, rows, f):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], f"k int, {kind}")
    return [r.x for r in df.select("k", f(*[F.col(c) for c in df.columns[1:]]).alias("x")).orderBy("k").collect()]


def test_times(spark):
    assert values(spark, "v double", [3723.4, 59.5, 0.2, 125.0, None], labels.hms) == ["1h02m03s", "1m00s", "0s", "2m05s", "—"]
    assert values(spark, "v double", [3723.5, 59.4, 0.5], labels.clock) == ["1:02:04", "00:59", "00:01"]
    assert values(spark, "v double", [3723.9, 59.9, -4.0], lambda c: labels.clock(c, rounded=False)) == ["1:02:03", "00:59", "00:00"]
    assert values(spark, "v double", [0.0, 3599.0, 5400.0, 172799.0, 172800.0, float("inf"), float("nan")], labels.rough) == ["—", "<1h", "~2h", "~48h", "~2.0 days", "—", "—"]
    rows = [(7200.0, 14400.0, True), (7200.0, None, False), (None, None, True)]
    assert values(spark, "w double, c double, e boolean", rows, labels.time_left) == ["~4h left", "~2h work time (calendar depends on runner availability) (excl. eval)", "—"]


def test_numbers(spark):
    assert values(spark, "v long", [0, 1023, 1024, 1536, 5 << 30], labels.size) == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 GB"]
    assert values(spark, "v long", [0, -1234567, 999], labels.count) == ["0", "-1,234,567", "999"]
    assert values(spark, "v long", [999_999, 1_000_000, 999_949_999, 999_950_000, -2_500_000_000, 7_000_000_000_000], labels.compact) == ["999,999", "1.0M", "999.9M", "1.0B", "-2.5B", "7.0T"]
    assert values(spark, "a string, c int", [("mp3", 2), ("", 1), (None, 6), (None, None), ("aac", 0)], labels.codec) == ["mp3 · stereo", "mono", "6ch", "—", "aac"]
    assert values(spark, "a int, b int", [(1536, 32768), (None, 4)], labels.memory) == ["1.5 / 32.0 GB", "—"]


def test_arguments():
    assert [arguments.limit(n, 7) for n in (None, 0, 1, 1000, 1001)] == [7, 7, 1, 1000, 7]
    assert [arguments.threshold(x) for x in (-0.1, 0, 1, 1.1)] == [0.3, 0, 1, 0.3]
    assert [arguments.offset(n) for n in (-1, 5, 2_000_000)] == [0, 5, 1_000_000] and [arguments.context(n) for n in (-1, 60)] == [0, 50]
    assert [arguments.snippet(n) for n in (-1, 0, 1, 100, 9000)] == [0, 0, 80, 100, 4000]
    assert arguments.states(" All ") is None is arguments.states("") and arguments.states("Accepted, stale,") == ["accepted", "stale"]
    with pytest.raises(ValueError, match="lost"):
        arguments.states("lost")
    assert arguments.decided_by("") == "mcp:agent" and arguments.decided_by("mcp:x") == "mcp:x" and len(arguments.decided_by("y" * 300)) == 200


def test_parsed_paths(spark):
    rows = ["/m/audiobooks/Ann Leckie/Justice [B0X]/Justice [B0X] - 03 - The End.mp3", "/m/audiobooks/Ann Leckie/Justice [B0X]/01.mp3", "/m/audiobooks/Ann/metadata.json", "a/b", "/m/x/A - one - C.mp3", "/m/audiobooks/B/A - x - 7 - C.mp3"]
    got = values(spark, "v string", rows, tx.parsed_path)
    assert [tuple(r) for r in got] == [("Ann Leckie", "Justice", 3, "The End"), ("Ann Leckie", "Justice", 0, ""), ("Ann", "", 0, ""), ("", "", 0, ""), ("", "A", 0, "C"), ("B", "A - x", 7, "C")]
