import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ledgerloom.functions import temporal as T, text as X


def _python_seconds(s):
    try:
        d = datetime.fromisoformat(s.strip())
    except (ValueError, AttributeError):
        return None
    d = d if d.tzinfo else d.replace(tzinfo=timezone.utc)
    return int((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() // 1)


TIMES = [
    "2024-06-05T07:34:02Z", "2024-08-05T16:34:24+05:30", "2024-04-08 08:01:53", "2024-05-21T15:32:05.602Z", "20250123T052206Z", "2024-08-11T01:17:57-04:00",
    " 2024-10-02T05:40:33Z\t", "2025-02-30", "2025-02-28", "20250228", "before the flood", "??", "n/a", "", "  ", "2024-W05-3", "2024W053", "2024-W05", "2024-W60",
    "2024-05-01T10", "2024-05-01T10:20", "20240501T1020+0530", "20240501T102030-0930", "2024-05-01T10:20:30+05", "2024-05-01T25:00:00", "1969-12-31T23:59:59.9Z",
    "0001-01-01", "2024-05-01T10:20:30,5", "2024-06-31T00:00:00Z", "0000-01-01", "2024-05", "2024-05-01T", "2024-05-01Z", None,
]


def test_instants_like_python(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", T.epoch_seconds(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == {t: _python_seconds(t) for t in TIMES}


def test_instant_text_and_keys(spark):
    r = spark.createDataFrame([(1704067199, " SNP_A\n"), (None, " \t")], "s bigint, k string").select(T.instant_text(F.col("s")), T.month_text(F.col("s")), T.reference_key(F.col("k"))).collect()
    assert [tuple(x) for x in r] == [("2023-12-31T23:59:59Z", "2023-12", "snp_a"), (None, None, None)]


def test_overlap_and_containment(spark):
    rows = [(1, 2, 2, 3), (1, 3, 2, 4), (None, 2, 1, None), (None, None, None, None), (5, 5, 1, 9)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = [r[0] for r in df.select(T.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [False, True, True, True, True]
    got = [r[0] for r in df.select(T.contains_instant(F.col("a"), F.col("b"), F.lit(1))).collect()]
    assert got == [True, True, True, True, False]


def test_lines_like_splitlines(spark):
    rng = random.Random(5)
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = ["", "a", "\n", "a\n", "a\r\nb\rc", "\r\n\r\n", *("".join(rng.choice(["x", "yy", "", "é", *ends]) for _ in range(rng.randrange(12))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.source_lines(F.col("t")).alias("l"), X.line_count(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.l == r.t.splitlines() and r.n == len(r.l)
    assert spark.createDataFrame([(None,)], "t string").select(X.line_count(F.col("t"))).first()[0] is None


def test_quotes_and_digests(spark):
    import hashlib

    df = spark.createDataFrame([("a\r\nb\rc", " SHA256:" + "AB" * 32), ("", "xyz"), (None, None)], "q string, h string")
    rows = df.select(X.quote_sha256(F.col("q")).alias("d"), X.plain_digest(F.col("h")).alias("p")).collect()
    assert rows[0].d == hashlib.sha256(b"a\nb\nc").hexdigest() and rows[0].p == "ab" * 32
    assert rows[1].d == hashlib.sha256(b"").hexdigest() and rows[1].p is None and rows[2].d is None
    lines = spark.createDataFrame([(["a", "b", "c"],)], "l array<string>")
    got = lines.select(*[X.line_quote(F.col("l"), F.lit(a), F.lit(b)) for a, b in ((1, 2), (3, 3), (0, 1), (2, 4), (3, 2))]).first()
    assert tuple(got) == ("a\nb", "c", None, None, None)
