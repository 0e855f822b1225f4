from datetime import datetime, timedelta

import numpy as np
import pytest

from codexmill.operators import timestamps
from codexmill.operators.timestamps import _compose, _decode, normalise

FEEDS = [("ny", "America/New_York", "en-US"), ("be", "Europe/Berlin", "de-DE"), ("gb", "Europe/London", "en-GB"), ("ist", "Asia/Kolkata", "en-IN")]


def utc(*parts):
    return int((datetime(*parts) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


CASES = [
    ("2021-04-20T21:15:35Z", "ny", utc(2021, 4, 20, 21, 15, 35)),
    (" 2021-04-20T21:15:35-00:00\t", "ny", utc(2021, 4, 20, 21, 15, 35)),
    ("2021-04-20 21:15:35+0545", "ny", utc(2021, 4, 20, 15, 30, 35)),
    ("2021-01-20 21:15:35 EST", "be", utc(2021, 1, 21, 2, 15, 35)),
    ("2012-02-14T06:18:49[Asia/Kolkata]", "be", utc(2012, 2, 14, 0, 48, 49)),
    ("2012-02-14T06:18:49[Mars/Base]", "be", None),
    ("2024-08-20T22:12:58,5657558", "gb", utc(2024, 8, 20, 21, 12, 58) + 565755),
    ("2021", "be", utc(2020, 12, 31, 23)),
    ("2021-07", "be", utc(2021, 6, 30, 22)),
    ("20160907", "gb", utc(2016, 9, 6, 23)),
    ("20220223T061200Z", "gb", utc(2022, 2, 23, 6, 12)),
    ("20100923070715", "ist", utc(2010, 9, 23, 1, 37, 15)),
    ("1301193252", "ny", 1301193252_000000),
    ("1420657686952", "ny", 1420657686952_000),
    ("Thu, 28 Jun 2012 17:15:13 +0100", "ny", utc(2012, 6, 28, 16, 15, 13)),
    ("3/4/2020", "ny", utc(2020, 3, 4, 5)),
    ("3/4/2020", "gb", utc(2020, 4, 2, 23)),
    ("03.04.2020, 12:30 Uhr", "be", utc(2020, 4, 3, 10, 30)),
    ("9/16/2018 12:34 AM", "ny", utc(2018, 9, 16, 4, 34)),
    ("9/16/2018", "gb", None),  # against the locale
    ("4 décembre 2011", "be", utc(2011, 12, 3, 23)),
    ("March 2, 2017", "ny", utc(2017, 3, 2, 5)),
    ("2015-10-25 02:30:00", "be", utc(2015, 10, 25, 0, 30)),  # occurs twice: the first
    ("2015-03-29 02:30:00", "be", utc(2015, 3, 29, 1, 30)),  # skipped: later by the gap
    ("2015-03-29 02:30:00", "nowhere", None),
    ("2015-03-29T02:30:00Z", None, utc(2015, 3, 29, 2, 30)),
    ("ca. 2013", "be", None),
    ("[2004?]", "be", None),
    ("1999/2000", "be", None),
    ("202-", "be", None),
    ("Winter 1998", "be", None),
    ("2019-13-05", "be", None),
    ("2019-02-29", "be", None),
    ("2017-06-12T25:61:00", "be", None),
    ("", "be", None),
    (None, "be", None),
    ("x" * 100_000, "be", None),
]


def run(spark, rows):
    values = spark.createDataFrame(rows, "tab string, row_key long, content string, feed string, loaded_at timestamp, source string")
    return normalise(values, spark.createDataFrame(FEEDS, "feed string, home_zone string, locale string"))


@pytest.mark.parametrize("block", [4096, 3])
def test_values(spark, monkeypatch, block):
    monkeypatch.setattr(timestamps, "BLOCK", block)
    rows = [("t", i, s, f, datetime(2024, 1, 1 + i % 7), "x") for i, (s, f, _) in enumerate(CASES)]
    got = {r.row_key: r.utc_us for r in run(spark, rows + rows[:5]).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES) if want is not None}


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_viterbi_is_exact():
    """Segments composed in blocks cost as much as the best of all paths."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 6))
        rows = []
        for _ in range(n):
            k = int(rng.integers(1, 4))
            utc_, fmt = rng.integers(0, 6, k), rng.integers(0, 3, k)
            m = np.full((k, k), 1e18)
            np.fill_diagonal(m, rng.integers(0, 3, k).astype(float))
            rows.append((utc_, fmt, utc_, fmt, m))

        def cost(path, rows=rows):
            c = sum(r[4][p, p] for r, p in zip(rows, path, strict=True))
            for (a, p), (b, q) in zip(zip(rows, path, strict=True), list(zip(rows, path, strict=True))[1:], strict=False):
                c += int(a[1][p] != b[1][q]) + int(b[0][q] < a[0][p])
            return c

        paths = [[]]
        for r in rows:
            paths = [[*p, i] for p in paths for i in range(len(r[0]))]
        best = min(map(cost, paths))
        assert _compose(rows).min() == best
        choice = _decode(rows, None, None)
        assert all(a == b for a, b in choice)
        assert cost([a for a, _ in choice]) == best


def _feed(dates, known=()):
    """Records of one feed without locale, in order."""
    return [("t", i, d, "open", datetime(2024, 1, 1) + timedelta(minutes=i), "x") for i, d in enumerate([*known, *dates])]


def _chosen(spark, rows, locale=None, **kw):
    values = spark.createDataFrame(rows, "tab string, row_key long, content string, feed string, loaded_at timestamp, source string")
    feeds = spark.createDataFrame([("open", "UTC", locale)], "feed string, home_zone string, locale string")
    return {r.row_key: r.utc_us for r in normalise(values, feeds, **kw).collect()}


def test_record_order_decides_where_no_locale_is_known(spark):
    """Dates of one May in growing order: without transitions the readings are others."""
    dates = ["2020-05-02", "05/03/2020", "05/04/2020", "2020-05-05", "05/06/2020", "05/07/2020", "2020-05-08"]
    got = _chosen(spark, _feed(dates))
    assert got == {i: utc(2020, 5, d) for i, d in enumerate((2, 3, 4, 5, 6, 7, 8))}
    free = _chosen(spark, _feed(dates), costs=(0.0, 0.0))
    assert free != got


def test_plain_values_settle_a_source(spark):
    """Many values that can be read in one order only outweigh what the record order would save, and settle what contradicts them."""
    plain = [f"{13 + i % 15}/01/2020" for i in range(200)]
    got = _chosen(spark, _feed(["2020-05-02", "05/03/2020", "2020-05-04", "05/16/2020"], plain))
    assert got[201] == utc(2020, 3, 5) and 203 not in got
    assert _chosen(spark, _feed(["05/16/2020"], plain[:20]))[20] == utc(2020, 5, 16)  # little evidence: nothing is settled


def test_locale_outweighs_record_order(spark):
    dates = ["2020-05-02", "05/03/2020", "05/04/2020", "2020-05-05"]
    assert _chosen(spark, _feed(dates), "de-DE")[1] == utc(2020, 3, 5)
    assert _chosen(spark, _feed(dates), "en-US")[1] == utc(2020, 5, 3)


def test_second_occurrence_by_record_order(spark):
    """At a low cost the second occurrence of a local time is chosen where only that keeps the order."""
    rows = [("t", i, c, "be", datetime(2024, 1, 1, 0, i), "x") for i, c in enumerate(["2015-10-25T00:40:00Z", "2015-10-25 02:30:00", "2015-10-25T01:40:00Z"])]
    values = spark.createDataFrame(rows, "tab string, row_key long, content string, feed string, loaded_at timestamp, source string")
    feeds = spark.createDataFrame(FEEDS, "feed string, home_zone string, locale string")
    at = lambda **kw: {r.row_key: r.utc_us for r in normalise(values, feeds, **kw).collect()}[1]
    assert at() == utc(2015, 10, 25, 0, 30)
    assert at(again_cost=0.5) == utc(2015, 10, 25, 1, 30)
