import datetime as dt

from wirelake.functions import times

UTC = dt.timezone.utc


def us(*a, hours=0):
    return int((dt.datetime(*a, tzinfo=UTC) - dt.timedelta(hours=hours)).timestamp() * 1_000_000)


CASES = [
    ("2026-03-01T10:20:30Z", None, None, us(2026, 3, 1, 10, 20, 30)),
    ("2026-03-01T10:20:30.1234567+02:00", None, None, us(2026, 3, 1, 8, 20, 30, 123456)),
    ("Sun, 01 Mar 2026 10:20:30 GMT", "Europe/Berlin", None, us(2026, 3, 1, 10, 20, 30)),
    ("03/04/2026 10:20", "UTC", False, us(2026, 3, 4, 10, 20)),
    ("03/04/2026 10:20", "UTC", True, us(2026, 4, 3, 10, 20)),
    ("1. März 2026, 10:20 Uhr", "Europe/Berlin", True, us(2026, 3, 1, 9, 20)),
    ("1 mars 2026 à 10h20", "Europe/Paris", True, us(2026, 3, 1, 9, 20)),
    ("March 1, 2026 at 3:05 PM", "America/New_York", False, us(2026, 3, 1, 20, 5)),
    ("1772360430", None, None, us(2026, 3, 1, 10, 20, 30)),
    ("1772360430123", None, None, us(2026, 3, 1, 10, 20, 30, 123000)),
    ("2026-10-25 02:30", "Europe/Berlin", True, us(2026, 10, 25, 0, 30)),  # twice: the first
    ("2026-03-29 02:30", "Europe/Berlin", True, us(2026, 3, 29, 1, 30)),  # skipped: the offset before
    ("2026-03-01", "UTC", None, None),
    ("2026-02-30 10:00", "UTC", None, None),
    ("1994-12-31T23:59:59Z", None, None, None),
    ("yesterday", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
]


def test_forms_zones_and_changes_of_the_clock(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "id long, text string, zone string, day_first boolean")
    got = {r.id: r.utc_us for r in times.with_instants(rows).collect()}
    assert {i: got[i] for i in got} == {i: c[3] for i, c in enumerate(CASES)}


def test_dictionary_grows_merges_and_reopens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(times, "PARTS", 2)
    path = str(tmp_path / "times")
    batches = [[(1, "2026-03-01T10:00:00Z"), (2, "no time")], [(3, "2026-03-01T10:00:00Z"), (4, "2026-03-02T10:00:00Z")], [(5, "2026-03-03T10:00:00Z")], []]
    found = []
    for b in batches:
        rows = spark.createDataFrame(b, "id long, text string").selectExpr("*", "null as zone", "null as day_first", "'x' as _t", "7L as utc_us")
        rows = rows.withColumns({"zone": rows.zone.cast("string"), "day_first": rows.day_first.cast("boolean")})
        known = times.TimeDictionary(spark, path)
        found += [(r.id, r.utc_us) for r in known.resolve(rows).collect()]
    assert sorted(found) == [(1, us(2026, 3, 1, 10)), (3, us(2026, 3, 1, 10)), (4, us(2026, 3, 2, 10)), (5, us(2026, 3, 3, 10))]
    last = times.TimeDictionary(spark, path)
    assert len(last.parts) <= 2 and last.known().count() == 4
