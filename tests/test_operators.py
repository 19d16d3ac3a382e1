"""Operators on small rows, with the cases that are easy to get wrong."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import text as x
from tidemark.functions.numbers import round_half_up, share
from tidemark.operators import attribution, calendar, classify, disclosure, folds, guards, intervals, projection, stats
from tidemark.operators.versioned import VersionedTable, diff, merge_known, monotone_refresh

D = dt.date


def test_ties_kept_or_one(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")], "k int, v int, x string")
    t = VersionedTable(df, ("k",), "v")
    assert [r[1] for r in rows(t.latest().select("k", "x"))] == ["b", "c"]
    assert [r[1] for r in rows(t.latest("one", [F.col("x")]).select("k", "x"))] == ["b", "d"]
    assert [r[1] for r in rows(t.latest(null_versions=True).select("k", "x"))] == ["b", "c", "d"]
    assert rows(t.as_of(1).latest().select("x")) == [("a",)]


def test_changes_and_history(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, v int, x string")
    t = VersionedTable(df, ("k",), "v")
    assert [r[0] for r in rows(t.changes(["x"]).select("v"))] == [1, 3, 5]
    assert rows(t.history())[0] == (1, 1, 5, 5)


def test_diff_is_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "k int, a int")
    new = spark.createDataFrame([(1, None), (2, 6), (4, 1)], "k int, a int")
    assert [r[1] for r in rows(diff(old, new, ["k"], ["a"]).select("k", "status"))] == ["unchanged", "revised", "new"]


def test_null_is_no_information(spark):
    old = spark.createDataFrame([(1, 5, 6), (2, 7, None)], "k int, a int, b int")
    new = spark.createDataFrame([(1, None, None), (2, None, 9), (3, None, 1)], "k int, a int, b int")
    assert rows(merge_known(old, new, ["k"], ["a", "b"])) == [(7, 9, 2), (None, 1, 3)]


def test_refresh_only_raises(spark):
    old = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, a int")
    new = spark.createDataFrame([(1, 6), (2, 1), (3, 2), (4, 8)], "k int, a int")
    assert [r[0] for r in rows(monotone_refresh(old, new, ["k"], ["a"]).select("a", "k"))] == [1, 6, 9]


def test_windows_are_inclusive(spark):
    days = calendar.spine(spark, D(2024, 1, 1), D(2024, 1, 31))
    assert calendar.day_window(days, "date", D(2024, 1, 10), 7).count() == 7
    assert calendar.lookback(days, "date", D(2024, 1, 31), 7).count() == 8
    assert calendar.weekdays(days, "date", []).count() == 31
    assert {r[0].weekday() for r in calendar.weekdays(days, "date", [0]).collect()} == {6}
    months = spark.createDataFrame([("2023-11",), ("2024-01",), ("2024-02",)], "month string")
    assert calendar.month_window(months, "month", D(2024, 1, 5), 2).count() == 1
    assert calendar.month_window(months, "month", D(2024, 1, 5), 3).count() == 2
    assert calendar.month_window(months, "month", D(2024, 1, 5), None).count() == 2
    assert calendar.spine(spark, D(2024, 1, 2), D(2024, 1, 1)).count() == 0


def test_end_date_is_checked():
    today = D(2024, 5, 5)
    assert calendar.as_date("2024-02-30", today) == today and calendar.as_date("x", today) == today and calendar.as_date("2024-02-01", today) == D(2024, 2, 1)
    late = dt.datetime(2024, 5, 5, 22, 30, tzinfo=dt.UTC)
    assert calendar.today_in("Europe/Kyiv", late) == D(2024, 5, 6) and calendar.today_in("UTC", late) == today


def test_fill_and_pad(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 5), (D(2024, 1, 3), None), (D(2024, 2, 1), 1)], "date date, v int")
    out = calendar.fill_days(df, "date", D(2024, 1, 1), D(2024, 1, 4), keep=F.dayofmonth("date") != 2)
    assert rows(out) == [(D(2024, 1, 1), 5), (D(2024, 1, 3), None), (D(2024, 1, 4), None)]
    twice = spark.createDataFrame([(D(2024, 1, 1), 5, 1), (D(2024, 1, 1), 6, 2), (D(2024, 1, 1), 7, 0)], "date date, v int, at int")
    assert rows(calendar.fill_days(twice, "date", D(2024, 1, 1), D(2024, 1, 1), order=[F.col("at")]).select("v")) == [(6,)]
    months = spark.createDataFrame([("2023-10", 1), ("2023-12", 2)], "month string, v int")
    assert rows(calendar.pad_months(months, "month", D(2024, 2, 9))) == [("2023-10", 1), ("2023-12", 2), ("2024-01", None), ("2024-02", None)]
    assert calendar.pad_months(months.limit(0), "month", D(2024, 2, 9)).count() == 0


def test_first_gap(spark):
    df = spark.createDataFrame([(D(2024, 1, d),) for d in (2, 3, 5)], "date date")
    assert rows(calendar.first_gap(df, "date", D(2024, 1, 1), D(2024, 1, 9))) == [(D(2024, 1, 2),), (D(2024, 1, 3),)]


def test_median_is_the_upper_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert rows(stats.stat_bundle(df, ["v"])) == [(4.0, 3.0, "v", 10.0)]
    assert rows(stats.stat_bundle(df, ["v"], nulls="zero")) == [(4.0, 2.0, "v", 10.0)]
    assert rows(stats.stat_bundle(df.where("v is null"), ["v"])) == [(0.0, 0.0, "v", 0.0)]


def test_rounding(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (2.4,)], "v double")
    assert sorted(r[0] for r in df.select(round_half_up(F.col("v"))).collect()) == [-2, 2, 3]
    assert [r[0] for r in df.limit(1).select(share(F.col("v"), F.lit(0))).collect()] == [None]


def test_end_of_day_needs_five_days(spark):
    curve = [(0, 5), (6, 30), (12, 50), (18, 85), (23, 100)]
    past = [("m", D(2024, 1, d), h, v * (100 + d)) for d in range(1, 8) for h, v in curve]
    today = [("m", D(2024, 1, 8), h, v * 95) for h, v in curve if h <= 12]
    df = spark.createDataFrame(past + today, "metric string, date date, bucket int, value int")
    (r,) = projection.end_of_day(df, D(2024, 1, 8)).collect()
    assert (r.bucket, r.fraction, r.projected) == (12, 0.5, 9500)
    assert projection.end_of_day(df.where("date > '2024-01-03'"), D(2024, 1, 8)).count() == 0


def test_running_total_and_trend(spark):
    v = [None, 2, None, 3, None]
    df = spark.createDataFrame([(D(2024, 1, i + 1), x) for i, x in enumerate(v)], "date date, v int")
    assert [r[2] for r in rows(projection.running_total(df, "date", "v").select("date", "v", F.col("running").alias("z")))] == [0, 2, 2, 5, None]
    assert [r[2] for r in rows(projection.trend(df, "date", "v").select("date", "v", F.col("trend").alias("z")))] == [None, 2, None, 3, None]
    one = projection.trend(df.where("v = 2"), "date", "v").first()
    assert one["trend"] == 2


def test_withheld_is_not_zero(spark):
    df = spark.createDataFrame([("a", 5.0, True), ("a", 1.0, False), ("b", 0.0, True), ("c", 0.0, False)], "k string, v double, w boolean")
    out = disclosure.disclosed_sums(df, ["k"], F.col("w"), {"v": F.col("v")})
    assert rows(out) == [(0, "c", 0.0), (1, "a", 1.0), (1, "b", None)]


def test_fair_share_does_not_double(spark):
    # the same report under two ids, each naming one place of a pair
    kids = spark.createDataFrame([(1, "n", 60, 1), (1, "n", 60, 1), (1, "s", 20, 2)], "id int, place string, n int, size int")
    shares = attribution.fair_share(kids, ["id"], "place", F.col("n"), F.col("size"))
    total = spark.createDataFrame([(1, 100.0), (2, None)], "id int, total double")
    assert rows(attribution.coverage(total, shares, ["id"], "total")) == [(0.0, 2, None, 0.0), (70.0, 1, 100.0, 30.0)]


def test_priority(spark):
    df = spark.createDataFrame([(1, "web", 9), (1, "post", 1), (1, "post", 2), (2, "other", 5)], "k int, s string, t int")
    assert rows(attribution.pick_by_priority(df, ["k"], "s", ["post"], [F.col("t").desc()])) == [(1, "post", 2), (2, "other", 5)]
    assert attribution.drop_covered(df, ["k"], "s", "post").count() == 3


def test_only_the_later_window_overlaps(spark):
    w = spark.createDataFrame([(1, 8, 23), (2, 20, 31), (3, 40, 41), (4, 41, 50), (5, None, None)], "id int, s int, e int")
    out = intervals.overlaps(w.where("id < 5"), [], "s", "e", "id").where("s < prev_end")
    assert [(r.id, r.prev_id) for r in out.collect()] == [(2, 1)]


def test_suspect_drop_holds_the_last_good(spark):
    df = spark.createDataFrame([("a", D(2024, 1, i + 1), v) for i, v in enumerate([110827, 11257, 111720])] + [("b", D(2024, 1, i + 1), v) for i, v in enumerate([10, 4, 12])] + [("c", D(2024, 1, 1), None), ("c", D(2024, 1, 2), 7), ("c", D(2024, 1, 3), 9)], "k string, d date, v int")
    out = {k: [r.increment for r in sorted(folds.hold_last_good(df, ["k"], "d", "v").where(F.col("k") == k).collect(), key=lambda r: r.d)] for k in "abc"}
    assert out == {"a": [110827, None, 893], "b": [10, -6, 8], "c": [None, None, 2]}


def test_run_lengths(spark):
    df = spark.createDataFrame([([3, -4, 1, -2],)], "c array<int>")
    assert df.select(folds.rle_decode(F.col("c"))).first()[0] == [3, 0, 0, 0, 0, 1, 0, 0]
    with pytest.raises(Exception, match="cover the days"):
        df.select(folds.checked_rle(F.col("c"), F.lit(7))).collect()
    days = spark.createDataFrame([(D(2022, 2, 24) + dt.timedelta(days=i), 1) for i in range(15)], "d date, n int")
    assert rows(folds.bucket_sums(days, "d", F.lit(D(2022, 2, 24)), "n")) == [(1, D(2022, 3, 10)), (7, D(2022, 2, 24)), (7, D(2022, 3, 3))]
    assert days.select(calendar.thursday_week(F.lit(D(2022, 3, 2)))).first()[0] == D(2022, 2, 24)


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, x string")
    guards.floor(df, 3)
    with pytest.raises(guards.GuardError):
        guards.floor(df, 4)
    with pytest.raises(guards.GuardError):
        guards.no_shrink(df, df.where("k = 1"), ["k"])
    with pytest.raises(guards.GuardError):
        guards.header_drift(df, ["k", "y"])
    assert rows(guards.duplicates(df, ["k"])) == [(2, 2)]
    renamed = spark.createDataFrame([(1, "z"), (2, "b")], "k int, x string")
    assert guards.unexplained_missing(df, renamed, ["k", "x"]).count() == 0
    assert guards.unexplained_missing(df, spark.createDataFrame([(9, "q")], "k int, x string"), ["k", "x"]).count() == 2
    with pytest.raises(guards.GuardError):
        guards.shrink(df, spark.createDataFrame([(9, "q")], "k int, x string"), ["k", "x"])
    assert guards.shrink_tolerance(10) == 1 and guards.shrink_tolerance(100_000) == 20
    parents = spark.createDataFrame([(1, 100), (2, 50)], "k int, total int")
    kids = spark.createDataFrame([(1, 50), (2, 20), (2, 30)], "k int, part int")
    assert rows(guards.child_mismatch(parents, kids, ["k"], "total", "part")) == [(50, 1, 100)]
    assert [r[0] for r in df.select(guards.plausible(F.lit(6000))).limit(1).collect()] == [None]
    assert df.limit(1).select(guards.consistent_total(F.lit(3), F.lit(5), F.lit(9)), guards.consistent_total(F.lit(3), F.lit(5), F.lit(4))).first()[:] == (9, None)


def test_classes_and_names(spark):
    df = spark.createDataFrame([("A1 and b2",), ("B2",), ("x",)], "n string")
    out = df.select(classify.classify(F.col("n"), [("top", ["a1"], "any"), ("all-b", ["b2", "b3"], "all")], "other"))
    assert [r[0] for r in out.collect()] == ["top", "all-b", "other"]
    known = spark.createDataFrame([("B2",)], "s string")
    assert "B2" in [r[0] for r in classify.canonical_spelling(spark.createDataFrame([("b2 ",)], "n string"), "n", known, "s").collect()]
    low, high, mid = classify.bounded(F.lit(4.0), F.lit(8.0), F.lit("range"))
    assert df.limit(1).select(low, high, mid).first()[:] == (4.0, 8.0, 6.0)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_facts(spark):
    assert one(spark, x.html_to_text(F.lit("<head><script>a<b</script></head><p>x&nbsp;&amp;<b>y</b></p><!-- z -->"))) == "x & y"
    assert one(spark, x.number_word(F.lit("Twelve"))) == 12 and one(spark, x.number_word(F.lit("дві"))) == 2 and one(spark, x.number_word(F.lit("lots"))) is None
    assert one(spark, x.list_sum(F.lit("3 tanks, a truck, 12 guns,"))) == 16
    assert [tuple(r) for r in one(spark, x.distributed(F.lit("5 over a, b and c")))] == [("a", 5), ("b", 5), ("c", 5)]
    assert one(spark, x.date_in(F.lit("on 5 March 2024"))) == D(2024, 3, 5) and one(spark, x.date_in(F.lit("31.02.2024"))) is None
    assert [tuple(r) for r in one(spark, x.label_values(F.lit("cars – 1 234 (+5)\nboats – 7")))] == [("cars", 1234, 5), ("boats", 7, 0)]
    assert one(spark, x.bound_before(F.lit("more than 40"), "40")) == "at_least" and one(spark, x.bound_before(F.lit("up to about 40"), "40")) == "approx" and one(spark, x.bound_before(F.lit("saw 40"), "40")) == "exact"
    assert one(spark, x.count_near(F.lit("destroyed 17 drones"), "drone")) == 17 and one(spark, x.count_near(F.lit("one drone"), "drone")) == 1 and one(spark, x.count_near(F.lit("6000 drones"), "drone")) is None


def test_report_windows(spark):
    posted = F.lit("2024-01-02 08:00:00").cast("timestamp")
    night = one(spark, x.report_window(F.lit("from 20:00 to 07:00"), posted))
    assert (night.start, night.end, night.kind) == (dt.datetime(2024, 1, 1, 20), dt.datetime(2024, 1, 2, 7), "night")
    late = one(spark, x.report_window(F.lit("from 18:00 to 24:00"), posted))
    assert (late.start, late.end, late.kind) == (dt.datetime(2024, 1, 1, 18), dt.datetime(2024, 1, 2, 0), "night")
    kinds = [one(spark, x.report_window(F.lit(w), posted)).kind for w in ("from 20:00 to 23:00", "from 0:00 to 6:00", "from 9:00 to 17:59", "from 0:00 to 7:20")]
    assert kinds == ["night", "night", "day", "day"]
    text = F.lit("from 20:00 to 07:00 destroyed 9 drones: 6 drones over the north, 5 over south.")
    report = one(spark, x.parse_report(text, posted, "drone"))
    assert report["count"] == 11 and [tuple(p) for p in report["parts"]] == [("north", 6), ("south", 5)] and report["report_date"] == D(2024, 1, 2)
    assert one(spark, x.parse_report(F.lit("nothing"), posted, "drone")) is None


def test_report_headers(spark):
    from tidemark.functions import reports as r

    posted = F.lit("2026-05-09 20:10:00").cast("timestamp")
    a = one(spark, r.snapshot_of(F.lit("Станом на 22:00 9 травня 2026 року"), posted))
    assert (a.report_date, a.snapshot_at, a.note) == (D(2026, 5, 9), dt.datetime(2026, 5, 9, 22), None)
    b = one(spark, r.snapshot_of(F.lit("станом на 08.00 10.05.2026: минулої доби"), F.lit("2026-05-10 05:30:00").cast("timestamp")))
    assert b.report_date == D(2026, 5, 9)
    c = one(spark, r.snapshot_of(F.lit("станом на 22:00 08.05.2026, від початку доби"), posted))
    assert (c.report_date, c.note) == (D(2026, 5, 9), "header said 2026-05-08")
    assert one(spark, r.snapshot_of(F.lit("нічого"), posted)) is None


def test_report_numbers(spark):
    from tidemark.functions import reports as r

    assert one(spark, r.spelt_number(F.lit("сорок чотири"))) == 44 and one(spark, r.spelt_number(F.lit("1 234"))) == 1234
    assert one(spark, r.spelt_number(F.lit("двести сорок пять"))) == 245 and one(spark, r.spelt_number(F.lit("сто одиннадцать"))) == 111
    assert one(spark, r.spelt_number(F.lit("три п'ять"))) == 5 and one(spark, r.spelt_number(F.lit("двадцать двести пять"))) == 205
    assert one(spark, r.spelt_number(F.lit("окупанти шість"))) == 6 and one(spark, r.spelt_number(F.lit("шість разом"))) is None
    assert one(spark, r.first_known(F.lit("a 0 b 7"), [r"a (\d)", r"b (\d)"])) == 7 and one(spark, r.first_known(F.lit("x"), [r"a (\d)"])) is None
    assert one(spark, r.tally(F.lit("Сили оборони уразили 12 районів, дві гармати, склад боєприпасів та озброєння."))) == 15
    assert one(spark, r.tally(F.lit("тихо"))) is None
    assert one(spark, r.tally(F.lit("Сили оборони уразили дві гармати, озброєння, 5 одиниць та озброєння 3 одиниці."))) == 10
    s = one(spark, r.parse_summary(F.lit("відбулося 94 боєзіткнення"), {"fights": [r"(\d+) боєзіткнен"]}))
    assert (s.fights, s.part) == (94, None)
    assert one(spark, r.parse_summary(F.lit("Частина 2. 94 боєзіткнення"), {"fights": [r"(\d+) боєзіткнен"]})).fights is None


def test_report_places(spark):
    from tidemark.functions import reports as r

    text = (
        "На Покровському напрямку ворог здійснив 17 атак, дві атаки тривають. На Лиманському та Північно-Слобожанському напрямках відбулося шість боєзіткнень, агресор сім разів атакував. "
        "На Херсонському напрямку ворог активних дій не проводив. На цьому напрямку 5 атак. На Покровському напрямку 99 атак."
    )
    out = [tuple(x) for x in one(spark, r.place_reports(F.lit(text)))]
    assert out == [("покровському", 17, 2, 1, None), ("лиманському", 7, None, 2, 1), ("північнослобожанському", 7, None, 2, 1), ("херсонському", None, None, 1, None)]
    assert one(spark, r.place_reports(F.lit(""))) == []


def test_report_places_read_whole_sections_and_leading_counts(spark):
    from tidemark.functions import reports as r

    def places(text):
        return [(x.place, x.attacks, x.ongoing) for x in one(spark, r.place_reports(F.lit(text)))]

    filler = "Точилися бої. " * 60
    long = f"На Покровському напрямку було важко. {filler}Ворог здійснив 17 атак, дві атаки тривають. На Лиманському напрямку тихо. {filler}5 атак."
    assert places(long) == [("покровському", 17, 2), ("лиманському", None, None)]  # the last section ends after 600 characters
    lead = "На Лиманському напрямку було тихо. Усього 25 атак здійснив ворог на Покровському напрямку, ще 2 атаки тривають. На Херсонському напрямку 3 атаки."
    assert places(lead) == [("лиманському", None, None), ("покровському", 25, 2), ("херсонському", 3, None)]
    assert places("Усього 25 атак здійснив ворог на Покровському напрямку. 2 атаки тривають") == [("покровському", 25, 2)]
    assert places("На Лиманському напрямку зупинили 13 атак На Херсонському напрямку зупинили 21 спробу") == [("лиманському", 13, None), ("херсонському", 21, None)]


def test_breakdown_passes(spark):
    def parts(text):
        return [tuple(p) for p in one(spark, x.breakdown(F.lit(text), "drone"))]

    assert parts("6 drones over the north, 5 over south. In total since noon: 40 drones over the north, 9 over south.") == [("north", 6), ("south", 5)]
    assert parts("three drones each over A, B and C; 4 drones over D") == [("A", 3), ("B", 3), ("C", 3), ("D", 4)]
    assert parts("over the east were destroyed 7 drones, 2 drones were destroyed over West Sea, a drone over the bay, 5 over south") == [("east", 7), ("West Sea", 2), ("bay", 1), ("south", 5)]
    assert parts("6 drones over the north, two over south, 1 over north") == [("north", 7), ("south", 2)]
    assert parts("6 drones over the north") == []


def test_dated_and_default_windows(spark):
    def window(text, posted):
        return tuple(one(spark, x.report_window(F.lit(text), F.lit(posted).cast("timestamp"))))

    t = dt.datetime
    assert window("from 20:00 on 31 December to 07:00 on 1 January", "2024-01-01 08:00:00") == (t(2023, 12, 31, 20), t(2024, 1, 1, 7), "night")
    assert window("from 20:00 on 4 May to 24:00 on 4 May", "2024-05-05 08:00:00") == (t(2024, 5, 4, 20), t(2024, 5, 5, 0), "night")
    assert window("last night 9 drones were destroyed", "2024-01-02 08:00:00") == (t(2024, 1, 1, 20), t(2024, 1, 2, 7), "night")
    assert window("overnight from 23:00 to 06:30", "2024-01-02 08:00:00") == (t(2024, 1, 1, 23), t(2024, 1, 2, 6, 30), "night")


def test_kinds_of_summaries_and_rough_places(spark):
    kind = lambda s: (lambda r: r and tuple(r))(one(spark, x.summary_kind(F.lit(s))))
    assert kind("Summary from 2 to 8 May 2025") == ("weekly", "2 May to 8 May 2025") and kind("Summary as of 3 May 2025") == ("daily", "3 May 2025")
    assert kind("Briefing from 28 to 29 May 2025") == ("briefing", None) and kind("A summary") == ("summary", None) and kind("9 drones") is None
    assert tuple(one(spark, x.rough_places(F.lit("9 drones over A, B and C. More")))) == (3, "A, B and C")


def test_periods_of_reports(spark):
    from tidemark.functions import reports as r

    period = lambda s: one(spark, r.period_of(F.lit(s)))
    assert period("За результатами бойової роботи у березні. 9 травня 2026. За підсумками квітня 2025") == "2026-04"
    assert period("У червні наші сили, 3 липня 2026") == "2026-06" and period("за підсумками травня") is None and period("12 травня 2026") is None


def test_entities(spark):
    text = F.lit("caf&eacute; &#233;&#xE9; &amp;amp; a&nbsp;b &lt;x&gt; &unknown; &#0; & &#1114112; &#x1F600; &apos;")
    assert one(spark, x.unescape(text)) == "caf\u00e9 \u00e9\u00e9 &amp; a b <x> &unknown; &#0; & &#1114112; \U0001f600 '"
    assert one(spark, x.unescape(F.lit("no entity"))) == "no entity" and one(spark, x.unescape(F.lit(None).cast("string"))) is None


def test_signatures_of_cells_with_separators(spark):
    from tidemark.operators.versioned import signature

    cells = [[("a|b", "c")], [("a", "b|c")], [(None, "c")], [("~", "c")], [("\\N", "c")], [("a", "b;c"), ("d", "e")], [("a", "b"), ("c", "d"), ("d", "e")], [("d", "e"), ("a", "b;c")]]
    df = spark.createDataFrame([(k, *c) for k, own in enumerate(cells) for c in own], "k int, a string, b string")
    got = [r[1] for r in sorted(signature(df, ["k"], ["a", "b"]).collect())]
    assert len(set(got)) == len(cells) - 1 and got[5] == got[7]


def test_limits_of_reports(spark):
    from tidemark.operators import guards

    sane = lambda total, parts, other: tuple(one(spark, guards.sane_report(F.lit(total).cast("long"), F.array(*map(F.lit, parts)).cast("array<long>"), F.lit(other).cast("long"))))
    assert sane(50, [1, 2, 30, 4, None], None) == (50, True) and sane(20, [1, 2, 30, 4, 5], 40) == (40, True) and sane(20, [1, 2, 30, 4, 5], 10) == (None, True)
    assert sane(50, [1, 2], None) == (50, False) and sane(900, [1, 2, 3, 4, 5], None) == (900, False) and sane(800, [1, 2, 3, 4, 501], None) == (800, False)
    assert one(spark, guards.within(F.lit(5), 1, 4)) is None and one(spark, guards.within(F.lit(4), 1, 4)) == 4
