from datetime import date

import pytest
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import ids as I
from skein.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_dates_of_null_have_defaults(spark):
    t = F.lit(None).cast("timestamp")
    assert one(spark, D.int_day(t), D.long_second(t), D.weekday_no(t), D.weekday_name(t), D.week_of_year(t), D.seconds_between(t, t)) == (0, 0, 0, "未知", -1, -1)


def test_week_numbers(spark):
    t = F.lit("2024-01-08").cast("timestamp")  # a year that begins on a Monday
    assert one(spark, D.week_of_year(t), D.full_week_of_year(t)) == (2, 2)
    t = F.lit("2023-01-08").cast("timestamp")
    assert one(spark, D.week_of_year(t), D.full_week_of_year(t)) == (2, 1)


def test_same_day_stands_twice(spark):
    d = F.lit(date(2024, 5, 1))
    assert one(spark, D.days_between(d, d))[0] == [date(2024, 5, 1)] * 2
    assert one(spark, D.days_between(d, F.lit(date(2024, 4, 1))))[0] == []


def test_weekday_of_week_outside_range(spark):
    t = F.lit("2024-05-01").cast("timestamp")
    assert one(spark, D.weekday_of_same_week(t, F.lit(0)), D.weekday_of_same_week(t, F.lit(1))) == (None, date(2024, 4, 29))


@pytest.mark.parametrize(("text", "want"), [("2024-05", "2024-05-01 00:00:00"), ("2024-5-1 7:08", "2024-05-01 07:08:00"), ("2024/05/01 07:08:09", "2024-05-01 07:08:09"), ("0", None), (" ", None), ("soon", None)])
def test_lenient_time(spark, text, want):
    assert one(spark, F.date_format(D.lenient_time(F.lit(text)), "yyyy-MM-dd HH:mm:ss"))[0] == want


@pytest.mark.parametrize("text", ["", " ", "—", "...", "NULL", "(no content)", "<empty>", "[empty]", "N/A", "nil", "{}", "​", "无内容", None])
def test_blank(spark, text):
    assert one(spark, T.is_blank(F.lit(text).cast("string")))[0]


@pytest.mark.parametrize("text", ["a", "0", "可以。", "nullable", "None of them", "No."])
def test_not_blank(spark, text):
    assert not one(spark, T.is_blank(F.lit(text)))[0]


def test_numbers(spark):
    assert one(spark, T.number(F.lit(None).cast("string")), T.number(F.lit("")), T.number(F.lit("x")), T.number(F.lit("2.5"))) == (0.0, 0.0, None, 2.5)


def test_bad_json_and_csv(spark):
    assert one(spark, T.json_list(F.lit("[bad")), T.json_list(F.lit(None).cast("string")), T.csv_list(F.lit(" a,,b ,"))) == ([], [], ["a", "b"])


def test_strict_label_raises(spark):
    with pytest.raises(Exception, match="unknown code 9"):
        one(spark, T.strict_label(F.lit(9), {"1": "A"}))
    assert one(spark, T.strict_label(F.lit(None).cast("int"), {"1": "A"}, "IDLE"))[0] == "IDLE"


def test_confidence_and_duration_edges(spark):
    bands = [one(spark, T.confidence_band(F.lit(x)))[0] for x in (0.0, 0.54, 0.55, 0.8)]
    assert bands == ["none", "widen", "usable", "high"]
    assert one(spark, T.duration_level(F.lit(5), F.lit(None).cast("int"), F.lit(5), F.lit(9)))[0] == "good"


def test_file_sizes_and_ids(spark):
    assert one(spark, T.file_size(F.lit(0)), T.file_size(F.lit(1023)), T.file_size(F.lit(1536)), T.short_id(F.lit("12345678901234")), T.short_id(F.lit("123456789012345"))) == ("-", "1023 B", "1.5 KB", "12345678901234", "123456...012345")


def test_snowflake_round_trip(spark):
    id_ = I.snowflake(F.lit(1700000000123).cast("bigint"), F.lit(31), F.lit(31), F.lit(4095))
    assert one(spark, I.snowflake_millis(id_))[0] == 1700000000123


def test_uid_round_trip(spark):
    assert one(spark, *I.uid_parts(I.uid(F.lit(1716134400 + 99).cast("bigint"), F.lit(7), F.lit(8191)))) == (1716134499, 7, 8191)
