"""Scalar rules against expected values."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, photo, text, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, expected",
    [("2024-02-11 10:00:00", "2024年2月"), ("0000-07-01", "夏"), ("2024", ""), ("", ""), (None, ""), ("1800-12", "冬"), ("2024-13-01", "")],
)
def test_time_segment(spark, given, expected):
    assert value(spark, text.time_segment(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize("given, expected", [("other other 其他 其他", ""), ("Beach P001 beach·Sea", "beach sea"), (None, ""), ("p12a P12", "p12a")])
def test_clean_scene(spark, given, expected):
    assert value(spark, text.clean_scene(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize("given, expected", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, given, expected):
    assert value(spark, text.fnv1a(F.lit(given))) == expected


def test_fnv_of_wide_characters(spark):
    h = 0xCBF29CE484222325
    for b in "杭州 · 夜景".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert value(spark, text.fnv1a(F.lit("杭州 · 夜景"))) == f"{h:016x}"


@pytest.mark.parametrize(
    "given, expected",
    [
        ("a@b.c", "a***@b.c"), ("13812345678", "138****5678"), ("11010519491231002X", "11**********2X"), ("$2b$abc", "<口令哈希 · 已打码>"), ("plain", None), ("", None),
        ("x" * 32, "<疑似令牌/密文 32 字符 · 已打码>"), ("a b@c.d", None),
    ],
)
def test_redaction(spark, given, expected):
    assert value(spark, text.redacted(F.lit(given))) == expected


def test_tags_and_lists(spark):
    tags = F.array(*map(F.lit, [" a", "b", "a", "", "x" * 31]))
    assert value(spark, text.normalised_tags(tags)) == ["a", "b"]
    assert value(spark, text.json_list(F.lit("not json"))) == []
    assert value(spark, text.json_list(F.lit('["p"]'))) == ["p"]
    assert value(spark, text.dumped_list(F.array().cast("array<string>"))) is None
    assert value(spark, text.shortened_place(F.lit("a · b · c"))) == "b · c"
    assert value(spark, text.shortened_place(F.lit("a"))) == "a"
    assert value(spark, text.folder_name(F.lit(' a/b:c '))) == "a_b_c"
    assert value(spark, text.cell_text(F.lit("y" * 201))).startswith("y" * 200 + "…")
    assert value(spark, text.screenshot_marker(F.lit("/A/Screenshot_1.png"))) == "screenshot"


def test_rounding_keeps_the_sign_of_zero(spark):
    given = [-1e-7, 1e-7, -0.0, 0.0, 0.1234565, -0.5, None]
    got = value(spark, F.transform(F.array(*(F.lit(x).cast("double") for x in given)), lambda x: vectors.rounded(x)))
    assert list(map(repr, got)) == ["-0.0", "0.0", "-0.0", "0.0", "0.123457", "-0.5", "None"]


def test_photo_formats(spark):
    assert [value(spark, photo.format_shutter(F.lit(v))) for v in (30.0, 1.5, 0.005)] == ["30s", "1.5s", "1/200s"]
    assert value(spark, photo.format_shoot_time(F.lit('"2023:01:15 10:30:00"'))) == "2023-01-15 10:30:00"
    assert value(spark, photo.format_shoot_time(F.lit("2023:01:15"))) == "2023-01-15"
    assert value(spark, photo.dms_to_decimal(F.lit(30.0), F.lit(30.0), F.lit(0.0), F.lit("s"))) == -30.5
    assert [value(spark, photo.format_bytes(F.lit(n))) for n in (0, 1024, 5 << 20, 3 << 30)] == ["0 KB", "1 KB", "5.0 MB", "3.0 GB"]
    assert value(spark, photo.saved_percent(F.lit(100.0), F.lit(18.0))) == "体积减少 82%"
    assert value(spark, photo.parse_aspect(F.lit("0:3"))) is None
    assert tuple(value(spark, photo.crop_rectangle(F.lit(1600), F.lit(900), F.lit(4), F.lit(3)))) == (200, 0, 1200, 900)
    assert value(spark, photo.crop_rectangle(F.lit(400), F.lit(300), F.lit(4), F.lit(3))) is None
    assert tuple(value(spark, photo.parse_bbox(F.lit("[1, 2, 30, 40]")))) == (1, 2, 30, 40)
    assert value(spark, photo.parse_bbox(F.lit("5,5,5,9"))) is None
    assert value(spark, photo.near_screen_ratio(F.lit(1920), F.lit(1080), [(16, 9)])) is True
    assert value(spark, photo.coverage(F.lit(3), F.lit(0))) == 0.0


def test_paths(spark):
    assert value(spark, paths.base_name(F.lit(r"C:\a\b.jpg"))) == "b.jpg"
    assert value(spark, paths.dir_name(F.lit("b.jpg"))) == ""
    assert value(spark, paths.is_under(F.lit(r"C:\ALB\a\x.jpg"), F.lit("c:/alb/A/"))) is True
    assert value(spark, paths.is_under(F.lit(r"C:\alb\ab\x.jpg"), F.lit(r"C:\alb\a"))) is False
    assert value(spark, paths.media_kind(F.lit("x.WEBP"))) == "animated"
    assert value(spark, paths.ancestors(F.lit("/a/b"))) == ["/a/b", "/a", ""]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0))
    assert value(spark, vectors.dot(a, b)) == 3.0
    assert value(spark, vectors.strict_dot(a, b)) < -3e38
    assert value(spark, vectors.normalised(a)) == [0.6, 0.8]
    assert value(spark, vectors.normalised(F.array(F.lit(0.0)))) == [0.0]
    assert value(spark, vectors.weighted_mean(a, F.lit(1), a, F.lit(3))) == [0.6, 0.8]
