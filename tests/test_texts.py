"""Text helpers on their awkward inputs."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from placefold.functions import text as tx
from placefold.functions.jsons import ADDRESS_DDL, decode, encode, setting
from placefold.functions.times import millis_between, ntz, round_places


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    "raw, city, region, postcode, whole",
    [
        (None, None, None, None, None),
        ("", None, None, None, None),
        ("Austin", "Austin", None, None, None),
        ("Austin, TX", "Austin", "TX", None, None),
        ("Austin, TX 78701", "Austin", "TX", "78701", "78701"),
        ("Toronto, ON M5V 2H1", "Toronto", "ON", "M5V", "M5V 2H1"),
        (", TX", "", "TX", None, None),
        ("Austin,", "Austin", None, None, None),
        ("A, B, C d", "A", "B,", "C", "C d"),
    ],
)
def test_locality(spark, raw, city, region, postcode, whole):
    assert tuple(value(spark, tx.parse_locality(text(raw)))) == (city, region, postcode)
    assert value(spark, tx.parse_locality(text(raw), full_postcode=True)).postcode == whole


def test_trim_knows_all_white_space(spark):
    assert value(spark, tx.trim_all(text(" 　﻿ a b \n"))) == "a b"
    assert value(spark, tx.clean(text("  "))) is None


@pytest.mark.parametrize(
    "raw, as_int, as_float",
    [("12abc", 12, 12.0), ("-3.7e1x", -3, -37.0), (" +4", 4, 4.0), (".5", None, 0.5), ("5.", 5, 5.0),
     ("abc", None, None), ("", None, None), (None, None, None), ("1,234", 1, 1.0), ("1e", 1, 1.0)],
)
def test_numbers(spark, raw, as_int, as_float):
    assert value(spark, tx.parse_int(text(raw))) == as_int
    assert value(spark, tx.parse_float(text(raw))) == as_float


def test_counts(spark):
    assert value(spark, tx.parse_count(text("(1,234)"))) == 1234
    assert value(spark, tx.parse_count(text("(1,234)"), grouped=False)) == 1
    assert value(spark, tx.parse_count(text("none"))) == 0


def test_slug_and_urls(spark):
    assert value(spark, tx.slugify(text("  O'Neil’s Bar, St. Kilda!"))) == "oneils-bar-st-kilda"
    assert value(spark, tx.slugify(text(None))) == ""
    assert value(spark, tx.id_from_href(text("/a/b/c-1/?q=2"))) is None
    assert value(spark, tx.id_from_href(text("/a/b/c-1?q=/2"))) == "2"
    assert value(spark, tx.id_from_document_path(text("/bus/x/77.html?a=/b"))) == "77"
    assert value(spark, tx.absolute_url(text("x"), "https://s.example/")) == "https://s.example/x"
    assert value(spark, tx.absolute_url(text(""), "https://s.example/")) is None


def test_phone(spark):
    assert value(spark, tx.phone_from(text("tel:+1 555"), text("ignored"))) == "+1 555"
    assert value(spark, tx.phone_from(text(""), text("Ph. (02) 9-1 ext"))) == "(02) 9-1"
    assert value(spark, tx.phone_from(text(None), text("call"))) is None


def test_subcategories_keep_order_and_case(spark):
    cats = F.array(*[text(v) for v in ("Food ", "bar", "Bar", None, "", "FOOD", "bar", "Cafe")])
    assert value(spark, tx.subcategories(text(" food"), cats)) == ["bar", "Bar", "Cafe"]
    assert value(spark, tx.subcategories(text(None), F.lit(None).cast("array<string>"))) == []


PLACE = "city town village suburb county state state_code iso_lvl4 postcode country_code".split()


@pytest.mark.parametrize(
    "fields, shown, term",
    [
        ({"town": "Bath", "state_code": "ENG"}, None, "Bath, ENG"),
        ({"city": "Perth", "iso_lvl4": "AU-WA", "state": "Western Australia"}, None, "Perth, WA"),
        ({"city": "Perth", "iso_lvl4": "AU", "state": "Western Australia"}, None, "Perth, Western Australia"),
        ({"postcode": "10001", "country_code": "us"}, "x", "10001"),
        ({"county": "Kent", "postcode": "10001", "country_code": "gb"}, "x", "Kent"),
        ({"postcode": "10001", "country_code": "gb"}, " A , B , C", "A , B"),
        ({}, "", None),
    ],
)
def test_location_term(spark, fields, shown, term):
    address = F.struct(*[text(fields.get(n)).alias(n) for n in PLACE])
    assert value(spark, tx.location_parts(address, text(shown))).location_term == term


def test_required_keyword(spark):
    assert value(spark, tx.require_text(text(" kw "), "keyword is required")) == "kw"
    with pytest.raises(Exception, match="keyword is required"):
        value(spark, tx.require_text(text("  "), "keyword is required"))


def test_json(spark):
    assert value(spark, decode(text("[broken"), "array<string>")) is None
    assert value(spark, decode(text("{broken"), ADDRESS_DDL)) is None
    assert value(spark, decode(text('{"street":"s","x":1}'), ADDRESS_DDL)).street == "s"
    assert value(spark, decode(text("null"), ADDRESS_DDL)) is None
    assert value(spark, setting(text("oops"), "limit", "int", 7)) == 7
    assert value(spark, setting(text('{"limit": 3}'), "limit", "int", 7)) == 3
    assert value(spark, encode(F.struct(F.lit(None).cast("string").alias("a")), "null")) == '{"a":null}'
    assert value(spark, encode(F.lit(None).cast("array<string>"), "[]")) == "[]"


def test_rounding_follows_the_binary_value(spark):
    assert value(spark, round_places(F.lit(1.005))) == 1.0
    assert value(spark, round_places(F.lit(33.125))) == 33.13
    for number in (1.115, 2.675, 1.255, 8.345, 0.615, -1.115, 10.075, 1e9 + 0.125, 0.0, 4.999999):
        exact = Decimal(number).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert value(spark, round_places(F.lit(number))) == float(exact), number


def test_millis_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        span = millis_between(ntz("2024-03-09 12:00:00"), ntz("2024-03-11 12:00:00.25"))
        assert value(spark, span) == 2 * 86400000 + 250
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "raw, line", [('a"b', '"a""b"'), ("a,b", '"a,b"'), ("a\nb", '"a\nb"'), ("a\rb", "a\rb"), (None, ""), (" a ", " a ")]
)
def test_csv_field(spark, raw, line):
    assert value(spark, tx.csv_field(text(raw))) == line


def test_supported_codes(spark):
    assert value(spark, tx.supported_code(text(" Us")))
    assert not value(spark, tx.supported_code(text("nz"))) and not value(spark, tx.supported_code(text(None)))
