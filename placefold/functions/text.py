"""Text, number and URL expressions, all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that ECMAScript's String.prototype.trim removes.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Accepted spellings of booleans.
TRUE_WORDS = ("1", "true", "yes", "on")
FALSE_WORDS = ("0", "false", "no", "off")

# Countries with a directory profile.
SUPPORTED_CODES = ("us", "au", "ca")

INT_PREFIX = rf"^[{SPACE_CLASS}]*([+-]?[0-9]+)"
FLOAT_PREFIX = rf"^[{SPACE_CLASS}]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def nonempty(c: Column) -> Column:
    """True when the text is neither null nor ''."""
    return F.coalesce(c, F.lit("")) != ""


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean(c: Column) -> Column:
    """Trimmed text, with blank text as null."""
    return null_if_empty(trim_all(c))


def first_filled(*cols: Column) -> Column:
    """The first argument that is neither null nor ''."""
    return F.coalesce(*[null_if_empty(c) for c in cols])


def require_text(c: Column, message: str) -> Column:
    """Trimmed text; a blank one fails the job with ``message``."""
    return F.coalesce(clean(c), F.raise_error(F.lit(message)).cast("string"))


def parse_int(c: Column) -> Column:
    """Integer prefix of a text, null without one ('12 reviews' gives 12)."""
    return null_if_empty(F.regexp_extract(c, INT_PREFIX, 1)).try_cast("bigint")


def parse_float(c: Column) -> Column:
    """Decimal prefix of a text, null without one ('4.5 stars' gives 4.5)."""
    return null_if_empty(F.regexp_extract(c, FLOAT_PREFIX, 1)).try_cast("double")


def parse_count(c: Column, grouped: bool = True) -> Column:
    """Count inside optional parentheses; 0 when there is none.

    ``grouped`` reads '1,234' as 1234. Without it the digits before the comma
    count, which is what a plain integer-prefix parse gives.
    """
    digits = F.regexp_replace(c, "[(),]" if grouped else "[()]", "")
    return F.coalesce(parse_int(digits), F.lit(0).cast("bigint"))


def parse_bool(c: Column, fallback: bool | None = None) -> Column:
    word = F.lower(trim_all(c))
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(fallback).cast("boolean"))
    )


def result_total(c: Column, after_of: bool = True) -> Column:
    """Total in a result-count text such as 'Showing 1-30 of 1,234'."""
    pattern = r"(?i)of\s+([0-9,]+)" if after_of else r"([0-9,]+)"
    digits = F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "")
    return null_if_empty(digits).try_cast("bigint")


def parse_locality(c: Column, full_postcode: bool = False) -> Column:
    """'City, REGION POSTCODE' as struct<city, state_region, postcode>.

    Only the second word after the comma is the postcode unless
    ``full_postcode`` asks for everything behind the region.
    """
    comma = F.instr(c, ",")
    has_comma = comma > 0
    city = F.when(has_comma, trim_all(F.substring_index(c, ",", 1))).otherwise(null_if_empty(c))
    rest = F.when(has_comma, trim_all(F.substr(c, comma + 1)))
    words = F.split(rest, f"[{SPACE_CLASS}]+")
    region = null_if_empty(F.get(words, F.lit(0)))
    if full_postcode:
        behind = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
        postcode = null_if_empty(behind)
    else:
        postcode = null_if_empty(F.get(words, F.lit(1)))
    return F.struct(
        city.alias("city"), region.alias("state_region"), postcode.alias("postcode")
    )


def slugify(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['’]", "")
    return F.btrim(F.regexp_replace(bare, "[^a-z0-9]+", "-"), F.lit("-"))


def phone_from(tel_href: Column, shown: Column) -> Column:
    """Number of a ``tel:`` link, else the dialable characters of a text."""
    linked = trim_all(F.regexp_replace(tel_href, "^tel:", ""))
    dialable = trim_all(F.regexp_replace(shown, rf"[^0-9+()\-{SPACE_CLASS}]", ""))
    return null_if_empty(F.when(nonempty(tel_href), linked).otherwise(dialable))


def last_path_segment(path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda part: part != "")
    return F.try_element_at(segments, F.lit(-1))


def id_from_href(href: Column) -> Column:
    """Last path segment without its query string."""
    return null_if_empty(F.substring_index(last_path_segment(href), "?", 1))


def id_from_document_path(path: Column) -> Column:
    """Last segment of a path ending in '.html', query string dropped first."""
    bare = F.regexp_replace(F.substring_index(path, "?", 1), r"\.html$", "")
    return null_if_empty(last_path_segment(bare))


def absolute_url(href: Column, base: str) -> Column:
    filled = null_if_empty(href)
    return F.when(filled.startswith("http"), filled).otherwise(F.concat(F.lit(base), filled))


def subcategories(primary: Column, categories: Column) -> Column:
    """Distinct trimmed categories other than the primary, in first-seen order."""
    main = F.lower(trim_all(F.coalesce(primary, F.lit(""))))
    named = F.filter(
        F.transform(F.coalesce(categories, F.array().cast("array<string>")),
                    lambda v: trim_all(F.coalesce(v, F.lit("")))),
        lambda v: (v != "") & (F.lower(v) != main),
    )
    return F.array_distinct(named)


def location_parts(address: Column, display_name: Column) -> Column:
    """Search term and parts of a place record.

    ``address`` is a struct of city, town, village, suburb, county, state,
    state_code, iso_lvl4, postcode and country_code.
    """
    a = address.getField
    city = first_filled(a("city"), a("town"), a("village"), a("suburb"), a("county"))
    iso_part = F.get(F.split(a("iso_lvl4"), "-"), F.lit(1))
    state = first_filled(a("state_code"), iso_part, a("state"))
    postcode = null_if_empty(a("postcode"))
    country = F.upper(null_if_empty(a("country_code")))
    shown = null_if_empty(display_name)
    term = (
        F.when(city.isNotNull() & state.isNotNull(), F.concat_ws(", ", city, state))
        .when((country == "US") & postcode.isNotNull(), postcode)
        .when(city.isNotNull(), city)
        .otherwise(trim_all(F.substring_index(shown, ",", 2)))
    )
    return F.struct(
        term.alias("location_term"),
        city.alias("city"),
        state.alias("state"),
        postcode.alias("postcode"),
        country.alias("country_code"),
        shown.alias("display_name"),
    )


def is_coarse(city: Column, postcode: Column) -> Column:
    """A place too vague to search by name: neither city nor postcode."""
    return city.isNull() & postcode.isNull()


def supported_code(c: Column, codes: tuple[str, ...] = SUPPORTED_CODES) -> Column:
    return F.coalesce(F.lower(trim_all(c)).isin(*codes), F.lit(False))


def csv_field(c: Column) -> Column:
    """One CSV field, quoted only when it holds a quote, a comma or a newline."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)
