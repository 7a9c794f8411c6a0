"""Listing records from stored directory pages.

A profile says where a page layout keeps each field. The per-page work in
Python is only to find those texts and attributes; ids, addresses, localities,
ratings and counts are cut out of them by column expressions afterwards.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from . import html_tree
from .html_tree import Element, Finder, Match, find_all, find_first, parse_html

# The extractor travels to the executors inside its task, so that they need no
# copy of this package.
for _module in (html_tree, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

RAW_RECORD = (
    "struct<name: string, href: string, path: string, phone_text: string, tel_href: string, "
    "website: string, street: string, locality: string, full_address: string, "
    "categories: array<string>, rating_text: string, star_class: string, reviews_text: string>"
)

Choice = tuple[Match, ...]  # any of these, in document order


@dataclass(frozen=True)
class Profile:
    """Where a page layout keeps its listings (fixed values of each layout).

    A tuple of choices is a fallback chain: the first choice that gives text
    wins. ``marker`` must occur in every page that has a listing.
    """

    country: str
    marker: str
    card: Choice
    name: Choice
    count: tuple[Choice, ...]
    per_page: int
    name_first_only: bool = False
    count_in_paragraph: bool = False
    count_after_of: bool = True
    phone: tuple[Choice, ...] = ()
    website: tuple[Choice, ...] = ()
    street: Choice = ()
    locality: Choice = ()
    full_address: Choice = ()
    categories: Choice = ()
    rating: Choice = ()
    stars: Choice = ()
    reviews: Choice = ()
    offsite_links: bool = False
    prefer_tel: bool = False
    tel_fallback: bool = False
    tel: Choice = (Match(starts=("href", "tel:")),)


def _cls(*names: str, tag: str = "", inside: Match | None = None) -> Match:
    return Match(tag=tag, classes=names, inside=inside)


def _like(part: str, tag: str = "") -> Match:
    return Match(tag=tag, contains=("class", part))


def _card_profile(country: str, per_page: int, stars: Choice) -> Profile:
    return Profile(
        country=country,
        marker="v-card",
        card=(_cls("v-card"),),
        name=(_cls("business-name", tag="a"),),
        count=((_cls("showing-count"), _cls("count-text")), (_like("showing"),)),
        per_page=per_page,
        count_in_paragraph=True,
        phone=((_cls("phones", "phone", "primary"),), (_cls("phone"),)),
        website=((_cls("website", tag="a"),), (_like("website", tag="a"),)),
        street=(_cls("street-address"),),
        locality=(_cls("locality"),),
        categories=(
            Match(tag="a", inside=_cls("categories")),
            Match(tag="span", inside=_cls("categories")),
        ),
        rating=(
            Match(tag="em", inside=_cls("result-rating")),
            Match(tag="em", inside=_cls("rating")),
        ),
        stars=stars,
        reviews=(_cls("count"), _cls("review-count")),
    )


CARD_US = _card_profile("US", 30, (_like("rating-stars"),))
CARD_AU = _card_profile("AU", 25, ())
LISTING_CA = Profile(
    country="CA",
    marker="listing__content",
    card=(_cls("listing__content"),),
    name=(_cls("listing__name--link"),),
    count=((_cls("resultCount"),),),
    per_page=20,
    count_after_of=False,
    phone=((_like("phone"),),),
    website=((Match(tag="a", inside=_like("website")), _like("website", tag="a")),),
    full_address=(_cls("listing__address--full"),),
    categories=(
        Match(tag="a", inside=_like("category")),
        Match(tag="span", inside=_like("category")),
    ),
    offsite_links=True,
    prefer_tel=True,
)
ITEM_NZ = Profile(
    country="NZ",
    marker="listing",
    card=(_cls("listing-item"), _cls("business-listing"), _like("listing-item")),
    name=(
        Match(tag="a", inside=Match(tag="h3")),
        Match(tag="a", inside=_cls("listing-name")),
        _like("name", tag="a"),
    ),
    name_first_only=True,
    tel_fallback=True,
    count=((_like("count"), _like("results")),),
    per_page=20,
    count_after_of=False,
    phone=((_like("phone"), Match(starts=("href", "tel:"))),),
    website=(
        (
            _like("website", tag="a"),
            Match(tag="a", equals=("rel", "nofollow"), starts=("href", "http")),
        ),
    ),
    locality=(_like("address"), _like("location")),
)
NAV_LINKS = Profile(
    country="",
    marker="<li",
    card=(Match(tag="li"),),
    name=(Match(tag="a"),),
    count=(),
    per_page=0,
)
PROFILES = {
    "card_us": CARD_US,
    "card_au": CARD_AU,
    "listing_ca": LISTING_CA,
    "item_nz": ITEM_NZ,
    "nav_links": NAV_LINKS,
}


def _count_text(root: list[Element], profile: Profile) -> str | None:
    shown = (e.text() for e in (find_first(root, choice) for choice in profile.count) if e is not None)
    found = next((text for text in shown if text), None)
    if found is None and profile.count_in_paragraph:
        for p in find_all(root, (Match(tag="p"),)):
            if re.search(r"\d+ of \d+", p.text()):
                return p.text()
    return found


class _Cards:
    """Reads the listings of pages of one layout; every field of a card is found in one pass over it."""

    def __init__(self, profile: Profile, own_host: str):
        self.profile = profile
        website = profile.website
        if profile.offsite_links:
            website = (*website, (Match("a", starts=("href", "http"), lacks=("href", own_host)),))
        one = lambda choice: (choice,) if choice else ()
        chains = {
            "name": (profile.name,), "path": ((Match(has="data-merchanturl"),),), "phone": profile.phone, "tel": (profile.tel,),
            "website": website, "street": one(profile.street), "locality": one(profile.locality), "whole": (profile.full_address,),
            "categories": (profile.categories,), "rating": one(profile.rating), "stars": one(profile.stars), "reviews": one(profile.reviews),
        }
        self.fields = Finder([m for chain in chains.values() for choice in chain for m in choice])
        self.chains = {name: tuple(self.fields.choice(c) for c in chain) for name, chain in chains.items()}
        self.cards = Finder(list(profile.card))
        self.card = self.cards.choice(profile.card)

    def read(self, elements: list[Element]) -> list[dict]:
        records = (self._record(card) for card in self.cards.find(elements).all(self.card))
        return [r for r in records if r]

    def _record(self, card: Element) -> dict | None:
        found, chains = self.fields.find(card.walk()), self.chains

        def text(field: str) -> str | None:
            for choice in chains[field]:
                element = found.first(choice)
                shown = element.text().strip() if element is not None else ""
                if shown:
                    return shown
            return None

        def attr(field: str, name: str) -> str | None:
            for choice in chains[field]:
                element = found.first(choice)
                value = element.attrs.get(name) if element is not None else None
                if value:
                    return value
            return None

        named = found.all(chains["name"][0])
        if self.profile.name_first_only:
            named = named[:1]
        name = "".join(e.text() for e in named).strip()
        if not name:
            return None
        whole = "".join(e.text() for e in found.all(chains["whole"][0])).strip()
        return {
            "name": name,
            "href": named[0].attrs.get("href"),
            "path": attr("path", "data-merchanturl"),
            "phone_text": text("phone"),
            "tel_href": attr("tel", "href"),
            "website": attr("website", "href"),
            "street": text("street"),
            "locality": text("locality"),
            "full_address": whole or None,
            "categories": [t for t in (e.text().strip() for e in found.all(chains["categories"][0])) if t],
            "rating_text": text("rating"),
            "star_class": attr("stars", "class"),
            "reviews_text": text("reviews"),
        }


LAYOUT = "_layout"
_FLAT = "_raw_"


def _own_host(base_url: str) -> str:
    return re.sub(r"^https?://(www\.)?", "", base_url).split(".")[0]


def _read_pages(pages: DataFrame, profiles: dict[str, tuple[Profile, str]], *carry: str, html: str) -> DataFrame:
    """``carry`` columns, layout, count text, records and error of each page.

    One pass for all layouts: a page is read by the profile that its
    ``_layout`` names, with the host that its site calls its own.
    """
    kept = pages.select(*carry, LAYOUT, F.col(html).alias(html))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.drop(html).schema]
    schema = ", ".join([*fields, "count_text string", f"records array<{RAW_RECORD}>", "error string"])

    def read_page(page: str, layout: str, readers: dict[str, _Cards]) -> tuple:
        try:
            reader, elements = readers[layout], parse_html(page).walk()
            return _count_text(elements, reader.profile), reader.read(elements), None
        except Exception as reason:  # a broken page must not end the job
            return None, [], f"{type(reason).__name__}: {reason}"[:500]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {layout: _Cards(*own) for layout, own in profiles.items()}
        for batch in batches:
            found = [read_page(page or "", layout, readers) for page, layout in zip(batch[html], batch[LAYOUT])]
            counts, records, errors = zip(*found) if found else ((), (), ())
            yield batch.drop(columns=[html]).assign(count_text=counts, records=records, error=errors)

    return kept.mapInPandas(extract, schema)


def _read_records(pages: DataFrame, profiles: dict[str, tuple[Profile, str]], *carry: str, html: str) -> DataFrame:
    """``carry`` columns, layout, position and raw record of each listing, where count texts are not needed.

    A row of texts per record: nested lists of records are slow to hand back.
    A page that cannot be read ends the job and is named by its ``carry`` values:
    without rows it would pass for a page without listings.
    """
    kept = pages.select(*carry, LAYOUT, F.col(html).alias(html))
    raw = StructType.fromDDL(RAW_RECORD[len("struct<") : -1])
    types = [f"{f.name} {f.dataType.simpleString()}" for f in kept.drop(html).schema]
    schema = ", ".join([*types, f"{_FLAT}position int", *(f"{_FLAT}{f.name} {f.dataType.simpleString()}" for f in raw)])
    fields = raw.fieldNames()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {layout: _Cards(*own) for layout, own in profiles.items()}
        for batch in batches:
            found: list[list[dict]] = []
            try:
                for page, layout in zip(batch[html], batch[LAYOUT]):
                    found.append(readers[layout].read(parse_html(page or "").walk()))
            except Exception as reason:
                which = ", ".join(f"{c} {batch[c].iat[len(found)]}"[:200] for c in (*carry, LAYOUT))
                raise RuntimeError(f"page cannot be read ({which}): {type(reason).__name__}: {reason}"[:2000]) from reason
            of = [i for i, records in enumerate(found) for _ in records]
            columns = {f"{_FLAT}position": [n for records in found for n in range(len(records))]}
            for f in fields:
                columns[f"{_FLAT}{f}"] = pd.Series([r[f] for records in found for r in records], dtype=object)
            yield batch.drop(columns=[html]).iloc[of].reset_index(drop=True).assign(**columns)

    record = F.struct(*[F.col(f"{_FLAT}{f}").alias(f) for f in fields]).alias("record")
    return kept.mapInPandas(extract, schema).select(*carry, LAYOUT, F.col(f"{_FLAT}position").alias("position"), record)


def _may_list(html: str, profile: Profile) -> Column:
    return F.lower(F.col(html)).contains(profile.marker.lower())


def raw_pages(
    pages: DataFrame,
    profile: Profile,
    own_host: str,
    *carry: str,
    html: str = "html",
    with_counts: bool = True,
) -> DataFrame:
    """``carry`` columns, count text and raw records of each page.

    When the count text is not needed, pages without the layout's marker,
    which have no listing, are left out before Python. A page that cannot be
    read keeps its row, without records and with the reason in ``error``.
    """
    read = pages if with_counts else pages.where(_may_list(html, profile))
    named = read.select(*carry, html, F.lit("").alias(LAYOUT))
    return _read_pages(named, {"": (profile, own_host)}, *carry, html=html).drop(LAYOUT)


def page_summary(raw: DataFrame, profile: Profile) -> DataFrame:
    """Records of each page with its announced total (its own size without one)."""
    return raw.withColumn("n_results", F.size("records")).withColumn(
        "total",
        F.coalesce(
            tx.result_total(F.col("count_text"), profile.count_after_of),
            F.col("n_results").cast("bigint"),
        ),
    )


def _fields(profile: Profile, base_url: str, grouped_counts: bool) -> dict[str, Column]:
    """Parsed fields of a raw ``record``; ``place`` is still one text."""
    r = lambda name: F.col(f"record.{name}")
    if profile.full_address:
        whole = r("full_address")
        comma = F.instr(whole, ",")
        # A leading comma does not split: the text before it must not be empty.
        street = F.when(comma > 1, tx.trim_all(F.substring_index(whole, ",", 1)))
        place = F.when(comma > 1, tx.trim_all(F.substr(whole, comma + 1))).otherwise(whole)
    else:
        street, place = r("street"), r("locality")
    if profile.prefer_tel:
        phone = tx.phone_from(r("tel_href"), r("phone_text"))
        listing_id = tx.id_from_document_path(r("path"))
        url = F.concat(F.lit(base_url), tx.null_if_empty(F.substring_index(r("path"), "?", 1)))
    else:
        phone = r("phone_text")
        if profile.tel_fallback:
            phone = F.coalesce(phone, F.regexp_replace(r("tel_href"), "^tel:", ""))
        listing_id = tx.id_from_href(r("href"))
        url = tx.absolute_url(r("href"), base_url)
    stars = tx.null_if_empty(F.regexp_extract(r("star_class"), r"s(\d+)", 1))
    return {
        "name": r("name"),
        "listing_id": listing_id,
        "listing_url": url,
        "phone": tx.null_if_empty(phone),
        "website": r("website"),
        "street": tx.null_if_empty(street),
        "place": place,
        "country": F.lit(profile.country),
        "categories": r("categories"),
        "category": F.get(r("categories"), F.lit(0)),
        "rating": F.coalesce(tx.parse_float(r("rating_text")), stars.cast("double") / 10),
        "review_count": tx.parse_count(r("reviews_text"), grouped_counts).try_cast("int"),
    }


def _records(raw: DataFrame, fields: dict[str, Column], *carry: str) -> DataFrame:
    rows = raw.withColumn("place", tx.parse_locality(fields["place"]))
    parsed = {c: F.col(f"place.{c}") for c in ("city", "state_region", "postcode")}
    named: list[Column] = []
    for name, value in fields.items():
        named += [v.alias(c) for c, v in parsed.items()] if name == "place" else [value.alias(name)]
    return rows.select(*carry, "position", *named)


def listing_records(
    raw: DataFrame, profile: Profile, base_url: str, *carry: str, grouped_counts: bool = True
) -> DataFrame:
    """Parsed listing records, one row each, in page order (``position``)."""
    rows = raw.select(*carry, F.posexplode("records").alias("position", "record"))
    return _records(rows, _fields(profile, base_url, grouped_counts), *carry)


def extract_listings(
    pages: DataFrame, profile: Profile, base_url: str, *carry: str
) -> DataFrame:
    """Parsed records of stored pages; ``base_url`` is the directory's own site."""
    named = pages.where(_may_list("html", profile)).select(*carry, "html", F.lit("").alias(LAYOUT))
    rows = _read_records(named, {"": (profile, _own_host(base_url))}, *carry, html="html")
    return _records(rows, _fields(profile, base_url, True), *carry)


@dataclass(frozen=True)
class Site:
    """A directory: its own address and the layout of its pages."""

    base_url: str
    profile: Profile

    @property
    def host(self) -> str:
        return re.sub(r"^https?://", "", self.base_url).split("/")[0].lower()


def extract_mixed(pages: DataFrame, sites: list[Site], *carry: str, url: str = "url", html: str = "html") -> DataFrame:
    """Parsed records of pages of several sites, read in one pass.

    The layout is chosen per row from the host of the page's address. Pages of
    other hosts, and those without their layout's marker, have no listings and
    do not go to Python.
    """
    by_host = {site.host: site for site in sites}
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    reads = F.lit(False)
    for name, site in by_host.items():
        reads = reads | ((host == name) & _may_list(html, site.profile))
    named = pages.withColumn(LAYOUT, host).where(reads).select(*carry, html, LAYOUT)
    rows = _read_records(named, {n: (s.profile, _own_host(s.base_url)) for n, s in by_host.items()}, *carry, html=html)
    chosen: dict[str, Column] = {}
    for name, site in by_host.items():
        for field, value in _fields(site.profile, site.base_url, True).items():
            so = F.col(LAYOUT) == name
            chosen[field] = F.when(so, value) if field not in chosen else chosen[field].when(so, value)
    return _records(rows, chosen, *carry)
