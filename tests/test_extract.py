"""Stored pages of each layout, by hand."""

import random
from datetime import datetime

import pytest
from pyspark.errors import PythonException

from placefold.operators.normalize import normalize_listings
from placefold.plans import scans
from placefold.sources import html_tree
from placefold.sources import listing_pages as lp
from placefold.sources.html_tree import Match, find_all, parse_html

US = """<html><body><div class="pagination"><span class="showing-count">Showing 1-30 of 1,234</span></div>
<div class="result"><div class="v-card">
 <h2><a class="business-name" href="/mip/joes-pizza-123?lid=9"><span>Joe's</span> Pizza &amp; Co</a></h2>
 <div class="phones phone primary"> (555) 010-2000 </div><div class="phone">other</div>
 <a class="track website" href="http://joes.example">Site</a>
 <div class="street-address">1 Main St</div><div class="locality">Springfield, IL 62701-1 USA</div>
 <div class="categories"><a>Pizza</a><span> Italian </span><a> </a></div>
 <div class="result-rating"><em>4.5 stars</em></div><span class="count">(1,234)</span>
</div></div>
<div class="v-card"><a class="business-name" href="https://elsewhere.example/x/y/">Plain</a>
 <div class="phone">555-1</div><a class="my-website-link" href="http://plain.example">w</a>
 <div class="locality">Nocomma</div>
 <div class="rating"><em>n/a</em></div><div class="rating-stars s35 big"></div></div>
<div class="v-card"><a class="business-name" href="/mip/none"> </a></div>
<div class="v-card"><a class="business-name">No link</a><br><img src=x><p>one<p>two</div>
</body></html>"""

CA = """<html><body><span class="resultCount">(11450 Result(s))</span>
<div class="listing__content"><a class="listing__name--link">Maple Dental</a>
 <div data-merchanturl="/bus/Ontario/Toronto/Maple-Dental/12345.html?what=d"></div>
 <a href="tel:416-555-0000 ">call</a><span class="mlr__phone">416 xxx</span>
 <ul><li class="mlr__item--website"><a href="/gourl/1">Site</a></li></ul>
 <span class="listing__address--full">123 Main St, Toronto, ON M5V 2H1</span>
 <div class="listing__category"><a>Dentists</a></div></div>
<div class="listing__content"><a class="listing__name--link">No Comma</a>
 <span class="my-phone">Tel: (416) 555-1111 now</span>
 <a href="https://www.directory.example/self">self</a><a href="http://offsite.example">out</a>
 <span class="listing__address--full">Toronto</span></div>
</body></html>"""

NZ = """<html><body><div class="result-count">1,050 found</div>
<div class="listing-item"><h3><a href="/b/kiwi-55?x=1">Kiwi Cafe</a></h3><h3><a href="/b/z">Second</a></h3>
 <a href="tel:0955">Ring</a><a rel="nofollow" href="http://kiwi.example">k</a>
 <div class="item-address">Auckland, AKL 1010</div></div>
<div class="business-listing"><div class="listing-name"><a href="/b/9">Bare</a></div><a href="tel:0977"></a></div>
</body></html>"""

SITE = "https://www.directory.example"


def records(spark, html, profile):
    pages = spark.createDataFrame([(1, html), (2, "<p>nothing here</p>"), (3, None)], "page_id int, html string")
    rows = lp.extract_listings(pages, profile, SITE, "page_id").orderBy("page_id", "position").collect()
    assert {r.page_id for r in rows} == {1}
    return rows


def test_card_us(spark):
    joe, plain, bare = records(spark, US, lp.CARD_US)
    assert joe.name == "Joe's Pizza & Co" and joe.listing_id == "joes-pizza-123"
    assert joe.listing_url == SITE + "/mip/joes-pizza-123?lid=9"
    assert (joe.phone, joe.website, joe.street) == ("(555) 010-2000", "http://joes.example", "1 Main St")
    assert (joe.city, joe.state_region, joe.postcode, joe.country) == ("Springfield", "IL", "62701-1", "US")
    assert (joe.categories, joe.category) == (["Pizza", "Italian"], "Pizza")
    assert (joe.rating, joe.review_count) == (4.5, 1234)
    assert (plain.listing_id, plain.listing_url) == ("y", "https://elsewhere.example/x/y/")
    assert (plain.phone, plain.website, plain.city) == ("555-1", "http://plain.example", "Nocomma")
    assert (plain.rating, plain.review_count, plain.category) == (3.5, 0, None)
    assert (bare.name, bare.listing_id, bare.listing_url, bare.rating) == ("No link", None, None, None)


def test_card_au_has_no_star_fallback(spark):
    joe, plain, _ = records(spark, US, lp.CARD_AU)
    assert (joe.country, joe.rating) == ("AU", 4.5) and plain.rating is None


def test_reviews_can_follow_a_plain_prefix_parse(spark):
    pages = spark.createDataFrame([(1, US)], "page_id int, html string")
    raw = lp.raw_pages(pages, lp.CARD_US, "directory", "page_id")
    rows = lp.listing_records(raw, lp.CARD_US, SITE, "page_id", grouped_counts=False).orderBy("position").collect()
    assert rows[0].review_count == 1


def test_listing_ca(spark):
    maple, other = records(spark, CA, lp.LISTING_CA)
    assert maple.listing_id == "12345" and maple.listing_url == SITE + "/bus/Ontario/Toronto/Maple-Dental/12345.html"
    assert (maple.phone, maple.website, maple.street) == ("416-555-0000", "/gourl/1", "123 Main St")
    assert (maple.city, maple.state_region, maple.postcode) == ("Toronto", "ON", "M5V")
    assert (maple.rating, maple.review_count, maple.categories) == (None, 0, ["Dentists"])
    assert (other.phone, other.website) == ("(416) 555-1111", "http://offsite.example")
    assert (other.street, other.city, other.listing_id, other.listing_url) == (None, "Toronto", None, None)


def test_item_nz(spark):
    kiwi, bare = records(spark, NZ, lp.ITEM_NZ)
    assert (kiwi.name, kiwi.listing_id, kiwi.phone) == ("Kiwi Cafe", "kiwi-55", "Ring")
    assert (kiwi.website, kiwi.city, kiwi.state_region, kiwi.postcode) == ("http://kiwi.example", "Auckland", "AKL", "1010")
    assert (bare.name, bare.phone, bare.website) == ("Bare", "0977", None)


@pytest.mark.parametrize(
    "html, profile, total, n",
    [
        (US, lp.CARD_US, 1234, 3),
        (CA, lp.LISTING_CA, 11450, 2),
        (NZ, lp.ITEM_NZ, 1050, 2),
        ('<p>Pages</p><p>1 of 77 results</p><div class="v-card"><a class="business-name">A</a></div>', lp.CARD_US, 77, 1),
        ('<div class="v-card"><a class="business-name">A</a></div>', lp.CARD_US, 1, 1),
        ("<p>empty</p>", lp.CARD_US, 0, 0),
        ('<b class="count-text">Results 0 of 57</b>', lp.CARD_AU, 57, 0),
    ],
)
def test_page_totals(spark, html, profile, total, n):
    pages = spark.createDataFrame([(html,)], "html string")
    row = lp.page_summary(lp.raw_pages(pages, profile, "directory"), profile).first()
    assert (row.total, row.n_results) == (total, n)


def test_extracted_records_normalise(spark):
    pages = spark.createDataFrame([(1, US)], "page_id int, html string")
    rows = normalize_listings(lp.extract_listings(pages, lp.CARD_US, SITE, "page_id"), "page_id").collect()
    keys = {r.name: r.dedupe_key for r in rows}
    assert keys == {"Joe's Pizza & Co": "joes-pizza-123", "Plain": "y", "No link": "No link::"}
    joe = next(r for r in rows if r.place_id == "joes-pizza-123")
    assert joe.address == "1 Main St, Springfield, IL, 62701-1" and joe.complete_address.country == "US"


def test_tree_closes_what_html_leaves_open():
    root = parse_html("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<p>y<script>var a='<b>';</script>")
    assert [e.text() for e in find_all(root.walk(), (Match("li"),))] == ["a", "bc", "c", "d"]
    assert [e.text() for e in find_all(root.walk(), (Match("p"),))][0] == "x"
    assert not find_all(root.walk(), (Match("b"),))
    assert parse_html("<div>a<script>x</script><style>y</style>b</div>").text() == "ab"


def _tree(node):
    texts = "".join(c for c in node.children if isinstance(c, str))
    return node.tag, node.attrs, texts, [_tree(c) for c in node.children if not isinstance(c, str)]


def test_plain_markup_gives_the_tree_of_the_standard_parser():
    parts = [
        "<div>", "</div>", '<p class="a b">', "<LI Class='x'>", "</li>", "text ", "a &amp; b", '<a href="/x?a=1&b=2&copy=3">', "</a>", "<br/>",
        "<img src=x>", '<script>var a="b";</script>', "<script>a<b</script>", "<style>x</style>", "<!-- c -->", "<!-- a-b -->", "<!doctype html>",
        "< b", "&", "<b", "<ul>", "<script/>", '<div a="1"b="2">', "</p >", "<title>x &lt; y</title>", "<![x[y]]>", "<?pi?>", "\n", "</", '<a b=">">',
    ]
    rng = random.Random(2)
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        standard = html_tree._Builder()
        standard.feed(page)
        standard.close()
        assert _tree(parse_html(page)) == _tree(standard.root), page


def test_plain_pages_do_without_the_standard_parser(monkeypatch):
    monkeypatch.setattr(html_tree._Builder, "feed", None)
    assert [len(_tree(parse_html(page))[3]) for page in (US.replace("src=x", ""), CA, NZ)] == [1, 1, 1]


def test_one_pass_finds_what_each_match_finds():
    for page, profile in ((US, lp.CARD_US), (CA, lp.LISTING_CA), (NZ, lp.ITEM_NZ)):
        elements = parse_html(page).walk()
        reader = lp._Cards(profile, "directory")
        found = reader.fields.find(elements)
        for match, number in reader.fields.numbers.items():
            assert found.all((number,)) == find_all(elements, (match,)), match


def test_records_come_back_flat(spark):
    pages = spark.createDataFrame([(1, US)], "page_id int, html string")
    plan = lp.extract_listings(pages, lp.CARD_US, SITE, "page_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "records" not in plan


def test_broken_pages_do_not_end_the_job(spark):
    deep = "<ul><li><a href='/x'>name</a>" + "<b>" * 100_000 + "end"
    ends = "<p>" * 20_000 + "</q>" * 20_000
    pages = spark.createDataFrame(
        [(1, deep), (2, "<![foo[bar]]><ul><li><a href='/y'>y</a></li></ul>"), (3, ends), (4, None),
         (5, "<UL><LI><A HREF='/z'>upper</A></LI></UL>")],
        "page_id int, html string",
    )
    rows = lp.extract_listings(pages, lp.PROFILES["nav_links"], "https://x.example", "page_id").collect()
    assert {(r.page_id, r.name) for r in rows} == {(1, "name" + "end"), (2, "y"), (5, "upper")} or {
        (r.page_id, r.name) for r in rows
    } == {(1, "name"), (2, "y"), (5, "upper")}
    raw = lp.raw_pages(pages, lp.PROFILES["nav_links"], "x", "page_id")
    assert raw.count() == 5 and raw.where("error IS NOT NULL").count() == 0


def test_overflowing_counts_are_null(spark):
    html = """<div class="result"><a class="business-name" href="/a"><span>Cafe</span></a><span class="count">(99999999999)</span></div>"""
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = lp.extract_listings(pages, lp.PROFILES["card_us"], "https://x.example", "page_id").collect()
    assert all(r.review_count is None for r in rows)


def test_pages_of_several_sites_in_one_pass(spark):
    """Layouts by host: the same records as one profile after the other; other hosts give none."""
    sites = [lp.Site("https://us.example", lp.CARD_US), lp.Site("https://www.ca.example", lp.LISTING_CA), lp.Site("https://nz.example/dir", lp.ITEM_NZ)]
    rows = [
        (1, "https://us.example/search?q=a", US), (2, "http://WWW.CA.example/x", CA), (3, "https://nz.example/dir/1", NZ),
        (4, "https://elsewhere.example/", US), (5, "https://us.example/", CA), (6, None, US), (7, "https://us.example/", None),
        (8, "not an address", NZ), (9, "https://us.example/2", US),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = lp.extract_mixed(pages, sites, "page_id")
    want = None
    for ids, site in (((1, 9), sites[0]), ((2,), sites[1]), ((3,), sites[2])):
        own = lp.extract_listings(pages.where(pages.page_id.isin(*ids)), site.profile, site.base_url, "page_id")
        want = own if want is None else want.unionByName(own)
    assert got.columns == want.columns and got.count() > 8
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def _no_memory_for(word):
    def parse(html):
        if word in html:
            raise MemoryError("none left")
        return parse_html(html)

    return parse


def _layout_pages(spark, *names):
    """A page of a US card for each name, as ``layout_pages`` has them; the third is of another site."""
    card = '<div class="v-card"><a class="business-name" href="/mip/{0}">{0}</a><div class="phone">{0}</div></div>'
    rows = [(i, "job", datetime(2026, 1, 1), f"https://{'other' if i == 3 else 'us'}.directory.example/{i}", card.format(n)) for i, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "page_id bigint, job_id string, observed_at timestamp_ntz, url string, html string")


def test_numbers_of_any_length_leave_a_page_whole(spark):
    """Python refuses to read them; as in browsers, one beyond the last character shows as U+FFFD."""
    long, zeros = "&#" + "9" * 5000, "&#" + "0" * 5000 + "65"
    for page in (f'<a href="{long};">{zeros};b{long}</a>', f'<a x=1 href="{long};">{zeros};b{long}</a>'):
        (link,) = parse_html(page).children
        assert (link.text(), link.attrs["href"]) == ("Ab\ufffd", "\ufffd")
    same = parse_html("".join(f"&#{n};" for n in ("0", "65", "065", "1114111", "1114112", "99999999", "9" * 600)))
    assert same.text() == "\ufffdAA\ufffd\ufffd\ufffd"
    pages = spark.createDataFrame([(1, f"<li><a href='/x'>x</a></li>{long};<li><a href='/y'>y</a></li>")], "page_id int, html string")
    assert [r.name for r in lp.extract_listings(pages, lp.NAV_LINKS, SITE, "page_id").collect()] == ["x", "y"]


def test_mixed_pages_are_whole_or_the_job_ends(spark, monkeypatch):
    """A page that cannot be read is no page without listings; one that is not read cannot fail."""
    monkeypatch.setattr(scans, "view", lambda *_: _layout_pages(spark, "a", "b &#" + "9" * 5000 + ";", "c"))
    assert {(r.page_id, r.name) for r in scans.mixed_pages(spark, "").collect()} == {(1, "a"), (2, "b \ufffd")}
    monkeypatch.setattr(lp, "parse_html", _no_memory_for(">c<"))
    assert scans.mixed_pages(spark, "").count() == 2
    monkeypatch.setattr(lp, "parse_html", _no_memory_for(">a<"))
    with pytest.raises(PythonException, match=r"page cannot be read \(page_id 1, .*us\.directory\.example\): MemoryError: none left"):
        scans.mixed_pages(spark, "").collect()


def test_coverage_is_of_all_pages_or_the_job_ends(spark, monkeypatch):
    """A page that cannot be read would be missing from the counts, which show nothing of it."""
    monkeypatch.setattr(scans, "view", lambda *_: _layout_pages(spark, "a", "b &#" + "9" * 5000 + ";", "c"))
    assert [tuple(r) for r in scans.pages_to_coverage(spark, "").collect()] == [("job", 2, 0, 2)]
    monkeypatch.setattr(lp, "parse_html", _no_memory_for(">a<"))
    with pytest.raises(PythonException, match=r"page cannot be read \(page_id 1, .*job_id job, .*\): MemoryError: none left"):
        scans.pages_to_coverage(spark, "").collect()
