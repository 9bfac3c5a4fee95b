"""HTML pages to rows: embedded JSON-LD and patterns in SQL functions, grids by the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONDITION_WORDS, META_AVAILABILITY, SCHEMA_AVAILABILITY
from ..functions.basics import group, lookup
from ..functions.gtin import normalize_all
from ..functions.money import dollars_to_cents, parse_price_cents
from ..functions.text import pack_count

OFFER = "struct<price:string,lowPrice:string,url:string,availability:string,itemCondition:string,priceCurrency:string>"
ITEM = f"struct<`@type`:string,name:string,sku:string,mpn:string,color:string,gtin8:string,gtin12:string,gtin13:string,gtin14:string,productGroupID:string,url:string,brand:struct<name:string>,offers:string,hasVariant:array<struct<sku:string,name:string,color:string,gtin8:string,gtin12:string,gtin13:string,offers:string>>,itemListElement:array<struct<item:struct<name:string,url:string,mpn:string,offers:{OFFER}>>>>"


def json_ld(body: Column) -> Column:
    """Array of the page's JSON-LD objects; arrays and @graph lists are flattened, broken ones dropped."""
    scripts = F.regexp_extract_all(body, F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    one = F.transform(scripts, lambda s: F.when(F.ltrim(s).startswith("["), s).otherwise(F.coalesce(F.get_json_object(s, "$.@graph"), F.concat(F.lit("["), s, F.lit("]")))))
    return F.flatten(F.transform(one, lambda s: F.coalesce(F.filter(F.from_json(s, f"array<{ITEM}>"), lambda x: x["@type"].isNotNull()), F.array().cast(f"array<{ITEM}>"))))


def offers_of(text: Column) -> Column:
    """The offers in the JSON text of an ``offers`` field, which is one object or a list of them."""
    listed = F.from_json(F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{OFFER}>")
    return F.coalesce(F.filter(listed, lambda o: o.isNotNull()), F.array().cast(f"array<{OFFER}>"))


def _availability(url: Column) -> Column:
    lowered = {k.lower(): v for k, v in SCHEMA_AVAILABILITY.items()}
    return lookup(lowered, F.lower(F.trim(F.element_at(F.split(url, "/"), -1))), F.lit("UNKNOWN"))


def _cents(offer: Column) -> Column:
    return dollars_to_cents(F.coalesce(offer["price"], offer["lowPrice"]).try_cast("double"))


def json_ld_offers(pages: DataFrame) -> DataFrame:
    """One row per offer of Product and ProductGroup objects of pages (url, body).

    A product's offers may be one or many (each a row), a group's variants have one each. A product
    without offers is a row without a price. Such pages make no claims.
    """
    objects = pages.select("url", F.explode(json_ld(F.col("body"))).alias("o"))
    own = F.array(F.struct(F.col("o.sku").alias("sku"), F.col("o.name").alias("name"), F.col("o.color").alias("color"), F.col("o.gtin8").alias("gtin8"), F.col("o.gtin12").alias("gtin12"), F.col("o.gtin13").alias("gtin13"), F.col("o.offers").alias("offers")))
    single = F.col("o.@type") == "Product"
    rows = objects.where(F.col("o.@type").isin("Product", "ProductGroup")).select(
        "url", F.col("o.brand.name").alias("brand"), F.col("o.name").alias("name"), single.alias("single"), F.explode(F.when(single, own).otherwise(F.col("o.hasVariant"))).alias("v")
    )
    # A variant's list of offers is none that its page means.
    text = F.when(F.col("single") | ~F.ltrim(F.col("v.offers")).startswith("["), F.col("v.offers"))
    each = rows.select("*", F.explode_outer(offers_of(text)).alias("f"))
    used = F.lower(F.trim(F.element_at(F.split(F.col("f.itemCondition"), "/"), -1))) == "usedcondition"
    return each.select(
        "url", "brand", F.col("v.sku").alias("sku"), F.coalesce("v.name", "name").alias("title"), F.col("v.color").alias("color"),
        _cents(F.col("f")).alias("price_cents"), _availability(F.col("f.availability")).alias("availability"),
        normalize_all(F.array("v.gtin8", "v.gtin12", "v.gtin13")).alias("gtin14"),
        F.when(used, "USED_UNGRADED").otherwise("NEW").alias("condition"), F.lit("FIRST_PARTY").alias("seller_type"), F.lit(None).cast("bigint").alias("claimed_cents"), F.lit(False).alias("on_clearance"), pack_count(F.col("name")).alias("unit_count"),
    )


def json_ld_list_rows(pages: DataFrame) -> DataFrame:
    """Discovered rows of ItemList objects; their prices are the least of a range."""
    objects = pages.select("url", F.explode(json_ld(F.col("body"))).alias("o")).where(F.col("o.@type") == "ItemList")
    rows = objects.select("url", F.explode("o.itemListElement").alias("e"))
    return rows.select("url", F.col("e.item.mpn").alias("product_code"), F.col("e.item.name").alias("title"), F.col("e.item.url").alias("product_url"), _cents(F.col("e.item.offers")).alias("price_cents"), F.lit(True).alias("price_is_range"))


def meta_page(pages: DataFrame) -> DataFrame:
    """Product facts of pages that mark prices with data attributes (url, body); a recommended price beats a former one."""
    body = F.col("body")
    price = parse_price_cents(group(body, r'data-product-price-without-tax\s+class="price price--withoutTax"[^>]*>([^<]*)<'))
    listed = parse_price_cents(group(body, r'data-product-rrp-price-without-tax\s+class="price price--rrp">\s*([^<]*)<'))
    was = parse_price_cents(group(body, r'data-product-non-sale-price-without-tax\s+class="price price--non-sale">\s*([^<]*)<'))
    claimed = F.coalesce(listed, was)
    stock = F.lower(F.trim(group(body, r'og:availability"\s+content="([^"]*)"')))
    return pages.select(
        "url",
        group(body, r'name="product_id" value="(\d+)"').alias("product_code"),
        clean(group(body, "data-product-sku>([^<]*)<")).alias("sku"),
        normalize_all(F.array(clean(group(body, "data-product-upc>([^<]*)<")))).alias("gtin14"),
        clean(group(body, r'(?s)<h1[^>]*class="productView-title"[^>]*>(.*?)</h1>')).alias("title"),
        clean(group(body, r'(?s)class="productView-brand[^"]*"[^>]*>\s*<a[^>]*>\s*<span>(.*?)</span>')).alias("brand"),
        price.alias("price_cents"),
        F.when(claimed > price, claimed).alias("claimed_cents"),
        F.when((claimed > price) & listed.isNotNull(), "MSRP").when(claimed > price, "WAS").alias("claimed_kind"),
        lookup(META_AVAILABILITY, stock, F.lit("UNKNOWN")).alias("availability"),
    )


def clean(text: Column) -> Column:
    """White space of any kind collapsed and cut from the ends; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def stock_cell(text: Column) -> Column:
    """Struct (quantity, is_floor, availability) of a stock cell: a number, n+, M/D or n Days."""
    t = F.trim(text)
    quantity = group(t, r"^(\d+)\+?$").try_cast("int")
    later = F.coalesce(t.rlike(r"^\d{1,2}/\d{1,2}$") | t.rlike(r"(?i)^\d+\s*Days?$"), F.lit(False))
    state = F.when(quantity > 0, "IN_STOCK").when(later, "BACKORDER").when(t == "0", "OUT_OF_STOCK").otherwise("UNKNOWN")
    return F.struct(quantity.alias("quantity"), F.coalesce(t.endswith("+") & quantity.isNotNull(), F.lit(False)).alias("is_floor"), state.alias("availability"))


def title_of(body: Column) -> Column:
    """The page's title with white space collapsed; null if blank or missing."""
    raw = group(body, r"(?is)<title[^>]*>(.*?)</title>")
    return clean(raw)


def links_of(body: Column) -> Column:
    """Distinct link targets in order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1)))


@dataclass(frozen=True)
class Mark:
    """Where a field stands inside a cell: tag, and a class or ``attribute=value``; its text, without
    the elements of the classes in ``skip``, or one of its attributes. The first one counts."""

    tag: str
    at: str
    attribute: str | None = None
    skip: frozenset[str] = frozenset()

    def fits(self, tag: str, attrs: dict[str, str | None]) -> bool:
        key, equals, value = self.at.partition("=")
        if tag != self.tag:
            return False
        return attrs.get(key) == value if equals else self.at in (attrs.get("class") or "").split()


@dataclass(frozen=True)
class Family:
    """A kind of page: its repeated cell, the fields in it, and the classes of names and values of a
    list of properties (given as ``spec_`` fields)."""

    cell: Mark
    fields: dict[str, Mark]
    named: tuple[str, str] | None = None


class _Cells(HTMLParser):
    """Collects the cells of a page as maps: fields, the cell's data attributes, properties."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, family: Family):
        super().__init__(convert_charrefs=True)
        self.family = family
        self.marks: dict[str, list[tuple[str, Mark]]] = {}
        for name, mark in family.fields.items():
            self.marks.setdefault(mark.tag, []).append((name, mark))
        self.skipped = frozenset().union(*(mark.skip for mark in family.fields.values()))
        self.rows: list[dict[str, str]] = []
        self.depth = self.inside = 0
        #: Open fields (depth, name) and elements that they skip.
        self.open: list[tuple[int, str]] = []
        self.muted: list[tuple[int, str]] = []
        self.text: dict[str, list[str]] = {}
        self.name = ""

    def handle_starttag(self, tag, attrs):
        self.start(tag, self.found(tag, dict(attrs)) if attrs else None)

    def found(self, tag: str, a: dict[str, str | None]) -> tuple | None:
        """What a tag is: the attributes of a cell, its classes, the fields and property parts that begin with it."""
        classes = frozenset((a.get("class") or "").split())
        fields = [(name, mark.attribute, a.get(mark.attribute or "")) for name, mark in self.marks.get(tag, ()) if mark.fits(tag, a)]
        parts = [name for name, css in zip(("\0name", "\0value"), self.family.named or ()) if css in classes]
        cell = {f"cell_{k}": v or "" for k, v in a.items() if k.startswith("data-") and (v or k == "data-closeout-item")} if self.family.cell.fits(tag, a) else None
        # What mutes nothing, marks nothing and begins nothing is like a tag without attributes.
        return (cell, classes, fields, parts) if cell is not None or fields or parts or not self.skipped.isdisjoint(classes) else None

    def start(self, tag: str, found: tuple | None) -> None:
        void = tag in self.VOID
        if not void:
            self.depth += 1
        if found is None:
            return
        cell, classes, fields, parts = found
        if cell is not None:
            self.rows.append(dict(cell))
            self.inside, self.open, self.muted, self.text = self.depth, [], [], {}
        if not self.inside:
            return
        if self.open:
            self.muted += [(self.depth, name) for _, name in self.open if name in self.family.fields and classes & self.family.fields[name].skip]
        for name, attribute, value in fields:
            if attribute is not None:
                if value:
                    self.rows[-1].setdefault(name, value)
            elif not void and name not in self.text:
                self.open.append((self.depth, name))
                self.text[name] = []
        for name in parts:
            if not void:
                self.open.append((self.depth, name))
                self.text[name] = []

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        if self.open and self.open[-1][0] >= self.depth:
            for depth, name in self.open:
                if depth >= self.depth:
                    self._close(name)
            self.open = [o for o in self.open if o[0] < self.depth]
        if self.muted:
            self.muted = [m for m in self.muted if m[0] < self.depth]
        if self.inside == self.depth:
            self.inside = 0
        self.depth -= 1

    def _close(self, name: str) -> None:
        found = re.sub(r"\s+", " ", "".join(self.text[name])).strip()
        if name == "\0name":
            self.name = found.rstrip(":").strip()
        elif name == "\0value":
            self.rows[-1].setdefault(f"spec_{self.name}", found)
        elif found:
            self.rows[-1].setdefault(name, found)

    def handle_data(self, data):
        if self.open:
            silent = {name for _, name in self.muted}
            for _, name in self.open:
                if name not in silent:
                    self.text[name].append(data)


#: A tag that stands in plain markup, with the text after it: quoted attributes, no references in them.
_TAG = re.compile(r"""(<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_][-a-zA-Z0-9_:.]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'))?)*)[ \t\n\r\f]*(/?)>([^<]*))""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*)(?:=(?:"([^"]*)"|'([^']*)'))?""")
_DOCTYPE = re.compile(r"[^<]*<!DOCTYPE [^<>\[\]\"']*>[^<]*|[^<]*", re.I)
#: Elements whose text is no markup, or is read by rules of its own.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext svg math".split())


def _plain_tags(body: str) -> list[tuple[str, ...]] | None:
    """The tags (whole, slash, name, attributes, closing slash, text after) of a body that is plain markup from
    end to end, and so reads the same in any parser; else None."""
    at = _DOCTYPE.match(body).end()
    tags = _TAG.findall(body, at)
    # Nothing lies between the tags if they are as long as the body.
    if at + sum([len(t[0]) for t in tags]) != len(body) or not _RAW.isdisjoint({t[2].lower() for t in tags}):
        return None
    return tags


def cells_of(body: str, family: Family) -> list[dict[str, str]]:
    """The cells of a page. Plain markup is taken tag by tag, any other goes through the standard parser."""
    parser = _Cells(family)
    tags = _plain_tags(body)
    if tags is None:
        parser.feed(body)
        parser.close()
        return parser.rows
    known: dict[tuple[str, str], tuple | None] = {}
    void = parser.VOID
    for _, slash, tag, attributes, single, text in tags:
        tag = tag.lower()
        if slash:
            if parser.open or parser.inside == parser.depth or tag in void:
                parser.handle_endtag(tag)
            else:
                parser.depth -= 1
        else:
            found = None
            if attributes:
                key = tag, attributes
                if key in known:
                    found = known[key]
                else:
                    found = known[key] = parser.found(tag, {n.lower(): a or b for n, a, b in _ATTRIBUTE.findall(attributes)})
            if found is None:
                if tag not in void:
                    parser.depth += 1
            else:
                parser.start(tag, found)
            if single:
                parser.handle_endtag(tag)
        if text and parser.open:
            parser.handle_data(unescape(text) if "&" in text else text)
    return parser.rows


_skip = frozenset
#: How the shops' pages mark their cells and fields.
GRIDS = {
    "catalogue_cells": Family(
        Mark("div", "cattable-wrap-cell"),
        {
            "title": Mark("h3", "cattable-wrap-cell-info-name"),
            "href": Mark("a", "cattable-wrap-cell-info", "href"),
            "price": Mark("div", "cattable-wrap-cell-info-price", skip=_skip({"cattable-wrap-cell-info-price-msrp"})),
            "was": Mark("span", "cattable-wrap-cell-info-price-msrp"),
        },
    ),
    "product_items": Family(
        Mark("div", "product-item"),
        {
            "title": Mark("a", "name"),
            "href": Mark("a", "name", "href"),
            "price": Mark("div", "displayed-price", skip=_skip({"price-before", "sr-only"})),
            "was": Mark("span", "price-strikethrough"),
        },
    ),
    "badge_tiles": Family(
        Mark("div", "product-tile"),
        {
            "code": Mark("a", "anchor-container", "pid"),
            "title": Mark("div", "product-name"),
            "href": Mark("a", "anchor-container", "href"),
            "badge": Mark("div", "image-banner"),
            "price": Mark("span", "regular-price", skip=_skip({"slash"})),
            "was": Mark("span", "strike"),
        },
    ),
    "product_cards": Family(
        Mark("div", "product-card-wrapper"),
        {
            "code": Mark("div", "yotpo", "data-product-id"),
            "title": Mark("h2", "product-title"),
            "href": Mark("a", "product-card", "href"),
            "price": Mark("span", "current-price"),
            "from": Mark("span", "fromtag"),
        },
    ),
    "ordering_rows": Family(
        Mark("tr", "js-ordering-subproduct"),
        {
            "label": Mark("strong", "js-ordering-name"),
            "price": Mark("span", "js-ordering-price"),
            "was": Mark("span", "is-crossout"),
            "stock": Mark("span", "js-ordering-available"),
            "gtin": Mark("meta", "itemprop=gtin13", "content"),
        },
        ("js-ordering-style-name", "js-ordering-style-item-name"),
    ),
    "spec_cards": Family(
        Mark("div", "variant-container"),
        {"sku": Mark("div", "rod-sku"), "price": Mark("span", "regular-price-tag"), "stock": Mark("span", "selected", "data-inventory")},
        ("rod-spec-title-mobile", "rod-spec-value-mobile"),
    ),
}


#: Cells that a task sends on at once.
CELLS = 2000


def grid_cells(pages: DataFrame, family: str, *kept: str) -> DataFrame:
    """(url, ord, cell map) for every grid cell of pages (url, body), with string columns ``kept`` of the page."""
    wanted, names = GRIDS[family], ["url", *kept]

    kinds = [*[pa.string()] * len(names), pa.int32(), pa.map_(pa.string(), pa.string())]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], [*names, "ord", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pages are taken out of a batch one by one and cells sent on by the thousand, so a task holds few of either.
        rows: list[tuple] = []
        for batch in batches:
            for body, *page in zip(*batch.columns):
                page = [value.as_py() for value in page]
                rows += [(*page, k, list(cell.items())) for k, cell in enumerate(cells_of(body.as_py() or "", wanted))]
                if len(rows) >= CELLS:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    schema = ", ".join(f"`{name}` string" for name in names)
    return pages.select("body", *names).mapInArrow(run, f"{schema}, ord int, cell map<string,string>")


def _field(name: str) -> Column:
    return F.try_element_at("cell", F.lit(name))


def _least_cents(text: Column) -> Column:
    """Cents of a price, or of the least of a range ``$a - $b``."""
    return parse_price_cents(F.trim(F.regexp_replace(F.get(F.split(text, " - "), F.lit(0)), r"\$\s+", "\\$")))


def absolute(page: Column, href: Column) -> Column:
    """A link of a page: one from the root gets the page's scheme and host, others stay."""
    origin = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    return F.when(href.startswith("/") & ~href.startswith("//"), F.concat(origin, href)).otherwise(href)


def grid_rows(pages: DataFrame, family: str, used: bool = False) -> DataFrame:
    """Discovered rows of a grid: code, title, link, price (the least of a range), claim and its kind.

    A claim marked with a trailing star is a recommended price. Badge grids keep only cells on
    clearance or on sale that have a title and a former price above the present one. A ``From`` before
    a price makes it a range. Grids of used goods hint at the condition.
    """
    price, was = _least_cents(_field("price")), _least_cents(F.regexp_replace(_field("was"), r"\s*\*$", ""))
    rows = grid_cells(pages, family).select(
        "url", "ord",
        F.coalesce(_field("code"), _field("cell_data-code"), _field("cell_data-product-code")).alias("product_code"),
        _field("title").alias("title"),
        absolute(F.col("url"), F.regexp_replace(F.trim(_field("href")), "(?i)%0D$", "")).alias("product_url"),
        price.alias("price_cents"),
        F.when(was > price, was).alias("claimed_cents"),
        F.when(was > price, F.when(F.rtrim(_field("was")).endswith("*"), "MSRP").otherwise("WAS")).alias("claimed_kind"),
        (F.coalesce(_field("price").contains(" - "), F.lit(False)) | _field("from").isNotNull()).alias("price_is_range"),
        F.lit("USED_UNGRADED" if used else None).cast("string").alias("condition_hint"), F.lower(F.trim(_field("badge"))).alias("badge"),
    )
    if family == "badge_tiles":
        # A tile without a link stands for its page.
        rows = rows.withColumn("product_url", F.coalesce("product_url", "url"))
        rows = rows.where(F.col("badge").isin("clearance", "on sale") & F.col("claimed_cents").isNotNull() & (F.trim("title") != "") & F.col("product_url").isNotNull())
    return rows.drop("badge")


def spec_offers(pages: DataFrame, family: str = "spec_cards") -> DataFrame:
    """Offers of product pages with a cell for each variant: properties as an attribute map, stock
    from the cell, title and brand from the page's heading.

    Ordering rows may be used goods, by their number or by the words of the page's description, which
    then give condition and recommended price; else a row on closeout claims its list price.
    """
    specs = F.map_filter("cell", lambda k, v: k.startswith("spec_"))
    stock = stock_cell(_field("stock"))
    price, was = _least_cents(_field("price")), _least_cents(_field("was"))
    body = F.col("body")
    headed = pages.select(
        "url", "body",
        clean(F.regexp_replace(group(body, r"(?is)<h1[^>]*>(.*?)</h1>"), "<[^>]+>", " ")).alias("title"),
        clean(F.coalesce(group(body, r'(?is)class="productView-brand[^"]*"[^>]*>\s*<a[^>]*>\s*<span>(.*?)</span>'), group(body, r'itemprop="brand" content="([^"]*)"'))).alias("brand"),
        group(body, r'data-gtm_detail_id="([^"]*)"').alias("code"),
        group(body, r'(?is)class="[^"]*product-description[^"]*"[^>]*>(.*?)</div>').alias("told"),
    )
    cells = grid_cells(headed, family, "title", "brand", "code", "told")
    words = used_wording(F.regexp_replace(F.col("told"), "<[^>]+>", " "))
    rows = family == "ordering_rows"
    is_used = F.lit(rows) & (words["wording"].isNotNull() | F.coalesce(F.upper(_field("cell_data-code")).startswith("USED"), F.lit(False)))
    closeout, listed = F.lit(rows) & F.map_contains_key("cell", "cell_data-closeout-item"), parse_price_cents(F.trim(_field("cell_data-list-price")))
    claim = F.when(is_used, F.coalesce(words["msrp_cents"], listed)).when(closeout & listed.isNotNull(), listed).when(was > price, was)
    kind = F.when(is_used & words["msrp_cents"].isNotNull(), "MSRP").when(claim.isNotNull(), "WAS")
    return cells.select(
        "url", "ord", "title", "brand",
        F.coalesce("code", _field("cell_data-product-id"), _field("cell_data-code")).alias("product_code"),
        F.coalesce(F.regexp_replace(_field("sku"), "^#", ""), _field("cell_data-code")).alias("sku"),
        F.coalesce(_field("label"), _field("spec_Model")).alias("variant_label"),
        price.alias("price_cents"), claim.alias("claimed_cents"), kind.alias("claimed_kind"), (is_used | closeout).alias("on_clearance"),
        F.when(is_used, lookup(CONDITION_WORDS, F.lower(words["wording"]), F.lit("USED_UNGRADED"))).otherwise("NEW").alias("condition"), F.when(is_used, words["wording"]).alias("condition_raw"),
        F.when(is_used, "RETAILER_RESALE").otherwise("FIRST_PARTY").alias("seller_type"),
        stock["quantity"].alias("quantity"), stock["is_floor"].alias("quantity_is_floor"), stock["availability"].alias("availability"),
        F.transform_keys(specs, lambda k, v: F.substring(k, 6, 1000)).alias("attributes"),
        normalize_all(F.array(_field("gtin"))).alias("gtin14"),
    )


EMBEDDED = "struct<id:bigint,title:string,vendor:string,options:array<string>,variants:array<struct<id:bigint,sku:string,title:string,options:array<string>,price:bigint,available:boolean,barcode:string>>>"
PROPERTIES = "array<struct<identifier:string,valueReference:struct<value:string>>>"


def embedded_product_offers(pages: DataFrame) -> DataFrame:
    """Offers of pages that carry their product as JSON in a script named ProductJson. The barcode is
    the variant's, or that of the page's JSON-LD property with the variant's sku. Such pages make no
    claims."""
    script = group(F.col("body"), r'(?s)<script[^>]*id="ProductJson-[^"]*"[^>]*>(.*?)</script>')
    scripts = F.regexp_extract_all("body", F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    listed = F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(F.get_json_object(s, "$.additionalProperty"), PROPERTIES), F.array().cast(PROPERTIES))))
    rows = pages.select("url", F.from_json(script, EMBEDDED).alias("p"), listed.alias("codes")).where("p.variants is not null").select("url", "p", "codes", F.explode("p.variants").alias("v"))
    code = F.get(F.filter("codes", lambda e: e["identifier"] == F.col("v.sku")), F.lit(0))["valueReference"]["value"]
    pairs = F.filter(F.arrays_zip(F.col("p.options").alias("n"), F.col("v.options").alias("x")), lambda e: e["n"].isNotNull() & e["x"].isNotNull())
    return rows.select(
        "url", F.col("p.id").cast("string").alias("product_code"), F.coalesce(F.nullif(F.col("v.sku"), F.lit("")), F.col("v.id").cast("string")).alias("sku"), F.concat_ws(" - ", "p.title", "v.title").alias("title"), F.col("p.vendor").alias("brand"),
        F.when(F.col("v.price") > 0, F.col("v.price")).alias("price_cents"), F.lit(None).cast("bigint").alias("claimed_cents"),
        F.when(F.col("v.available"), "IN_STOCK").otherwise("OUT_OF_STOCK").alias("availability"),
        F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["n"], e["x"]))).alias("attributes"), normalize_all(F.array(F.coalesce("v.barcode", code))).alias("gtin14"),
    )


def browser_capture(pages: DataFrame, was_patterns: dict[str, str]) -> DataFrame:
    """What a browser capture takes from a product page (url, host, body): the first JSON-LD product
    with a price, its condition, and the former price by the host's pattern."""
    priced = F.transform(json_ld(F.col("body")), lambda o: F.struct(o["@type"].alias("@type"), o["name"].alias("name"), F.get(F.filter(offers_of(o["offers"]), lambda f: _cents(f).isNotNull()), F.lit(0)).alias("offers")))
    best = F.get(F.filter(priced, lambda o: (o["@type"] == "Product") & o["offers"].isNotNull()), F.lit(0))
    was = F.lit(None).cast("string")
    for host, pattern in was_patterns.items():
        was = F.when(F.col("host") == host, group(F.col("body"), pattern)).otherwise(was)
    condition = lookup({"NewCondition": "NEW", "UsedCondition": "USED_UNGRADED", "RefurbishedCondition": "REFURBISHED", "DamagedCondition": "USED_ACCEPTABLE"}, F.element_at(F.split(best["offers"]["itemCondition"], "/"), -1))
    return pages.select(
        F.col("url").alias("product_url"), best["name"].alias("title"), condition.alias("condition"), F.coalesce(best["offers"]["priceCurrency"], F.lit("USD")).alias("currency"),
        _cents(best["offers"]).alias("current_cents"), parse_price_cents(was).alias("was_cents"),
    ).where("current_cents is not null")


def next_page(body: Column) -> Column:
    """Target of the page's rel=next link."""
    return F.coalesce(group(body, r'(?i)<(?:a|link)\s[^>]*rel="next"[^>]*href="([^"]*)"'), group(body, r'(?i)<(?:a|link)\s[^>]*href="([^"]*)"[^>]*rel="next"'))


def used_wording(description: Column) -> Column:
    """Struct (msrp_cents, wording) of a used item's free text, such as ``MSRP $299.99 - Excellent condition``."""
    pattern = r"(?i)MSRP\s*\$([0-9][0-9,]*\.\d{2})\s*-\s*([A-Za-z][A-Za-z ]*?)\s+condition\b"
    return F.struct(parse_price_cents(group(description, pattern)).alias("msrp_cents"), F.lower(group(description, pattern, 2)).alias("wording"))
