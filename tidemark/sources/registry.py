"""Which parser reads which shop, and the parsers as table functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..config import COLLECTION_SHOPS
from . import feeds, markup

Parser = Callable[[DataFrame], DataFrame]

#: slug -> page type -> parser.
PARSERS: dict[str, dict[str, Parser]] = {slug: {"LISTING": feeds.collection_rows, "PRODUCT": feeds.product_offers} for slug, _, _ in COLLECTION_SHOPS}
PARSERS |= {
    "tackle_warehouse": {"LISTING": partial(markup.grid_rows, family="catalogue_cells"), "USED_LISTING": partial(markup.grid_rows, family="catalogue_cells", used=True), "PRODUCT": partial(markup.spec_offers, family="ordering_rows")},
    "academy": {"LISTING": markup.json_ld_list_rows, "PRODUCT": markup.json_ld_offers},
    "jandh": {"LISTING": partial(markup.grid_rows, family="product_cards"), "PRODUCT": markup.embedded_product_offers},
    "fishusa": {"PRODUCT": markup.spec_offers},
    "tackledirect": {"PRODUCT": markup.meta_page},
    "alltackle": {"PRODUCT": markup.meta_page},
    "basspro": {"LISTING": feeds.search_rows},
    "cabelas": {"LISTING": feeds.search_rows},
    "dicks": {"LISTING": feeds.catalog_rows},
    "sportsmans_warehouse": {"LISTING": partial(markup.grid_rows, family="product_items")},
    "sportsmans_guide": {"LISTING": partial(markup.grid_rows, family="badge_tiles")},
}


#: The columns that every shop's offers and listed rows have, whatever its parser gives; what it doesn't give is null.
COMMON = {
    "shop": "string", "page_type": "string", "url": "string", "product_url": "string", "product_code": "string", "sku": "string", "title": "string", "brand": "string", "variant_label": "string",
    "price_cents": "bigint", "claimed_cents": "bigint", "claimed_kind": "string", "price_is_range": "boolean", "condition": "string", "seller_type": "string", "availability": "string",
    "quantity": "int", "unit_count": "int", "on_clearance": "boolean", "gtin14": "array<string>",
}


def _common(rows: DataFrame, slug: str, page_type: str) -> DataFrame:
    have = {c.lower(): kind for c, kind in rows.dtypes}
    known = {"shop": F.lit(slug), "page_type": F.lit(page_type)}
    if "available" in have and "availability" not in have:
        known["availability"] = F.when(F.col("available"), "IN_STOCK").when(~F.col("available"), "OUT_OF_STOCK")
    if "condition" not in have:
        known["condition"] = F.col("condition_hint") if "condition_hint" in have else F.when(F.lit(page_type == "PRODUCT"), "NEW")
    if "claimed_cents" in have and "claimed_kind" not in have:
        known["claimed_kind"] = F.when(F.col("claimed_cents").isNotNull(), "WAS")
    return rows.select(*[known.get(c, F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in COMMON.items()])


def common_offers(pages: DataFrame, shops: Iterable[str] | None = None) -> DataFrame:
    """Offers and listed rows of pages (shop, page_type, url, host, body) of many shops, all in the columns COMMON.

    Each shop's pages go through its own parser; a table kept by shop is read shop by shop. Pages of
    unknown shops and types give no rows. ``shops`` names those to read, by default all.
    """
    parts = []
    for slug in PARSERS if shops is None else shops:
        for page_type, parser in PARSERS[slug].items():
            mine = pages.where((F.col("shop") == slug) & (F.col("page_type") == page_type)).select("url", "host", "body")
            parts.append(_common(parser(mine), slug, page_type))
    return reduce(DataFrame.unionByName, parts)


def register_offers(pages: DataFrame, name: str = "offers") -> None:
    """``common_offers`` as a view for SQL."""
    common_offers(pages).createOrReplaceTempView(name)


def parser_of(slug: str, page_type: str) -> Parser:
    """The parser of a shop's pages; KeyError names what is unknown."""
    return PARSERS[slug][page_type]


def collection_url(slug: str) -> str:
    host, handle = next((h, c) for s, h, c in COLLECTION_SHOPS if s == slug)
    return f"https://{host}/collections/{handle}/products.json"


class GridCells:
    """``grid_cells(body, family)``: a row for each cell of a grid page."""

    def eval(self, body: str, family: str) -> Iterator[tuple[int, dict[str, str]]]:
        parser = markup._Cells(markup.GRIDS[family])
        parser.feed(body or "")
        parser.close()
        yield from enumerate(parser.rows)


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("grid_cells", udtf(GridCells, returnType="ord int, cell map<string,string>"))
