"""Thresholds and fixed vocabularies of the price engine."""

from __future__ import annotations

from dataclasses import dataclass

#: Price bands in cents by category. Fixed values.
CATEGORY_BANDS = {
    "rod": (1500, 200000),
    "reel": (1500, 150000),
    "combo": (2000, 200000),
    "soft_bait": (150, 20000),
    "hard_bait": (300, 20000),
    "line": (300, 20000),
    "terminal": (100, 20000),
    "other": (100, 200000),
}

#: Attributes that a variant key needs, in order. Fixed values.
VARIANT_ATTRIBUTES = {
    "rod": ("rod_type", "length_in", "power", "action", "pieces"),
    "reel": ("reel_type", "size_code", "gear_ratio"),
    "combo": ("rod_type", "length_in", "power", "action", "pieces", "reel_size_code"),
    "soft_bait": ("length_in", "color_key", "unit_count"),
    "hard_bait": ("length_in", "color_key"),
    "line": ("line_type", "lb_test", "yards", "color_key"),
    "terminal": ("size", "weight_oz", "unit_count"),
}

#: Condition wordings of used-gear pages. Fixed values.
CONDITION_WORDS = {
    "new": "NEW",
    "excellent": "USED_LIKE_NEW",
    "like new": "USED_LIKE_NEW",
    "very good": "USED_VERY_GOOD",
    "good": "USED_GOOD",
    "fair": "USED_ACCEPTABLE",
    "acceptable": "USED_ACCEPTABLE",
    "used": "USED_UNGRADED",
}

#: Condition names that captures may use. Fixed values.
CAPTURE_CONDITIONS = {
    "NEW": "NEW",
    "NEW_OPEN_BOX": "NEW_OPEN_BOX",
    "OPEN_BOX": "NEW_OPEN_BOX",
    "REFURBISHED": "REFURBISHED",
    "REFURB": "REFURBISHED",
    "USED_LIKE_NEW": "USED_LIKE_NEW",
    "USED_VERY_GOOD": "USED_VERY_GOOD",
    "USED_GOOD": "USED_GOOD",
    "USED_ACCEPTABLE": "USED_ACCEPTABLE",
    "USED_UNGRADED": "USED_UNGRADED",
    "USED": "USED_UNGRADED",
}

CONDITION_GROUPS = {
    "NEW": "NEW",
    "NEW_OPEN_BOX": "OPEN_BOX",
    "REFURBISHED": "REFURB",
    "USED_LIKE_NEW": "USED",
    "USED_VERY_GOOD": "USED",
    "USED_GOOD": "USED",
    "USED_ACCEPTABLE": "USED",
    "USED_UNGRADED": "USED",
}

#: Conditions that the used-against-new rule accepts.
USED_RULE_CONDITIONS = ("NEW_OPEN_BOX", "REFURBISHED", "USED_LIKE_NEW", "USED_VERY_GOOD", "USED_GOOD", "USED_UNGRADED")

#: Rod power and action names. Fixed values.
ROD_POWER = {
    "ultralight": "UL", "ul": "UL", "light": "L", "l": "L", "medium light": "ML", "medium-light": "ML", "ml": "ML",
    "medium": "M", "m": "M", "md": "M", "medium heavy": "MH", "medium-heavy": "MH", "mh": "MH", "heavy": "H", "h": "H",
    "extra heavy": "XH", "xh": "XH",
}
ROD_ACTION = {
    "extra fast": "XF", "xf": "XF", "fast": "F", "f": "F", "moderate fast": "MF", "medium fast": "MF", "mf": "MF",
    "moderate": "MOD", "mod": "MOD", "slow": "S", "s": "S", "medium": "M", "m": "M",
}

#: Substrings of block pages, first match wins. Fixed values.
BLOCK_SIGNATURES = ("edgesuite", "access denied", "site unavailable", "cf-chl", "captcha", "press & hold", "_abck")

#: Availability wordings of page metadata. Fixed values.
META_AVAILABILITY = {
    "instock": "IN_STOCK", "in-stock": "IN_STOCK", "in stock": "IN_STOCK",
    "oos": "OUT_OF_STOCK", "outofstock": "OUT_OF_STOCK", "out-of-stock": "OUT_OF_STOCK", "out of stock": "OUT_OF_STOCK",
    "preorder": "BACKORDER", "pre-order": "BACKORDER", "backorder": "BACKORDER", "back-order": "BACKORDER",
}
SCHEMA_AVAILABILITY = {
    "InStock": "IN_STOCK", "OutOfStock": "OUT_OF_STOCK", "InStoreOnly": "STORE_ONLY", "BackOrder": "BACKORDER", "PreOrder": "BACKORDER",
    "SoldOut": "OUT_OF_STOCK", "LimitedAvailability": "IN_STOCK", "OnlineOnly": "IN_STOCK", "Discontinued": "OUT_OF_STOCK",
}

#: What documents show for stored enumerations. Fixed values.
SHOWN_SELLER = {"FIRST_PARTY": "FIRST_PARTY", "RETAILER_RESALE": "FIRST_PARTY", "MARKETPLACE_3P": "MARKETPLACE"}
SHOWN_AVAILABILITY = {"IN_STOCK": "IN_STOCK", "STORE_ONLY": "STORE_ONLY", "OUT_OF_STOCK": "OUT_OF_STOCK", "BACKORDER": "OUT_OF_STOCK", "UNKNOWN": "OUT_OF_STOCK"}
SHOWN_CLAIM = {"WAS": "WAS", "MSRP": "MSRP", "LIST": "LIST", "COMPARE_AT": "LIST"}
SHOWN_REFERENCE = {
    "OWN_HISTORY_MEDIAN_90D": "OWN_HISTORY_MEDIAN_90D",
    "CROSS_RETAILER_NEW": "CROSS_RETAILER_NEW",
    "DATA_API_HISTORY": "DATA_API_HISTORY",
    "CURRENT_NEW": "CROSS_RETAILER_NEW",
}

#: Networks that a fetch must never reach. Fixed values.
BLOCKED_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::1/128", "::/128",
    "64:ff9b::/96", "100::/64", "fc00::/7", "fe80::/10", "::ffff:0:0/96",
)

#: Shops that serve a collection feed: slug, host, handle of the sale collection. Fixed values.
COLLECTION_SHOPS = (
    ("abugarcia", "www.abugarcia.com", "sale"),
    ("berkley", "www.berkley-fishing.com", "sale"),
    ("discounttackle", "discounttackle.com", "clearance"),
    ("fishingonline", "www.fishingonline.com", "sale"),
    ("gloomis", "fishshop.shimano.com", "sale"),
    ("jackall", "fishshop.shimano.com", "sale"),
    ("penn", "www.pennfishing.com", "sale"),
    ("pflueger", "pfluegerfishing.com", "sale"),
    ("powerpro", "fishshop.shimano.com", "sale"),
    ("rodlocker", "rodlocker.com", "sale"),
    ("shimano", "fishshop.shimano.com", "sale"),
    ("uglystik", "www.uglystik.com", "sale"),
)
#: Hosts of the other shops. Fixed values.
OTHER_HOSTS = (
    ("tackle_warehouse", "www.tacklewarehouse.com"),
    ("academy", "www.academy.com"),
    ("jandh", "www.jandh.com"),
    ("fishusa", "www.fishusa.com"),
    ("tackledirect", "www.tackledirect.com"),
    ("alltackle", "alltackle.com"),
    ("basspro", "basspro.com"),
    ("basspro", "www.basspro.com"),
    ("cabelas", "cabelas.com"),
    ("cabelas", "www.cabelas.com"),
    ("dicks", "dickssportinggoods.com"),
    ("dicks", "www.dickssportinggoods.com"),
    ("sportsmans_warehouse", "www.sportsmans.com"),
    ("sportsmans_guide", "www.sportsmansguide.com"),
)


@dataclass(frozen=True)
class Rules:
    """Thresholds of detection, confirmation and guards. Percentages are in basis points."""

    min_discount_bp: int = 5000
    min_saving_cents: int = 1000
    held_upper_bp: int = 8500
    implausible_bp: int = 9500
    inflated_ratio: float = 1.25
    own_min_days: int = 21
    own_min_span: int = 30
    own_window_days: int = 90
    cross_max_age_days: int = 7
    current_new_max_age_hours: int = 48
    min_confirm_minutes: int = 10
    confirm_deadline_hours: int = 3
    price_tolerance: float = 1.02
    stale_hours: int = 24
    replay_hours: int = 168
    move_low_pct: float = 35.0
    move_high_pct: float = 300.0
    unit_tolerance: float = 0.05
    unit_guesses: tuple[int, ...] = (3, 4, 5, 6, 10, 12, 20, 25, 50)


RULES = Rules()
