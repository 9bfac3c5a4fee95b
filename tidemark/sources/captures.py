"""Captures that a browser posts: JSON bodies to checked rows, each with the answer it gets.

A body is parsed once into a VARIANT, so that the kind of every value is known before it is cast: a
price of ``true`` or ``12.0`` is no whole number, a title of 5 is no text.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CAPTURE_CONDITIONS
from ..functions.basics import first_reason, lookup
from ..functions.times import minute_bucket
from ..operators.pacing import limit_requests

#: Limits of the endpoint in bytes, characters, cents and fields.
BODY_BYTES, URL_LENGTH, TITLE_LENGTH, VARIANT_LENGTH, HINT_LENGTH = 32 * 1024, 2048, 500, 300, 100
LEAST_CENTS, MOST_CENTS = 1, 10_000_000
RAW_FIELDS, RAW_KEY, RAW_LENGTH = 20, 100, 2000
TEXTS = ("product_url", "title_raw", "variant_label_raw", "retailer_hint", "condition", "currency", "captured_at", "idempotency_key")
#: Names of a body's fields and of the columns they become.
RENAMED = {"title_raw": "title", "variant_label_raw": "variant_label", "current_price_cents": "current_cents", "was_price_cents": "was_cents"}
#: Errors that say a URL is unsafe; all others are plain validation errors.
UNSAFE = ("product_url_not_https", "product_url_userinfo")
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _cleaned(text: str, longest: int) -> str:
    return _CONTROLS.sub("", unicodedata.normalize("NFC", text)).strip()[:longest]


def clean_text(text: Column, longest: int) -> Column:
    """Text in Unicode NFC without control characters, trimmed and cut to a length; null if nothing is left.

    NFC and white space of all kinds are beyond the built-in functions.
    """

    @F.pandas_udf(T.StringType())
    def clean(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else _cleaned(t, longest) or None)

    return clean(text)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def clean_raw(values: pd.Series) -> pd.Series:
    """The extras of a body (an object's JSON text) as cleaned texts; what is no text is shown as the
    sender's language writes it."""

    def one(text: str | None) -> dict | None:
        found = None if text is None else json.loads(text)
        return None if not isinstance(found, dict) else {_cleaned(k, RAW_KEY): _cleaned(v if isinstance(v, str) else repr(v), RAW_LENGTH) for k, v in found.items()}

    return values.map(one)


def parsed(posts: DataFrame) -> DataFrame:
    """``posts`` (with a text ``body``) and the typed fields of their bodies.

    ``object``: the body is a JSON object. ``mistyped``: the fields whose values are of the wrong kind;
    those, absent ones and JSON nulls are null. ``raw`` is the extras' JSON text.
    """
    body = F.try_parse_json("body")
    whole = posts.withColumn("v_", body)
    at = lambda name: f"try_variant_get(v_, '$.{name}', 'variant')"
    kind = lambda name: F.expr(f"schema_of_variant({at(name)})")
    typed, mistyped = {}, []
    for name in TEXTS:
        typed[RENAMED.get(name, name)] = F.when(kind(name) == "STRING", F.expr(f"try_variant_get(v_, '$.{name}', 'string')"))
        # An absent currency has a default, a null one is no text.
        wrong = kind(name).isNotNull() & ~kind(name).isin(*(("STRING",) if name == "currency" else ("STRING", "VOID")))
        mistyped.append(F.when(wrong, F.lit(RENAMED.get(name, name))))
    for name in ("current_price_cents", "was_price_cents"):
        typed[RENAMED[name]] = F.when(kind(name) == "BIGINT", F.expr(f"try_variant_get(v_, '$.{name}', 'bigint')"))
        mistyped.append(F.when(kind(name).isNotNull() & ~kind(name).isin("BIGINT", "VOID"), F.lit(RENAMED[name])))
    raw_kind = kind("raw")
    mistyped.append(F.when(raw_kind.isNotNull() & ~raw_kind.startswith("OBJECT") & (raw_kind != "VOID"), F.lit("raw")))
    is_object = F.coalesce(F.expr("schema_of_variant(v_)").startswith("OBJECT"), F.lit(False))
    keys = F.map_keys(F.expr("try_variant_get(v_, '$.raw', 'map<string,variant>')"))
    fields = {"object": is_object, "valid_json": F.col("v_").isNotNull(), "mistyped": F.array_compact(F.array(*mistyped)), "raw_keys": F.when(raw_kind.startswith("OBJECT"), keys), "raw_text": F.when(raw_kind.startswith("OBJECT"), F.get_json_object("body", "$.raw"))}
    return whole.select(*posts.columns, *[c.alias(n) for n, c in (typed | fields).items()])


def validate_captures(df: DataFrame, now: Column) -> DataFrame:
    """Checked captures: cleaned fields, ``error`` (null if accepted), its ``code`` and the idempotency key.

    Input: product_url, title, condition, currency, current_cents, was_cents, captured_at (timestamp or
    ISO text), idempotency_key and, where given, variant_label, retailer_hint, raw (a map of texts) or
    raw_text and raw_keys, and mistyped (names of fields that were of the wrong kind); all nullable.
    Further columns stay. A key of the sender's counts; else captures of one page, variant and price
    in a minute share theirs. The first field that is wrong gives the error.
    """
    have = set(df.columns)
    wrong = lambda name: F.array_contains("mistyped", name) if "mistyped" in have else F.lit(False)
    variant = clean_text(F.col("variant_label"), VARIANT_LENGTH) if "variant_label" in have else F.lit(None).cast("string")
    hint = clean_text(F.col("retailer_hint"), HINT_LENGTH) if "retailer_hint" in have else F.lit(None).cast("string")
    if "raw_text" in have:
        raw, keys = clean_raw("raw_text"), F.col("raw_keys")
    else:
        raw = F.col("raw") if "raw" in have else F.lit(None).cast("map<string,string>")
        keys = F.map_keys(raw)
        raw = F.transform_values(raw, lambda _, v: F.substring(v, 1, RAW_LENGTH))
    url, price, was = F.col("product_url"), F.col("current_cents"), F.col("was_cents")
    title = clean_text(F.col("title"), TITLE_LENGTH)
    # A sender's URL may hold characters that a strict parser refuses; its parts are plain to see.
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    host = F.nullif(F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")), F.lit(""))
    condition = lookup(CAPTURE_CONDITIONS, F.upper(F.trim(F.coalesce("condition", F.lit("NEW")))))
    given = F.col("captured_at")
    if dict(df.dtypes)["captured_at"] == "string":
        zoned = F.when(given.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), given).otherwise(F.concat(given, F.lit("Z")))
        given = zoned.try_cast("timestamp")
    at = F.coalesce(given, now)
    currency = F.upper(F.trim(F.coalesce("currency", F.lit("USD"))))
    size_wrong = lambda keys: (F.size(keys) > RAW_FIELDS) | F.exists(keys, lambda k: F.length(k) > RAW_KEY)
    sent = clean_text(F.col("idempotency_key"), 128)
    sane = F.coalesce(F.length("idempotency_key").between(8, 128) & sent.isNotNull(), F.lit(False))
    error = first_reason(
        [
            ("product_url_missing", wrong("product_url") | url.isNull() | (url == "")),
            ("product_url_too_long", F.length(url) > URL_LENGTH),
            ("product_url_control_chars", url.rlike(r"[\x00-\x1F]")),
            ("product_url_not_https", ~url.rlike("^(?i)https:")),
            ("product_url_bad_host", host.isNull() | ~host.contains(".")),
            ("product_url_userinfo", authority.rlike("[^:@].*@")),
            ("title_missing", wrong("title") | title.isNull()),
            ("variant_label_invalid", wrong("variant_label")),
            ("retailer_hint_invalid", wrong("retailer_hint")),
            ("condition_unknown", wrong("condition") | condition.isNull()),
            ("currency_invalid", wrong("currency") | ~currency.rlike("^[A-Z]{3}$")),
            ("current_price_invalid", wrong("current_cents") | price.isNull() | ~price.between(LEAST_CENTS, MOST_CENTS)),
            ("was_price_invalid", wrong("was_cents") | (was.isNotNull() & ~was.between(LEAST_CENTS, MOST_CENTS))),
            ("captured_at_invalid", wrong("captured_at") | (F.col("captured_at").isNotNull() & given.isNull())),
            ("captured_at_future", at > now + F.expr("INTERVAL 5 MINUTES")),
            ("captured_at_too_old", at < now - F.expr("INTERVAL 7 DAYS")),
            ("raw_invalid", wrong("raw") | F.coalesce(F.exists(keys, lambda k: F.trim(k) == ""), F.lit(False))),
            ("raw_too_large", F.coalesce(size_wrong(keys), F.lit(False))),
            ("idempotency_key_invalid", wrong("idempotency_key") | (F.col("idempotency_key").isNotNull() & ~sane)),
        ]
    )
    derived = F.concat(F.lit("auto_"), F.substring(F.sha2(F.concat_ws("|", host, url, F.coalesce(variant, F.lit("")), price.cast("string"), minute_bucket(at)).cast("binary"), 256), 1, 40))
    made = {
        "product_url": url, "host": host, "retailer_hint": hint, "title": title, "condition": condition, "currency": currency, "current_cents": price, "was_cents": F.when(was > price, was), "captured_at": at,
        "variant_label": variant, "raw": raw, "idempotency_key": F.coalesce(sent, derived), "error": error, "code": F.when(error.isin(*UNSAFE), "UNSAFE_URL").when(error.isNotNull(), "VALIDATION_ERROR"),
    }
    gone = {*made, "object", "valid_json", "mistyped", "raw_keys", "raw_text"}
    return df.select(*[c for c in df.columns if c not in gone], *[c.alias(n) for n, c in made.items()])


def answered(posts: DataFrame, token: str, now: Column) -> DataFrame:
    """Captures out of posts (client, seq, received_at, authorization, body), with the answer each gets.

    ``status`` and ``code`` in the order in which an endpoint looks: authorisation, size, JSON, fields.
    Posts over a client's rate are for ``within_rate`` to find, which needs them in order of time.
    """
    checked = validate_captures(parsed(posts), now)
    flat = F.try_parse_json("body")
    code = (
        F.when(~F.coalesce(F.col("authorization") == f"Bearer {token}", F.lit(False)), "UNAUTHORIZED")
        .when(F.octet_length("body") > BODY_BYTES, "PAYLOAD_TOO_LARGE")
        .when(flat.isNull() | ~F.coalesce(F.schema_of_variant(flat).startswith("OBJECT"), F.lit(False)), "VALIDATION_ERROR")
        .otherwise(F.col("code"))
    )
    error = F.when(code == "UNAUTHORIZED", "unauthorized").when(code == "PAYLOAD_TOO_LARGE", "body_too_large").when(flat.isNull(), "body_not_json").when(~F.schema_of_variant(flat).startswith("OBJECT"), "body_not_object").otherwise(F.col("error"))
    status = F.when(code.isNull(), 202).when(code == "UNAUTHORIZED", 401).when(code == "PAYLOAD_TOO_LARGE", 413).otherwise(400)
    return checked.withColumns({"status": status, "code": code, "error": error})


def within_rate(posts: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """``posts`` with ``admitted``: false beyond ``limit`` admitted posts of a client in ``window`` seconds."""
    asked = posts.select("client", "seq", F.col("received_at").alias("at"))
    told = limit_requests(asked, limit, window).select("client", "seq", "admitted")
    return posts.join(told, ["client", "seq"])


def insert_captures(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` (accepted captures) with ``pub_id`` and ``created``: of each idempotency key the earliest row
    is created unless the key is stored; all others get the id that is there.

    ``stored`` has one row for each idempotency_key, with pub_id. A created row's pub_id is derived
    from its key, so a batch that runs again gives the same ids. Rows without a key are created.
    """
    order = Window.partitionBy("idempotency_key").orderBy("captured_at", "seq")
    first = (F.row_number().over(order) == 1) | F.col("idempotency_key").isNull()
    known = stored.select("idempotency_key", F.col("pub_id").alias("stored_id"))
    joined = batch.withColumn("first_", first).join(known, "idempotency_key", "left")
    made = F.concat(F.lit("cap_"), F.substring(F.sha2(F.coalesce("idempotency_key", F.col("seq").cast("string")).cast("binary"), 256), 1, 16))
    return joined.withColumns({"pub_id": F.coalesce("stored_id", made), "created": F.col("first_") & F.col("stored_id").isNull()}).drop("first_", "stored_id")
