"""Captures: typed rows, posted bodies of every kind, and the stream that sets bad ones aside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.captures import answered, insert_captures, validate_captures
from ..sources.files import table, table_stream
from ..streaming.quarantine import start_split, stored_split
from .q_stateful import _checkpoint
from .registering import query


CAPTURES = """WITH c AS (
  SELECT page_id, url AS product_url, CASE page_id % 3 WHEN 0 THEN 'Size ' || page_id % 7 WHEN 1 THEN '' END AS variant, 'T' || page_id AS title, CASE page_id % 4 WHEN 0 THEN 'used' WHEN 1 THEN NULL WHEN 2 THEN 'mint' ELSE 'open_box' END AS condition, page_id * 100 AS cents,
    CASE WHEN page_id % 3 = 0 THEN page_id * 90 ELSE page_id * 150 END AS was, TIMESTAMP '2024-05-01 00:00:00' - INTERVAL 1 HOUR * (page_id % 200) AS taken, TIMESTAMP '2024-05-01 00:00:00' AS reference_time FROM pages
), h AS (SELECT *, regexp_extract(product_url, '^[a-z]+://([^/?#]+)', 1) AS host,
   CASE WHEN condition IS NULL THEN 'NEW' WHEN upper(condition) = 'USED' THEN 'USED_UNGRADED' WHEN upper(condition) = 'OPEN_BOX' THEN 'NEW_OPEN_BOX' END AS cond FROM c)"""


def captures(spark, sf_dir):
    i, now = F.col("page_id"), F.lit("2024-05-01 00:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("url").alias("product_url"),
        F.concat(F.lit("T"), i.cast("string")).alias("title"),
        F.when(i % 4 == 0, "used").when(i % 4 == 2, "mint").when(i % 4 == 3, "open_box").alias("condition"),
        F.lit(None).cast("string").alias("currency"),
        (i * 100).alias("current_cents"),
        F.when(i % 3 == 0, i * 90).otherwise(i * 150).alias("was_cents"),
        (now - F.make_dt_interval(hours=(i % 200).cast("int"))).alias("captured_at"),
        F.lit(None).cast("string").alias("idempotency_key"),
        F.when(i % 3 == 0, F.concat(F.lit(" Size "), (i % 7).cast("string"))).when(i % 3 == 1, "").alias("variant_label"),
    )
    return validate_captures(rows, now)


@query(
    f"""{CAPTURES} SELECT product_url, host, cond AS condition, CASE WHEN was > cents THEN was END AS was_cents,
    CASE WHEN product_url NOT LIKE 'https://%' THEN 'product_url_not_https' WHEN cond IS NULL THEN 'condition_unknown' WHEN NOT cents BETWEEN 1 AND 10000000 THEN 'current_price_invalid'
      WHEN NOT was BETWEEN 1 AND 10000000 THEN 'was_price_invalid' WHEN taken < reference_time - INTERVAL 7 DAY THEN 'captured_at_too_old' END AS error FROM h"""
)
def capture_validation(spark, sf_dir):
    return captures(spark, sf_dir).select("product_url", "host", "condition", "was_cents", "error")


@query(
    f"""{CAPTURES} SELECT product_url, 'auto_' || substr(sha256(host || '|' || product_url || '|' || coalesce(nullif(variant, ''), '') || '|' || cents || '|' || strftime(taken, '%Y-%m-%dT%H:%M')), 1, 40) AS idempotency_key FROM h"""
)
def capture_idempotency_key(spark, sf_dir):
    return captures(spark, sf_dir).select("product_url", "idempotency_key")


#: Bodies that browsers might post; a page posts the one at its number's remainder. @url@ and @id@ are the page's.
_GOOD = '"product_url":"https://shop.example.com/p/@id@","title_raw":"T @id@","current_price_cents":1@id@'
BODIES = (
    "{" + _GOOD + "}",
    "{" + _GOOD + ',"condition":" open_box ","currency":" usd ","was_price_cents":2@id@0,"variant_label_raw":"Size @id@","captured_at":"2024-04-30T10:0@last@:00Z"}',
    '{"product_url":"@url@","title_raw":"T","current_price_cents":500,"retailer_hint":"shop"}',
    '{"product_url":"https://shop.example.com/p","title_raw":"T","current_price_cents":true}',
    '{"product_url":"https://shop.example.com/p","title_raw":"T","current_price_cents":"12"}',
    '{"product_url":"https://shop.example.com/p","title_raw":"T","current_price_cents":12.0}',
    '{"product_url":"https://shop.example.com/p","title_raw":"T","current_price_cents":10000001}',
    '{"product_url":"https://shop.example.com/p","title_raw":"T","current_price_cents":5,"was_price_cents":false}',
    '{"product_url":7,"title_raw":"T","current_price_cents":5}',
    '{"product_url":"javascript:alert(1)","title_raw":"T","current_price_cents":5}',
    '{"product_url":"https://user:pw@shop.example.com/p","title_raw":"T","current_price_cents":5}',
    '{"product_url":"https://localhost/p","title_raw":"T","current_price_cents":5}',
    '{"product_url":"https://shop.example.com/p","title_raw":["T"],"current_price_cents":5}',
    '{"product_url":"https://shop.example.com/p","title_raw":" \\u0007 ","current_price_cents":5}',
    "{" + _GOOD + ',"currency":null}',
    "{" + _GOOD + ',"condition":3}',
    "{" + _GOOD + ',"condition":"mint"}',
    "{" + _GOOD + ',"captured_at":"yesterday"}',
    "{" + _GOOD + ',"captured_at":"2024-05-01T01:00:00+00:00"}',
    "{" + _GOOD + ',"captured_at":"2024-04-01T01:00:00"}',
    "{" + _GOOD + ',"raw":["a"]}',
    "{" + _GOOD + ',"raw":{"n":12,"b":true,"z":null,"t":" padded "}}',
    "{" + _GOOD + ',"raw":{' + ",".join(f'"k{k}":{k}' for k in range(21)) + "}}",
    "{" + _GOOD + ',"raw":{"' + "k" * 101 + '":1}}',
    "{" + _GOOD + ',"raw":{"long":"' + "x" * 2100 + '"}}',
    "{" + _GOOD + ',"idempotency_key":"short"}',
    "{" + _GOOD + ',"idempotency_key":"sender-@last@-key"}',
    "[1,2]",
    '{"product_url":',
    "{" + _GOOD + ',"pad":"' + "y" * 33000 + '"}',
)
NOW, TOKEN = "2024-05-01 00:00:00", "token"


def posts(pages):
    """pages as posts."""
    i = F.col("page_id")
    body = F.element_at(F.array(*map(F.lit, BODIES)), (i % len(BODIES) + 1).cast("int"))
    for mark, value in (("@url@", F.col("url")), ("@id@", i.cast("string")), ("@last@", (i % 10).cast("string"))):
        body = F.replace(body, F.lit(mark), value)
    return pages.select(i.alias("seq"), F.concat(F.lit("c"), (i % 7).cast("string")).alias("client"), F.lit(NOW).cast("timestamp").alias("received_at"), F.when(i % 17 != 3, f"Bearer {TOKEN}").alias("authorization"), body.alias("body"))


def _text(body: str) -> str:
    return "'" + body.replace("'", "''") + "'"


ANSWERS = f"""WITH p AS (
  SELECT page_id AS seq, page_id % 17 <> 3 AS known, replace(replace(replace(([{", ".join(map(_text, BODIES))}])[page_id % {len(BODIES)} + 1], '@url@', url), '@id@', CAST(page_id AS VARCHAR)), '@last@', CAST(page_id % 10 AS VARCHAR)) AS body FROM pages
), j AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS d FROM p
), k AS (
  SELECT *, json_type(d) AS shape, json_type(d, '$.product_url') AS k_url, d->>'$.product_url' AS url, json_type(d, '$.title_raw') AS k_title, trim(regexp_replace(d->>'$.title_raw', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS title,
    json_type(d, '$.condition') AS k_cond, CASE WHEN d->>'$.condition' IS NULL THEN 'NEW' WHEN upper(trim(d->>'$.condition')) = 'OPEN_BOX' THEN 'NEW_OPEN_BOX' END AS cond,
    json_type(d, '$.currency') AS k_cur, json_type(d, '$.current_price_cents') AS k_price, TRY_CAST(d->>'$.current_price_cents' AS BIGINT) AS price, json_type(d, '$.was_price_cents') AS k_was, TRY_CAST(d->>'$.was_price_cents' AS BIGINT) AS was,
    d->>'$.captured_at' AS taken, TRY_CAST(replace(replace(d->>'$.captured_at', 'Z', ''), '+00:00', '') AS TIMESTAMP) AS stamp, json_type(d, '$.raw') AS k_raw, json_keys(d, '$.raw') AS raw_keys, d->>'$.idempotency_key' AS sent, d->>'$.variant_label_raw' AS variant FROM j
), v AS (
  SELECT *, CASE WHEN NOT known THEN 'unauthorized' WHEN strlen(body) > 32768 THEN 'body_too_large' WHEN d IS NULL THEN 'body_not_json' WHEN shape <> 'OBJECT' THEN 'body_not_object'
    WHEN coalesce(k_url, 'NULL') <> 'VARCHAR' THEN 'product_url_missing' WHEN url NOT LIKE 'https://%' THEN 'product_url_not_https' WHEN url LIKE 'https://localhost%' THEN 'product_url_bad_host' WHEN url LIKE '%user:pw@%' THEN 'product_url_userinfo'
    WHEN coalesce(k_title, 'NULL') <> 'VARCHAR' OR title = '' THEN 'title_missing' WHEN k_cond NOT IN ('VARCHAR', 'NULL') OR cond IS NULL THEN 'condition_unknown' WHEN k_cur <> 'VARCHAR' THEN 'currency_invalid'
    WHEN coalesce(k_price, 'NULL') NOT IN ('UBIGINT', 'BIGINT') OR NOT price BETWEEN 1 AND 10000000 THEN 'current_price_invalid' WHEN k_was NOT IN ('UBIGINT', 'BIGINT', 'NULL') OR NOT was BETWEEN 1 AND 10000000 THEN 'was_price_invalid'
    WHEN taken IS NOT NULL AND stamp IS NULL THEN 'captured_at_invalid' WHEN stamp > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE THEN 'captured_at_future' WHEN stamp < TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'captured_at_too_old'
    WHEN k_raw NOT IN ('OBJECT', 'NULL') THEN 'raw_invalid' WHEN len(raw_keys) > 20 OR list_max(list_transform(raw_keys, lambda x: length(x))) > 100 THEN 'raw_too_large' WHEN length(sent) NOT BETWEEN 8 AND 128 THEN 'idempotency_key_invalid' END AS error FROM k
), a AS (
  SELECT *, CASE error WHEN 'unauthorized' THEN 401 WHEN 'body_too_large' THEN 413 ELSE CASE WHEN error IS NULL THEN 202 ELSE 400 END END AS status,
    CASE WHEN error IS NULL THEN NULL WHEN error = 'unauthorized' THEN 'UNAUTHORIZED' WHEN error = 'body_too_large' THEN 'PAYLOAD_TOO_LARGE' WHEN error IN ('product_url_not_https', 'product_url_userinfo') THEN 'UNSAFE_URL' ELSE 'VALIDATION_ERROR' END AS code,
    CASE WHEN error IS NULL THEN coalesce(sent, 'auto_' || substr(sha256(regexp_extract(url, '^https://([^/?#]+)', 1) || '|' || url || '|' || coalesce(variant, '') || '|' || price || '|' || strftime(coalesce(stamp, TIMESTAMP '{NOW}'), '%Y-%m-%dT%H:%M')), 1, 40)) END AS key FROM v
)"""
_RAW = """CASE WHEN error IS NULL AND k_raw = 'OBJECT' THEN array_to_string(list_sort(list_transform(json_keys(d, '$.raw'), lambda x: x || '=' || CASE json_type(d, '$.raw.' || x) WHEN 'BOOLEAN' THEN CASE json_extract_string(d, '$.raw.' || x) WHEN 'true' THEN 'True' ELSE 'False' END
      WHEN 'NULL' THEN 'None' ELSE substr(trim(json_extract_string(d, '$.raw.' || x)), 1, 2000) END)), ';') END"""


@query(f"{ANSWERS} SELECT seq, CAST(status AS INTEGER) AS status, code, error, error IS NULL AS accepted, CASE WHEN error IS NULL THEN cond END AS condition, CASE WHEN error IS NULL THEN price END AS price_cents, CASE WHEN error IS NULL AND was > price THEN was END AS was_cents, {_RAW} AS raw, key FROM a")
def capture_stream(spark, sf_dir):
    """Posts from a stream: answered, split into accepted rows and dead letters, read from the store."""
    where = _checkpoint(spark)
    made = answered(posts(table_stream(spark, sf_dir, "pages")), TOKEN, F.lit(NOW).cast("timestamp"))
    start_split(made, F.col("error"), f"{where}/store", f"{where}/progress").awaitTermination()
    done = stored_split(spark, f"{where}/store")
    good = lambda c: F.when(F.col("accepted"), c)
    raw = F.array_join(F.array_sort(F.transform(F.map_entries("raw"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return done.select("seq", "status", "code", "error", "accepted", good(F.col("condition")).alias("condition"), good(F.col("current_cents")).alias("price_cents"), good(F.col("was_cents")).alias("was_cents"), good(raw).alias("raw"), good(F.col("idempotency_key")).alias("key"))


@query(
    f"""{ANSWERS}, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(stamp, TIMESTAMP '{NOW}'), seq) AS n FROM a WHERE error IS NULL)
    SELECT seq, key, CASE WHEN s.known_id IS NOT NULL THEN s.known_id ELSE 'cap_' || substr(sha256(key), 1, 16) END AS pub_id, n = 1 AND s.known_id IS NULL AS created
    FROM b LEFT JOIN (SELECT DISTINCT 'sender-' || page_id % 10 || '-key' AS k, 'old_' || page_id % 10 AS known_id FROM pages WHERE page_id % 10 < 4) AS s ON s.k = b.key"""
)
def capture_insert(spark, sf_dir):
    """Accepted captures against those stored: replays of a key get its id and are not created."""
    last = F.col("page_id") % 10
    stored = table(spark, sf_dir, "pages").where(last < 4).select(F.concat(F.lit("sender-"), last.cast("string"), F.lit("-key")).alias("idempotency_key"), F.concat(F.lit("old_"), last.cast("string")).alias("pub_id")).distinct()
    good = answered(posts(table(spark, sf_dir, "pages")), TOKEN, F.lit(NOW).cast("timestamp")).where("error is null")
    return insert_captures(stored, good).select("seq", F.col("idempotency_key").alias("key"), "pub_id", "created")
