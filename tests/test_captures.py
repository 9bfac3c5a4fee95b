"""Posted captures of every kind, replays of keys, and streams that set bad rows aside."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import captures
from tidemark.sources.files import table_stream
from tidemark.streaming import quarantine

def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


GOOD = {"product_url": "https://shop.example.com/p", "title_raw": "T", "current_price_cents": 500}


def answer(spark, bodies):
    rows = [(k, b if isinstance(b, str | None) else json.dumps(b)) for k, b in enumerate(bodies)]
    posts = spark.createDataFrame(rows, "seq long, body string").withColumn("authorization", F.lit("Bearer t"))
    return sorted(captures.answered(posts, "t", now()).collect(), key=lambda r: r.seq)


@pytest.fixture(scope="module")
def answers(spark):
    bodies = [
        GOOD, GOOD | {"product_url": None}, GOOD | {"product_url": ""}, GOOD | {"product_url": "https://a.b/" + "x" * 2048}, GOOD | {"product_url": "https://a.b/\t"}, GOOD | {"product_url": "https://a.b/\x7f"},
        GOOD | {"title_raw": None}, GOOD | {"title_raw": 5}, GOOD | {"variant_label_raw": 5}, GOOD | {"retailer_hint": {}}, GOOD | {"currency": "EURO"}, GOOD | {"current_price_cents": None},
        GOOD | {"current_price_cents": 0}, GOOD | {"current_price_cents": 10**19}, GOOD | {"current_price_cents": 1e3}, GOOD | {"raw": "text"}, GOOD | {"raw": {"": 1}}, GOOD | {"raw": {}}, GOOD | {"idempotency_key": 5}, None, "", "null", "5", "\ud83d",
    ]
    return answer(spark, [b.encode("utf-8", "replace").decode() if isinstance(b, str) else b for b in bodies])


def test_errors(answers):
    assert [r.error for r in answers] == [
        None, "product_url_missing", "product_url_missing", "product_url_too_long", "product_url_control_chars", None, "title_missing", "title_missing", "variant_label_invalid", "retailer_hint_invalid", "currency_invalid",
        "current_price_invalid", "current_price_invalid", "current_price_invalid", "current_price_invalid", "raw_invalid", "raw_invalid", None, "idempotency_key_invalid", "body_not_json", "body_not_json", "body_not_object", "body_not_object", "body_not_json",
    ]
    assert {r.status for r in answers if r.error} == {400} and answers[0].status == 202


def test_what_is_kept(spark):
    raw = {"k": "v\u0301\x07 ", "n": None, "f": 1.0, "l": [1, "a"], "o": {"x": True}, "t": "y" * 3000}
    got = answer(spark, [GOOD | {"title_raw": " " + "t" * 600, "variant_label_raw": "x" * 400, "retailer_hint": "h" * 200, "was_price_cents": 400, "condition": " used ", "captured_at": "2024-04-30T23:00:00+02:00", "raw": raw}])[0]
    assert (got.title, got.variant_label, got.retailer_hint, got.was_cents, got.condition) == ("t" * 500, "x" * 300, "h" * 100, None, "USED_UNGRADED")
    assert got.raw == {"k": "v\u0301", "n": "None", "f": "1.0", "l": "[1, 'a']", "o": "{'x': True}", "t": "y" * 2000}
    assert got.captured_at == datetime(2024, 4, 30, 21)
    same = [answer(spark, [GOOD | {"captured_at": f"2024-04-30T10:00:{s}Z"}])[0].idempotency_key for s in ("05", "55")]
    assert same[0] == same[1]


def test_rate_and_order_of_answers(spark):
    rows = [(k, "c", datetime(2024, 5, 1) + timedelta(seconds=k), None if k == 3 else "Bearer t", "x" * (40000 if k == 4 else 1)) for k in range(40)]
    posts = spark.createDataFrame(rows, "seq long, client string, received_at timestamp, authorization string, body string")
    assert captures.within_rate(posts).where("not admitted").count() == 10
    got = {r.seq: (r.status, r.code) for r in captures.answered(posts, "t", now()).collect()}
    assert (got[3], got[4], got[5]) == ((401, "UNAUTHORIZED"), (413, "PAYLOAD_TOO_LARGE"), (400, "VALIDATION_ERROR"))


def test_replayed_keys_are_not_created(spark):
    batch = spark.createDataFrame([(1, "a", datetime(2024, 1, 2)), (2, "a", datetime(2024, 1, 1)), (3, "b", datetime(2024, 1, 1)), (4, None, None), (5, None, None)], "seq long, idempotency_key string, captured_at timestamp")
    stored = spark.createDataFrame([("b", "old")], "idempotency_key string, pub_id string")
    got = {r.seq: (r.created, r.pub_id) for r in captures.insert_captures(stored, batch).collect()}
    assert {k: c for k, (c, _) in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    assert got[1][1] == got[2][1] and got[3][1] == "old" and got[4][1] != got[5][1]


def test_bad_rows_are_set_aside_and_counted(spark, tmp_path):
    for part in range(3):
        spark.createDataFrame([(f"{k}" if k % 4 else "bad",) for k in range(10 * part, 10 * part + 10)], "n string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    reason = F.when(F.col("n").try_cast("int").isNull(), "not_a_number")
    for _ in range(2):
        run = quarantine.start_split(stream, reason, str(tmp_path / "store"), str(tmp_path / "ck"))
        run.awaitTermination()
        found = quarantine.counts(run)
    done = quarantine.stored_split(spark, str(tmp_path / "store"))
    assert done.count() == 30 and {(r.reason, r["count"]) for r in done.groupBy("reason").count().collect()} == {(None, 22), ("not_a_number", 8)}
    assert found == {"seen": 0, "set_aside": 0} or found["seen"] == 0
    first = quarantine.start_split(stream, reason, str(tmp_path / "again"), str(tmp_path / "ck2"))
    first.awaitTermination()
    assert quarantine.counts(first) == {"seen": 30, "set_aside": 8}


def test_tables_stream_from_a_file_and_from_a_folder(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "n")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "t.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "file" / "t.parquet")
    for kind in ("folder", "file"):
        run = quarantine.start_split(table_stream(spark, str(tmp_path / kind), "t"), F.lit(None).cast("string"), str(tmp_path / kind / "store"), str(tmp_path / kind / "ck"))
        run.awaitTermination()
        assert sorted(r.n for r in quarantine.stored_split(spark, str(tmp_path / kind / "store")).collect()) == list(range(5))
