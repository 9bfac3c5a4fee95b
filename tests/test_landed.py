"""Landed bodies as a data source, and the budget of a run."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import work
from tidemark.sources import landed


def test_written_bodies_come_back(spark, tmp_path):
    rows = [(f"r{k}.gz", bytes([k % 256]) * (k * 50)) for k in range(40)] + [("u.gz", "zürich".encode()), (None, b"x"), ("n.gz", None)]
    frame = spark.createDataFrame(rows, "ref string, body binary").repartition(4)
    folder = str(tmp_path / "landed")
    landed.land(frame, folder)
    landed.land(frame.limit(0), folder)
    landed.land(spark.createDataFrame([("r1.gz", b"\x01" * 50), ("more.gz", b"m")], "ref string, body binary"), f"file://{folder}")
    got = {r.ref: (bytes(r.body), r.sha256) for r in landed.landed(spark, folder).collect()}
    assert got == {ref: (body, hashlib.sha256(body).hexdigest()) for ref, body in [*rows[:41], ("more.gz", b"m")]}
    assert gzip.decompress((tmp_path / "landed" / "u.gz").read_bytes()).decode() == "zürich"
    told = [json.loads(p.read_text()) for p in (tmp_path / "landed" / "_commits").iterdir()]
    assert sorted(t["bodies"] for t in told) == [0, 2, 41]
    with pytest.raises(Exception, match="only ever added"):
        frame.withColumn("sha256", F.lit("")).write.format(landed.FORMAT).mode("overwrite").save(folder)


def test_what_no_commit_names_is_not_there(spark, tmp_path):
    folder = str(tmp_path / "landed")
    landed.register(spark)
    assert landed.landed(spark, folder).count() == 0
    bad = spark.range(8).select(F.concat(F.lit("b"), F.col("id").cast("string"), F.lit(".gz")).alias("ref"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("body"))
    with pytest.raises(Exception, match="broken"):
        landed.land(bad, folder)
    assert landed.landed(spark, folder).count() == 0


def test_responses(spark, tmp_path):
    folder = str(tmp_path / "landed")
    landed.land(spark.createDataFrame([("a", b"body")], "ref string, body binary"), folder)
    requests = spark.createDataFrame([("u1", "a", None), ("u2", "b", None), ("u3", None, None), ("u4", "a", "Read timed out"), ("u5", "a", "")], "url string, ref string, error string")
    got = {r.url: (r.status, r.transport, r.body is not None) for r in landed.responses(requests, landed.landed(spark, folder)).collect()}
    assert got == {"u1": (200, None, True), "u2": (404, None, False), "u3": (404, None, False), "u4": (None, "timeout", False), "u5": (None, "connection", False)}


@pytest.mark.parametrize("round_robin", [False, True])
def test_run_budget_against_a_plain_run(spark, round_robin):
    rng = random.Random(3)
    tasks = [(rng.randrange(6), k, rng.choice([1, 2, None]), rng.choice([5, 30, 70])) for k in range(60)]
    rows = [(shop, shop * 5 % 6, k, p, None, cost) for shop, k, p, cost in tasks]
    frame = spark.createDataFrame(rows, "retailer_id int, ord int, task_id int, priority int, not_before timestamp, cost_seconds int")
    mine = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[3] is not None, r[3] or 0, r[2]))[:4] for s in range(6)}
    order = sorted(range(6), key=lambda s: s * 5 % 6)
    clock, expected = 0, {}
    if round_robin:
        for turn in range(4):
            for s in order:
                if turn < len(mine[s]):
                    expected[mine[s][turn][2]] = (turn + 1, clock, clock < 300)
                    clock += mine[s][turn][5]
    else:
        for s in order:
            runs = clock < 300
            for turn, r in enumerate(mine[s]):
                expected[r[2]] = (turn + 1, clock, runs)
                clock += r[5]
    got = {r.task_id: (r.turn, r.starts_at, r.runs) for r in work.run_budget(frame, 4, 300, round_robin).collect()}
    assert got == expected and {r for *_, r in got.values()} == {True, False}


def test_a_task_holds_few_bodies_at_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "landed")
    landed.land(spark.range(30).coalesce(1).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("ref"), F.lit("x" * 100).alias("body")), folder)
    monkeypatch.setattr(landed, "BATCH_BYTES", 1000)
    reader = landed._Reader(folder)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [10, 10, 10]
