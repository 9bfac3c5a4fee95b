"""File sources and sinks: tables, snapshots, fixtures and the versioned document export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over as many partitions as a shuffle has: a small file whose rows take long is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of part files.

    The name is given as a pattern that only it fits: a stream takes a pattern's finds as they are,
    where a plain path must be a folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def snapshot_ref(at: Column, task_id: Column, body: Column) -> Column:
    """``UTC stamp to the microsecond-task-digest.gz`` of a raw body."""
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmssSSSSSS'Z'")
    return F.concat(stamp, F.lit("-task"), task_id.cast("string"), F.lit("-"), F.substring(F.sha2(body.cast("binary"), 256), 1, 16), F.lit(".gz"))


def fixture_pages(spark: SparkSession, requests: DataFrame, manifest: DataFrame, bodies: str) -> DataFrame:
    """Responses for requests (url) from a manifest (url, file) of stored bodies; others are 404."""
    files = spark.read.format("binaryFile").load(bodies).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("body"))
    return requests.join(manifest, "url", "left").join(files, "file", "left").select("url", F.when(F.col("body").isNull(), 404).otherwise(200).alias("status"), "body")


def newest_versions(files: DataFrame, keep: int = 5) -> DataFrame:
    """Files (path, modified) that pruning removes: all but the newest ``keep``.

    The listing of versions is small; the newest are a top-k and the rest an anti-join.
    """
    kept = files.orderBy(F.desc("modified"), "path").limit(keep)
    return files.join(kept.select("path"), "path", "left_anti")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def export_versioned(documents: dict[str, DataFrame], meta: DataFrame, root: str, version: str, promote: bool = True) -> str:
    """Writes document tables as JSON under ``root/exports/version`` and, if promoted, under
    ``root/latest``; meta goes last in both, so a reader that finds it finds the rest. Any file
    system that Spark writes to will do, object stores included."""
    spark = meta.sparkSession
    base = f"{root}/exports/{version}"
    for name, df in documents.items():
        df.write.mode("overwrite").json(f"{base}/{name}")
    meta.coalesce(1).write.mode("overwrite").json(f"{base}/meta")
    if promote:
        fs, jvm = _fs(spark, root)
        path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in (*documents, "meta"):
            target = path(f"{root}/latest/{name}")
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(f"{base}/{name}"), fs, target, False, conf)
    return base


def read_latest(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame | None:
    """The promoted documents, or None where there are none."""
    fs, jvm = _fs(spark, root)
    where = f"{root}/latest/{name}"
    return spark.read.schema(schema).json(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(where)) else None


def prune_versions(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Deletes all but the newest versions; their names."""
    fs, jvm = _fs(spark, root)
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/exports")
    if not fs.exists(base):
        return []
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(base)), reverse=True)
    for _, name in found[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/exports/{name}"), True)
    return [name for _, name in found[keep:]]


def sink_root(env: dict[str, str]) -> str:
    """Where documents go: a local folder or an object store, by EXPORT_TARGET."""
    target = env.get("EXPORT_TARGET", "local")
    if target == "local":
        return env.get("EXPORT_DIR", "exports")
    if target == "s3":
        return f"s3a://{env['EXPORT_BUCKET']}/{env.get('EXPORT_PREFIX', '').strip('/')}".rstrip("/")
    raise ValueError(f"unknown export target {target!r}")


def read_feed(spark: SparkSession, root: str, schema: str, version: int = 2) -> DataFrame:
    """The promoted deals; fails if their head is missing or of another schema version."""
    meta = read_latest(spark, root, "meta", "schema_version int")
    found = meta.first() if meta is not None else None
    if found is None or found.schema_version != version:
        raise ValueError(f"feed has schema version {found and found.schema_version}, not {version}")
    return read_latest(spark, root, "deals", schema)


def dimension(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A small dimension from a YAML file: the list, or the map's entries, under ``key``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = yaml.safe_load(f)[key]
    if isinstance(entries, dict):
        entries = [{"name": k, **v} if isinstance(v, dict) else {"name": k, "value": v} for k, v in entries.items()]
    names = [c.strip().split(" ")[0].split(":")[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], schema)


def run_summary(counts: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of several frames as one frame."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
