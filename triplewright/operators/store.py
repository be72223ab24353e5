"""The edge table in buckets of keys: a batch adds small delta files, readers merge them, compaction folds them in."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import KEY
from .review import first_of

#: Buckets of a new table; it keeps its number.
BUCKETS = 64


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, base: str):
    return _path(spark, base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, base: str) -> dict | None:
    """The last complete manifest: number, buckets, schema, parts (bucket, version, kind, number); None before the first.

    A part is a folder of a version with rows of a bucket, whole (base) or added (delta).
    """
    fs, folder = _files(spark, base), _path(spark, f"{base}/manifests")
    if not fs.exists(folder):
        return None
    for name in sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True):
        with_schema = spark.read.text(f"{base}/manifests/{name}", wholetext=True).first()
        try:
            return json.loads(with_schema[0])
        except (TypeError, ValueError):  # its writer was lost; the one before it holds
            continue
    return None


def _commit(spark: SparkSession, base: str, version: str, change: Callable[[dict | None, int], dict]) -> None:
    """Writes the next manifest; a number that another writer took first is tried again on top of theirs."""
    fs, number = _files(spark, base), 0
    while True:
        last = manifest(spark, base)
        if last and version in last["versions"]:
            raise ValueError(f"version {version} is in use")
        number = max(number + 1, (last["number"] if last else 0) + 1)
        new = change(last, number)
        new |= {"number": number, "versions": (last["versions"] if last else []) + [version]}
        try:
            out = fs.create(_path(spark, f"{base}/manifests/{number:012d}"), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                continue
            raise
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        return


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")


def _write(rows: DataFrame, base: str, version: str, buckets: int) -> list[int]:
    """Writes rows by bucket, in one folder each; the buckets that have rows."""
    spark, rows = rows.sparkSession, rows.withColumn("bucket", _bucket(buckets))
    # a folder that no manifest names is what a failure left
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/data/{version}")
    fs, folder = _files(spark, base), _path(spark, f"{base}/data/{version}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def upsert(edges: DataFrame, base: str, version: str, now: Column, buckets: int = BUCKETS, most_deltas: int = 8) -> list[int]:
    """Merges ``edges`` as merge_edges does, writing only them; the buckets that were rewritten by compaction.

    Of equal edges the first by edge_ord counts. A name of a version is used once, ever: one that a
    manifest has is an error (see ``known``), and what a lost writer left under a name is overwritten.
    Buckets with more than ``most_deltas`` deltas are then compacted.
    """
    spark = edges.sparkSession
    last = manifest(spark, base)
    if last and version in last["versions"]:
        raise ValueError(f"version {version} is in use")
    n = last["buckets"] if last else buckets
    keyed = edges.withColumn("__source", F.coalesce("source", F.lit("")))
    new = first_of(keyed, list(KEY), ["edge_ord"]).withColumns({"created_at": now, "last_updated_at": now})
    if last:
        kind = T.StructType.fromJson(last["schema"])
        new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in kind])
    touched = _write(new, base, version, n)

    def add(before: dict | None, number: int) -> dict:
        parts = [{"bucket": k, "version": version, "kind": "delta", "number": number} for k in touched]
        have = before or {"buckets": n, "schema": new.schema.jsonValue(), "parts": []}
        return {"buckets": have["buckets"], "schema": have["schema"], "parts": have["parts"] + parts}

    _commit(spark, base, version, add)
    return compact(spark, base, most_deltas)


def known(spark: SparkSession, base: str, version: str) -> bool:
    """Whether a manifest has ever had this version."""
    last = manifest(spark, base)
    return bool(last) and version in last["versions"]


def _merged(spark: SparkSession, base: str, state: dict, parts: list[dict]) -> DataFrame:
    """Rows of parts, one a key: properties and created_at of the first, last_updated_at of the last."""
    kind = T.StructType.fromJson(state["schema"])
    by_version: dict[tuple[str, int], list[str]] = {}
    for p in parts:
        by_version.setdefault((p["version"], p["number"]), []).append(f"{base}/data/{p['version']}/bucket={p['bucket']}")
    rows = None
    for (_, number), paths in sorted(by_version.items(), key=lambda x: x[0][1]):
        some = spark.read.schema(kind).parquet(*paths).withColumn("__n", F.lit(number).cast("long"))
        rows = some if rows is None else rows.union(some)
    if rows is None:
        return spark.createDataFrame([], kind)
    rest = [c for c in kind.names if c not in (*KEY, "last_updated_at")]
    found = rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "__n").alias("s"), F.max_by("last_updated_at", "__n").alias("last_updated_at"))
    return found.select(*[F.col(c) if c in (*KEY, "last_updated_at") else F.col(f"s.{c}").alias(c) for c in kind.names])


def read(spark: SparkSession, base: str) -> DataFrame:
    """The edges after all complete versions."""
    state = manifest(spark, base)
    if state is None:
        raise ValueError(f"no version is complete under {base}")
    return _merged(spark, base, state, state["parts"]).drop("__source")


def compact(spark: SparkSession, base: str, most_deltas: int = 8) -> list[int]:
    """Rewrites the buckets with more than so many deltas, each as one part; their numbers."""
    state = manifest(spark, base)
    deltas = Counter(p["bucket"] for p in state["parts"] if p["kind"] == "delta")
    full = sorted(k for k, v in deltas.items() if v > most_deltas)
    if not full:
        return []
    old = [p for p in state["parts"] if p["bucket"] in full]
    version = f"compact-{state['number']}-{len(state['versions'])}"
    while version in state["versions"]:
        version += "x"
    _write(_merged(spark, base, state, old), base, version, state["buckets"])
    upto = max(p["number"] for p in old)

    def swap(before: dict | None, number: int) -> dict:
        if not all(p in before["parts"] for p in old):
            raise ValueError("these buckets were compacted by another writer")
        # what others added meanwhile is newer
        parts = [p for p in before["parts"] if p not in old] + [{"bucket": k, "version": version, "kind": "base", "number": upto} for k in full]
        return {"buckets": before["buckets"], "schema": before["schema"], "parts": parts}

    _commit(spark, base, version, swap)
    return full
