"""A run's journal: sightings and errors as JSON lines, a manifest, replay, resume and a streaming tail."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCATION = "struct<surface:string,path:string,line:int,byte_offset:bigint,layer_digest:string,endpoint:string>"
_EVIDENCE = "array<struct<tier:string,matcher_id:string,snippet:string,detail:map<string,string>>>"
SIGHTING = (
    "seq bigint, run_id string, target_id string, asset_kind string, name string, primitive string, parameters map<string,string>, oid string, functions array<string>, library string, collector string, "
    f"confidence double, location {_LOCATION}, evidence {_EVIDENCE}, observed_at timestamp"
)
ERROR = "target_id string, collector string, phase string, reason string, path string"
REQUIRED = ("target_id", "asset_kind", "name", "collector", "location")
# Vocabularies of a sighting.
KINDS = ("algorithm", "certificate", "protocol", "related-crypto-material", "library")
SURFACES = ("source", "elf", "container", "tls")


def write_sightings(df: DataFrame, directory: str, mode: str = "append") -> None:
    """Append sightings as JSON lines; a row is one line, so a broken tail costs one row."""
    df.write.mode(mode).json(f"{directory}/findings")


def _parsed(lines: DataFrame, schema: str, required: Iterable[str]) -> DataFrame:
    parsed = lines.select(F.from_json("value", schema + ", __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r")).select("r.*")
    keep = F.col("__broken").isNull()
    for c in required:
        keep = keep & F.col(c).isNotNull()
    return parsed.filter(keep).drop("__broken")


def replay(spark: SparkSession, directory: str) -> DataFrame:
    """The sightings of a journal. Blank and broken lines, lines that lack a required key and unknown kinds or surfaces are left out."""
    rows = _parsed(spark.read.text(f"{directory}/findings"), SIGHTING, REQUIRED)
    return rows.filter(F.col("asset_kind").isin(*KINDS) & F.col("location.surface").isin(*SURFACES))


def tail(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    """The journal as a stream of sightings."""
    rows = _parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(f"{directory}/findings"), SIGHTING, REQUIRED)
    return rows.filter(F.col("asset_kind").isin(*KINDS) & F.col("location.surface").isin(*SURFACES))


def replay_errors(spark: SparkSession, directory: str) -> DataFrame:
    return _parsed(spark.read.text(f"{directory}/errors"), ERROR, ("target_id", "phase"))


def manifest(targets: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """target_id, content_hash, status, findings, errors of the targets of a run."""
    f = findings.groupBy("target_id").agg(F.count(F.lit(1)).alias("findings"))
    e = errors.groupBy("target_id").agg(F.count(F.lit(1)).alias("errors"))
    j = targets.join(f, "target_id", "left").join(e, "target_id", "left")
    n = F.coalesce("errors", F.lit(0))
    return j.select("target_id", "content_hash", F.when(n > 0, "error").otherwise("complete").alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"), n.alias("errors"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old manifest rows with those of new, which replace them."""
    return old.join(new, "target_id", "left_anti").unionByName(new)


def to_scan(targets: DataFrame, done: DataFrame) -> DataFrame:
    """The targets that no complete row of done has with the same hash."""
    complete = done.filter("status = 'complete'").select(F.col("target_id").alias("t"), F.col("content_hash").alias("h"))
    return targets.join(complete, (F.col("target_id") == F.col("t")) & F.col("content_hash").eqNullSafe(F.col("h")), "left_anti")


def content_hashes(files: DataFrame) -> DataFrame:
    """target_id, content_hash: a digest of each target's files, of their paths and bytes, in 4096 blocks so that no task holds a target."""
    one = files.select("target_id", "path", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("h")).select("target_id", F.sha2(F.concat_ws("\n", "path", "h"), 256).alias("h"))
    blocks = one.groupBy("target_id", F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return blocks.groupBy("target_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("content_hash"))


def save_manifest(path: str, rows: Iterable[dict], **about: object) -> None:
    Path(path).write_text(json.dumps({**about, "targets": list(rows)}, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    targets = json.loads(Path(path).read_text(encoding="utf-8")).get("targets", [])
    schema = T.StructType([T.StructField(n, t) for n, t in (("target_id", T.StringType()), ("content_hash", T.StringType()), ("status", T.StringType()), ("findings", T.LongType()), ("errors", T.LongType()))])
    return spark.createDataFrame([tuple(t.get(f.name) for f in schema) for t in targets], schema)
