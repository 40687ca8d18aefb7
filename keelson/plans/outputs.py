"""Files of a run: the bill of materials, the report, the evidence pack. What reaches the driver is bounded, except where a format is one file."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import inventory, risk

REPORT_ROWS = 40


def write_components(assets: DataFrame, directory: str, include_low: bool = False) -> None:
    """The components as JSON lines, sorted by reference over all files; of any size."""
    inventory.components(assets, include_low).orderBy("bom_ref", "run_id").write.mode("overwrite").json(directory)


def bill_of_materials(assets: DataFrame, run_id: str, path: str, include_low: bool = False) -> None:
    """One CycloneDX 1.7 document of one run, streamed row by row; the same input gives the same bytes."""
    comps = inventory.components(assets.filter(F.col("run_id") == run_id), include_low)
    serials = inventory.serial(comps).limit(1).collect()
    head = {"$schema": "http://cyclonedx.org/schema/bom-1.7.schema.json", "bomFormat": "CycloneDX", "specVersion": "1.7", "serialNumber": serials[0]["serial"] if serials else None, "version": 1, "metadata": {"timestamp": "1970-01-01T00:00:00Z"}}
    row = comps.orderBy("bom_ref").select(F.to_json(F.struct(F.col("bom_ref").alias("bom-ref"), "type", "name", "description", "properties"))).toLocalIterator()
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.write(json.dumps(head)[:-1] + ', "components": [')
        for i, r in enumerate(row):
            out.write(("," if i else "") + "\n" + r[0])
        out.write("\n]}\n")


def load_components(spark, path: str) -> DataFrame:
    """bom_ref, type, name, properties (a map) of a document's components of the two types that count."""
    doc = spark.read.option("multiLine", True).json(path)
    c = doc.select(F.explode("components").alias("c"))
    props = F.map_from_entries(F.transform("c.properties", lambda p: F.struct(p["name"], p["value"])))
    return c.select(F.col("c.bom-ref").alias("bom_ref"), "c.type", "c.name", props.alias("properties")).filter(F.col("type").isin("cryptographic-asset", "library"))


def shorten(c, most: int = 44):
    return F.when(F.length(c) > most, F.concat(F.lit("..."), F.substring(c, -(most - 3), most - 3))).otherwise(c)


def report(queue: DataFrame, errors: DataFrame, path: str) -> None:
    """Markdown with the head of the queue, counts by tier and the latest errors; each part is bounded by REPORT_ROWS."""
    top = risk.ordered(queue).limit(REPORT_ROWS).select("name", shorten(F.col("target_id")).alias("target"), "tier", "targets", F.coalesce("recommended", F.lit("-")).alias("recommended"), "cost_bytes").collect()
    tiers = {r["tier"]: r["n"] for r in queue.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    latest = errors.orderBy(F.col("reported_at").desc(), "error_id").limit(REPORT_ROWS).collect()
    total = sum(tiers.values())
    lines = ["# Migration queue", "", *[f"- {t}: {tiers.get(t, 0)}" for t in ("critical", "high", "medium", "low", "pq-safe")], "", "| # | asset | target | tier | reach | to | bytes |", "|-|-|-|-|-|-|-|"]
    lines += [f"| {i} | {r['name']} | {r['target']} | {r['tier']} | {r['targets']} | {r['recommended']} | {r['cost_bytes']} |" for i, r in enumerate(top, 1)]
    lines += ["", f"{max(0, total - len(top))} more are not shown.", "", "## Errors", ""] + [f"- {r['target_id']}: {r['phase']}: {r['reason']}" for r in latest]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8", newline="\n")


def evidence_pack(directory: str, path: str) -> None:
    """A zip of a run's files with their digests in pack.json; members have fixed times, so equal files give equal packs."""
    files = sorted(p for p in Path(directory).rglob("*") if p.is_file() and p.resolve() != Path(path).resolve())
    sums = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            name = p.relative_to(directory).as_posix()
            h = hashlib.sha256()
            with p.open("rb") as src, z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as out:
                while block := src.read(1 << 20):
                    h.update(block)
                    out.write(block)
            sums[name] = h.hexdigest()
        z.writestr(zipfile.ZipInfo("pack.json", (1980, 1, 1, 0, 0, 0)), json.dumps({"files": sums}, indent=2, sort_keys=True))
