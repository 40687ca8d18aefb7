"""Command line: report, bom, diff and pack over a directory of Parquet tables."""

from __future__ import annotations

import argparse
import sys

from keelson.session import local_session


def main(argv: list[str] | None = None) -> int:
    """0: done; 2: unusable arguments."""
    p = argparse.ArgumentParser(prog="keelson")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, args in {"report": ("tables", "out"), "bom": ("tables", "run", "out"), "diff": ("tables", "out"), "pack": ("directory", "out")}.items():
        s = sub.add_parser(verb)
        for a in args:
            s.add_argument(a)
    a = p.parse_args(argv)
    from keelson.operators import assets, risk, snapshots
    from keelson.plans import outputs
    from keelson.sources import table

    if a.verb == "pack":
        outputs.evidence_pack(a.directory, a.out)
        return 0
    spark = local_session()
    if a.verb == "diff":
        snapshots.snapshot_changes(table(spark, a.tables, "components")).write.mode("overwrite").json(a.out)
        return 0
    merged = assets.merged(table(spark, a.tables, "findings"))
    if a.verb == "bom":
        outputs.bill_of_materials(merged, a.run, a.out)
    else:
        outputs.report(risk.queue(risk.assessed(merged, table(spark, a.tables, "targets")), assets.reach(table(spark, a.tables, "findings").filter("asset_kind <> 'library'"))), table(spark, a.tables, "errors"), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
