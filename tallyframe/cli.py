"""python -m tallyframe.cli --input FILES... [--out FOLDER] [--run-id NAME] [--profile-only]"""

from __future__ import annotations

import argparse
import json

from tallyframe import pipeline
from tallyframe.session import get_session
from tallyframe.sources import readers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyframe", description="Ranked findings from messy tables.")
    p.add_argument("--input", nargs="+", required=True, help="paths or globs of CSV, JSON, NDJSON or Parquet files")
    p.add_argument("--out", default="artifacts", help="folder of the runs")
    p.add_argument("--run-id", default="cli_run")
    p.add_argument("--profile-only", action="store_true", help="print the profile and stop")
    a = p.parse_args(argv)
    spark = get_session()
    if a.profile_only:
        paths = readers.expand(spark, a.input)
        print(json.dumps(pipeline.build_profile(readers.load_files(spark, paths), paths), indent=2, default=str))
        return 0
    state = pipeline.run(spark, a.input, a.out, a.run_id)
    print(f"{state.folder}\n{state.headline or 'no headline'}\n{state.results['report']['path']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
