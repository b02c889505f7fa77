"""Command line: ``spark-submit -m mergewell.cli --csv FILE --resume FILE``. Exit 0: valid, 1: invalid or bad input, 2: other errors."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from mergewell import __version__


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mergewell", description="Merge a candidate's records from several sources into one profile.")
    p.add_argument("--csv", help="recruiter CSV file")
    p.add_argument("--resume", help="résumé (PDF)")
    p.add_argument("--config", help="projection config (JSON)")
    p.add_argument("--output-dir", default="output")
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    p.add_argument("--quiet", action="store_true", help="errors only")
    p.add_argument("--version", action="version", version=__version__)
    return p


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = build_parser()
    a = p.parse_args(argv)
    if not (a.csv or a.resume):
        p.error("give --csv, --resume or both")
    for path in (a.csv, a.resume, a.config):
        if path and not os.path.exists(path):
            p.error(f"no such file: {path}")
    return a


def configure_logging(level: str = "INFO", quiet: bool = False) -> None:
    logging.basicConfig(level=logging.ERROR if quiet else getattr(logging, level), format="%(asctime)s %(levelname)-8s %(name)s: %(message)s", force=True)


def main(argv: list[str] | None = None) -> int:
    a = parse_args(argv)
    configure_logging(a.log_level, a.quiet)
    log = logging.getLogger("mergewell")
    from pyspark.sql import SparkSession

    from mergewell.plans.pipeline import Pipeline, PipelineInput

    try:
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        out = Pipeline(spark).run(PipelineInput(a.csv, a.resume, a.config, a.output_dir), None if a.quiet else lambda m, n: log.info("%3d%% %s", n, m))
    except ValueError as e:
        log.error("%s", e)
        return 1
    except Exception as e:
        log.exception("%s", e)
        return 2
    for w in out.warnings:
        log.warning("%s", w)
    for name, path in out.paths.items():
        log.info("%s: %s", name, path)
    return 0 if out.is_valid else 1


if __name__ == "__main__":
    sys.exit(main())
