"""What the jobs share: configuration, log, command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def shipped(name: str) -> dict[str, Any]:
    """The config file beside a job's module."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def configured(spark: SparkSession, name: str, path: str | None) -> dict[str, Any]:
    """The shipped configuration with what the file at ``path`` sets anew; ValueError for keys that the job doesn't know."""
    base = shipped(name)
    own = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := {*own} - {*base}:
        raise ValueError(f"{path}: unknown {sorted(unknown)}")
    return base | own


def main(name: str, doc: str, paths: tuple[str, ...], run: Callable[..., object], argv: list[str] | None = None) -> None:
    """Runs ``run(spark, *paths, config)`` in a session of its own; each of ``paths`` is an option."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file with settings that differ from the shipped ones")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *(args[p] for p in paths), configured(spark, name, args["config"]))
    finally:
        spark.stop()
