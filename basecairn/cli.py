"""Command line: compress, decompress, scramble, info, check.

A source or target that is missing or "-" is standard input or output, which pass through a temporary folder of this machine:
so they need a session whose tasks run here.
"""

from __future__ import annotations

import argparse
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

VERSION = "2"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="basecairn", description="FASTQ archives on Spark")
    p.add_argument("command", choices=["compress", "decompress", "scramble", "info", "check"])
    p.add_argument("source", nargs="?", default="-", help="path, or - for standard input (default)")
    p.add_argument("target", nargs="?", default="-", help="path, or - for standard output (default)")
    p.add_argument("-c", "--stdout", action="store_true", help="write to standard output")
    p.add_argument("-b", "--block-records", type=int, default=100_000, help="records in a block")
    p.add_argument("-w", "--workers", type=int, default=0, help="local task slots (default: all cores)")
    p.add_argument("--seed", default="0", help="seed of scramble")
    p.add_argument("--magic", action=argparse.BooleanOptionalAction, default=True, help="know gzip files by their first bytes as well as by .gz")
    p.add_argument("--mode", choices=["strict", "lenient"], default="strict")
    p.add_argument("--paired", action="store_true", help="set the flag of paired reads")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def _to_stdout(path: Path) -> None:
    """A file, or the part files of a folder in order."""
    for part in sorted(path.glob("part-*")) if path.is_dir() else [path]:
        with part.open("rb") as f:
            shutil.copyfileobj(f, sys.stdout.buffer)
    sys.stdout.buffer.flush()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from .plans import archive
    from .sources import fastq

    active = SparkSession.getActiveSession()
    spark = active or SparkSession.builder.master(f"local[{a.workers or '*'}]").appName("basecairn").getOrCreate()
    try:
        piped = a.command in ("compress", "decompress", "scramble") and (a.stdout or a.target == "-")
        if (piped or a.source == "-") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("standard input and output need a local session")
        with tempfile.TemporaryDirectory(prefix="basecairn-") as folder:
            source, target = a.source, f"{folder}/target" if piped else a.target
            if source == "-":
                source = f"{folder}/source"
                with open(source, "wb") as f:
                    shutil.copyfileobj(sys.stdin.buffer, f)
            if a.command == "compress":
                archive.compress(spark, source, target, a.block_records, a.magic, a.mode, paired=a.paired)
            elif a.command == "decompress":
                archive.decompress(spark, source, target)
            elif a.command == "scramble":
                fastq.write_fastq(archive.scramble(fastq.read_fastq(spark, source, a.mode, a.block_records, a.magic), a.seed), target)
            elif a.command == "info":
                archive.info(spark, source).show(1_000_000, truncate=False)
            else:
                print(archive.check(spark, source))
            if piped:
                _to_stdout(Path(target))
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if not active:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
