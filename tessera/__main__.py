"""Command line: ``spark-submit tessera/__main__.py [options] file`` (or ``python -m tessera``).

The session and its master are those that spark-submit, the environment or a configuration file names; only where none does, it is a
local one of ``-t`` threads.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

if __package__ in (None, ""):  # run as a file
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark import SparkConf  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.config import Settings, parser, settings_of  # noqa: E402
from tessera.plans import archive  # noqa: E402
from tessera.sources import lines as src  # noqa: E402
from tessera.sources import portable  # noqa: E402


def session(settings: Settings) -> SparkSession:
    """The session in use, or a new one; local only if no master is named anywhere."""
    builder = SparkSession.builder.appName("tessera")
    # A JVM that spark-submit has started knows its settings; before, only the environment and files do.
    named = "PYSPARK_GATEWAY_PORT" in os.environ or SparkConf().contains("spark.master") or "SPARK_REMOTE" in os.environ
    if SparkSession.getActiveSession() is None and not named:
        builder = builder.master(f"local[{settings.threads}]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = settings_of(args)
    except ValueError as e:
        parser().error(str(e))
    spark = session(settings)
    began = last = time.time()

    def step(name: str) -> None:
        nonlocal last
        now = time.time()
        print(f"{name}: {(now - last) * 1000:.0f} ms")
        last = now

    if args.restore:
        lines = archive.read(spark, args.file).select("row_no", F.coalesce("line", F.lit("")).alias("value"))
        lines.repartitionByRange("row_no").sortWithinPartitions("row_no").select("value").write.option("lineSep", "\n").text(settings.output)
        step("restore")
    else:
        lines = src.text_lines(spark, args.file, settings.chunk_lines)
        archive.write(lines, settings.output, settings, step)
        if args.legacy:
            portable.export(portable.write_archives(lines, settings), f"{settings.output}/portable")
            step("portable")
    print(f"total: {(time.time() - began) * 1000:.0f} ms")
    return 0


if __name__ == "__main__":
    sys.exit(main())
