"""Run the tables of a parameter file: ``spark-submit … -m tidemark``, or ``python -m tidemark``.

    python -m tidemark FILE ROOT --workflow NAME [--url JDBC_URL] [--option KEY=VALUE …] [--report FOLDER]

Without a URL, tables are read from the catalog. The password is best given in
the environment: ``--option password=$VARIABLE`` names a variable, not a value,
if it is written ``password=env:VARIABLE``. The exit code is 0 if all tables ran.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tidemark.plans.chain import RunFailed, run_file
from tidemark.sources.jdbc import JdbcSource
from tidemark.spec import Layout


def _option(text: str) -> tuple[str, str]:
    key, equals, value = text.partition("=")
    if not equals:
        raise argparse.ArgumentTypeError(f"{text!r} is not KEY=VALUE")
    return key, os.environ[value.removeprefix("env:")] if value.startswith("env:") else value


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description="Pull and load the tables of a parameter file.")
    parser.add_argument("file", help="parameter file (JSON)")
    parser.add_argument("root", help="root folder of the lake")
    parser.add_argument("--workflow", required=True)
    parser.add_argument("--url", help="JDBC URL of the source database")
    parser.add_argument("--option", type=_option, action="append", default=[], metavar="KEY=VALUE",
                        help="JDBC option; a value env:NAME is read from the environment")
    parser.add_argument("--report", help="folder for the validation report")
    given = parser.parse_args(arguments)
    source = JdbcSource(given.url, dict(given.option)) if given.url else None
    spark = SparkSession.builder.appName(f"tidemark-{given.workflow}").getOrCreate()
    try:
        results = run_file(spark, given.file, Layout(given.root), given.workflow, source, given.report)
    except RunFailed as failed:
        results = failed.results
    except ValueError as invalid:
        print(invalid, file=sys.stderr)
        return 2
    for r in results:
        print(f"{r.source}\tpulled {r.rows_pulled}\tloaded {r.rows_loaded}\t{','.join(r.modes) or '-'}\t{r.error or 'ok'}")
    return int(any(r.error is not None for r in results))


if __name__ == "__main__":
    sys.exit(main())
