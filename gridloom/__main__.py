"""Command line over a library folder of Parquet tables, built from pictures or given."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.control.requests import FIELDS, RequestError, parse
from gridloom.control.service import Service
from gridloom.operators import library
from gridloom.operators.references import orphan_report
from gridloom.session import build_session, table

#: Commands that are operations of the service, by the names of the command line.
OPERATIONS = {"build": "build", "mosaic": "mosaic", "inspect": "inspect", "db-stats": "stats", "db-health": "health", "db-usage": "usage", "db-purge": "purge", "db-usage-export": "export"}


def _print(df: DataFrame, limit: int) -> None:
    for row in df.limit(limit).toJSON().collect():
        print(row)


def _fields(words: list[str], operation: str) -> dict:
    """--name value pairs as a request body; a name without a value is true."""
    made: dict[str, object] = {}
    kinds = {n: f.kind for name, f in FIELDS[operation].items() for n in (name, *f.other)}
    at = 0
    while at < len(words):
        name = words[at].lstrip("-")
        if not words[at].startswith("--") or name not in kinds:
            raise RequestError(f"unknown option: {words[at]}")
        has = at + 1 < len(words) and not words[at + 1].startswith("--")
        text = words[at + 1] if has else "true"
        kind = kinds[name]
        try:
            made[name] = text if kind is str else text.lower() not in ("0", "false", "no", "off") if kind is bool else kind(text)
        except ValueError:
            raise RequestError(f"{name} must be a number") from None
        at += 1 + has
    return made


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    conf = {"spark.ui.showConsoleProgress": "false"}
    try:
        if args and args[0] in OPERATIONS and all(w.startswith("--") for w in args[1:2]):
            operation = OPERATIONS[args[0]]
            request = parse(operation, json.dumps(_fields(args[1:], operation)))
            service = Service(build_session("*", **conf), start=False)
            if operation in ("build", "mosaic"):
                print(json.dumps(service.run(operation, request)))
                return 0
            status, body = service.call(operation, json.dumps(request))
            print(json.dumps(body), file=sys.stdout if status == 200 else sys.stderr)
            return 0 if status == 200 else body.get("exitCode", 1)
        parser = argparse.ArgumentParser(prog="gridloom", description=__doc__, epilog=f"also: {', '.join(OPERATIONS)} with --field value")
        parser.add_argument("command", choices=["stats", "health", "usage", "unused", "orphans", "inspect"])
        parser.add_argument("folder")
        parser.add_argument("--limit", type=int, default=50, help="rows shown")
        parser.add_argument("--l", type=float, help="L to inspect around")
        parser.add_argument("--cores", default="*")
        given = parser.parse_args(args)
        if given.limit < 1:
            raise RequestError("limit must be at least 1")
        if given.command == "inspect" and given.l is None:
            raise RequestError("inspect needs --l")
    except RequestError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001
        print(json.dumps({"error": str(e).splitlines()[0]}), file=sys.stderr)
        return 2
    spark = build_session(given.cores, **conf)
    t = lambda name: table(spark, given.folder, name)
    try:
        if given.command == "stats":
            _print(library.library_stats(t("images")), 1)
            _print(library.l_histogram(t("images")).orderBy("bin"), 8)
            _print(library.coverage_gaps(t("images")), 5)
        elif given.command == "health":
            _print(library.health_report(t("images"), t("usage_stats")), 1)
        elif given.command == "usage":
            _print(library.top_used(t("usage_stats"), given.limit), given.limit)
        elif given.command == "unused":
            _print(library.unused_images(t("images"), t("usage_stats")), given.limit)
        elif given.command == "orphans":
            _print(orphan_report(t("images"), "id", [("usage_stats", t("usage_stats"), "image_id", "last_used"), ("winners", t("winners"), "image_id", "run_at")]).orderBy("src_table", "period"), given.limit)
        else:
            _print(library.band_join(spark.range(1).select(F.col("id").alias("q"), F.lit(given.l).alias("l")), t("images")), 1)
        return 0
    except Exception as e:  # noqa: BLE001
        print(json.dumps({"error": str(e).splitlines()[0]}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
