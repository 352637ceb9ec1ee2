"""Command line: run a request file, or look at the catalogue.

    python -m statspark.cli run --input t.parquet --request r.json --output out/
    python -m statspark.cli list | inspect KEY | validate | hash

Exit codes: 0 done, 1 a request or data error, 2 an internal error.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from .model import ErrorCode, OperatorError, Request
from .plans.registry import catalogue, check_catalogue, lookup


def catalogue_hash() -> str:
    """SHA-256 over length-prefixed file names and contents of the package."""
    top = Path(__file__).resolve().parent
    digest = hashlib.sha256()
    for f in sorted(top.rglob("*.py")):
        for part in (f.relative_to(top).as_posix().encode(), f.read_bytes()):
            digest.update(len(part).to_bytes(8, "big") + part)
    return digest.hexdigest()


def describe(key: str) -> dict:
    op = lookup(key)
    slots = [{"id": s.id, "types": sorted(s.types), "labels": sorted(s.labels), "least": s.least, "most": s.most} for s in op.slots]
    return {"key": op.key, "module": op.module, "doc": op.doc, "slots": slots, "parameters": op.parameters, "required": list(op.required), "constraints": [{"kind": c.kind, "slots": list(c.slots), "value": c.value} for c in op.constraints], "produces_data": op.produces_data}


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .runner import run_operation
    from .sources.files import read_table, write_error, write_result

    spark = SparkSession.builder.appName("statspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        raw = "\n".join(r[0] for r in spark.read.text(args.request, wholetext=True).collect())
        try:
            request = Request.from_dict(json.loads(raw))
        except (json.JSONDecodeError, TypeError) as e:
            raise OperatorError(ErrorCode.PARAMETER_ERROR, "request is not valid JSON") from e
        write_result(spark, args.output, run_operation(read_table(spark, args.input), request))
        return 0
    except OperatorError as e:
        write_error(spark, args.output, e)
        return 1
    except Exception:  # the caller must always find a result file, without a stack in it
        write_error(spark, args.output, OperatorError(ErrorCode.INTERNAL_ERROR, "internal error"))
        return 2


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="statspark")
    commands = parser.add_subparsers(dest="command", required=True)
    runner = commands.add_parser("run")
    for name in ("input", "request", "output"):
        runner.add_argument(f"--{name}", required=True)
    commands.add_parser("list")
    commands.add_parser("inspect").add_argument("key")
    commands.add_parser("validate")
    commands.add_parser("hash")
    args = parser.parse_args(argv)
    if args.command == "run":
        return run(args)
    if args.command == "list":
        print("\n".join(sorted(catalogue())))
    elif args.command == "inspect":
        try:
            print(json.dumps(describe(args.key), ensure_ascii=False, indent=1))
        except OperatorError as e:
            print(json.dumps(e.payload()), file=sys.stderr)
            return 1
    elif args.command == "hash":
        print(catalogue_hash())
    else:
        problems = check_catalogue()
        print("\n".join(problems) or f"{len(catalogue())} operators are well declared")
        return 1 if problems else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
