"""Command line: register, write, validate, query, check, describe, list, publish, unpublish, budget.

Exit codes: 0 done, 1 an error, 2 refused.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from pactspark.plans.contract import ContractError
from pactspark.plans.engine import BudgetExceeded, Denied, Engine, GuaranteeFailed, NotFound, Violated
from pactspark.plans.guard import Refused
from pactspark.sources import formats

FORMATS = ("table", "json", "csv", *formats.FORMATS)
REFUSALS = (Refused, Denied, NotFound, Violated, GuaranteeFailed, BudgetExceeded)


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pactspark", description=__doc__)
    top.add_argument("--root", default=".", help="the folder of contracts, manifests and data")
    top.add_argument("--caller", default="{}", help="the caller as JSON: id, tenant, purpose, roles")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("register").add_argument("document", help="a contract as a JSON file")
    write = verbs.add_parser("write")
    write.add_argument("name")
    write.add_argument("rows", help="a Parquet or CSV file or folder")
    write.add_argument("--append", action="store_true")
    write.add_argument("--on-violation", default="refuse", choices=("refuse", "exclude", "warn"))
    verbs.add_parser("validate").add_argument("name")
    query = verbs.add_parser("query")
    query.add_argument("sql")
    query.add_argument("--format", default="table", choices=FORMATS)
    query.add_argument("--out", help="the file that takes the answer; needed for arrow and parquet")
    query.add_argument("--envelope", action="store_true")
    verbs.add_parser("check").add_argument("sql")
    verbs.add_parser("describe").add_argument("name")
    verbs.add_parser("list")
    for verb in ("publish", "unpublish"):
        one = verbs.add_parser(verb)
        one.add_argument("name")
        one.add_argument("to")
    verbs.add_parser("budget")
    return top


def run(spark: SparkSession, argv: list[str]) -> object:
    """What a command prints: text, or a value that goes out as JSON."""
    at = _arguments().parse_args(argv)
    engine, caller = Engine.open(spark, str(Path(at.root).resolve())), json.loads(at.caller)
    if at.verb == "register":
        return engine.register(json.loads(Path(at.document).read_text())).name
    if at.verb == "write":
        rows = spark.read.option("header", True).option("inferSchema", True).csv(at.rows) if at.rows.endswith(".csv") else spark.read.parquet(at.rows)
        done = engine.write(at.name, rows, "append" if at.append else "overwrite", at.on_violation, caller)
        return {"rows": done["rows"], "broken": done["broken"]}
    if at.verb == "validate":
        return engine.validate(at.name)
    if at.verb == "query":
        if at.format in ("arrow", "parquet") and not at.out:
            raise ValueError(f"{at.format} needs --out")
        table, envelope = engine.query_with_envelope(at.sql, caller)
        texts = {"table": lambda: table.to_pandas().to_string(index=False), "csv": lambda: table.to_pandas().to_csv(index=False), "json": lambda: json.dumps(table.to_pylist(), default=str)}
        body = texts[at.format]().encode() if at.format in texts else formats.as_bytes(table, at.format)
        if at.out:
            formats.write_file(at.out, body)
            return json.dumps(envelope) if at.envelope else at.out
        return body.decode() + ("\n" + json.dumps(envelope) if at.envelope else "")
    if at.verb == "check":
        return engine.check(at.sql, caller)
    if at.verb == "describe":
        return engine.describe(at.name, caller)
    if at.verb == "list":
        return engine.names(caller)
    if at.verb == "budget":
        return {b: spent for (b, who), spent in engine.budgets.spent.items() if who == f"{caller.get('tenant')}/{caller.get('id')}"}
    getattr(engine, at.verb)(at.name, at.to)
    return at.name


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("pactspark").getOrCreate()
    try:
        out = run(spark, sys.argv[1:] if argv is None else argv)
    except REFUSALS as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2
    except (ContractError, LookupError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
