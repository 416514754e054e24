"""python -m litsieve validate|info|run DEFINITION.yml [--out PATH] [--resume] [--dry-run]"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="litsieve")
    parser.add_argument("command", choices=["validate", "info", "run"])
    parser.add_argument("definition")
    parser.add_argument("--out", help="where run writes the table, as Parquet")
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--dry-run", action="store_true", help="run all steps, keep none of their results")
    args = parser.parse_args(argv)
    import yaml

    from .plans import pipeline
    from .plans.definition import Definition

    with open(args.definition, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if wrong := pipeline.validate(raw):
        print("\n".join(wrong))
        return 1
    if args.command == "validate":
        print("valid")
    elif args.command == "info":
        definition = Definition.from_mapping(raw)
        print("\n".join([definition.name, *definition.describe()]))
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        if args.dry_run:
            raw["steps"] = [s | {k: {**(s[k] or {}), "dry_run": True} for k in s if k.startswith("builtin.")} for s in raw["steps"]]
        df, ctx = pipeline.run(spark, raw, resume=args.resume)
        for r in ctx.log:
            print(f"{r.status:8} {r.name} {r.message}".rstrip())
        print(pipeline.metrics(df))
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
