"""Command line of the library; ``python -m tesselar COMMAND --help`` describes each command."""

from __future__ import annotations

import argparse
import json
import platform
import sys
from pathlib import Path


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tesselar")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *names: str, **options: dict) -> None:
        one = sub.add_parser(name, help=about, description=about)
        for n in names:
            one.add_argument(n)
        for n, how in options.items():
            one.add_argument(f"--{n.replace('_', '-')}", **how)

    command("version", "print the version")
    command("doctor", "say what a session would run with, and whether it can write where it has to")
    command("list-methods", "list registered methods", category={})
    command("ask", "compile a question into a plan", "question")
    command("query", "run a registered query over a folder of tables", "name", "sf_dir", rows={"type": int, "default": 20})
    command("ingest", "read an assay's export into a bundle", "assay", "path", "out")
    command("inspect-bundle", "print a bundle's manifest", "path")
    command("validate-bundle", "check a bundle's tables against its manifest", "path")
    command("run", "run a plan (a JSON list of category, method, params) over a bundle and write the result", "plan", "bundle", "out")
    command("step", "run one method over a bundle and write the result", "category", "method", "bundle", "out", params={"default": "{}"})
    command("report", "write an HTML page of a bundle's tables", "bundle", "out", title={"default": "Report"})
    command("landscape", "mean scores of a long CSV", "csv", out={})
    command("pareto", "the configurations of each data set that no other dominates", "csv")
    command("stats-review", "signed-rank tests of all pairs of configurations, with corrected p values", "csv")
    for name, about in (("recommend", "rank configurations for a data set"), ("decide", "the decision card of a data set"), ("calibrate", "what to measure next for a data set")):
        command(name, f"{about}, from metadata (Parquet) and a long CSV", "meta", "csv", dataset={"required": True}, prefer={"default": "high"})
    command("share", "check JSON records, one a line, against the privacy gate", "path")
    return parser


def _doctor(spark) -> dict:
    from . import __version__
    from .plans.tables import saved, shared_dir

    found = {"version": __version__, "python": platform.python_version(), "spark": spark.version, "java": spark.sparkContext._jvm.System.getProperty("java.version"), "master": spark.sparkContext.master}
    try:
        found |= {"shared": shared_dir(spark), "writable": saved(spark.range(1), "doctor").count() == 1}
    except Exception as e:  # told, not raised: the command describes what is wrong
        found |= {"writable": False, "error": str(e).splitlines()[0]}
    return found


def _evidence(spark, args):
    """Metadata, means, references, ranking and baseline of one request."""
    from pyspark.sql import functions as F

    from .operators import recommend as R
    from .plans.tables import saved
    from .sources import longtable

    meta = spark.read.parquet(args.meta)
    means = saved(longtable.read_long_csv(spark, args.csv).groupBy("dataset", "config").agg(F.avg("score").alias("score")), "means")
    asked = meta.filter(F.col("dataset") == args.dataset)
    if asked.isEmpty():
        raise SystemExit(f"no data set {args.dataset!r}")
    near = saved(R.near_references(R.audited(meta, asked)), "near")
    ranked = saved(R.ranked_methods(near, means, args.prefer), "ranked")
    return asked, means, near, ranked, saved(R.baseline(near, ranked, means, R.global_bests(means, asked)), "baseline"), meta


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from . import __version__
    from .plans import methods

    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "ask":
        for s in methods.compile_question(args.question):
            print(f"{s.category}/{s.method} {json.dumps(s.params)}")
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .sources import assays, bundle, longtable

    spark = SparkSession.builder.appName("tesselar").getOrCreate()
    show = lambda df, n=200: df.show(n, False)
    if args.command == "doctor":
        found = _doctor(spark)
        print(json.dumps(found, indent=1))
        return 0 if found["writable"] else 1
    if args.command == "list-methods":
        show(methods.list_methods(spark, args.category).orderBy("category", "name"))
    elif args.command == "query":
        from .plans import registry

        show(registry.QUERIES[args.name](spark, args.sf_dir), args.rows)
    elif args.command == "ingest":
        print(json.dumps({n: t["rows"] for n, t in bundle.write_bundle(assays.read(spark, args.assay, args.path), args.out)["tables"].items()}))
    elif args.command == "inspect-bundle":
        print(json.dumps(bundle.inspect_bundle(spark, args.path), indent=1))
    elif args.command == "validate-bundle":
        try:
            bundle.read_bundle(spark, args.path)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print("valid")
    elif args.command in ("run", "step"):
        plan = json.loads(Path(args.plan).read_text()) if args.command == "run" else [{"category": args.category, "method": args.method, "params": json.loads(args.params)}]
        made, log = methods.run_pipeline(bundle.read_bundle(spark, args.bundle), [methods.Step(s["category"], s["method"], s.get("params", {}), s.get("version")) for s in plan])
        bundle.write_bundle(made, args.out, {"log": log})
        print(json.dumps(log, indent=1))
    elif args.command == "report":
        from .plans import report

        tables = bundle.read_bundle(spark, args.bundle)
        Path(args.out).write_text(report.report(args.title, {n: report.table(df) for n, df in tables.items()}, bundle.inspect_bundle(spark, args.bundle)["meta"].get("log", [])))
    elif args.command in ("landscape", "pareto", "stats-review"):
        from .operators import evidence as E
        from .operators import stats as S

        rows = longtable.read_long_csv(spark, args.csv)
        means = rows.groupBy("dataset", "config").agg(F.avg("score").alias("score"), F.count("*").alias("n"), *([F.avg("secs").alias("secs")] if "secs" in rows.columns else []))
        if args.command == "landscape":
            if args.out:
                means.write.parquet(args.out)
            show(means.orderBy("dataset", F.desc("score")))
        elif args.command == "pareto":
            axes = {"score": "max"} | ({"secs": "min"} if "secs" in means.columns else {})
            show(E.pareto_frontier(means, axes, by="dataset").orderBy("dataset", F.desc("score")))
        else:
            one, two = (means.select("dataset", F.col("config").alias(c), F.col("score").alias(f"s{c}")) for c in ("a", "b"))
            tests = S.signed_rank(one.join(two, "dataset").filter("a < b").withColumn("d", F.col("sa") - F.col("sb")), ["a", "b"]).withColumn("pair", F.concat_ws("|", "a", "b"))
            show(E.step_up(tests, "p_value", "q_value", "pair").drop("pair").orderBy("q_value", "a", "b"))
    elif args.command == "share":
        from .functions import text as N

        bad = spark.read.text(args.path).filter(~N.shareable(F.col("value"))).select(F.array_join(N.private_keys(F.col("value")), ",").alias("keys"), N.long_numbers(F.col("value")).alias("long_numbers"))
        if refused := bad.count():
            show(bad, 20)
            print(f"{refused} records may not be shared", file=sys.stderr)
            return 1
        print("may be shared")
    else:
        from .operators import recommend as R

        asked, means, near, ranked, base, meta = _evidence(spark, args)
        if args.command == "recommend":
            show(near)
            show(ranked.orderBy("rank"))
            show(base)
        elif args.command == "calibrate":
            show(R.acquisition_plan(meta, means, near, ranked, base).orderBy("priority"))
        else:
            given = {c: asked[c] if c in asked.columns else F.lit(x) for c, x in (("metric", "ARI"), ("higher_is_better", True))}
            show(R.decision_card(asked.withColumns(given), near, ranked, base))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
