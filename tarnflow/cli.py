"""Command line: ``init``, ``scan`` and ``run`` on folders of tables."""

from __future__ import annotations

import argparse
import sys

from tarnflow.operators.detect import load_recognizers
from tarnflow.operators.relationships import RelationshipGraph, render_tree
from tarnflow.plans import config as C
from tarnflow.plans.runner import Runner, parse_ids, parse_query
from tarnflow.plans.scan import report, scan
from tarnflow.sources.catalog import FolderCatalog
from tarnflow.sources.jobs import get_job


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "scan", "run"):
        s = sub.add_parser(name)
        s.add_argument("job", nargs="?", help="job id; its places come from the environment")
        s.add_argument("--source")
        s.add_argument("--destination")
        s.add_argument("--config")
        if name == "scan":
            s.add_argument("--report")
            s.add_argument("--recognizers", help="YAML with recognizers")
            s.add_argument("--output", help="where the proposed configuration goes")
        if name == "run":
            s.add_argument("--collections", help="names, comma-separated")
            s.add_argument("--ids", help="collection=id1,id2")
            s.add_argument("--query", help='collection={"field": value}')
            s.add_argument("--parallel", type=int)
            s.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code 0, 1 if a collection failed, 2 for wrong arguments, 130 when interrupted."""
    args = parser().parse_args(argv)
    try:
        if args.job:
            job = get_job(args.job)
            args.source, args.destination = args.source or job.source_uri, args.destination or job.destination_uri
            args.config = args.config or job.config_path
        if not args.source or args.command != "scan" and not args.destination:
            raise ValueError("give a job, or a source and a destination")
        if args.command == "init":
            if not args.config:
                raise ValueError("init needs --config")
            with open(args.config, "x", encoding="utf-8") as f:
                f.write(C.starter(args.source, args.destination))
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tarnflow").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
        source = FolderCatalog(spark, args.source)
        if args.command == "scan":
            recognizers = load_recognizers(args.recognizers) if args.recognizers else None
            result = scan(spark, source, C.load_config(args.config) if args.config else None, recognizers=recognizers)
            text = report(result)
            if args.report:
                with open(args.report, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text)
            if args.output:
                C.save_config(result.config, args.output)
            return 0
        settings = C.load_config(args.config) if args.config else C.Config(replication=C.LoadConfig())
        runner = Runner(spark, source, FolderCatalog(spark, args.destination), settings, progress=lambda n, s, d: print(f"{n}: {s} ({d['documents']} documents)"))
        result = runner.run(
            args.collections.split(",") if args.collections else None,
            ids=parse_ids(args.ids) if args.ids else None,
            query=parse_query(args.query) if args.query else None,
            parallel=args.parallel,
            dry_run=args.dry_run,
        )
        if args.dry_run:
            counts = {o.collection: o.documents for o in result.outcomes}
            if args.ids or args.query:  # what belongs to the root's rows, as the tree that it is
                root = (args.ids or args.query).partition("=")[0].strip()
                print(render_tree(RelationshipGraph(settings.graph()).tree(root), counts))
            else:
                print("\n".join(f"{n}: {k} rows" for n, k in counts.items()))
            print(f"{len(counts)} collections, {sum(counts.values())} rows; nothing was written")
        return 1 if result.failed else 0
    except (ValueError, FileNotFoundError, FileExistsError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
