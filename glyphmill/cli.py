"""Commands: evaluate, compare, crawl, infer, ask."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .cluster import ship
from .operators import batch_infer, chat, crawl, evaluate
from .operators.predict import Factory, apply_predictor
from .sources import examples
from .sources.images import read_bytes
from .sources.pages import HttpFetcher, PageStore


def _factory(name: str) -> Factory:
    """The predictor factory `module:attribute`."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _items(spark: SparkSession, args: argparse.Namespace):
    return examples.to_items(examples.read_examples(spark, args.val_jsonl, max_samples=args.max_samples))


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> str:
    rows = evaluate.result_rows(_items(spark, args), _factory(args.predictor), args.max_samples)
    made = evaluate.report_dict(rows)
    evaluate.write_report(made, args.report_path)
    return json.dumps(made["metrics"])


def _compare(spark: SparkSession, args: argparse.Namespace) -> str:
    items = _items(spark, args).cache()
    base, tuned = (evaluate.result_rows(items, _factory(f), args.max_samples) for f in (args.base, args.finetuned))
    made = evaluate.compare_report(base, tuned, args.base, args.finetuned)
    evaluate.write_report(made, args.report_path)
    return json.dumps(made["delta"])


def _crawl(spark: SparkSession, args: argparse.Namespace) -> str:
    source = PageStore(spark.read.parquet(args.pages)) if args.pages else HttpFetcher(args.user_agent, args.timeout_sec)
    folder = args.out_dir.rstrip("/") + "/downloads"
    made = crawl.crawl(spark, args.seed_url, source, args.out_dir, args.max_pages, args.max_downloads, bool(args.same_host_only), crawl.file_writer(folder))
    crawl.append_events(made, args.out_dir.rstrip("/") + "/meta")
    return json.dumps({"pages": made.pages, "downloads": made.downloads})


def _infer(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.image_file:
        one = spark.createDataFrame([(args.image_file,)], "image_path string")
        return apply_predictor(one, _factory(args.predictor)).first()["pred"]
    rows = batch_infer.infer_directory(spark, args.examples_dir, args.results_dir, _factory(args.predictor), args.results_dir.rstrip("/") + "/summary")
    return json.dumps({"images": rows.count()})


def _ask(spark: SparkSession, args: argparse.Namespace) -> str:
    options = {"max_tokens": args.max_tokens, "temperature": args.temperature}
    requests = chat.image_requests(read_bytes(spark, args.image_path), args.model, args.prompt, **options)
    if args.dry_run:
        return requests.select(F.col("request")).first()[0]
    return chat.call(requests, chat.http_post(args.base_url, args.api_key)).first()["text"]


def parser() -> argparse.ArgumentParser:
    """The commands' arguments."""
    top = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, **options: tuple) -> None:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for option, (kind, default) in options.items():
            own.add_argument(f"--{option}", type=kind, default=default, required=default is ...)

    command("evaluate", _evaluate, predictor=(str, ...), val_jsonl=(str, ...), report_path=(str, ...), max_samples=(int, None))
    command("compare", _compare, base=(str, ...), finetuned=(str, ...), val_jsonl=(str, ...), report_path=(str, ...), max_samples=(int, None))
    command("crawl", _crawl, seed_url=(str, ...), out_dir=(str, ...), max_pages=(int, 50), max_downloads=(int, 200), same_host_only=(int, 1), timeout_sec=(float, 15.0), user_agent=(str, "glyphmill/0.1"), pages=(str, None))
    command("infer", _infer, predictor=(str, ...), image_file=(str, None), examples_dir=(str, "examples"), results_dir=(str, "results"))
    command("ask", _ask, base_url=(str, ...), model=(str, ...), image_path=(str, ...), prompt=(str, ...), api_key=(str, None), max_tokens=(int, 2048), temperature=(float, 0.0), dry_run=(int, 0))
    return top


def main(argv: list[str] | None = None) -> None:
    """Runs a command on the session's cluster and prints its result."""
    args = parser().parse_args(argv)
    print(args.run(ship(SparkSession.builder.appName("glyphmill").getOrCreate()), args))


if __name__ == "__main__":
    main()
