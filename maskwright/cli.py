"""``python -m maskwright.cli transform|init|check|presets``: dumps in, dumps out."""

from __future__ import annotations

import argparse
import os
import stat
import sys
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from maskwright.operators.anonymize import plan_table
from maskwright.operators.check import check
from maskwright.operators.classify import classify, starter_config
from maskwright.plans.config import ConfigError, load, resolve_key
from maskwright.plans.queries import catalog
from maskwright.plans.report import report
from maskwright.plans.shared import dropped
from maskwright.sources.mysqldump import PLACE, Dump, anonymize_dump, dump_bytes, read_dump, spooled, write_dump
from maskwright.sources.mysqltext import DumpError


def _whole(path: str) -> str:
    """Spark's own process may have another working folder."""
    return path if "://" in path else os.path.abspath(path)


def _is_pipe(path: str) -> bool:
    """A device or a pipe, which is written to in order and not replaced."""
    return os.path.exists(path) and (stat.S_ISFIFO(m := os.stat(path).st_mode) or stat.S_ISCHR(m))


@contextmanager
def progress(spark: SparkSession, told: Callable[[int, int], None], every: float = 0.5) -> Iterator[None]:
    """Calls ``told(tasks done, tasks)`` of the running stages again and again while the block runs."""
    ended, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def watch() -> None:
        while not ended.wait(every):
            stages = [x for i in tracker.getActiveStageIds() if (x := tracker.getStageInfo(i))]
            if stages:
                told(sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages))

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()


def _shown(done: int, tasks: int) -> None:
    print(f"\r{done} of {tasks} tasks", end="", file=sys.stderr, flush=True)


def _sampled(dump: Dump) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The tables, for their columns, and samples of all their texts."""
    return {t: dump.text_table(t, placed=False) for t in dump.tables}, reduce(DataFrame.unionByName, map(dump.first_texts, dump.tables)) if dump.tables else None


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("maskwright")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {"transform": ("from", "config"), "init": ("from", "out"), "check": ("from", "config"), "presets": ()}.items():
        p = commands.add_parser(name)
        for o in options:
            p.add_argument(f"--{o}", required=True, dest=f"{o}_")
        if name == "transform":
            p.add_argument("--out", dest="out_", help="a folder, a pipe or a device; without it the dump goes to standard output")
            p.add_argument("--progress", action="store_true", help="tell on standard error how far the running stages are")
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--verbose", action="store_true")
            p.add_argument("--report", default=".maskwright")
    args = parser.parse_args(argv)
    dump = None
    spark = SparkSession.builder.appName("maskwright").config("spark.sql.redaction.string.regex", "0x[0-9A-Fa-f]{16,}").getOrCreate()
    try:
        if args.command == "presets":
            for r in catalog(spark).collect():
                print(f"{r['preset']:<14} {r['sample']} -> {r['output']}")
            return 0
        source = spooled(spark, sys.stdin.buffer) if args.from_ == "-" else _whole(args.from_)
        dump = read_dump(spark, source)
        if args.from_ == "-":
            dropped(spark, source)  # its statements are kept
        if args.command == "init":
            tables, values = _sampled(dump)
            made = starter_config(classify(tables, values=values))
            with open(args.out_, "w", encoding="utf-8") as f:
                f.write(made.yaml)
            print(f"{made.rules} rules, {made.to_review} to review: {args.out_}")
            return 0
        config = load(args.config_)
        if args.command == "check":
            tables, values = _sampled(dump)
            found = check(tables, config, values=values)
            print(found.text())
            return 0 if found.ok else 1
        began, key = time.time(), resolve_key(config)
        out = anonymize_dump(dump, config, key)
        to = sys.stdout
        with progress(spark, _shown) if args.progress else nullcontext():
            if args.dry_run:
                out.write.format("noop").mode("overwrite").save()
            elif args.out_ and not _is_pipe(args.out_):
                write_dump(out, _whole(args.out_))
            else:
                to = sys.stderr
                with open(args.out_, "wb") if args.out_ else nullcontext(sys.stdout.buffer) as sink:
                    for part in dump_bytes(out):
                        sink.write(part)
                    sink.flush()
        counted = {t: (dump.text_table(t).drop(*PLACE, "row"), plan_table(t, d.columns, config)) for t, d in dump.tables.items()}
        got = report(config.mode, counted, key, dump.notable())
        got.duration_ms = int((time.time() - began) * 1000)
        print(got.text(args.verbose), file=to)
        got.write_json(args.report)
        return 0
    except (ConfigError, DumpError) as e:
        print(e, file=sys.stderr)
        return 1
    finally:
        if dump:
            dump.close()


if __name__ == "__main__":
    sys.exit(main())
