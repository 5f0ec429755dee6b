"""``python -m castwise.cli analyze FILE`` and ``corpus PATH...``; without a command a guided prompt."""

from __future__ import annotations

import argparse
import glob
import os
import sys
from pathlib import Path

VERSION = "0.1.0"


def corpus_paths(paths: list[str], pattern: str = "*.xml") -> list[str]:
    """Folders by pattern, files as they are; missing ones are told and left out; each file once, sorted."""
    found = set()
    for p in paths:
        if os.path.isdir(p):
            found |= {str(Path(x).resolve()) for x in glob.glob(os.path.join(p, pattern)) if os.path.isfile(x)}
        elif os.path.isfile(p):
            found.add(str(Path(p).resolve()))
        else:
            print(f"no such file: {p}", file=sys.stderr)
    return sorted(found)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="castwise")
    top.add_argument("--version", action="version", version=VERSION)
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command")
    for name in ("analyze", "corpus"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="+" if name == "corpus" else 1)
        c.add_argument("--seg", choices=["all", "sd", "large-seq", "middle-seq"], default="all")
        c.add_argument("--export-model", choices=["full", "p-speaking", "s-speaking"], default="full")
        c.add_argument("--weight", choices=["segments", "words"], default="segments")
        c.add_argument("--out", default="output")
        c.add_argument("--no-dashboard", action="store_true", help="leave out the pages' data (payload.json, corpus.json)")
        c.add_argument("--pattern", default="*.xml")
        c.add_argument("--name", default=None)
    return top


def run(args: argparse.Namespace) -> int:
    """0, 1 if nothing was found or made, 2 if a file failed (the others are done)."""
    from pyspark.sql import SparkSession

    from .operators.views import corpus_name
    from .plans.corpus import SPINES, analyse
    from .sinks.exports import write, write_corpus, write_table
    from .sources.tei import read_plays, tables

    files = corpus_paths(args.paths, args.pattern)
    if not files:
        return 1
    spark = SparkSession.builder.appName("castwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    plays = read_plays(spark, *files).cache()
    t = tables(plays)
    failed = t["failed"].collect()
    for r in failed:
        print(f"failed: {r['path']}: {r['error']}", file=sys.stderr)
    a = analyse(t, tuple(SPINES) if args.seg == "all" else (args.seg,))
    made = write(a, t["plays"], args.out, args.export_model, f"{args.weight}_shared", payloads=not args.no_dashboard)
    if made:
        made.append(str(Path(args.out, f"{args.name or 'comparison'}.csv")))
        write_table(a["comparison"], ["id", "segmentation", "model", "aggregated"], made[-1])
        if args.command == "corpus" and not args.no_dashboard:
            made.append(str(Path(args.out, "corpus.json")))
            write_corpus(a, t["plays"], corpus_name(args.paths, len(files) - len(failed), args.name), made[-1])
    if args.verbose:
        print("\n".join(made), file=sys.stderr)
    return 2 if failed and args.command == "corpus" else 1 if not made else 0


def prompt() -> list[str]:
    """Asks for a path, a model, a folder and (for a folder of plays) a name; end of input cancels; pasted quotes are taken off; no answer takes the default."""
    ask = lambda text: input(text).strip().strip("'\"").strip()
    try:
        path = ask("Play or folder: ")
        if not path:
            return []
        command = "corpus" if os.path.isdir(path) else "analyze"
        out = [command, path]
        for flag, text, among in (("--export-model", "Model to export (full, p-speaking, s-speaking): ", ("full", "p-speaking", "s-speaking")), ("--out", "Folder for the files: ", None), *([("--name", "Name of the corpus: ", None)] if command == "corpus" else [])):
            while (given := ask(text)) and among and given not in among:
                print(f"one of {', '.join(among)}", file=sys.stderr)
            out += [flag, given] if given else []
        return out
    except (EOFError, KeyboardInterrupt):
        return []


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args(argv or prompt())
    return run(args) if args.command else 0


if __name__ == "__main__":
    sys.exit(main())
