"""python -m sextant {find,map,explain,index} FOLDER [QUESTION]: the library's verbs over a folder of files, as JSON."""

from __future__ import annotations

import argparse
import dataclasses
import json


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sextant", description=__doc__)
    parser.add_argument("verb", choices=("find", "map", "explain", "index"))
    parser.add_argument("folder")
    parser.add_argument("question", nargs="?", default="")
    parser.add_argument("--scope", default="")
    parser.add_argument("--depth", type=int, default=2, help="levels of folders that index prints")
    args = parser.parse_args(argv)
    if args.verb != "index" and not args.question.strip():
        parser.error(f"{args.verb} needs a question")
    from pyspark.sql import SparkSession

    from sextant.api import Library
    from sextant.sources.snapshot import read_files

    spark = SparkSession.builder.appName("sextant").getOrCreate()
    library = Library(read_files(spark, args.folder))
    if args.verb == "index":
        rows = library.tree.where(f"kind = 'dir' and depth <= {args.depth}").orderBy("path").collect()
        print(json.dumps([r.asDict() for r in rows], ensure_ascii=False))
    else:
        print(json.dumps(dataclasses.asdict(getattr(library, args.verb)(args.question, args.scope)), ensure_ascii=False))


if __name__ == "__main__":
    main()
