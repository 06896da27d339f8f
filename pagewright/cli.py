"""python -m pagewright.cli FILE [--json | --blocks] [--structure S] [--styles T]: exit 0 clean, 1 with issues, 2 unsupported."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import load_structure, load_styles
from .plans import report, run
from .sources import corpus_of, extracted, extractor_for, supported_extensions


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("file")
    p.add_argument("--json", action="store_true")
    p.add_argument("--blocks", action="store_true", help="list the blocks that were read, and check nothing")
    p.add_argument("--structure")
    p.add_argument("--styles")
    args = p.parse_args(argv)
    if hasattr(sys.stdout, "reconfigure"):  # a console may lack characters of a document
        sys.stdout.reconfigure(errors="replace")
    if extractor_for(args.file) is None:
        print(f"unsupported file type: {args.file} (supported: {', '.join(supported_extensions())})", file=sys.stderr)
        return 2
    structure, styles = load_structure(args.structure), load_styles(args.styles)
    spark = spark or SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    folder = os.path.dirname(os.path.abspath(args.file))
    pattern = "*.tex" if args.file.lower().endswith(".tex") else os.path.basename(args.file)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = extracted(files.select("path", "content"), styles).where(F.regexp_replace("path", "^file:/+", "/") == os.path.abspath(args.file)).persist()
    for r in rows.where("error is not null").take(1):
        raise ValueError(r.error)
    corpus = corpus_of(rows)
    if args.blocks:
        for r in report.block_lines(corpus.blocks).orderBy("index").toLocalIterator():
            sys.stdout.write(r.line + "\n")
        return 0
    issues = run.run_checks(corpus, structure, styles)
    docs = corpus.docs.withColumn("path", F.lit(args.file))
    out = report.json_reports(docs, issues, run.enabled_checks(styles)) if args.json else report.text_reports(docs, issues)
    text = out.first().report
    sys.stdout.write((report.indented(text) if args.json else text) + "\n")
    return 1 if issues.take(1) else 0


if __name__ == "__main__":
    sys.exit(main())
