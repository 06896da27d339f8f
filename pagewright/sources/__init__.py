"""Readers by extension, and corpora read with them in parallel."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import STYLES
from ..functions.patterns import compile_patterns
from ..schema import BLOCK, Corpus
from . import docx, latex, odt
from .model import Document

Reader = Callable[[bytes, object], Document]
_readers: dict[str, Reader] = {}
ROW = f"path string, format string, error string, toc_present boolean, toc_anchors array<string>, heading_bookmarks array<string>, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"
REFERENCES = "path string, main boolean, names array<string>"


def register(extensions: tuple[str, ...], reader: Reader) -> None:
    """reader(data, patterns) reads files of the extensions from now on; a later one replaces an earlier one."""
    for e in extensions:
        _readers[e.lower()] = reader


def extractor_for(path: str) -> Reader | None:
    return _readers.get(posixpath.splitext(path)[1].lower())


def supported_extensions() -> list[str]:
    return sorted(_readers)


register((".docx",), docx.extract)
register((".odt",), odt.extract)
register((".tex",), lambda data, patterns: latex.extract(data.decode("utf-8", "replace"), patterns))


def _row(path: str, read: Callable[[], Document]) -> dict:
    form = posixpath.splitext(path)[1].lower().lstrip(".")
    try:
        d = read()
    except Exception as e:  # a broken file is a row of its own and must not end the job
        return {"path": path, "format": form, "error": f"{type(e).__name__}: {e}"}
    return {"path": path, "format": form, "error": None} | asdict(d)


def extracted(files: DataFrame, styles: dict | None = None, kept: list[DataFrame] | None = None) -> DataFrame:
    """One row (ROW) for each of files (columns path, content); unsupported and broken ones have an error.

    LaTeX files with a document class are documents; what they include, however deep, is looked up among
    `files` by path (latex.included), and a document's task gets its own includes only. All other formats
    are read where they lie. kept: gets the frames that are persisted, for a caller that goes on to unpersist.
    """
    kept = [] if kept is None else kept
    patterns, readers = compile_patterns(styles or STYLES), dict(_readers)
    schema, named = (to_arrow_schema(StructType.fromDDL(x)) for x in (ROW, REFERENCES))

    def reader(path: str) -> Reader | None:
        return readers.get(posixpath.splitext(path)[1].lower())

    def one(path: str, data: bytes) -> dict:
        f = reader(path)
        if f is None:
            return {"path": path, "format": posixpath.splitext(path)[1].lower().lstrip("."), "error": "unsupported"}
        return _row(path, lambda: f(data, patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(p, c) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [c.decode("utf-8", "replace") for c in b["content"].to_pylist()]
            rows = [(p, "\\documentclass" in t, sorted({*latex.included(t, p)})) for p, t in zip(b["path"].to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "main", "names"), r, strict=True)) for r in rows], schema=named)

    def project(t: pa.Table) -> pa.Table:
        main = t["main"][0].as_py()
        texts = {p: c.decode("utf-8", "replace") for p, c in zip(t["path"].to_pylist(), t["content"].to_pylist(), strict=True)}
        return pa.Table.from_pylist([_row(main, lambda: latex.extract(latex.expanded(texts[main], main, texts.get), patterns))], schema=schema)

    files = files.select("path", "content", F.lower(F.col("path")).endswith(".tex").alias("tex"))
    others = files.where("not tex").select("path", "content").mapInArrow(run, ROW)
    tex = files.where("tex").select("path", "content")
    known = tex.mapInArrow(references, REFERENCES).persist()
    kept.append(known)
    links = known.select(F.col("path").alias("from"), F.explode("names").alias("path")).join(known.select("path"), "path", "left_semi")
    step = known.where("main").select(F.col("path").alias("main"), "path")
    needed = step
    while True:
        step = step.withColumnRenamed("path", "from").join(links, "from").select("main", "path").join(needed, ["main", "path"], "left_anti").distinct().persist()
        kept.append(step)
        if step.isEmpty():
            break
        needed = needed.unionByName(step)
    return others.unionByName(needed.join(tex, "path").groupBy("main").applyInArrow(lambda t: project(t), ROW))


def corpus_of(rows: DataFrame) -> Corpus:
    """Corpus of extracted rows; doc_id is the 64-bit hash of the path; files with an error are listed apart."""
    rows = rows.withColumn("doc_id", F.xxhash64("path"))
    good = rows.where("error is null")
    docs = good.select("doc_id", "path", "format", "toc_present", "toc_anchors", "heading_bookmarks")
    blocks = good.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")
    return Corpus(docs, blocks, rows.where("error is not null").select("doc_id", "path", "format", "error"))


def read_corpus(spark: SparkSession, path: str, styles: dict | None = None) -> Corpus:
    """All supported files below path. Extraction is costly Python and is kept for the checks' two passes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return corpus_of(extracted(files, styles).persist())
