"""Running checks over a corpus, and what is counted from their issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STRUCTURE, STYLES
from ..operators.checks import BLOCK_CHECKS, CHECKS, DOC_CHECKS, NEED_HEADINGS, heading_facts, with_neighbours
from ..schema import Corpus

# Display names of the checks.
LABELS = {
    "heading-hierarchy": "Heading structure",
    "heading-numbering": "Heading numbering",
    "toc-present": "Table of contents present",
    "toc-linked": "Table of contents linked",
    "required-sections": "Required sections",
    "section-order": "Section order",
    "list-formatting": "List formatting",
    "table-caption": "Table captions",
    "figure-caption": "Figure captions",
    "equation-format": "Equation format",
    "inline-image": "Inline images",
}


def enabled_checks(styles: dict | None = None) -> list[str]:
    """Names whose switch is on or missing; switches of unknown names are ignored."""
    switches = (styles or STYLES)["checks"]
    return [c for c in CHECKS if switches.get(c, True)]


def run_checks(corpus: Corpus, structure: dict | None = None, styles: dict | None = None, only: list[str] | None = None) -> DataFrame:
    """Issues of the enabled checks (of those in `only`); a check that is off leaves no trace in the plan.

    One pass: the blocks are dealt out and sorted by document once; what the block checks find and what the
    document checks need to know of headings are gathered in the same order, next to the documents.
    """
    structure, styles = structure or STRUCTURE, styles or STYLES
    names = [c for c in enabled_checks(styles) if only is None or c in only]
    tag = lambda c, issue: F.when(issue.isNotNull(), named(c)(issue))
    named = lambda c: lambda x: F.struct(F.lit(CHECKS.index(c)).alias("check_ord"), F.lit(c).alias("check"), x.alias("issue"))
    by_block = [tag(c, BLOCK_CHECKS[c](structure, styles)) for c in names if c in BLOCK_CHECKS]
    by_doc = [c for c in names if c in DOC_CHECKS and (structure["sections"] or c not in ("required-sections", "section-order"))]
    of_doc = F.concat(*(F.transform(F.array_compact(DOC_CHECKS[c](structure, styles)), named(c)) for c in by_doc)) if by_doc else None
    in_block = F.array_compact(F.array(*by_block)) if by_block else None
    if not by_doc:
        rows = corpus.docs.limit(0).withColumn("found", F.array(tag("toc-present", DOC_CHECKS["toc-present"](structure, styles)[0]))) if in_block is None else with_neighbours(corpus.blocks).select("doc_id", in_block.alias("found"))
    else:
        needed = heading_facts(structure) if set(by_doc) & NEED_HEADINGS else []
        if in_block is not None:
            blocks, needed = with_neighbours(corpus.blocks).withColumn("_issues", in_block), [F.flatten(F.collect_list(F.when(F.size("_issues") > 0, F.col("_issues")))).alias("_issues"), *needed]
        else:
            blocks = corpus.blocks.where(F.col("type") == "heading")
        rows = corpus.docs.join(blocks.groupBy("doc_id").agg(*needed), "doc_id", "left") if needed else corpus.docs
        rows = rows.select("doc_id", (F.concat(F.coalesce("_issues", F.array()), of_doc) if in_block is not None else of_doc).alias("found"))
    i = rows.select("doc_id", F.explode("found").alias("i"))
    return i.select("doc_id", "i.check_ord", "i.issue.item_ord", "i.check", "i.issue.message", "i.issue.block_index", "i.issue.text")


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy("doc_id", "check_ord", "item_ord")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id", "check").agg(F.count("*").alias("n"))


def checks_fired(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id").agg(F.sort_array(F.collect_set("check")).alias("checks"))


def dense_counts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a document and one column a check, zeros included."""
    wide = issues.groupBy("doc_id").agg(*(F.count_if(F.col("check") == c).alias(c) for c in CHECKS))
    return docs.select("doc_id").join(wide, "doc_id", "left").na.fill(0)


def status(docs: DataFrame, issues: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """doc_id, passed, n_issues, exit_status: 0 passed, 1 with issues, 2 a file of errors that couldn't be read."""
    n = issues.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_issues"))
    out = out.select("doc_id", (F.col("n_issues") == 0).alias("passed"), "n_issues", F.when(F.col("n_issues") == 0, 0).otherwise(1).alias("exit_status"))
    return out if errors is None else out.unionByName(errors.select("doc_id", F.lit(False).alias("passed"), F.lit(0).cast("long").alias("n_issues"), F.lit(2).alias("exit_status")))


def dashboard(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues by format and check with subtotals."""
    return issues.join(docs.select("doc_id", "format"), "doc_id").rollup("format", "check").agg(F.count("*").alias("n"))


def ueq_scores(answers: DataFrame) -> DataFrame:
    """Means of the two scales (participant, scale, answer), for participants with all eight answers."""
    mean = lambda s: F.bround(F.avg(F.when(F.col("scale") == s, F.col("answer"))), 2).alias(s)
    return answers.groupBy("participant").agg(F.count("answer").alias("_n"), mean("pragmatic"), mean("hedonic")).where("_n = 8").drop("_n")
