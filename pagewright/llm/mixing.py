"""Mixing sources to target weights over a domain - language - source tree.

A budget of tokens goes down the tree: each node gives its children shares by weight. A child can't take
more than its subtree holds (times the epochs allowed); what it lacks goes to its siblings by their
weights, and only what all siblings together can't take is missing at the parent, where it was given to
the parent's siblings beforehand, as capacities are summed upwards first. Each leaf then takes whole
epochs and a prefix of one more, in an order seeded by epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import NULL_ID, doc_id, files_for, row_key, written

LEVELS = ("domain", "lang", "source")
#: Integer weights of names at each level; other names weigh 1.
WEIGHTS = {"domain": {"web": 2, "forum": 5, "books": 3}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
#: Documents in a bucket of a leaf's order, about; only one bucket of a leaf is put in order row by row.
BUCKET = 512
#: A plan of up to so many leaves is broadcast.
BROADCAST_LEAVES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """The first source is the web crawl, the next six are forums, the others books."""
    n = F.regexp_extract(source, r"^src(\d{1,9})$", 1)
    return F.when(n == "0", "web").when(n.try_cast("int") <= 6, "forum").otherwise("books")


def fill(rows: DataFrame, parent: list[str], budget: str, capacity: str, weight: str, name: str, into: str) -> DataFrame:
    """rows with `into`: each one's share of its parent's budget, by weight, none above its capacity.

    In order of capacity / weight those below the final level are full; the level is what is left of the
    budget over the weights that are left, at the first row that isn't full.
    """
    w = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col(capacity) / F.col(weight), name)
    before = F.coalesce(F.sum(capacity).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(weight).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col(budget) - before).cast("double") / after.cast("double"))
    rows = rows.withColumn("_full", F.col(capacity) <= F.col("_level") * F.col(weight))
    rows = rows.withColumn("_final", F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy(*(parent or [F.lit(0)]))))
    share = F.when(F.col("_full"), F.col(capacity)).otherwise(F.floor(F.col("_final") * F.col(weight)))
    return rows.withColumn(into, share.cast("long")).drop("_level", "_full", "_final")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("int")


def budgets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """leaves (the levels and tokens) with allot: tokens to take, for a budget of share times all tokens.

    Nodes of weight 0 get nothing. One row a leaf: the tree's size bounds all of this.
    """
    rows = leaves.withColumns({f"w_{x}": weight_of(x, weights) for x in LEVELS})
    rows = rows.where(" and ".join(f"w_{x} > 0" for x in LEVELS)).withColumn("cap_source", F.col("tokens") * epochs)
    lang = rows.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("cap_source").alias("cap_lang"))
    domain = lang.groupBy("domain", "w_domain").agg(F.sum("cap_lang").alias("cap_domain"))
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).cast("long").alias("budget"))
    domain = fill(domain.crossJoin(F.broadcast(total)), [], "budget", "cap_domain", "w_domain", "domain", "for_domain")
    lang = fill(lang.join(domain.select("domain", "for_domain"), "domain"), ["domain"], "for_domain", "cap_lang", "w_lang", "lang", "for_lang")
    rows = rows.join(lang.select("domain", "lang", "for_lang"), ["domain", "lang"])
    return fill(rows, ["domain", "lang"], "for_lang", "cap_source", "w_source", "source", "allot").select(*LEVELS, "tokens", "docs", "allot")


def counted(docs: DataFrame) -> DataFrame:
    """_id, _h, the levels and n (words of the whole text) of every row; null lang or source: empty name."""
    names = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    n = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n")
    return docs.select(*row_key(docs), domain_of(F.coalesce(docs["source"].cast("string"), F.lit(""))).alias("domain"), *names, n)


def counted_rows(docs: DataFrame) -> DataFrame:
    return written(counted(docs).repartition(files_for(docs.select("doc_id").count())))


def mixed(rows: DataFrame, share: float = 0.8, epochs: int = 2, seed: int = 11, weights: dict[str, dict[str, int]] = WEIGHTS, bucket: int = BUCKET, broadcast: int = BROADCAST_LEAVES) -> tuple[DataFrame, bool]:
    """_id, _h, the levels, epoch and n: one row for each time that a row of counted() is taken; and whether the tree is small.

    A leaf with allot tokens to give and T of its own takes allot div T epochs whole; of the next, ordered
    by the md5 of seed, epoch and doc_id (without one: the text's hash), it takes the longest prefix within
    the rest. The prefix is found by sums of hash buckets, so a leaf with a third of all rows is put in
    order in parallel. Ties in that order go by doc_id, then by length.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    size, tree = rows.count(), leaves.count()
    plan = budgets(leaves, share, epochs, weights)
    full = F.when(F.col("tokens") > 0, F.expr("allot div tokens")).otherwise(F.lit(0)).cast("int")
    plan = written(plan.withColumn("full", full).select(*LEVELS, "full", (F.col("allot") - F.col("full") * F.col("tokens")).alias("rest"), F.ceil(F.col("docs") / bucket).cast("long").alias("buckets")), tree)
    small = tree <= broadcast
    planned = rows.join(F.broadcast(plan) if small else plan, list(LEVELS))
    name = F.when(F.col("_id") != NULL_ID, F.col("_id").cast("string")).otherwise(F.concat(F.lit("h"), F.col("_h")))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "full", name))
    planned = planned.withColumn("o", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    planned = planned.withColumn("b", F.shiftright(F.shiftright("o", 30) * F.col("buckets"), 30))
    whole = planned.where("full > 0").select("_id", "_h", *LEVELS, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "n")
    partial = planned.where((F.col("full") < epochs) & (F.col("rest") > 0))
    sums = partial.groupBy(*LEVELS, "b", "rest").agg(F.sum("n").alias("sum"))
    w = Window.partitionBy(*LEVELS).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    edges = written(sums.withColumn("upto", F.sum("sum").over(w)).withColumn("before", F.col("upto") - F.col("sum")).where("before <= rest").select(*LEVELS, "b", "before", "upto"), size // bucket + tree)
    near = partial.join(edges, [*LEVELS, "b"])
    inside = near.where("upto <= rest")
    order = Window.partitionBy(*LEVELS, "b").orderBy("o", "_id", "n", "_h").rowsBetween(Window.unboundedPreceding, 0)
    cut = near.where("upto > rest").withColumn("at", F.col("before") + F.sum("n").over(order)).where("at <= rest")
    columns = ["_id", "_h", *LEVELS, F.col("full").alias("epoch"), "n"]
    return whole.unionByName(inside.select(*columns)).unionByName(cut.select(*columns)), small


def query(docs: DataFrame, **options) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens: one row for each time that a row of docs is taken.

    Null and empty texts have no tokens and count as such, very long ones with all their words; a null
    doc_id is one more name in the order; null lang or source is an empty name; repeated rows are counted
    and taken one by one; no rows, no result.
    """
    return mixed(counted_rows(docs), **options)[0].select(doc_id(), *LEVELS, "epoch", F.col("n").alias("n_tokens"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that a mix of one epoch takes, with all their columns unchanged.

    Nulls, empty and very long texts and ties are as in query. Of repeated rows (equal doc_id, or none, and
    text) as many stay as were taken: those with the smallest hashes of all columns, so the budget holds.
    """
    rows = counted_rows(docs)
    picks, small = mixed(rows, epochs=1, **options)
    picks = picks.groupBy("_id", "_h").agg(F.count("*").alias("_k")).join(rows.groupBy("_id", "_h").agg(F.count("*").alias("_n")), ["_id", "_h"])
    whole, part = picks.where("_k = _n").select("_id", "_h"), picks.where("_k < _n").select("_id", "_h", "_k")
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_key(docs))
    # a leaf's order is cut at one place, so no more keys than leaves are taken in part
    order = Window.partitionBy("_id", "_h").orderBy(F.xxhash64("_row"))
    some = tagged.join(F.broadcast(part) if small else part, ["_id", "_h"]).withColumn("_i", F.row_number().over(order)).where("_i <= _k").select("_row")
    out = tagged.join(whole, ["_id", "_h"], "left_semi").select("_row").unionByName(some)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
