"""Parts that several operators use: folders, row keys, grouped streams, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.dealing import dealt_out

#: Stands for a null doc_id, so such a row sorts before all others and joins with itself.
NULL_ID = -(2**63)

#: Rows of a few numbers that go to one file.
FILE_ROWS = 500_000
#: A node of more than a 10,000th of all links, and of so many, is a hub.
HUB = 100_000

#: Arrow batches of this many bytes at most reach Python, whatever the length of a text.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES in this session, so that very long texts don't pile up."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where none is set, a temporary one if driver and executors are one process, as in tests; a cluster must
    name one (ValueError).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there and any executor can read it again.

    rows: about how many it has, where that is known; each FILE_ROWS of them get one file then. Files and
    tasks so follow the data, however many partitions df was dealt out in.
    """
    path = f"{shared_folder(df.sparkSession)}/pagewright-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(files_for(rows))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing will read again, wherever Spark can write."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def files_for(rows: int) -> int:
    return max(1, math.ceil(rows / FILE_ROWS))


def process_wide(key: str, make: Callable[[], object]):
    """What make() gives, made once in a Python worker for its later tasks; a worker keeps one such thing."""
    import builtins

    kept = builtins.__dict__.get("_pagewright_kept", (None, None))
    if kept[0] != key:
        builtins.__dict__.pop("_pagewright_kept", None)
        builtins.__dict__["_pagewright_kept"] = kept = (key, make())
    return kept[1]


def release() -> None:
    """Drops what process_wide keeps, at the start of tasks that need the memory for something else."""
    import builtins

    builtins.__dict__.pop("_pagewright_kept", None)


class Remembered:
    """Values by name, made for all new names of a call at once.

    Names used since memory was full the time before last are remembered: about `limit` and as many again.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], limit: int) -> None:
        self.make, self.limit = make, limit
        self.now: dict = {}
        self.older: dict = {}

    def __call__(self, names: list[str]) -> list:
        if len(self.now) > self.limit:
            self.now, self.older = {}, self.now
        now, older = self.now, self.older
        new = [x for x in names if x not in now]
        now.update((x, older[x]) for x in new if x in older)
        missing = [x for x in new if x not in older]
        now.update(zip(missing, self.make(missing), strict=True))
        return list(map(now.__getitem__, names))


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of texts (between ASCII white space), the number of each word, and where each text's words begin (and the last one's end).

    White space at either end of a text counts as a blank word.
    """
    words = pc.ascii_split_whitespace(texts)
    begin = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), begin


def text_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of values that each text has."""
    out = np.zeros((len(begin) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        out[some] = np.add.reduceat(values, begin[some], axis=0, dtype=np.float64)
    return out


def keyed(docs: DataFrame, text: bool = True) -> DataFrame:
    """Columns _id (doc_id as long, null: NULL_ID), _h (64-bit hash of the text) and _t (text, null: empty).

    Only these columns go on, so further columns of any name can't clash. Rows with equal doc_id and
    text are one document to every operator: each of them gets the same result.
    """
    t = F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_t")
    return dealt_out(docs.select(*row_key(docs), t)) if text else docs.select(*row_key(docs))


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(docs["text"].cast("string")).alias("_h")


def apart(docs: DataFrame) -> DataFrame:
    """docs (of keyed columns and more), each row without a doc_id a document of its own: its _h is a number.

    Such rows, if there are any, are written with their numbers, so that they keep them.
    """
    none = docs.where(F.col("_id") == NULL_ID)
    if none.isEmpty():
        return docs
    return docs.where(F.col("_id") != NULL_ID).unionByName(written(none.withColumn("_h", F.monotonically_increasing_id())))


def doc_id(column: str = "_id") -> Column:
    """The doc_id that keyed() made the column from."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias("doc_id")


def complete_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int, least: int = 20_000) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups from batches sorted by key, of about least rows each (or one larger group).

    A group of over limit rows comes in pieces, each with True beside it: no more than limit rows plus
    a batch are ever held, and the caller passes such rows on to a finer key.
    """
    held: list[pa.Table] = []
    rows, over = 0, None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        k = t[key].to_numpy()
        if over is not None:
            n = int(np.searchsorted(k != over, True)) if len(k) else 0
            if n:
                yield t.slice(0, n), True
            t, k = t.slice(n), k[n:]
            if not len(k):
                continue
            over = None
        if not len(k):
            continue
        held.append(t)
        rows += len(k)
        if rows < least:
            continue
        t = pa.concat_tables(held).combine_chunks()
        k = t[key].to_numpy()
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut:
            yield from _split_large(t.slice(0, cut), k[:cut], limit, least)
        held, rows = [t.slice(cut)], len(k) - cut
        if rows > limit:
            yield held[0], True
            held, rows, over = [], 0, k[-1]
    if rows:
        t = pa.concat_tables(held).combine_chunks()
        yield from _split_large(t, t[key].to_numpy(), limit, least)


def _split_large(t: pa.Table, k: np.ndarray, limit: int, least: int) -> Iterator[tuple[pa.Table, bool]]:
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[start, len(k)])

    def pieces(a: int, z: int) -> Iterator[tuple[pa.Table, bool]]:
        while a < z:
            i = int(np.searchsorted(start, a + least))
            end = min(z, int(start[i])) if i < len(start) else z
            yield t.slice(a, end - a), False
            a = end

    at = 0
    for s, n in zip(start[size > limit].tolist(), size[size > limit].tolist(), strict=True):
        yield from pieces(at, s)
        yield t.slice(s, n), True
        at = s + n
    yield from pieces(at, len(k))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    done, out = 1, x
    while done * 2 <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - done : len(x) - done + 1]) if done < w else out


def window_owners(h: np.ndarray, w: int) -> np.ndarray:
    """For each w neighbours of h, the place of the smallest (the leftmost of equals; 40 bits count).

    Equal stretches of w values have their smallest at the same place, so these places sample a
    sequence by its content alone: two copies of a stretch always share the sample that owns it.
    """
    low, piece = np.uint64(2**24 - 1), 2**23
    out = []
    for c in range(0, len(h) - w + 1, piece):
        part = h[c : c + piece + w - 1]
        packed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(packed, w) & low).astype(np.int64) + c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, nodes: int | None = None) -> DataFrame:
    """Columns node and component (the smallest node reachable) of every node that has a link.

    nodes: about how many there are, if known, so that links are written in files of a good size.
    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no longer change.
    Links are written to the shared folder after each round, and only a count and a checksum reach the
    driver. A step finds each node's smallest neighbour: by a window over its links, or, where there are
    more than HUB links and so a node may have as many, by minima that Spark combines before the shuffle
    and joins; hubs' links then stay where they are, and the minima of hubs, 20,000 at most, are broadcast.
    Links to null or to the node itself are ignored; without links the result is empty.
    """
    u, v = F.col("u"), F.col("v")
    state = F.expr("count(1) as n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0L) as x")

    def with_minimum(rows: DataFrame, total: int) -> DataFrame:
        """rows with m, the smallest v of their u."""
        if total <= HUB:
            return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        low, hub = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), max(HUB, total // 10_000)
        hubs = low.where(F.col("n") > hub).drop("n")
        few = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.where(F.col("n") <= hub).drop("n"), "u")
        return few.unionByName(rows.join(F.broadcast(hubs), "u"))

    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((u != v) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), nodes)
    seen = now.agg(*state).first()
    for _ in range(rounds if seen.n else 0):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        large = with_minimum(both, 2 * seen.n).where(v > u).select(v.alias("u"), F.least("u", "m").alias("v"))
        small = with_minimum(large, 2 * seen.n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        old, now = now, written(small.where(u != v).distinct(), 2 * seen.n)
        remove(links.sparkSession, old.written_to)
        last, seen = seen, now.agg(*state).first()
        if last == seen:
            break
    else:
        if seen.n:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
