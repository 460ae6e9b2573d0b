"""What the operators of this subpackage share: stored tables, word hashing in numpy, connected components.

Stored tables go to the folder named by ``spark.checkpoint.dir``, which a cluster shares between its driver and
executors; only where it is unset (tests, a laptop) a temporary folder of this machine stands in. A stored table cuts
lineage as a checkpoint does and outlives any executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BYTES = "8m"  # of an Arrow batch of whole texts

#: The bytes between words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Fixed value: an odd number whose powers tell the places of words apart.
_ODD = np.uint64(0xD1342543DE82EF95)


def shared_dir(spark: SparkSession) -> str:
    """The folder for stored tables: ``spark.checkpoint.dir``, or one of this machine where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tallygrove-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def stored(df: DataFrame, label: str, path: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and return the written table.

    ``batch_rows`` bounds the rows (and ``TEXT_BYTES`` the bytes) of an Arrow batch during this write, for rows that hold whole texts: a batch is held by
    the JVM and by the Python worker of every core.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before, bytes_before = spark.conf.get(BATCH_ROWS), spark.conf.get(BATCH_BYTES)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, min(batch_rows, int(before)) if int(before) > 0 else batch_rows)
        spark.conf.set(BATCH_BYTES, TEXT_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, before)
            spark.conf.set(BATCH_BYTES, bytes_before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path  # type: ignore[attr-defined]
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_stored_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no live DataFrame refers to, instead of at the driver's next full collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def no_clash(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the needed columns, under this module's own names; extra columns cannot clash with names used here."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in needed.items()])


# --- words and hashes over Arrow text --------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of uint64 (multiply, xor-shift twice); its two factors are fixed values of a public mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base = int(base)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


_word_powers, _check_powers = _Powers(_ODD), _Powers(np.uint64(0xA0761D6478BD642F))


def text_slices(column, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of an Arrow text column of about ``limit`` bytes: first row, end row, offsets from 0, bytes.

    A null is an empty text. A text is never cut: one longer than ``limit`` is a run of its own.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, offs[lo : hi + 1] - offs[lo], data[offs[lo] : offs[hi]]
        lo = hi


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every row, and the index of each row's first word (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    at = cuts[(cuts > 0) & (cuts < len(data))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)  # the low bytes of a block
#: Odd numbers that set two hashes of one word apart.
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``which`` 0 and 1 give two independent ones.

    Each block of eight bytes is mixed with its place before the blocks of a word are summed, so no regular word cancels out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    seed, lengths = _SEEDS[which], (ends - starts).astype(np.uint64)
    out = mixed((at_byte[starts] & _KEEP[np.minimum(lengths, 8)]) ^ seed)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        more = (lengths[long].astype(np.int64) - 1) // 8  # blocks after the first
        nth = grouped_chars(more) + 1
        at = np.repeat(starts[long], more) + 8 * nth
        block = at_byte[at] & _KEEP[np.minimum(np.repeat(ends[long], more) - at, 8)]
        block = mixed(mixed(block ^ seed) + mixed(nth.astype(np.uint64) * seed))
        out[long] += np.add.reduceat(block, np.cumsum(more) - more)
    return mixed(out + lengths * seed)


class RangeHash:
    """Hashes of ranges of consecutive words by prefix sums."""

    def __init__(self, words: np.ndarray, check: bool = False) -> None:
        up, self.down = (_check_powers if check else _word_powers).to(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words) * up[: len(words)] if check else words * up[: len(words)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def grouped_chars(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 within each group of the given lengths."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


# --- connected components --------------------------------------------------------------------------------------------


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the undirected links: component is the smallest node reachable.

    Alternating large-star and small-star steps, each stored in the shared folder; about log2 of the longest chain
    rounds. Every step is an aggregation (minimum per node, combined before the shuffle) and a join whose hot side Spark
    splits; no group is gathered.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    before = None
    for _ in range(rounds):
        # large star: every neighbour above a node is linked to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour below a node, and the node, is linked to the smallest neighbour
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = stored(small, "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = nxt
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def unit(*columns: Column) -> Column:
    """A number from 0 to below 1 fixed by the values, alike in any SQL engine: the first 32 bits of a SHA-256."""
    text = F.concat_ws("\u001f", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
