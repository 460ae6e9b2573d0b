"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. A word goes if some window that covers it also starts earlier:
in a document that came before, or before it in the same document.

Fingerprints. Of the window's inner ``GRAM``-word hashes the smallest stands for the window (winnowing): equal windows
always share it, and about two in ``WINDOW - GRAM + 2`` hashes are ever chosen. A fingerprint is stored with a second,
independent hash of its whole surroundings (all windows that hold it), its document and its place.

Index. Each batch of documents leaves one immutable run: its new fingerprints, sorted, in packed rows by hash range. A new
batch is merged with the runs range by range:

* same fingerprint and same surroundings as an earlier occurrence: all windows there repeat, nothing more to compare;
* a fingerprint with several surroundings: the windows of one occurrence of each are verified. Their documents' words are
  read again, every window is hashed by two independent 64-bit hashes, and the first of equal windows stays.

Runs hold only one occurrence of each surroundings, so boilerplate costs one entry however often it occurs; more than
``MAX_RUNS`` runs are compacted into one.

Skew. Occurrences met in the same slice of a few MB are merged before the shuffle. Fingerprints that a bounded sample shows
to be frequent are dealt by their surroundings as well, so that no hash range gathers a hot one; they always go the
verified way, which gives the same result.

Defined cases: a missing text has no words; a document of fewer than ``WINDOW`` words loses nothing; rows without id are
left out; repeated rows (same id and text) are one document and each get its result; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.common import RangeHash, delete_path, forget, release_shuffles, shared_dir, split_words, stored, text_slices, word_hashes

WINDOW, GRAM = 20, 8
SIDE = WINDOW - GRAM
BATCHES, MAX_RUNS = 2, 1
RANGE_BYTES, PART_BYTES = 16 << 20, 8 << 20
SAMPLE_DOCS, HOT_SHARE, HOT_MOST = 4000, 0.01, 4096
_MAX = np.iinfo(np.uint64).max

ANCHOR, FLAG, REQUEST, RUN = 0, 1, 2, 3
SCHEMA = "kind int, key long, old boolean, fp binary, ctx binary, doc binary, pos binary, span binary"


def prime_at(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _slide(x: np.ndarray, width: int, f, forward: bool) -> np.ndarray:
    """f over x[i .. i+width-1], or over x[i-width+1 .. i]; cut at the ends."""
    if not forward:
        return _slide(x[::-1], width, f, True)[::-1]
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = f(out[:-step], out[step:]) if len(out) > step else out[:-step]
        have += step
    return out


def anchors(words: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Chosen fingerprints of the rows: row, place in the row, words before (a) and after (b) in the surroundings, fp, ctx."""
    nw = len(words)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    left = first[1:][row] - np.arange(nw)  # words from here to the row's end
    wide = n[row] >= WINDOW
    at = np.arange(nw)
    ok = wide & (left >= GRAM)
    fp = np.full(nw, _MAX)
    main = RangeHash(words)
    fp[ok] = main.of(at[ok], at[ok] + GRAM) | np.uint64(1)
    low = _slide(fp, SIDE + 1, np.minimum, True)
    low[~(wide & (left >= WINDOW))] = 0
    i = np.flatnonzero(ok & (_slide(low, SIDE + 1, np.maximum, False) == fp))
    place = i - first[row[i]]
    a, b = np.minimum(SIDE, place), np.minimum(SIDE, left[i] - GRAM)
    ctx = RangeHash(words, check=True).of(i - a, i + GRAM + b) + (a * (SIDE + 1) + b).astype(np.uint64)
    return {"row": row[i], "place": place, "a": a, "b": b, "fp": fp[i], "ctx": ctx}


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _packed(kind: int, keys: np.ndarray, old: bool, **columns: np.ndarray) -> list[tuple]:
    """One row for each key, the columns as bytes in their order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cuts = np.append(np.flatnonzero(_groups(k)), len(k)) if len(k) else np.zeros(1, np.int64)
    cols = {c: v[order] for c, v in columns.items()}
    get = lambda c, lo, hi: cols[c][lo:hi].tobytes() if c in cols else b""
    return [(kind, int(k[lo]), old, *[get(c, lo, hi) for c in ("fp", "ctx", "doc", "pos", "span")]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _arrow(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 8
    kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "key", "old", "fp", "ctx", "doc", "pos", "span"])


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), dtype)


class FingerprintIndex:
    """Runs of historical fingerprints; ``add`` deduplicates a batch against them and itself, and appends the batch's run."""

    def __init__(self, spark: SparkSession, expected_bytes: int, max_runs: int = MAX_RUNS) -> None:
        self.spark, self.max_runs = spark, max_runs
        self.ranges = max(32, -(-expected_bytes // RANGE_BYTES))
        self.parts = prime_at(max(31, -(-expected_bytes // PART_BYTES)))
        self.runs: list[DataFrame] = []
        self.history: list[DataFrame] = []
        self.hot: set[int] | None = None

    # --- steps of a batch ---

    def _hot(self, docs: DataFrame) -> np.ndarray:
        """Fingerprints in at least ``HOT_SHARE`` of a sample of at most ``SAMPLE_DOCS`` documents; only a matter of balance."""
        n = docs.count()
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_DOCS))) == 0).limit(SAMPLE_DOCS)

        def chosen(batches):
            for batch in batches:
                for _, _, offs, data in text_slices(batch.column(1)):
                    starts, ends, first = split_words(data, offs)
                    x = anchors(word_hashes(data, starts, ends), first)
                    u = np.unique(np.stack([x["row"].astype(np.uint64), x["fp"]]), axis=1)[1]
                    yield pa.record_batch([pa.array(u.view(np.int64))], names=["fp"])

        least = max(20, HOT_SHARE * min(n, SAMPLE_DOCS))
        found = some.select("doc_id", "text").mapInArrow(chosen, "fp long").groupBy("fp").count().where(F.col("count") >= least).orderBy(F.desc("count"), "fp").limit(HOT_MOST)
        return np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64))

    def _fingerprinted(self, docs: DataFrame, hot: np.ndarray) -> DataFrame:
        ranges, parts = self.ranges, self.parts

        def make(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for lo, hi, offs, data in text_slices(batch.column(1)):
                    starts, ends, first = split_words(data, offs)
                    x = anchors(word_hashes(data, starts, ends), first)
                    doc = ids[lo:hi][x["row"]]
                    order = np.lexsort((x["place"], doc, x["ctx"], x["fp"]))
                    x = {k: v[order] for k, v in x.items()}
                    doc = doc[order]
                    new = _groups(x["fp"], x["ctx"])
                    same = ~new & (doc == doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]) & (x["place"] == x["place"][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))])
                    again = ~new & ~same
                    begin = (x["place"] - x["a"]).astype(np.uint32)
                    size = (x["a"] + GRAM + x["b"]).astype(np.uint8)
                    rows = _packed(FLAG, doc[again] % parts, False, doc=doc[again], pos=begin[again], span=size[again])
                    kept = {k: v[new] for k, v in x.items()}
                    key = ((kept["fp"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    if len(hot):
                        is_hot = hot[np.minimum(np.searchsorted(hot, kept["fp"]), len(hot) - 1)] == kept["fp"]
                        key = np.where(is_hot, ((kept["ctx"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64) + ranges, key)
                    rows += _packed(ANCHOR, key, False, fp=kept["fp"], ctx=kept["ctx"], doc=doc[new], pos=kept["place"].astype(np.uint32), span=(kept["a"] * 16 + kept["b"]).astype(np.uint8))
                    yield from _arrow(rows).to_batches()

        return docs.select("doc_id", "text").mapInArrow(make, SCHEMA)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """Fingerprints of the batch and of the runs, range by range: flags, requests to verify, and the new run."""
        parts, ranges = self.parts, self.ranges

        def merge(key, table):
            if key[0].as_py() == FLAG:
                return table
            which = int(key[1].as_py())
            sizes = [len(d) // 8 for d in table["doc"].to_pylist()]
            old = np.repeat(table["old"].to_numpy(zero_copy_only=False).astype(bool), sizes)
            fp, ctx, doc = _joined(table, "fp", np.uint64), _joined(table, "ctx", np.uint64), _joined(table, "doc", np.int64)
            pos, span = _joined(table, "pos", np.uint32), _joined(table, "span", np.uint8)
            order = np.lexsort((pos, doc, ~old, ctx, fp))
            fp, ctx, doc, pos, span, old = fp[order], ctx[order], doc[order], pos[order], span[order], old[order]
            a, b = (span >> 4).astype(np.int64), (span & 15).astype(np.int64)
            new = _groups(fp, ctx)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = ~new & ~old & ~((doc == doc[lead]) & (pos == pos[lead]))
            out = _packed(FLAG, doc[again] % parts, False, doc=doc[again], pos=(pos - a)[again].astype(np.uint32), span=(a + GRAM + b)[again].astype(np.uint8))
            # one occurrence of each surroundings; those of a fingerprint with several are verified if one of them is new
            rep = np.flatnonzero(new)
            group = np.cumsum(_groups(fp[rep])) - 1 if len(rep) else np.zeros(0, np.int64)
            several = np.bincount(group) > 1 if len(rep) else np.zeros(0, bool)
            fresh = np.bincount(group, ~old[rep]) > 0 if len(rep) else np.zeros(0, bool)
            ask = rep[(several & fresh)[group]] if which < ranges else rep
            for was in (False, True):
                some = ask[old[ask] == was]
                out += _packed(REQUEST, doc[some] % parts, was, doc=doc[some], pos=(pos - a)[some].astype(np.uint32), span=(a + b - SIDE)[some].astype(np.uint8))
            keep = rep[~old[rep]]
            out += _packed(RUN, np.full(len(keep), which), True, fp=fp[keep], ctx=ctx[keep], doc=doc[keep], pos=pos[keep], span=span[keep])
            return _arrow(out)

        return rows.groupBy("kind", "key").applyInArrow(merge, SCHEMA)

    def _windows(self, docs: DataFrame, requests: DataFrame) -> DataFrame:
        """Window hashes at the requested places, packed by hash range: fp and ctx are two hashes of the window."""
        ranges = self.ranges

        def hashed(texts, asked):
            rows: list[tuple] = []
            if asked.num_rows and texts.num_rows:
                was = bool(asked["old"][0].as_py())
                doc, pos, more = _joined(asked, "doc", np.int64), _joined(asked, "pos", np.uint32).astype(np.int64), _joined(asked, "span", np.uint8).astype(np.int64)
                order = np.argsort(doc, kind="stable")
                doc, pos, more = doc[order], pos[order], more[order]
                ids = texts["doc_id"].to_numpy()
                for lo, hi, offs, data in text_slices(texts["text"].combine_chunks()):
                    mine = ids[lo:hi]
                    lows, highs = np.searchsorted(doc, mine), np.searchsorted(doc, mine, side="right")
                    if not (highs > lows).any():
                        continue
                    starts, ends, first = split_words(data, offs)
                    words = word_hashes(data, starts, ends)
                    h1, h2 = RangeHash(words), RangeHash(words, check=True)
                    count = highs - lows
                    r = np.repeat(np.arange(len(mine)), count)
                    pick = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lows, count)
                    each = more[pick] + 1  # windows from pos on
                    row = np.repeat(r, each)
                    start = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(pos[pick], each)
                    both = np.unique(row * np.int64(1 << 32) + start)
                    row, start = both >> 32, both & 0xFFFFFFFF
                    at = first[row] + start
                    fp, ctx = h1.of(at, at + WINDOW), h2.of(at, at + WINDOW)
                    d = mine[row]
                    order2 = np.lexsort((start, d, ctx, fp))
                    fp, ctx, d, start = fp[order2], ctx[order2], d[order2], start[order2]
                    key = ((fp >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    rows += _packed(ANCHOR, key, was, fp=fp, ctx=ctx, doc=d, pos=start.astype(np.uint32))
            return _arrow(rows)

        part = F.pmod("doc_id", F.lit(self.parts)).alias("key")
        return docs.select(part, "doc_id", "text").groupBy("key").cogroup(requests.groupBy("key")).applyInArrow(hashed, SCHEMA)

    def _verified(self, windows: DataFrame) -> DataFrame:
        parts = self.parts

        def repeats(key, table):
            old = np.repeat(table["old"].to_numpy(zero_copy_only=False).astype(bool), [len(d) // 8 for d in table["doc"].to_pylist()])
            fp, ctx, doc, pos = _joined(table, "fp", np.uint64), _joined(table, "ctx", np.uint64), _joined(table, "doc", np.int64), _joined(table, "pos", np.uint32)
            order = np.lexsort((pos, doc, ~old, ctx, fp))
            fp, ctx, doc, pos, old = fp[order], ctx[order], doc[order], pos[order], old[order]
            new = _groups(fp, ctx)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = ~new & ~old & ~((doc == doc[lead]) & (pos == pos[lead]))
            return _arrow(_packed(FLAG, doc[again] % parts, False, doc=doc[again], pos=pos[again], span=np.full(int(again.sum()), WINDOW, np.uint8)))

        return windows.groupBy("key").applyInArrow(repeats, SCHEMA)

    def _cut(self, docs: DataFrame, flags: DataFrame, with_text: bool) -> DataFrame:
        """Each document without the flagged words."""

        def cut(texts, flagged):
            ids, n_words, n_removed, digests, kept_texts = [], [], [], [], []
            doc, pos, size = _joined(flagged, "doc", np.int64), _joined(flagged, "pos", np.uint32).astype(np.int64), _joined(flagged, "span", np.uint8).astype(np.int64)
            order = np.argsort(doc, kind="stable")
            doc, pos, size = doc[order], pos[order], size[order]
            mine_all = texts["doc_id"].to_numpy()
            for lo, hi, offs, data in text_slices(texts["text"].combine_chunks()) if texts.num_rows else ():
                mine = mine_all[lo:hi]
                starts, ends, first = split_words(data, offs)
                lows = np.searchsorted(doc, mine)
                count = np.searchsorted(doc, mine, side="right") - lows
                r = np.repeat(np.arange(len(mine)), count)
                pick = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lows, count)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first[r] + pos[pick], 1)
                np.add.at(edge, first[r] + pos[pick] + size[pick], -1)
                gone = np.cumsum(edge)[:-1] > 0
                row = np.repeat(np.arange(len(mine)), np.diff(first))
                k = np.flatnonzero(~gone)
                last = np.ones(len(k), bool)
                last[:-1] = row[k[1:]] != row[k[:-1]]
                step = np.zeros(len(data) + 2, np.int8)
                np.add.at(step, starts[k], 1)
                np.add.at(step, np.where(last, ends[k], ends[k] + 1), -1)
                inside = np.cumsum(step[: len(data)], dtype=np.int8).astype(bool)
                spaced = data.copy()
                spaced[ends[k][~last]] = 32
                out = spaced[inside].tobytes()
                bounds = np.concatenate([[0], np.cumsum(inside)])[offs] if len(data) else np.zeros(len(offs), np.int64)
                ids += mine.tolist()
                n_words += np.diff(first).tolist()
                n_removed += np.bincount(row[gone], minlength=len(mine)).tolist()
                for i in range(len(mine)):
                    kept = out[bounds[i] : bounds[i + 1]]
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode() if with_text else None)
            cols = [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
            return pa.table(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

        part = F.pmod("doc_id", F.lit(self.parts)).alias("key")
        out = docs.select(part, "doc_id", "text").groupBy("key").cogroup(flags.groupBy("key")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
        return out if with_text else out.drop("kept_text")

    # --- the public part ---

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of a batch (doc_id long, text); everything added before counts as earlier."""
        docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
        if self.hot is None:
            self.hot = self._hot(docs)
        rows = self._fingerprinted(docs, self.hot)
        for run in self.runs:
            rows = rows.unionByName(run.withColumn("kind", F.lit(ANCHOR)))
        path = f"{shared_dir(self.spark)}/fingerprints-{uuid.uuid4().hex}"
        self._merged(rows).write.option("compression", "zstd").partitionBy("kind").parquet(path)
        merged = self.spark.read.schema(SCHEMA).parquet(path)
        release_shuffles(self.spark)
        kind = lambda k: merged.where(F.col("kind") == k)
        windows = self._windows(docs, kind(REQUEST).where("not old"))
        for before in self.history:
            windows = windows.unionByName(self._windows(before, kind(REQUEST).where("old")))
        flags = stored(self._verified(windows), "flags")
        release_shuffles(self.spark)
        result = stored(self._cut(docs, kind(FLAG).unionByName(flags), with_text), "cut")
        release_shuffles(self.spark)
        forget(flags)
        for k in (FLAG, REQUEST):
            delete_path(self.spark, f"{path}/kind={k}")
        run = kind(RUN)
        run._stored_path = path
        self.runs.append(run)
        self.history.append(docs)
        if len(self.runs) > self.max_runs:
            self.compact()
        return result

    def compact(self) -> None:
        """All runs as one, each hash range sorted again."""
        if len(self.runs) < 2:
            return
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.unionByName(run)

        def merge(key, table):
            fp, ctx, doc = _joined(table, "fp", np.uint64), _joined(table, "ctx", np.uint64), _joined(table, "doc", np.int64)
            pos, span = _joined(table, "pos", np.uint32), _joined(table, "span", np.uint8)
            order = np.lexsort((pos, doc, ctx, fp))
            return _arrow(_packed(RUN, np.full(len(fp), key[0].as_py()), True, fp=fp[order], ctx=ctx[order], doc=doc[order], pos=pos[order], span=span[order]))

        new = stored(rows.groupBy("key").applyInArrow(merge, SCHEMA), "run")
        forget(*self.runs)
        self.runs = [new]
        release_shuffles(self.spark)

    def drop(self) -> None:
        forget(*self.runs)
        self.runs, self.history = [], []


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """Deduplicate a whole table in ``batches`` ranges of ids, smallest first, through one index."""
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = FingerprintIndex(docs.sparkSession, int(size))
    cuts = sorted({int(c) for c in d.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001)}) if batches > 1 else []
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        some = d
        if lo is not None:
            some = some.where(F.col("doc_id") > lo)
        if hi is not None:
            some = some.where(F.col("doc_id") <= hi)
        done = index.add(some, with_text)
        out = done if out is None else out.unionByName(done)
    index.drop()
    return out
