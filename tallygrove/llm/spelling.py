"""Spelling variants: words one edit apart, through a positional q-gram inverted index with a count filter.

Two words are near if they differ by one inserted, deleted or replaced code point. One edit leaves the left or the right
half of the shorter word as it is, so every word is dealt to the groups of its halves (as the shorter and as the longer one
of a pair) and near words meet in at least one group. A group above ``BLOCK`` words, such as a very frequent prefix, is
dealt again by the halves of what its words do not share, until groups are small or one code point is left; so no group grows
with the vocabulary, and no pair is lost. Of the groups in which a pair meets, the one of equal left halves counts it.

Within a group there is an inverted index of bigrams with their positions, over what the members do not share, padded at both ends.
The postings of a word's bigrams, one position off at most, of words of its length or one more, are merged in order and
counted. One edit spoils two bigrams at most, so a pair with fewer common bigrams than the longer word has, less two, is dropped;
what is left is verified on its code points. A task returns, for each word, the number of near words and the most frequent one, never
pairs.

Defined cases: null texts hold no words; a document without id damages no word; repeated documents count again; an empty
table gives no rows; extra columns are ignored; ties between near words go to the smallest in code-point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import forget, grouped_chars, mixed, stored

BLOCK = 256  # words of a group that are compared through one index
BUNDLE = 60_000  # memberships of a task
POSTINGS = 1 << 21  # that are merged at once
RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: maximal runs of Latin letters, lower-cased from A to Z. Where ``damage`` divides h, the crc32 of
    ``<doc_id>:<run>``, the run's code point h % length is deleted (0 damages none). Only words of ``min_length`` and more that occur ``min_count`` times."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))  # a shorter run is no word, damaged or not
    d = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word: Column = F.col("run")
    if damage:
        d = d.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    return d.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _halved(members: DataFrame) -> DataFrame:
    """Each membership (word, n, size, short, head, tail) in the groups of both halves of what its words do not share.

    ``short`` is the length of the shorter word of the group's pairs; its members share ``head`` code points at the start and ``tail`` at the end."""
    rest = F.col("short") - F.col("head") - F.col("tail")
    half = F.floor(rest / 2).cast("int")
    left = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    right = F.struct(F.col("head").alias("head"), (F.col("tail") + rest - half).cast("int").alias("tail"))
    same = F.struct(F.col("head").alias("head"), F.col("tail").alias("tail"))
    sides = F.explode(F.when(rest >= 2, F.array(left, right)).otherwise(F.array(same)))
    out = members.select("word", "n", "size", "short", sides.alias("side")).select("word", "n", "size", "short", "side.*")
    shared = F.xxhash64("short", "head", "tail", F.substring(F.col("word"), F.lit(1), F.col("head")), F.substring(F.col("word"), F.col("size") - F.col("tail") + 1, F.col("tail")))
    return out.withColumn("key", shared)


def groups(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """The memberships of all words, in groups of at most ``block`` words or of words that differ in a code point or two."""
    size = F.length("word")
    start = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("short")).where("short >= 1")
    members = stored(_halved(start.select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"))), "members")
    done: list[DataFrame] = []
    while True:
        hot = stored(members.where(F.col("short") - F.col("head") - F.col("tail") >= 2).groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block).select("key"), "hot")
        if hot.isEmpty():
            break
        done.append(members.join(hot, "key", "left_anti"))
        members = stored(_halved(members.join(hot, "key").drop("key")), "members")
    out = members
    for part in done:
        out = out.unionByName(part)
    return out


def _expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts, lengths) + grouped_chars(lengths)


def _common(points: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many code points are equal from a and b on (``step`` 1) or backwards (-1), up to ``most``."""
    out, alive, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(alive):
        alive = alive[most[alive] > k]
        alive = alive[points[a[alive] + step * k] == points[b[alive] + step * k]]
        k += 1
        out[alive] = k
    return out


def near_pairs(words: list[str], key: np.ndarray, short: np.ndarray, head: np.ndarray, tail: np.ndarray, postings: int = POSTINGS) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words that these groups count, each pair once. Memberships must be in the order of ``key``."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(size) - size
    rest = size - head - tail
    # the inverted index: (group, bigram), position -> membership
    grams = rest + 1
    owner, place = np.repeat(np.arange(len(words)), grams), grouped_chars(grams)
    at = begin[owner] + head[owner] + place
    padded = np.concatenate([[0], points, [0]]).astype(np.uint64)
    first = np.where(place > 0, padded[at], 0).astype(np.uint64)
    second = np.where(place < rest[owner], padded[np.minimum(at + 1, len(padded) - 1)], 0).astype(np.uint64)
    code = mixed(key.astype(np.int64).view(np.uint64)[owner] ^ mixed((first << np.uint64(32)) | second))
    single = np.flatnonzero((rest <= 1) & (size == short))  # one code point is left: all are near, though they share no bigram
    owner, place = np.concatenate([owner, single]), np.concatenate([place, np.zeros(len(single), np.int64)])
    code = np.concatenate([code, mixed(key.astype(np.int64).view(np.uint64)[single] + np.uint64(1))])
    _, gram = np.unique(code, return_inverse=True)
    span = int(place.max(initial=0)) + 3
    slot = gram.astype(np.int64) * span + place + 1
    order = np.lexsort((owner, slot))
    slot, owner, place = slot[order], owner[order], place[order]
    asking = np.flatnonzero((size == short)[owner])  # the shorter word asks
    asking = asking[np.argsort(owner[asking], kind="stable")]
    low, high = np.searchsorted(slot, slot[asking] - 1), np.searchsorted(slot, slot[asking] + 1, side="right")
    found_a, found_b = [], []
    total = np.cumsum(high - low)
    cuts = np.flatnonzero(np.diff(owner[asking])) + 1  # where the next word begins to ask
    lo = 0
    while lo < len(asking):
        limit = (total[lo - 1] if lo else 0) + postings
        fit = cuts[(cuts > lo) & (total[np.maximum(cuts - 1, 0)] <= limit)]
        later = cuts[cuts > lo]
        hi = int(fit[-1]) if len(fit) and total[-1] > limit else len(asking) if total[-1] <= limit else int(later[0]) if len(later) else len(asking)
        some = slice(lo, hi)
        count = high[some] - low[some]
        a, b = np.repeat(owner[asking[some]], count), owner[_expanded(low[some], count)]
        keep = (size[b] > size[a]) | ((size[b] == size[a]) & (b > a))
        pair, times = np.unique(a[keep] * np.int64(len(words)) + b[keep], return_counts=True)  # the postings merged
        a, b = pair // len(words), pair % len(words)
        enough = times >= np.maximum(rest[b] - 1, 1)
        a, b = a[enough], b[enough]
        front = _common(points, begin[a], begin[b], np.minimum(size[a], size[b]), 1)
        back = _common(points, begin[a] + size[a] - 1, begin[b] + size[b] - 1, np.minimum(size[a], size[b]), -1)
        near = np.where(size[a] == size[b], (front < size[a]) & (front + back >= size[a] - 1), front + back >= size[a])
        near &= (key[a] == key[b]) & (front >= head[a]) & (back >= tail[a]) & ((tail[a] == 0) | (front < short[a] - tail[a]))
        found_a.append(a[near])
        found_b.append(b[near])
        lo = hi
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _bundle(table: pa.Table) -> pa.Table:
    """word, near, best_n, best for each membership of a bundle that has a near word."""
    key = table["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    lengths = np.diff(np.concatenate([[0], cut, [len(order)]]))
    order = order[np.repeat(lengths > 1, lengths)]  # a group of one has no pair
    table = table.take(pa.array(order))
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    column = lambda c: table[c].to_numpy().astype(np.int64)
    a, b = near_pairs(words, column("key"), column("short"), column("head"), column("tail"))
    of, other = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.argsort(of, kind="stable")
    of, other = of[by], other[by]
    own, first, near = np.unique(of, return_index=True, return_counts=True)
    most = np.maximum.reduceat(n[other], first) if len(own) else np.zeros(0, np.int64)
    top = n[other] == np.repeat(most, near)
    best: dict[int, str] = {}
    for i, j in zip(of[top].tolist(), other[top].tolist(), strict=True):
        if i not in best or words[j] < best[i]:
            best[i] = words[j]
    return pa.table({"word": pa.array([words[i] for i in own], pa.string()), "near": pa.array(near, pa.int64()), "best_n": pa.array(most, pa.int64()), "best": pa.array([best[i] for i in own.tolist()], pa.string())})


def near_words(words: DataFrame, block: int = BLOCK, bundle: int = BUNDLE) -> DataFrame:
    """word, n_near, best_n, best of each word (distinct, with its n) that has a near word."""
    members = groups(words, block)
    bundles = -(-members.count() // bundle) or 1
    found = members.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(bundles))).groupBy("bundle").applyInArrow(_bundle, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from each word of ``forms`` (word, form) by following forms, by doubling the steps."""
    jumps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = stored(jumps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        moved = not further.where("moved").isEmpty()
        forget(jumps)
        jumps = further.drop("moved")
        jumps._stored_path = further._stored_path  # type: ignore[attr-defined]
        if not moved:
            return jumps


def group_variants(words: DataFrame, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts n.

    A word's form is its most frequent near word, if that occurs at least ``ratio`` times as often."""
    words = stored(words.select("word", "n"), "words")
    near = words.join(near_words(words, block), "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n")), "near")
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of an SQL string, for DuckDB, in a query that also reads ``crc_table``."""
    h = f"hex(encode({text}))"
    byte = f"list_transform(range(CAST(length({h}) / 2 AS BIGINT)), lambda i: CAST(('0x' || substr({h}, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


CRC_TABLE_SQL = "crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t)"

ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
told AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
hashed AS (SELECT run, times, {crc32_sql("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM told, crc_table WHERE length(run) >= 5),
damaged AS (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word, n),
forms AS MATERIALIZED (SELECT b.word, min(x.other) AS form, any_value(b.most) AS form_n FROM best b JOIN near x ON x.word = b.word AND x.other_n = b.most WHERE b.most >= 2 * b.n GROUP BY b.word),
walk AS (SELECT word, form AS root FROM forms UNION SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.root),
ends AS (SELECT w.word, w.root FROM walk w LEFT JOIN forms f ON f.word = w.root WHERE f.word IS NULL)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends e USING (word)
"""
