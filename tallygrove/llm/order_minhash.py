"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are its windows of three words, each labelled with how often it occurred before in the document. A
sketch takes the ``PICKS`` labelled k-mers with the smallest values of one hash function and keeps them in text order;
two documents share it with a probability that falls with their edit distance. Documents that share one of ``SKETCHES``
sketches are candidates, and are linked if ``1 - edits / longer length >= 0.8``, where edits are words inserted, deleted
or replaced, counted by a banded bit-parallel alignment. Classes are the connected components of the links.

Texts of 5 to ``SHORT`` words have no sketches but exact keys: the longer text of a pair is cut into one segment more than
the edits the pair may have, so one segment is left whole and lies in the shorter text, shifted by no more than the edits.
Every pair at the threshold whose shorter text has at most ``SHORT`` words shares such a key.

Equal word sequences are one class member each (grouped by digest first), so copies never meet in a bucket. Buckets are
not expanded into pairs. First every member of a bucket is compared with the bucket's smallest, by joins that Spark splits
where a bucket is hot; this makes the components large. Members of different components that still share a bucket then
meet in tasks: a bucket is split by length into bands of ratio ``least`` (lengths that can't be similar never meet) and
dealt into blocks of at most ``BLOCK`` members and ``BLOCK_BYTES`` of text. A task keeps a union-find of its block's
components, rules out by common words and word pairs what can't be similar (an edit takes away one common word and two
common pairs at most), aligns the rest, and returns only the links that joined two components: a pair that was compared
is never a row. A pair with several common buckets is compared in the one with the smallest key. So no pair that shares a
sketch or key is left untried unless its documents are already in one class.

Buckets of few possible pairs go to tasks in bundles. Alignments are made for many pairs at once, a few 64-bit numbers a
pair; those of very long texts one by one with long integers. Tasks on buckets compare 32-bit hashes of words; every link
is verified on the words themselves, and if one fails, the buckets are compared again by other hashes.

Defined cases: a missing text and a text without words are classes of their own; a text of fewer than five words is only
in a class with equal word sequences; repeated ids are one document, of different texts the one with most words (then the
larger hash) counts; rows without id are left out; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import RangeHash, components, forget, grouped_chars, mixed, release_shuffles, split_words, stored, text_slices, word_hashes

K, SKETCHES, PICKS, SIMILARITY = 3, 40, 2, 0.8
LEAST_WORDS, SHORT = 5, 24
BLOCK, BLOCK_BYTES, BINS = 1024, 8 << 20, 2048
FEW_PAIRS, BUNDLE = 1 << 16, 1024  # pairs of a bucket that goes in a bundle, rows of a bundle
MOST_PARTS, FEW = 8, 8  # 64-bit numbers of a pair aligned with others, pairs that are worth it
TEXT_ROWS, ALIGN_BYTES = 1000, 6 << 20  # texts in an Arrow batch, bytes of texts aligned together
FEW_IDS = 500_000  # rows of two numbers that are broadcast; more are joined by a shuffle


def _occurrences(kmers: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each k-mer occurred before in its row."""
    order = np.lexsort((kmers, row))
    k, r = kmers[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(k))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(k), np.uint64)
    out[order] = nth
    return out


def sketches(data: np.ndarray, offs: np.ndarray, n_sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of a text slice: word hashes, first word of each row, rows that have sketches, their sketches (rows x n_sketches)."""
    starts, ends, first = split_words(data, offs)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    rows = np.flatnonzero(n >= K)
    if not len(rows):
        return words, first, rows, np.zeros((0, n_sketches), np.uint64)
    each = n[rows] - K + 1
    row = np.repeat(np.arange(len(rows)), each)
    begin = np.cumsum(each) - each
    at = np.arange(int(each.sum())) - np.repeat(begin, each) + np.repeat(first[rows], each)
    kmers = RangeHash(words).of(at, at + K)
    labelled = mixed(kmers + np.uint64(0x9FB21C651E98DF25) * _occurrences(kmers, row))
    out = np.empty((len(rows), n_sketches), np.uint64)
    some = each > 1
    for s in range(n_sketches):
        h = labelled * np.uint64(2 * (0x2545F4914F6CDD1D + s * 0x9E3779B97F4A7C15) + 1 & (1 << 64) - 1)
        h ^= h >> np.uint64(32)
        low = np.minimum.reduceat(h, begin)
        is_low = np.flatnonzero(h == low[row])
        p1 = is_low[np.searchsorted(is_low, begin)]  # the first place of the smallest value
        h[p1] = np.iinfo(np.uint64).max
        low2 = np.minimum.reduceat(h, begin)
        is_low = np.flatnonzero(h == low2[row])
        p2 = is_low[np.searchsorted(is_low, begin)]
        a, b = np.minimum(p1, p2), np.maximum(p1, p2)
        b = np.where(some, b, a)
        out[:, s] = mixed(mixed(labelled[a]) * np.uint64(3) + labelled[b] + np.uint64(s))
    return words, first, rows, out


@cache
def _segments(n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and kind of the keys of a text of n words: its own segments as the longer text of a pair,
    and as the shorter one the places where a segment of a longer text may lie."""
    made = set()
    for longer in range(n, int(n / least + 1e-9) + 1):
        if longer > n and n > SHORT:
            break
        most = int((1 - least) * longer + 1e-9)
        if not most:
            continue
        cuts = [longer * i // (most + 1) for i in range(most + 2)]
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            shifts = [x for x in range(-most, most + 1) if abs(x) + abs(x + longer - n) <= most] if n <= SHORT else [0]
            made |= {(lo + x, hi - lo, longer * 1024 + i) for x in shifts if 0 <= lo + x and hi + x <= n}
    at, size, kind = np.array(sorted(made), np.int64).reshape(-1, 3).T
    return at, size, mixed(kind.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))


def short_keys(words: np.ndarray, first: np.ndarray, least: float = SIMILARITY) -> dict[int, np.ndarray]:
    """For the rows that may be in a pair whose shorter text has at most ``SHORT`` words: their exact keys."""
    n, hashes, out = np.diff(first), RangeHash(words), {}
    for size in range(LEAST_WORDS, int(SHORT / least + 1e-9) + 1):
        rows = np.flatnonzero(n == size)
        at, length, kind = _segments(size, least)
        if len(rows) and len(at):
            lo = first[rows][:, None] + at
            out |= zip(rows.tolist(), mixed(hashes.of(lo, lo + length) ^ kind).view(np.int64), strict=True)
    return out


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Words to insert, delete or replace to make b from a, or most + 1 if more: the band of diagonals within ``most`` of the main one.

    Bit i of the vectors of column j is the vertical difference at row j - most + i; the band slides down one row a column.
    """
    n, m = len(a), len(b)
    lo = 0
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n:
        return m
    # a narrow band first: if it isn't left, its result is exact
    width = min(most, max(8, m - n))
    while True:
        d = _banded(a, b, width)
        if d <= width or width >= most:
            return min(d, most + 1)
        width = min(most, 4 * width)


def _banded(a: list[int], b: list[int], k: int) -> int:
    """Edit distance if at most k, else a number above k. len(a) <= len(b) <= len(a) + k.

    Myers' bit vectors over the rows of a, cut for each column to the rows within k of it.
    """
    n, m = len(a), len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    if 2 * k + 1 >= n:
        ones = (1 << n) - 1
        vp, vn, score, last = ones, 0, n, 1 << (n - 1)
        for x in b:
            eq = places.get(x, 0)
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & ones
            hp, hn = vn | (ones & ~(d0 | vp)), d0 & vp
            if hp & last:
                score += 1
            elif hn & last:
                score -= 1
            hp = (hp << 1 | 1) & ones
            vp, vn = (hn << 1 & ones) | (ones & ~(d0 | hp)), hp & d0
        return score
    # rows j-k .. j+k of column j as bits 0 .. 2k; rows above the first are kept as matches of nothing with vertical steps of 0
    width = 2 * k + 1
    ones = (1 << width) - 1
    top = 1 << (width - 1)
    # before column 1: rows 1-k .. 1+k of column 0 seen from the band of column 1; vertical difference is +1 for rows >= 1
    vp, vn = ones & ~((1 << k) - 1), 0
    score = k  # value at the lowest row of the band in column 0: row k
    for j in range(1, m + 1):
        shift = j - 1 - k  # index into a of bit 0
        x = places.get(b[j - 1], 0)
        eq = (x >> shift if shift >= 0 else x << -shift) & ones
        low = j + k  # row of the top bit
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & ones
        hp, hn = vn | (ones & ~(d0 | vp)), d0 & vp
        if low <= n:
            score += 0 if d0 & top else 1  # along the diagonal
        else:
            bit = 1 << (width - 1 - (low - n))  # row n
            if hp & bit:
                score += 1
            elif hn & bit:
                score -= 1
        # the next column's band begins one row lower: vectors shift down by one bit
        d1 = d0 >> 1
        vp, vn = (hn | (ones & ~(d1 | hp))) & ones, hp & d1
        if score > k + (m - j) + k:
            return k + 1
    return score


def _sum(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of long unsigned numbers, one a column, the lowest word first."""
    out = x + y
    carry = out < x
    for w in range(1, len(out)):
        more = out[w] + carry[w - 1]
        carry[w] |= more < out[w]
        out[w] = more
    return out


def _shifted(x: np.ndarray) -> np.ndarray:
    """Long numbers shifted down by one bit."""
    out = x >> np.uint64(1)
    out[:-1] |= x[1:] << np.uint64(63)
    return out


def banded_distances(pairs: list[tuple[np.ndarray, np.ndarray]], parts: int = 1) -> np.ndarray:
    """Edit distances of many pairs at once, exact up to ``32 * parts - 1`` and above it only known to be above.

    The bit vectors of ``_banded`` for that band around the main diagonal, ``parts`` unsigned numbers a pair.
    """
    k, width = 32 * parts - 1, 64 * parts - 1
    out = np.full(len(pairs), k + 1)
    short = [x if len(x) <= len(y) else y for x, y in pairs]
    long = [y if len(x) <= len(y) else x for x, y in pairs]
    n, m = np.array([len(x) for x in short], np.int64), np.array([len(x) for x in long], np.int64)
    out[m == 0] = 0
    order = np.argsort(-m, kind="stable")
    order = order[(m[order] - n[order] <= k) & (m[order] > 0)]
    if not len(order):
        return out
    n, m, p, most = n[order], m[order], len(order), int(m[order[0]])
    # the shorter texts with k places of no word before and enough after; the longer ones by column
    a, b = np.full((p, most + width + 1), -1, np.int32), np.full((most, p), -2, np.int32)
    for i, q in enumerate(order):
        a[i, k : k + n[i]], b[: m[i], i] = short[q], long[q]
    one, top = np.uint64(1), np.uint64(1 << 62)
    ones = np.full((parts, 1), np.iinfo(np.uint64).max)
    ones[-1] >>= one  # the highest bit is no place of the band
    vp, vn = np.zeros((parts, p), np.uint64), np.zeros((parts, p), np.uint64)
    for bit in range(k, width):
        vp[bit // 64] |= one << np.uint64(bit % 64)
    score, live, every = np.minimum(k, n), p, np.arange(p)
    for j in range(1, most + 1):
        while m[live - 1] < j:
            live -= 1
        eq = np.packbits(a[:live, j - 1 : j - 1 + width] == b[j - 1, :live, None], axis=1, bitorder="little").view("<u8").T
        p1, n1 = vp[:, :live], vn[:, :live]
        d0 = ((_sum(eq & p1, p1) ^ p1) | eq | n1) & ones
        hp, hn = n1 | (ones & ~(d0 | p1)), d0 & p1
        beyond = j + k - n[:live]  # rows of the band below the last row
        place = np.clip(width - 1 - beyond, 0, width - 1)
        at, bit = place // 64, one << (place % 64).astype(np.uint64)
        along = ((d0[-1] & top) == 0).astype(np.int64)
        across = ((hp[at, every[:live]] & bit) != 0).astype(np.int64) - ((hn[at, every[:live]] & bit) != 0)
        score[:live] += np.where(beyond <= 0, along, across)
        d1 = _shifted(d0)
        vp[:, :live], vn[:, :live] = (hn | (ones & ~(d1 | hp))) & ones, hp & d1
    out[order] = np.minimum(score, k + 1)
    return out


def numbered(texts: list[bytes], known: dict[bytes, int]) -> list[np.ndarray]:
    """The words of the texts as numbers, equal for equal words; ``known`` gathers the numbers given."""
    return [np.array([known.setdefault(w, len(known)) for w in t.split()], np.int32) for t in texts]


def _labelled(items: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Rows x ``BINS``: how many of a row's items, each with its number of occurrence, fall into a bin."""
    label = mixed(items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(_occurrences(items.astype(np.uint64), row)))
    return np.bincount(row * BINS + (label % np.uint64(BINS)).astype(np.int64), minlength=n_rows * BINS).reshape(n_rows, BINS).astype(np.float32)


def profiles(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs of neighbouring words of each text by bin; the product of two rows is never below what the texts have in common."""
    out = np.zeros((2, len(words), BINS), np.float32)
    lo = 0
    while lo < len(words):  # some texts at a time, for memory
        hi, size = lo + 1, len(words[lo])
        while hi < len(words) and size + len(words[hi]) <= 1 << 15 and hi - lo < 128:
            size, hi = size + len(words[hi]), hi + 1
        row, every = np.repeat(np.arange(hi - lo), [len(w) for w in words[lo:hi]]), np.concatenate(words[lo:hi]).astype(np.int64)
        both = every[:-1] << 32 | every[1:]
        inside = row[:-1] == row[1:]
        out[0, lo:hi], out[1, lo:hi] = _labelled(every, row, hi - lo), _labelled(both[inside], row[:-1][inside], hi - lo)
        lo = hi
    return out[0], out[1]


def may_be_similar(a: list[np.ndarray], b: list[np.ndarray], least: float, known: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Rows x columns: whether lengths, common words and common word pairs leave a similarity of ``least`` possible."""
    n, m = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
    longer = np.maximum(n, m)
    most = np.floor((1 - least) * longer + 1e-9)
    (words_a, words_b), (pairs_a, pairs_b) = known or zip(profiles(a), profiles(b), strict=True)
    out = (longer - np.minimum(n, m) <= most) & (words_a @ words_b.T >= longer - most)
    return out & (pairs_a @ pairs_b.T >= longer - 1 - 2 * most)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the words that they have in common at the beginning and at the end; no alignment needs those."""
    n = min(len(a), len(b))
    apart = a[:n] != b[:n]
    lo = int(apart.argmax()) if apart.any() else n
    a, b, n = a[lo:], b[lo:], n - lo
    apart = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    hi = int(apart.argmax()) if apart.any() else n
    return a[: len(a) - hi], b[: len(b) - hi]


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """1 - edits / longer length of each pair of word sequences, or -1 below ``least``."""
    longer = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    most = np.floor((1 - least) * longer + 1e-9).astype(np.int64)
    pairs = [_trimmed(x, y) for x, y in pairs]
    left = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    enough = np.minimum(most, left) // 32 + 1  # parts whose band holds every distance that counts
    # every word of the longer rest that has no equal in the other takes an edit
    common = np.array([np.minimum(np.bincount(x & BINS - 1, minlength=BINS), np.bincount(y & BINS - 1, minlength=BINS)).sum() if r > m else r for (x, y), r, m in zip(pairs, left, most, strict=True)], np.int64)
    may = left - common <= most
    d, todo = np.where(may, -1, most + 1), np.argsort(left, kind="stable")
    todo = todo[may[todo]]
    for step in (1, 2, MOST_PARTS):
        again = []
        parts_of = np.minimum(enough[todo], step)
        for parts in np.unique(parts_of).tolist():
            mine, lo = todo[parts_of == parts], 0
            while lo < len(mine):  # as many pairs as a few MB hold
                hi = lo + 1
                while hi < len(mine) and hi - lo < 8192 and (hi - lo) * (left[mine[hi]] + 64 * parts) < 1 << 20:
                    hi += 1
                some, lo = mine[lo:hi], hi
                if len(some) >= FEW:
                    d[some] = banded_distances([pairs[i] for i in some], parts)
                    again.append(some[(d[some] >= 32 * parts) & (enough[some] > parts)])
                else:
                    d[some] = -1
        todo = np.concatenate([*again, todo[:0]])
        todo = todo[np.argsort(left[todo], kind="stable")]
    d[todo] = -1
    for i in np.flatnonzero(d < 0):
        d[i] = edit_distance(pairs[i][0].tolist(), pairs[i][1].tolist(), int(most[i]))
    return np.where(d <= most, 1 - d / np.maximum(longer, 1), -1.0)


def _sketched(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, hash (of the text), digest (of the word sequence), n_words, sketches (of a short text its exact keys, of one a
    little longer both)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            digests, sizes, sk = [b""] * n, np.zeros(n, np.int64), [None] * n
            for lo, _, offs, data in text_slices(batch.column(2)):
                words, first, rows, made = sketches(data, offs)
                whole = data.tobytes()
                sizes[lo : lo + len(offs) - 1] = np.diff(first)
                for i in range(len(offs) - 1):
                    digests[lo + i] = hashlib.blake2b(b" ".join(whole[offs[i] : offs[i + 1]].split()), digest_size=16).digest()
                for r, values in zip(rows, made.view(np.int64), strict=True):
                    if first[r + 1] - first[r] > SHORT:
                        sk[lo + int(r)] = values
                for r, values in short_keys(words, first, least).items():
                    sk[lo + r] = values if sk[lo + r] is None else np.concatenate([sk[lo + r], values])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(sk, pa.list_(pa.int64()))], names=["doc_id", "hash", "digest", "n_words", "sketches"])

    return docs.select("doc_id", "hash", "text").mapInArrow(make, "doc_id long, hash long, digest binary, n_words long, sketches array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs at ``least`` or above."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            held += [batch] if batch is not None else []
            if held and (batch is None or sum(x.nbytes for x in held) >= ALIGN_BYTES):  # many pairs at once, whatever the batches
                known: dict[bytes, int] = {}
                some = pa.Table.from_batches(held)
                a, b = (numbered(some.column(i).cast(pa.binary()).to_pylist(), known) for i in (2, 3))
                found = some.filter(pa.array(similarities(list(zip(a, b, strict=True)), least) >= 0)).select([0, 1])
                held = []
                yield from found.to_batches()

    return both.select("a", "b", "text_a", "text_b").mapInArrow(align, "a long, b long")


def _coded(texts: DataFrame, which: int) -> DataFrame:
    """id, codes (32 bits of the words' hashes, of one of two kinds), keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, offs, data in text_slices(batch.column(1)):
                starts, ends, first = split_words(data, offs)
                words = (word_hashes(data, starts, ends, which) >> np.uint64(32)).astype("<u4")
                out += [words[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["id", "codes", "keys"])

    return texts.select("id", "text", "keys").mapInArrow(make, "id long, codes binary, keys array<long>")


class Members:
    """Documents of a task: ids, components, whether they ask, words, and all keys that they share with other components."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.components, self.key = table["doc_id"].to_numpy(), table["component"].to_numpy(), table["key"].to_numpy()
        self.asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        self.codes = [np.frombuffer(x, np.uint32) for x in table["codes"].to_pylist()]
        lists = table["keys"].combine_chunks()
        self.starts, self.keys = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
        self.starts = self.starts - self.starts[0]


def _numbered(*sides: Members) -> list[list[np.ndarray]]:
    """The words of both sides by small numbers."""
    codes = np.concatenate([np.zeros(0, np.uint32), *[c for side in sides for c in side.codes]])
    number = np.unique(codes, return_inverse=True)[1].astype(np.int32)
    cuts = np.cumsum([len(c) for side in sides for c in side.codes])
    parts = np.split(number, cuts[:-1]) if len(cuts) else []
    return [parts[: len(sides[0].ids)], parts[len(sides[0].ids) :]]


def _joining(words_a, words_b, left: Members, right: Members, pairs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of those of the pairs (places in left and right) that are similar and join two components not yet joined."""
    comps, number = np.unique(np.concatenate([left.components, right.components]), return_inverse=True)
    comp_a, comp_b = number[: len(left.ids)], number[len(left.ids) :]
    parent = np.arange(len(comps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links: list[tuple[int, int]] = []
    rest, wave = pairs[np.random.default_rng(len(pairs)).permutation(len(pairs))], 512  # so that a wave holds pairs of many components
    while len(rest):
        now, rest = rest[:wave], rest[wave:]
        similar = similarities([(words_a[i], words_b[j]) for i, j in now], least) >= 0
        for i, j in now[similar]:
            x, y = root(comp_a[i]), root(comp_b[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((left.ids[i], right.ids[j]))
        if similar.any() and len(rest):
            roots = np.array([root(x) for x in range(len(comps))])
            rest = rest[roots[comp_a[rest[:, 0]]] != roots[comp_b[rest[:, 1]]]]
        wave = min(2 * wave, 8192)
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return np.minimum(a, b), np.maximum(a, b)


def block_links(left: Members, right: Members, key: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller id, larger id) that join components of two blocks of one large bucket."""
    words_a, words_b = _numbered(left, right)
    open_ = may_be_similar(words_a, words_b, least)
    open_ &= left.components[:, None] != right.components[None, :]
    open_ &= ~right.asks[None, :] | (left.ids[:, None] < right.ids[None, :])  # of two that ask, the smaller asks
    # a pair that shares a smaller key is compared there
    owner = np.repeat(np.arange(len(right.ids)), np.diff(right.starts))
    smaller = right.keys < key
    flat, owner = right.keys[smaller], owner[smaller]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in np.flatnonzero(open_.any(axis=1)):
        own = left.keys[left.starts[i] : left.starts[i + 1]]
        own = own[own < key]
        lo, hi = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        open_[i, owner[np.repeat(lo, hi - lo) + grouped_chars(hi - lo)]] = False
    return _joining(words_a, words_b, left, right, np.argwhere(open_), least)


def bundle_links(some: Members, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for a bundle of small buckets (all rows of each)."""
    order = np.lexsort((some.ids, some.key))
    cuts = np.append(np.flatnonzero(np.diff(some.key[order], prepend=some.key[order[0]] - 1)), len(order))
    (words, _) = _numbered(some, some)
    made = profiles(words)
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        mine = order[lo:hi]
        asks = mine[some.asks[mine]]
        open_ = may_be_similar([words[i] for i in asks], [words[j] for j in mine], least, [(x[asks], x[mine]) for x in made])
        open_ &= (some.components[asks][:, None] != some.components[mine]) & (~some.asks[mine] | (some.ids[asks][:, None] < some.ids[mine]))
        i, j = np.nonzero(open_)
        found.append(np.stack([asks[i], mine[j]], axis=1))
    pairs = np.concatenate(found)
    # a pair that meets in several buckets of the bundle counts once
    low, high = np.minimum(some.ids[pairs[:, 0]], some.ids[pairs[:, 1]]), np.maximum(some.ids[pairs[:, 0]], some.ids[pairs[:, 1]])
    by = np.lexsort((high, low))
    new = np.ones(len(by), bool)
    new[1:] = (low[by[1:]] != low[by[:-1]]) | (high[by[1:]] != high[by[:-1]])
    pairs = pairs[by[new]]
    sets = [frozenset(some.keys[lo:hi].tolist()) for lo, hi in zip(some.starts[:-1], some.starts[1:], strict=True)]
    use = np.array([min(sets[i] & sets[j]) == some.key[i] for i, j in pairs], bool)
    return _joining(words, words, some, some, pairs[use], least)


def _untried(buckets: DataFrame, comp: DataFrame, texts: DataFrame, least: float, which: int = 0, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, few: int = FEW_PAIRS) -> DataFrame:
    """a, b: links between components that share a bucket, not verified on words.

    What lies outside a bucket's largest component asks, the whole bucket is held. Buckets of at most ``few`` such pairs go
    in bundles. In others a document is held in the band of its length, and asks in that band and the next to either side;
    bands are compared block by block.
    """
    there = buckets.select("key", "doc_id").join(comp, F.col("doc_id") == F.col("node")).drop("node")
    sizes = there.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    sizes = sizes.select("key", F.col("largest.component").alias("main"), (F.col("n") * (F.col("n") - F.col("largest.n")) <= few).alias("small"))
    band = F.floor(F.log(F.col("n_words").cast("double")) / F.lit(float(np.log(1 / least)))).cast("int")
    mixed_ = stored(there.join(sizes, "key").select("key", "doc_id", "component", (F.col("component") != F.col("main")).alias("asks"), "small", "n_words", band.alias("band")), "mixed-buckets")
    keys = mixed_.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # as many as a document has sketches and keys
    whole = stored(_coded(texts.withColumnRenamed("doc_id", "id").join(keys, F.col("id") == F.col("doc_id")), which), "mixed-codes", batch_rows=TEXT_ROWS)
    with_codes = lambda d: d.join(whole, F.col("doc_id") == F.col("id")).drop("id")
    as_links = lambda x: pa.table({"a": pa.array(x[0], pa.int64()), "b": pa.array(x[1], pa.int64())})

    small = mixed_.where("small")
    bundles = max(1, -(-small.count() // BUNDLE))
    small = with_codes(small.select("key", "doc_id", "component", "asks", F.pmod(F.xxhash64("key"), F.lit(bundles)).alias("bundle")))
    found = small.groupBy("bundle").applyInArrow(lambda t: as_links(bundle_links(Members(t), least)), "a long, b long")

    large = mixed_.where("not small")
    around = F.explode(F.expr("sequence(band - 1, band + 1)")).alias("band")
    sized = lambda d, n: d.groupBy("key", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum(F.col("n_words") * 4) / F.lit(block_bytes))).cast("int").alias(n))
    blocks = stored(sized(large.where("asks").select("key", "n_words", around), "asking").join(sized(large, "holding"), ["key", "band"]), "blocks")
    part = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    plain = ["key", "doc_id", "component", "asks", "codes", "keys"]
    large = with_codes(large)
    asked = large.where("asks").select(*plain, around).join(blocks, ["key", "band"]).select(*plain, "band", part("asking").alias("i"), every("holding").alias("j"))
    held = large.select(*plain, "band").join(blocks, ["key", "band"]).select(*plain, "band", every("asking").alias("i"), part("holding").alias("j"))
    held = held.toDF(*held.columns)

    def compare(group, left, right):
        return as_links(block_links(Members(left), Members(right), group[0].as_py(), least) if left.num_rows and right.num_rows else (np.zeros(0, np.int64),) * 2)

    place = ["key", "band", "i", "j"]
    found = found.unionByName(asked.groupBy(*place).cogroup(held.groupBy(*place)).applyInArrow(compare, "a long, b long"))
    found = stored(found.distinct(), "joining")
    release_shuffles(buckets.sparkSession)
    forget(mixed_, whole, blocks)
    return found


def _sent(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most ``FEW_IDS`` rows, so that whole texts need no shuffle to be
    joined with it; beyond that Spark joins by shuffles."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, class_id (smallest id of its class), kept (doc_id = class_id), n_copies (other documents
    with the same words)."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    every = stored(_sketched(d, least).groupBy("doc_id").agg(F.max(F.struct("n_words", "hash", "digest", "sketches")).alias("x")).select("doc_id", "x.*"), "sketches", batch_rows=TEXT_ROWS)
    # equal word sequences: one stands for all, the smallest id; documents without words stand alone
    stands = every.where("n_words > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = every.select("doc_id", "digest", "n_words").join(stands, "digest", "left").select("doc_id", F.when(F.col("n_words") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = stored(members, "members")
    reps = every.where("sketches is not null").join(_sent(members.where("doc_id <> rep").select("doc_id")), "doc_id", "left_anti")
    keys = reps.select("doc_id", F.explode("sketches").alias("key"))
    many = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low")
    buckets = stored(keys.join(many, "key").select("key", "low", "doc_id"), "buckets")  # only keys that several documents share
    release_shuffles(spark)
    wanted = stored(every.select("doc_id", "hash", "n_words").join(buckets.select("doc_id").distinct(), "doc_id"), "wanted")
    texts = stored(d.join(_sent(wanted.select("doc_id", "hash")), ["doc_id", "hash"]).groupBy("doc_id").agg(F.first("text").alias("text")), "texts", batch_rows=TEXT_ROWS)
    release_shuffles(spark)
    # every member of a bucket against the smallest
    size = lambda x: wanted.select(F.col("doc_id").alias(x), F.col("n_words").alias(f"n_{x}"))
    pairs = buckets.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = pairs.join(size("a"), "a").join(size("b"), "b").where(f"least(n_a, n_b) >= {least} * greatest(n_a, n_b) - 1e-6").select("a", "b")
    links = stored(_verified(stored(pairs, "pairs"), texts, least), "links", batch_rows=TEXT_ROWS)
    release_shuffles(spark)
    first = components(links, "a", "b")
    first = stored(wanted.join(first, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("node"), "n_words", F.coalesce("component", "doc_id").alias("component")), "classes")
    # members of different components that share a bucket; their links join components
    for which in (0, 1):
        joining = _untried(buckets, first, texts, least, which)
        more = stored(_verified(joining, texts, least), "links", batch_rows=TEXT_ROWS)
        if more.count() == joining.count():
            break
    side = lambda x: first.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    joined = components(more.join(side("a"), "a").join(side("b"), "b"), "of_a", "of_b").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    classes = stored(first.join(joined, "component", "left").select(F.col("node").alias("rep"), F.coalesce("whole", "component").alias("class_id")), "classes")
    out = members.join(classes, "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1).alias("n_copies"))
    forget(every, buckets, wanted, texts, links, more, first)
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"), "n_copies")
