"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy.

A text is the mean of the embeddings of its hashed character n-grams (two to four letters, words padded by a blank,
letters in lower case); a linear layer and a softmax give the languages. Both layers are trained together by stochastic
gradient descent on a bounded sample of labelled documents (``TRAIN_DOCS`` documents, spread over the labels). Part of
the sample calibrates: a temperature for the probabilities, and for every language the score below which a prediction
is rejected.

After training, embedding times linear layer is one table of ``BUCKETS`` x languages, so prediction adds up table rows:
it runs over every whole text in slices of a few MB, without any shuffle.

Defined cases: a missing text and a text without a letter are ``und`` with score 0 and are rejected; without labelled
documents everything is ``und``; equal texts get equal answers; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 16, 16, 6, 32, 0.5
GRAMS = (2, 3, 4)
MOST_LANGUAGES = 1000  # a model has BUCKETS numbers for each
TRAIN_DOCS, CALIBRATE = 3000, 4  # documents in the sample; one in so many calibrates
REJECT_SHARE = 0.001  # of rightly named calibration documents that may be rejected
UND = "und"
_SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _letters() -> np.ndarray:
    """By code point: itself in lower case if a letter, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: np.ndarray | None = None


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between blanks, as letters or blanks; and the bounds of the texts."""
    global _table
    if _table is None:
        _table = _letters()
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _table[points], np.concatenate([[0], np.cumsum(lengths)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts that hold a letter and no inner blank, and the text that each belongs to (ascending)."""
    points, bounds = _folded(texts)
    blank = points == 32
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    ids, own = [], []
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        ok = owner[:m] == owner[n - 1 :]
        for j in range(n):
            h = (h ^ points[j : j + m]) * _SEEDS[j]
            h ^= h >> np.uint32(15)
            if 0 < j < n - 1:
                ok &= ~blank[j : j + m]
        if n == 2:
            ok &= ~(blank[:m] & blank[1 : m + 1])
        h = (h * np.uint32(0x2C1B3C6D) + np.uint32(n)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        at = np.flatnonzero(ok)
        ids.append(h[at])
        own.append(owner[at])
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    ids, own = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return ids[order], own[order]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, float32
    bias: np.ndarray
    temperature: float
    reject_below: np.ndarray  # by language

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and rejection of each text."""
        k, n = len(self.languages), len(texts)
        logits, counts = _summed(self.table, [t or "" for t in texts])
        known = counts > 0
        if not k or not n:
            return [UND] * n, np.zeros(n), np.ones(n, bool)
        z = (logits / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(n), best], 0.0)
        return [self.languages[b] if ok else UND for b, ok in zip(best, known, strict=True)], score, ~known | (score < self.reject_below[best])


def _summed(table: np.ndarray, texts: list[str], slice_chars: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table rows over the n-grams of each text, and their number; slices bound the memory."""
    out, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= slice_chars:
            size += len(texts[hi])
            hi += 1
        ids, own = grams(texts[lo:hi])
        counts[lo:hi] = np.bincount(own, minlength=hi - lo)
        for c in range(table.shape[1]):
            out[lo:hi, c] = np.bincount(own, table[ids, c], minlength=hi - lo)
        lo = hi
    return out, counts


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Train and calibrate on a list of texts."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, np.zeros(0))
    y_all = np.array([languages.index(x) for x in labels])
    bags = []
    for lo in range(0, len(texts), 64):
        ids, own = grams(texts[lo : lo + 64])
        cuts = np.searchsorted(own, np.arange(len(texts[lo : lo + 64]) + 1))
        for i in range(len(cuts) - 1):
            u, c = np.unique(ids[cuts[i] : cuts[i + 1]], return_counts=True)
            bags.append((u, (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % CALIBRATE == CALIBRATE - 1
    if len(texts) < 4 * CALIBRATE:
        held[:] = False
    train = np.flatnonzero(~held)
    k = len(languages)
    emb = rng.normal(0, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    steps, step = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for lo in range(0, len(order), BATCH):
            some = [i for i in order[lo : lo + BATCH] if len(bags[i][0])]
            rate, step = RATE * (1 - step / steps), step + 1
            if not some:
                continue
            hidden = np.stack([bags[i][1] @ emb[bags[i][0]] for i in some])
            z = hidden @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y_all[some]] -= 1
            back = p @ out.T
            out -= rate * hidden.T @ p
            bias -= rate * p.sum(axis=0) / len(some)
            for i, g in zip(some, back, strict=True):
                u, w = bags[i]
                emb[u] -= (rate * 20.0 * w[:, None]) * g
    model = Model(languages, (emb @ out).astype(np.float32), bias.astype(float), 1.0, np.zeros(k))
    calibration = np.flatnonzero(held) if held.any() else train
    some = [texts[i] for i in calibration]
    logits, counts = _summed(model.table, some)
    ok = counts > 0
    z, y = (logits / np.maximum(counts, 1)[:, None] + model.bias)[ok], y_all[calibration][ok]
    if len(z):
        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

        model.temperature = min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss)
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for c in range(k):
            right = p[(best == c) & (y == c), c]
            # below what rightly named documents score, and never above an even chance of being wrong
            model.reject_below[c] = min(0.5, float(np.quantile(right, REJECT_SHARE)) * 0.9) if len(right) else 0.0
    return model


def training_sample(docs: DataFrame, max_docs: int = TRAIN_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str]]:
    """At most ``max_docs`` labelled documents, in turn from each label by the hash of the id."""
    from pyspark.sql import Window

    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    # the first of each label by a fixed draw: candidates by a coarse cut of the draw per label, so that no label is sorted whole
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    ids = d.select("doc_id", "lang", draw.alias("draw"))
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    if not sizes:
        return [], []
    # cut before any shuffle: of each label about twice the sample's documents are left
    cut = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(64, -(-(1 << 20) * max_docs * 2 // n)))])
    ids = ids.where(F.col("draw") < cut[F.col("lang")])
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")))
    chosen = ids.orderBy("nth", "lang", "doc_id").limit(max_docs).select("doc_id").distinct()
    keys = [r[0] for r in chosen.collect()]
    if not keys:
        return [], []
    schema = d.select("doc_id").schema
    few = d.sparkSession.createDataFrame([(k,) for k in keys], schema)
    got = d.join(F.broadcast(few), "doc_id").orderBy("doc_id", "lang", "text").limit(max_docs).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, **columns: str) -> Model:
    """Fit on a bounded sample of the labelled documents of docs."""
    texts, labels = training_sample(docs, max_docs, **columns)
    return fit(texts, labels)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs and lang_pred, lang_score, lang_rejected, which take the place of columns of docs with these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the corpus

    def name(batches):
        m = sent.value
        for column in batches:
            texts = [t if isinstance(t, str) else None for t in column]
            lang, score, rejected = m.predict(texts)
            yield pd.DataFrame({"pred": lang, "score": score, "rejected": rejected})

    # texts only go to Python and back as three short columns
    from collections.abc import Iterator

    name.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # one evaluation a row: a filter on its result must not make the optimizer name the text twice
    named = F.pandas_udf(name, "pred string, score double, rejected boolean").asNondeterministic()
    own = ("lang_pred", "lang_score", "lang_rejected")
    kept = [c for c in docs.columns if c not in own]
    out = docs.select(*[F.col(f"`{c}`").alias(f"of_docs_{c}") for c in kept], named(F.col(f"`{text}`")).alias("told"))
    return out.select(*[F.col(f"`of_docs_{c}`").alias(c) for c in kept], *[F.col(f"told.{c.removeprefix('lang_')}").alias(c) for c in own])
