"""Toxicity by weak supervision: a generative label model over many voters, then a linear classifier on its posteriors.

Voters look at a text and vote toxic, clean, or abstain. Some hold a seed lexicon of insults of one kind, some a share of the
markers induced from labelled training texts: words that toxic ones hold far more often, and beginnings of words that are
far denser in them. A marker speaks by its Poisson likelihood ratio, so a long text may hold one by chance. Others look for a
pattern: an insult addressed to someone, several insults, shouting, masked words, no insult at all. The label model has a hidden class and, for
each class, the chances of every voter's votes; it is fitted by expectation-maximisation. Pairs of voters that depend on each
other within the classes are found by conditional mutual information and joined into a forest, in which each voter's votes
depend on its parent's, so that two voters that say the same are not counted twice: near repetitions first, then all.

The posteriors are the labels of a linear classifier (word presence and votes, logistic loss, L1 penalty, proximal gradient
with momentum, in numpy). Its scores are calibrated by two numbers on labelled training documents that were held back from it.

All fitting is on a bounded sample (``TRAIN_DOCS`` labelled documents by the hash of the id, near copies within it once, so that one
wrongly labelled text and its copies make no word); scoring covers every whole
text, without any shuffle.

Defined cases: a missing or empty text scores as one without words; equal texts score alike; labels that contradict each other
for one id are left out; without labelled rows the seed lexicons decide; repeated ids count once each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import mixed

TRAIN_DOCS, CALIBRATE = 4000, 4  # labelled documents in the sample; one in so many calibrates
INDUCED, LEAST_DOCS, LIFT = 8, 4, 8.0  # voters of induced markers; documents and lift of such a marker
STEMS, DENSE, SPEAKS = (4, 5, 6, 7), 200, 2.0  # lengths of beginnings; a text is dense in one at once in so many words; log likelihood ratio of a vote
FEATURES, PENALTY, STEPS = 2000, 1e-3, 200  # words that the classifier may weigh
THRESHOLD = 0.7
TWINS, TIES = 0.2, 0.005  # nats that two voters tell of each other within the classes: nearly the same, and dependent
PIECE = 1 << 20  # characters of a text that are split into words at once
ABSTAIN, CLEAN, TOXIC = 0, 1, 2

#: Seed words of the lexicon voters, by kind, in four languages.
SEEDS = {
    "stupid": "idiot idiots moron morons stupid dumb imbecile dimwit idiota imbécil estúpido estúpida tonto dumm dummkopf trottel blöd idioten imbécile crétin stupide débile",
    "worthless": "worthless loser losers pathetic useless versager wertlos erbärmlich minable perdedor inútil patético nul",
    "disgust": "disgusting scum trash filth vermin garbage sewage abschaum dreck widerlich ekelhaft ordure déchet dégoûtant basura escoria asqueroso",
    "mockery": "clown clowns fool fools buffoon freak weirdo narr witzfigur bouffon payaso",
    "abuse": "bastard bitch asshole jerk arsehole arschloch hurensohn salaud connard putain cabrón hijoputa pendejo",
}
ADDRESSED = frozenset("you your youre ur du dich dein deine ihr tu te toi ton vous eres usted ustedes".split())

_WORD, _SHOUT, _MASK = re.compile(r"[^\W\d_]+"), re.compile(r"\b[A-Z]{4,}\b"), re.compile(r"[*#$@%&]{3,}|\w\*+\w")


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokens(text: str | None) -> Iterator[list[str]]:
    """Words in lower case, a piece of the text at a time; a piece ends between words."""
    text, at = text or "", 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (text[end].isalpha() or text[end - 1].isalpha()):
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


@dataclass(frozen=True)
class Marker:
    """A word, or (``stem``) the beginning of longer words, and how often it occurs per word in toxic texts that have it and in clean ones."""

    form: str
    stem: bool
    toxic_rate: float
    clean_rate: float

    def ratio(self, hits: int, n: int) -> float:
        """Logarithm of the likelihood ratio of so many hits in n words."""
        return hits * float(np.log(self.toxic_rate / self.clean_rate)) - n * (self.toxic_rate - self.clean_rate)


def counted(text: str | None) -> Counter[str]:
    out: Counter[str] = Counter()
    for piece in tokens(text):
        out.update(piece)
    return out


def stem_counts(counts: Counter[str], heads: frozenset[str] | None = None) -> Counter[str]:
    """How many words begin with each of their beginnings; only words whose first letters are in ``heads``, if given."""
    out: Counter[str] = Counter()
    for w, c in counts.items():
        if heads is None or w[: STEMS[0]] in heads:
            for k in STEMS:
                if len(w) > k:
                    out[w[:k]] += c
    return out


@dataclass
class Voters:
    """Seed lexicons and groups of markers, one a voter, and the pattern voters."""

    seeds: dict[str, frozenset[str]]
    markers: list[list[Marker]]

    def __post_init__(self) -> None:
        self.names = [*self.seeds, *[f"induced {i}" for i in range(len(self.markers))], "addressed", "several", "dense", "shouting", "exclaiming", "masked", "no insult", "no insult in prose"]
        self.insults = frozenset().union(*self.seeds.values(), [m.form for group in self.markers for m in group if not m.stem])
        self.heads = frozenset(m.form[: STEMS[0]] for group in self.markers for m in group if m.stem)

    def _addressed(self, text: str) -> bool:
        before: list[str] = []
        for piece in tokens(text):
            run = before + piece
            if any(w in self.insults and not ADDRESSED.isdisjoint(run[max(0, i - 4) : i]) for i, w in enumerate(run)):
                return True
            before = run[-4:]
        return False

    def vote(self, text: str | None, counts: Counter[str] | None = None) -> list[int]:
        text = text or ""
        counts = counted(text) if counts is None else counts
        n = sum(counts.values())
        there = self.insults & counts.keys()
        stems = stem_counts(counts, self.heads) if self.heads else Counter()
        votes = [ABSTAIN if x.isdisjoint(there) else TOXIC for x in self.seeds.values()]
        hits, spoken = sum(counts[w] for w in there), False
        for group in self.markers:
            says = max((m.ratio((stems if m.stem else counts)[m.form], n) for m in group if (m.form in stems if m.stem else m.form in there)), default=0.0)
            votes.append(TOXIC if says > SPEAKS else ABSTAIN)
            spoken |= says > SPEAKS
        hits += max((stems[m.form] for group in self.markers for m in group if m.stem and m.form in stems and m.ratio(stems[m.form], n) > SPEAKS), default=0)
        votes += [TOXIC if there and self._addressed(text) else ABSTAIN, TOXIC if hits > 1 else ABSTAIN, TOXIC if hits * 60 >= n > 0 and hits else ABSTAIN]
        votes += [TOXIC if len(_SHOUT.findall(text)) * 4 > n > 0 else ABSTAIN, TOXIC if text.count("!!") * 20 > n > 0 else ABSTAIN, TOXIC if len(_MASK.findall(text)) * 4 > n > 0 else ABSTAIN]
        clean = not there and not spoken
        return [*votes, CLEAN if clean else ABSTAIN, CLEAN if clean and n >= 50 else ABSTAIN]


def voters_of(markers: list[Marker]) -> Voters:
    seeds = {k: frozenset(v.split()) for k, v in SEEDS.items()}
    return Voters(seeds, [[m for m in markers if zlib.crc32(m.form.encode()) % INDUCED == i] for i in range(INDUCED)])


def without_copies(bags: list[set[str]], least: float = 0.5, draws: int = 8) -> list[int]:
    """Places of the texts that are no near copy of an earlier one of the sample: of those with two equal least hashes of their words, none shares ``least`` of the words."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, bag in enumerate(bags):
        h = np.array([zlib.crc32(w.encode()) for w in bag] or [0], np.uint64)
        keys = [(k, int((mixed(h + np.uint64(k << 32))).min())) for k in range(draws)]
        shared = Counter(j for key in keys for j in seen.get(key, ()))  # of half the words alike two of eight least hashes are, at 0.96
        alike = (j for j, n in shared.items() if n > 1 and len(bag) >= least * len(bags[j]) and len(bags[j]) >= least * len(bag))
        if not any(len(bag & bags[j]) >= least * len(bag | bags[j]) for j in alike):
            kept.append(i)
            for key in keys:
                seen.setdefault(key, []).append(i)
    return kept


def induce(counts: list[Counter[str]], labels: np.ndarray, least: int = LEAST_DOCS, lift: float = LIFT) -> list[Marker]:
    """Markers that toxic texts show at least ``lift`` times as often as clean ones, in both halves of the sample.

    A word shows by being there, a beginning by being dense. Of markers of which one begins the other and that show in the same texts, the one of more texts stays."""
    sizes = np.array([sum(c.values()) for c in counts])
    words = int(sizes[labels == 0].sum()) or 1
    shown: dict[tuple[str, bool], tuple[list[int], list[int]]] = {}
    hits: dict[tuple[str, bool], list[int]] = {}
    for i, c in enumerate(counts):
        y = int(labels[i])
        for stem, found in ((False, c), (True, stem_counts(c))):
            for form, k in found.items():
                hits.setdefault((form, stem), [0, 0])[y] += k
                if not stem or k * DENSE >= sizes[i]:
                    shown.setdefault((form, stem), ([], []))[y].append(i)
    n = [[max(1, int((labels[half::2] == y).sum())) for y in (0, 1)] for half in (0, 1)]
    strong = []
    for key, (clean, toxic) in shown.items():
        if len(toxic) >= 2 * least and all((t := sum(i % 2 == half for i in toxic)) >= least and t / n[half][1] > lift * (sum(i % 2 == half for i in clean) + 0.5) / n[half][0] for half in (0, 1)):
            strong.append((len(toxic), key, frozenset(toxic)))
    out: list[Marker] = []
    accepted: list[tuple[str, frozenset[int]]] = []
    for _, (form, stem), docs in sorted(strong, key=lambda x: (-x[0], x[1])):
        if any((form.startswith(other) or other.startswith(form)) and len(docs - there) <= 0.05 * len(docs) for other, there in accepted):
            continue
        accepted.append((form, docs))
        in_toxic = max(1, int(sizes[list(docs)].sum()))
        out.append(Marker(form, stem, max(hits[form, stem][1] / in_toxic, 1e-6), (hits[form, stem][0] + 0.5) / words))
    return [m for m in out if m.toxic_rate > m.clean_rate]


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | class, parent's vote); parent -1 is none."""

    prior: float
    parent: list[int]
    tables: list[np.ndarray]  # class x parent's vote x vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, (p, t) in enumerate(zip(self.parent, self.tables, strict=True)):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
            log += np.log(t[:, above, votes[:, j]]).T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)

    def accuracy(self, votes: np.ndarray) -> np.ndarray:
        """Of each voter, the share of its votes (not abstentions) that agree with the posterior class."""
        q = self.posterior(votes)
        right = np.where(votes == TOXIC, q[:, None], np.where(votes == CLEAN, 1 - q[:, None], 0.0)).sum(axis=0)
        return right / np.maximum(1, (votes != ABSTAIN).sum(axis=0))


def _tables(votes: np.ndarray, q: np.ndarray, parent: list[int], smooth: float = 0.5) -> list[np.ndarray]:
    out = []
    for j, p in enumerate(parent):
        above = votes[:, p] if p >= 0 else np.zeros(len(votes), np.int64)
        t = np.full((2, 3, 3), smooth)
        for y, r in ((0, 1 - q), (1, q)):
            t[y] += np.bincount(above * 3 + votes[:, j], r, minlength=9).reshape(3, 3)
        out.append(t / t.sum(axis=2, keepdims=True))
    return out


def _forest(votes: np.ndarray, q: np.ndarray, least: float) -> list[int]:
    """Each voter's parent: the spanning forest of largest conditional mutual information, of pairs above ``least`` nats."""
    m, edges = votes.shape[1], []
    for a in range(m):
        for b in range(a):
            value = 0.0
            for r in (1 - q, q):
                joint = np.bincount(votes[:, a] * 3 + votes[:, b], r, minlength=9).reshape(3, 3) + 1e-9
                share = joint.sum() / len(votes)
                joint = joint / joint.sum()
                value += share * float((joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum())
            edges.append((value, a, b))
    group, near = list(range(m)), [[] for _ in range(m)]

    def top(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for value, a, b in sorted(edges, reverse=True):
        if value > least and top(a) != top(b):
            group[top(a)] = top(b)
            near[a].append(b)
            near[b].append(a)
    parent, seen = [-1] * m, set()
    for root in range(m):
        queue = [] if root in seen else [root]
        seen.add(root)
        for x in queue:
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    parent[y] = x
                    queue.append(y)
    return parent


def fit_labels(votes: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Accuracies and correlations of the voters, from their votes alone and the share of the toxic class."""
    balance = (votes == TOXIC).sum(axis=1) - (votes == CLEAN).sum(axis=1)
    q = np.where(balance > 0, 0.9, 0.05)
    for least in (TWINS, TIES):  # voters that nearly repeat each other first, else a voter that has many copies would pass for the class
        parent = _forest(votes, q, least)
        for _ in range(rounds):
            model = LabelModel(prior, parent, _tables(votes, q, parent))
            q = model.posterior(votes)
    return model


@dataclass
class Model:
    voters: Voters
    weights: dict[str, float]
    of_votes: np.ndarray  # voters x 3
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    labels: LabelModel | None = None

    def margin(self, votes: list[int], words) -> float:
        known = self.weights.keys() & words
        return self.bias + sum(self.weights[w] for w in sorted(known)) + float(self.of_votes[np.arange(len(votes)), votes].sum())

    def score(self, text: str | None) -> float:
        counts = counted(text)
        z = self.slope * self.margin(self.voters.vote(text, counts), counts.keys()) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def seed_model() -> Model:
    """What decides without labelled rows: any seed lexicon's vote."""
    v = voters_of([])
    of_votes = np.zeros((len(v.names), 3))
    of_votes[: len(SEEDS), TOXIC] = 5.0
    return Model(v, {}, of_votes, -3.0)


def logistic_l1(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least logistic loss on soft labels y plus penalty * sum |weight|."""
    n, d = x.shape
    w = v = np.zeros(d + 1, np.float32)
    ones = np.concatenate([x, np.ones((n, 1))], axis=1).astype(np.float32)
    y = y.astype(np.float32)
    probe = np.ones(d + 1, np.float32)  # the step from the largest singular value, by power iteration
    for _ in range(20):
        probe = ones.T @ (ones @ probe)
        probe /= np.linalg.norm(probe) or 1.0
    rate = 4.0 * n / max(1e-9, float(probe @ (ones.T @ (ones @ probe)))) * 0.95
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ones @ v, -30, 30)))
        step = v - rate * (ones.T @ (p - y)) / n
        nxt = (np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)).astype(np.float32)
        nxt[-1] = step[-1]
        t_nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = (nxt + (t - 1) / t_nxt * (nxt - w)).astype(np.float32), nxt, t_nxt
    return w[:-1], float(w[-1])


def fit(texts: list[str], labels: list[int]) -> Model:
    """Voters, label model, classifier and calibration from labelled texts."""
    bags = [counted(t) for t in texts]
    kept = without_copies([set(b) for b in bags])
    texts, bags, y = [texts[i] for i in kept], [bags[i] for i in kept], np.array([labels[i] for i in kept], np.int64)
    if len(y) < 40 or y.min() == y.max():
        return seed_model()
    held = np.arange(len(y)) % CALIBRATE == CALIBRATE - 1
    train = np.flatnonzero(~held)
    voters = voters_of(induce([bags[i] for i in train], y[train]))
    votes = np.array([voters.vote(t, b) for t, b in zip(texts, bags, strict=True)])
    labelling = fit_labels(votes[train], float(np.clip(y[train].mean(), 0.01, 0.5)))
    q = labelling.posterior(votes[train])
    sums: list[Counter[str]] = [Counter(), Counter()]
    for i, p in zip(train, q, strict=True):
        for w in bags[i]:
            sums[0][w] += 1 - p
            sums[1][w] += p
    common = [w for w in sums[0].keys() | sums[1].keys() if sums[0][w] + sums[1][w] >= LEAST_DOCS]
    n0, n1 = max(1e-9, float((1 - q).sum())), max(1e-9, float(q.sum()))
    pull = {w: abs(np.log((sums[1][w] + 0.5) / n1) - np.log((sums[0][w] + 0.5) / n0)) * (sums[0][w] + sums[1][w]) ** 0.5 for w in common}
    chosen = sorted(common, key=lambda w: (-pull[w], w))[:FEATURES]
    place = {w: i for i, w in enumerate(chosen)}
    x = np.zeros((len(train), len(chosen) + 3 * votes.shape[1]), np.float32)
    for row, i in enumerate(train):
        x[row, [place[w] for w in bags[i] if w in place]] = 1
        x[row, len(chosen) + 3 * np.arange(votes.shape[1]) + votes[i]] = 1
    w, bias = logistic_l1(x, q)
    of_votes = w[len(chosen) :].reshape(-1, 3)
    model = Model(voters, {c: float(w[i]) for c, i in place.items() if w[i]}, of_votes, bias, labels=labelling)
    z = np.array([model.margin(votes[i].tolist(), bags[i].keys()) for i in np.flatnonzero(held)])
    model.slope, model.shift = _calibrated(z, y[held])
    return model


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least logistic loss, with a weak pull towards 1 and 0: Newton steps, halved until the loss falls."""
    beta, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], axis=1)

    def loss(b: np.ndarray) -> float:
        s = x @ b
        return float(np.sum(np.logaddexp(0, s) - y * s)) + 0.5 * float((b - start) @ (b - start))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + beta - start)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if size * np.abs(step).max() < 1e-9:
            break
    return max(0.05, float(beta[0])), float(beta[1])


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> tuple[list[str], list[int]]:
    """At most ``max_docs`` labelled documents that are not held out, the first by the hash of the id."""
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(~held_out(F.col("doc_id")))
    n = marks.count()
    if not n:
        return [], []
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    marks = marks.where(draw < max(64, -(-(1 << 20) * max_docs * 2 // n)))  # about twice the sample, before any shuffle
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most and toxic in (0, 1)").select("doc_id", "toxic")
    few = [tuple(r) for r in marks.orderBy(draw, "doc_id").limit(max_docs).collect()]
    if not few:
        return [], []
    sent = F.broadcast(docs.sparkSession.createDataFrame(few, marks.schema))
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    got = d.join(sent, "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(max_docs).collect()
    return [r["text"] for r in got], [r["toxic"] for r in got]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, **columns: str) -> Model:
    return fit(*training_sample(docs, labels, max_docs, **columns))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES words and the lexicons

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for column in batches:
            yield pd.Series([m.score(t if isinstance(t, str) else None) for t in column], dtype="float64")

    rated = F.pandas_udf(rate, "double").asNondeterministic()
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), rated(F.col(f"`{text}`")).alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
