"""Spelling variants, toxicity and importance resampling, against plain versions."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tallygrove.llm import importance, spelling, toxicity

DOC = "doc_id long, text string, lang string, word string, n long, key string"
LETTERS = "abcdeéß"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "clash", 9, "clash") for i, t in enumerate(texts)], DOC)


# --- spelling --------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    forms, near_of = {}, {}
    for w, n in counts.items():
        near_of[w] = [x for x in counts if near(w, x)]
        if near_of[w]:
            most = max(counts[x] for x in near_of[w])
            if most >= 2 * n:
                forms[w] = min(x for x in near_of[w] if counts[x] == most)
    out = {}
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, len(near_of[w]), counts[forms[w]] if w in forms else None)
    return out


def of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_of_documents(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(LETTERS), k)) for k in rng.integers(4, 9, 500)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(20)] + [None, "", "12 -- ", "Ünlike Åpples ×÷×÷× " * 4, ("x" * 3000 + " ") * 3, ("x" * 2999 + " ") * 9]
    texts += [texts[0]]
    got = of(spelling.group_variants(spelling.word_counts(docs(spark, texts))))
    want = plain_variants(plain_counts(enumerate(texts)))
    assert got == want and sum(v[3] > 0 for v in want.values()) > 30
    assert got["x" * 2999][3] == 1 and got["x" * 3000][0] == "x" * 2999


@pytest.mark.parametrize("block", [2, 8, 1000])
def test_variants_in_hot_groups(spark, block):
    """Words with one long common beginning or end, dealt again and again."""
    rng = np.random.default_rng(block)
    tails = {"".join(rng.choice(list("abc"), k)) for k in rng.integers(1, 7, 300)}
    words = {f"common{t}" for t in tails} | {f"{t}mutual" for t in tails} | {"a", "b", "ab", "ba", "abc", "\U0001f600bc"}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.integers(1, 40, len(words)), strict=True)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert of(spelling.group_variants(rows, block=block)) == plain_variants(counts)


def test_variants_chain_and_ties(spark):
    rows = spark.createDataFrame([("aaaaa", 64), ("aaaab", 32), ("aaabb", 16), ("aabbb", 8), ("abbbb", 4), ("zzzzx", 6), ("zzzzy", 6), ("zzzzz", 3)], "word string, n long")
    got = of(spelling.group_variants(rows))
    assert got["abbbb"] == ("aabbb", "aaaaa", 4, 1, 8) and got["zzzzz"] == ("zzzzx", "zzzzx", 3, 2, 6) and got["zzzzx"][:2] == (None, "zzzzx")


def test_variants_of_nothing(spark):
    assert spelling.group_variants(spelling.word_counts(docs(spark, []))).count() == 0
    assert spelling.group_variants(spelling.word_counts(docs(spark, [None, ""]))).count() == 0
    rows = spark.createDataFrame([(None, "wörter " * 3)], "doc_id long, text string")
    assert of(spelling.group_variants(spelling.word_counts(rows))) == {"wörter": (None, "wörter", 3, 0, None)}


# --- importance ------------------------------------------------------------------------------------------------------


def features(text):
    text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain_resample(rows, target):
    s, t = Counter(b for _, x in rows for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out, able = {}, []
    for i, x in rows:
        words, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(f), weight, score, None]
        if len(words) >= 20:
            able.append((-score, i))
    for k, (_, i) in enumerate(sorted(able)[: 25 * len(able) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v) for i, v in out.items()}


def test_importance_against_a_plain_version(spark):
    rng = np.random.default_rng(9)
    words = ["Alpha", "beta", "gamma", "ÜBER", "straße", "x1", "naïve"] + [f"W{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 60, 120)] + [None, "", "one", " ... ", "日本 語", "long " * 30_000]
    target = ["alpha beta gamma " * 5, None, "über straße"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.resample(docs(spark, texts), docs(spark, target)).collect()}
    assert got == plain_resample(rows, target)
    assert sum(v[3] is not None for v in got.values()) > 10


def test_importance_defined_cases(spark):
    none = importance.resample(docs(spark, []), docs(spark, ["a b"]))
    assert none.columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.count() == 0
    long = "many words in a row " * 5
    rows = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None), (3, long), (4, long), (5, long), (6, long), (7, long)], "doc_id long, text string")
    got = importance.resample(rows, docs(spark, [])).collect()
    assert len(got) == 9 and sorted(r["rank"] for r in got if r["rank"]) == [1]  # a quarter of seven
    assert [r["score"] for r in got if r["doc_id"] is None] == [None] and [r["rank"] for r in got if r["doc_id"] in (None, 2)] == [None, None]


def test_importance_scores_without_exploding_or_shuffling(spark):
    plan = importance.weigh(docs(spark, ["a b"]), [1] * 10000)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "explode" not in plan.lower()


# --- toxicity --------------------------------------------------------------------------------------------------------


def made(n, seed):
    """Clean and toxic texts of invented words; toxic ones hold an insult each 40 words, or words with one beginning."""
    rng = np.random.default_rng(seed)
    syllables = ["ta", "ri", "mo", "len", "sha", "ku", "vi", "dro"]
    plain = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    texts, labels = [], []
    for i in range(n):
        words = [plain() for _ in range(rng.integers(30, 400))]
        toxic = i % 5 == 0
        for at in rng.choice(len(words), max(2, len(words) // 40), replace=False) if toxic else ():
            words[at] = rng.choice(["gromp", "blorken", "fetzwit"]) if i % 10 else "xuzba" + plain()
        texts.append(" ".join(words))
        labels.append(int(toxic) if rng.random() > 0.02 else 1 - int(toxic))
    return texts, labels


def test_toxicity_learns_words_and_beginnings():
    texts, labels = made(900, 1)
    model = toxicity.fit(texts, labels)
    forms = {m.form for group in model.voters.markers for m in group}
    assert {"gromp", "blorken", "fetzwit"} <= forms and any(f.startswith("xuzb") for f in forms)
    fresh, _ = made(400, 2)
    told = np.array([model.score(t) >= toxicity.THRESHOLD for t in fresh])
    truth = np.arange(400) % 5 == 0
    assert (told & truth).sum() >= 0.95 * truth.sum() and (told & ~truth).sum() <= 0.02 * (~truth).sum()
    assert 0 <= model.score("") < 0.5 and 0 <= model.score(None) < 0.5


def test_label_model_finds_accuracies_and_counts_twins_once():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    cast = lambda share: np.where(rng.random(4000) < share, y, ~y)
    good, fair, weak = cast(0.9), cast(0.8), cast(0.7)
    votes = np.stack([good, fair, weak, weak, weak], axis=1).astype(int) + 1  # the weak voter thrice
    model = toxicity.fit_labels(votes, 0.3)
    independent = toxicity.LabelModel(0.3, [-1] * 5, toxicity._tables(votes, y.astype(float), [-1] * 5))
    assert len({model.parent[j] for j in (2, 3, 4)} & {2, 3, 4}) >= 1  # the copies hang together
    q = model.posterior(votes)
    loss = lambda p: -np.mean(np.log(np.where(y, p, 1 - p).clip(1e-6)))
    assert loss(q) < loss(independent.posterior(votes)) and ((q > 0.5) == y).mean() > 0.88
    assert model.accuracy(votes)[0] > model.accuracy(votes)[1]


def test_toxicity_on_tables(spark):
    texts, marks = made(600, 3)
    texts += [None, "", texts[0], "z" * 50_000]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(m), 1) for i, m in enumerate(marks)] + [(600, 1, 1), (7, 0, 0), (7, 1, 0), (None, 1, 1), (8, None, 1)], "doc_id long, toxic int, text int")
    out = {r["doc_id"]: r for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    assert len(out) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in out.items())
    held = [(i, r) for i, r in out.items() if r["held_out"] and i < 600]
    assert sum(r["predicted"] == (i % 5 == 0) for i, r in held) >= 0.95 * len(held)
    assert out[600]["score"] == out[601]["score"] and out[602]["score"] == out[0]["score"]
    # labels of held-out documents change nothing
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.train(d, flipped)).collect()}
    assert again == {i: r["score"] for i, r in out.items()}


def test_toxicity_without_labels_and_empty(spark):
    d = docs(spark, ["You are a pathetic idiot", "A calm day by the sea", None])
    model = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score(d, model).orderBy("doc_id").collect()] == [1, 0, 0]
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_words_of_long_texts_are_not_cut(monkeypatch):
    text = "alpha beta " * 50
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.counted(text) == Counter(alpha=50, beta=50)
