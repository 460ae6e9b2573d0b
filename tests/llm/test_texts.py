"""Operators on documents, against brute force or round trips."""

import base64
import gzip
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallygrove.llm import langid, order_minhash, packing, secrets, substring

DOC = "doc_id long, text string, lang string, source string, key long, row string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "web", 1, "clash") for i, t in enumerate(texts)], DOC)


WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def kept_by_brute_force(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, batches):
    rng = np.random.default_rng(5)
    passage = prose(rng, 70)
    texts = [prose(rng, 60) + ("\n" + passage if i % 3 == 0 else "") for i in range(40)]
    texts += [passage, passage + " " + passage, "w1 " * 90, None, "", "w1 w2", "  \t" + prose(rng, 30) + "\x0b", texts[0], texts[0], " nbsp stays " + texts[1], prose(rng, 4000) + " " + passage]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(docs(spark, texts), batches=batches).collect()}
    assert got == kept_by_brute_force(enumerate(texts))


def test_substrings_of_an_empty_table_and_with_text(spark):
    assert substring.dedup_substrings(docs(spark, [])).count() == 0
    t = prose(np.random.default_rng(6), 25)
    rows = {r["doc_id"]: r["kept_text"] for r in substring.dedup_substrings(docs(spark, [t, "a b " + t]), with_text=True).collect()}
    assert rows == {0: t, 1: "a b"}


def test_later_batches_are_merged_with_earlier_runs(spark):
    rng = np.random.default_rng(7)
    texts = [prose(rng, 50) for _ in range(12)]
    texts += [texts[3][:150] + " tail " + texts[4], texts[0]]
    index = substring.FingerprintIndex(spark, 1 << 20)
    got = {}
    for lo, hi in ((0, 5), (5, 10), (10, 14)):
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in index.add(docs(spark, texts[lo:hi], lo)).collect()}
    assert len(index.runs) == 1
    index.drop()
    assert got == kept_by_brute_force(enumerate(texts))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_table():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(0, 60))
        a = rng.integers(0, int(rng.integers(2, 40)), n).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 12))):
            at = int(rng.integers(0, len(b) + 1))
            kind = rng.integers(0, 3)
            b[at : at + (kind != 0)] = [] if kind == 2 else [int(rng.integers(0, 40))]
        if rng.random() < 0.2:
            b = rng.integers(0, 5, int(rng.integers(0, 60))).tolist()
        true = edits(a, b)
        for most in (0, 1, 3, 8, 20, 100):
            assert order_minhash.edit_distance(a, b, most) == min(true, most + 1)


def test_near_duplicates(spark):
    rng = np.random.default_rng(9)
    base = [prose(rng, int(n)) for n in rng.integers(40, 300, 12)]
    texts = list(base)
    for i, t in enumerate(base[:8]):  # edits of 2 to 8 percent
        w = t.split()
        for _ in range(max(1, len(w) * (i + 2) // 100)):
            w[int(rng.integers(0, len(w)))] = "edited"
        texts.append(" ".join(w))
    texts += [base[9], "  " + base[9].replace(" ", "\n"), base[9]]  # equal words
    texts += [None, "", " \n", "a b", "a b", "a c", base[11].split(" ", 20)[-1]]
    texts += [base[10] + f" copy {i} of {i * 7}" for i in range(60)]  # a large group
    got = {r["doc_id"]: r for r in order_minhash.near_duplicates(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    n = len(base)
    words = [(t or "").split() for t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            if longer and (words[i] == words[j] or min(len(words[i]), len(words[j])) >= 5 and edits(words[i], words[j]) <= 0.2 * longer + 1e-9):
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(low))
    assert all(got[n + i]["class_id"] == i for i in range(8))
    assert got[9]["n_copies"] == 3 and all(r["kept"] == (r["class_id"] == i) for i, r in got.items())
    assert order_minhash.near_duplicates(docs(spark, [])).count() == 0


def edited(rng, words, n_edits):
    """words with so many of them replaced."""
    out = list(words)
    for at in rng.choice(len(out), n_edits, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


def test_pairs_at_the_threshold_share_a_sketch():
    """Recall of the candidates at similarities of 0.80 and 0.85, and every one of the short pairs."""
    from tallygrove.llm.common import text_slices

    rng = np.random.default_rng(31)

    def sharing(pairs):
        texts = pa.array([" ".join(w) for pair in pairs for w in pair])
        sets = []
        for _, _, offs, data in text_slices(texts):
            words, first, rows, made = order_minhash.sketches(data, offs)
            some = [set() for _ in range(len(offs) - 1)]
            for r, values in zip(rows, made.view(np.int64), strict=True):
                if first[r + 1] - first[r] > order_minhash.SHORT:
                    some[r] |= set(values.tolist())
            for r, values in order_minhash.short_keys(words, first).items():
                some[r] |= set(values.tolist())
            sets += some
        return np.mean([bool(a & b) for a, b in zip(sets[::2], sets[1::2], strict=True)])

    def drawn(n):
        return [f"v{x}" for x in rng.integers(0, 1 << 40, n)]

    for n in (25, 50, 100, 500):
        for similarity in (0.80, 0.85):
            pairs = [(w, edited(rng, w, int((1 - similarity) * n + 1e-9))) for w in (drawn(n) for _ in range(200))]
            assert sharing(pairs) >= 0.98
    short = [("a b c d e f g h i j".split(), "a b c d e X g h i j".split()), ("a b c d e".split(), "a b X c d e".split())]
    for _ in range(1500):  # words replaced, left out and put in, as many as the threshold allows
        w = drawn(int(rng.integers(5, 25)))
        longer = int(rng.integers(len(w), len(w) * 5 // 4 + 1))
        more = longer - len(w)
        other = edited(rng, w, int(0.2 * longer + 1e-9) - more)
        for _ in range(more):
            other.insert(int(rng.integers(0, len(other) + 1)), f"in{rng.integers(1 << 40)}")
        short.append((w, other))
    assert sharing(short) == 1.0


def test_short_near_duplicates(spark):
    texts = ["a b c d e f g h i j", "a b c d e X g h i j", "k l m n o", "k l X m n o", "q r s t u v", "q r s t Y Z"]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def test_links_beside_the_smallest_member_of_a_shared_passage(spark):
    """Pairs inside buckets whose smallest member is no duplicate: every similar pair that shares a sketch ends in one class."""
    rng = np.random.default_rng(21)
    passage = prose(rng, 60)
    texts = [passage + " " + prose(rng, 25) for _ in range(40)]
    for t in texts[10:40]:
        w = t.split()
        for at in rng.choice(len(w), 9, replace=False):
            w[at] = "edited"
        texts.append(" ".join(w))
    d = docs(spark, texts)
    whole = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(d).collect()}
    few = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(d.repartition(7)).collect()}
    sketched = {r["doc_id"]: set(r["sketches"]) for r in order_minhash._sketched(d.selectExpr("doc_id", "0L AS hash", "text")).collect()}
    words = [t.split() for t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sketched[i] & sketched[j] and edits(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])) + 1e-9:
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    assert whole == few == dict(enumerate(low))
    assert len(set(low)) > 5


def test_profiles_rule_out_no_similar_pair():
    rng = np.random.default_rng(22)
    words = [rng.integers(0, 50, int(n)).astype(np.int32) for n in rng.integers(5, 60, 60)]
    words += [np.where(rng.random(len(w)) < 0.15, 7, w).astype(np.int32) for w in words]
    words += [np.delete(w, rng.integers(0, len(w), 1)) for w in words[:60]]
    open_ = order_minhash.may_be_similar(words[:60], words, 0.8)
    for i in range(60):
        for j in range(len(words)):
            if edits(list(words[i]), list(words[j])) <= int(0.2 * max(len(words[i]), len(words[j])) + 1e-9):
                assert open_[i, j]
    assert open_.mean() < 0.2


def test_many_alignments_at_once_equal_single_ones():
    rng = np.random.default_rng(23)
    pairs = []
    for _ in range(600):
        a = rng.integers(0, int(rng.integers(2, 200)), int(rng.integers(0, 220))).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, 50))):
            at, kind = int(rng.integers(0, len(b) + 1)), rng.integers(0, 3)
            b[at : at + (kind != 0)] = [] if kind == 2 else [int(rng.integers(0, 200))]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    for (a, b), d, s in zip(pairs, order_minhash.banded_distances(pairs), order_minhash.similarities(pairs), strict=True):
        assert d == min(order_minhash.edit_distance(a.tolist(), b.tolist(), 31), 32)
        longer = max(len(a), len(b))
        true = order_minhash.edit_distance(a.tolist(), b.tolist(), int(0.2 * longer + 1e-9))
        assert order_minhash.banded_distances([(a, b)], 2)[0] == min(order_minhash.edit_distance(a.tolist(), b.tolist(), 63), 64)
        assert s == pytest.approx(1 - true / max(1, longer) if true <= int(0.2 * longer + 1e-9) else -1.0)


def test_rows_between_stages_follow_a_hot_bucket(spark, monkeypatch):
    """Documents that share a passage: twice as many of them give at most about twice as many rows in any table of the operator."""
    rng = np.random.default_rng(24)
    passage = prose(rng, 60)
    texts = [passage + " " + " ".join(f"v{x}" for x in rng.integers(0, 1 << 40, int(n))) for n in rng.integers(20, 60, 800)]
    made = {}
    plain = order_minhash.stored

    def counted(df, label, *args, **named):
        out = plain(df, label, *args, **named)
        made.setdefault(n, {}).setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "stored", counted)
    for n in (400, 800):
        assert order_minhash.near_duplicates(docs(spark, texts[:n])).where("kept").count() == n
    for label, few in made[400].items():
        assert sum(made[800][label]) <= 2.3 * sum(few) + 50, label


def test_blocks_find_every_link_of_a_bucket(spark, monkeypatch):
    """Blocks of five members and bands of length find what one block finds."""
    rng = np.random.default_rng(25)
    passage = prose(rng, 60)
    texts = []
    for _ in range(12):
        own = (passage + " " + prose(rng, int(rng.integers(10, 50)))).split()
        texts += [" ".join(edited(rng, own, int(e)) + ["more"] * int(rng.integers(0, 9))) for e in rng.integers(0, 12, 4)]
    whole = order_minhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    plain = order_minhash._untried
    monkeypatch.setattr(order_minhash, "_untried", lambda *a: plain(*a, block=5, block_bytes=3000, few=0))
    assert order_minhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect() == whole


def test_words_that_a_plain_polynomial_confuses(spark):
    """A Thue-Morse word and its complement are two words, as words of a text and as whole texts."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rng = np.random.default_rng(26)
    for size in (1024, 2048, 4096):
        x = word[:size]
        y = x.translate(str.maketrans("ab", "ba"))
        rest = prose(rng, 19)
        got = substring.dedup_substrings(docs(spark, [f"{x} {rest}", f"{y} {rest}"])).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in got] == [0, 0]
        classes = order_minhash.near_duplicates(docs(spark, [x, y, f"{x} a b c", f"{y} a b c"])).collect()
        assert all(r["kept"] for r in classes)


def test_near_duplicates_defined_cases(spark):
    rng = np.random.default_rng(27)
    long = prose(rng, 30000)
    w = long.split()
    w[100] = "changed"
    rows = [(1, long), (2, " ".join(w)), (3, None), (None, long), (4, "a b c d e f"), (4, prose(rng, 40)), (5, "a b c d e f"), (6, "\x0b")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, key int")
    got = {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in order_minhash.near_duplicates(table).collect()}
    # of id 4 the text with most words counts
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0)}


KEY = "AKIA" + "Q7" * 8
BASE = [
    (0, re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12),
    (1, re.compile(r"AKIA[A-Z0-9]+"), 18),
    (2, re.compile(r"[0-9a-f]+"), 16),
]


def base_spans(text):
    out = []
    for kind, pattern, least in BASE:
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(1) if kind == 0 else m.group()) >= least]
    return sorted(out)


def encoded(text, *layers):
    for layer in layers:
        if layer == "base64":
            text = base64.b64encode(text.encode()).decode()
        elif layer == "gzip":
            text = base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()
        elif layer == "url":
            text = "".join(f"%{b:02X}" for b in text.encode())
        else:
            text = "".join(f"\\u{ord(c):04x}" for c in text)
    return text


def test_secrets(spark):
    hidden = f'password = "hunter2hunter2" and {KEY}'
    texts = [
        None, "", "nothing here", f"é {KEY} x PassWord:'abcdefghijkl' " + "deadbeef" * 3, "token=short", "AKIA123 " + "f" * 15, "secretsecret=aaaaaaaaaaaaaaa api_key : zzzzzzzzzzzz",
        "passwordpassword=aaaaaaaaaaaaaaaaaaaaaaa", "ſecret=aaaaaaaaaaaaaaa",
        *["väter " + encoded(hidden, *layers) + " end" for layers in (["base64"], ["url"], ["unicode"], ["gzip"], ["base64", "base64"], ["unicode", "base64", "url"], ["gzip", "base64"], ["url", "gzip", "unicode"])],
        "%25" * 50, "%2525252541", "QUFB" * 2000,
    ]
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in spans) for kind in (0, 1, 2)], t
        assert r["base_sha256"] == hashlib.sha256(secrets.joined(spans).encode()).hexdigest()
        assert set(secrets.joined(spans).split(",")) - {""} <= set(r["spans"].split(","))
    for i in range(9, 17):  # every encoded secret is found, inside the encoded part
        found = [s.split(":") for s in got[i]["spans"].split(",")]
        assert {"assign", "access"} <= {f[0] for f in found}
        assert all(6 <= int(a) < int(b) <= len(texts[i]) - 4 for _, a, b in found), texts[i]
    assert got[10]["spans"].split(",") == ["assign:6:96", "access:111:171"] or got[10]["n_decoded"] == 2
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, texts)).collect()}
    assert redacted[0] is None and redacted[2] == texts[2]
    assert KEY not in redacted[3] and all("[redacted]" in redacted[i] for i in range(9, 17))


def test_language_id_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = table.select("doc_id", "text", "lang").collect()
    fit = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"]]
    model = langid.fit([r["text"] for r in fit], [r["lang"] for r in fit])
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    lang, score, rejected = model.predict([r["text"] for r in held])
    assert np.mean([a == r["lang"] for a, r in zip(lang, held, strict=True)]) > 0.95
    assert (score >= 0).all() and (score <= 1).all() and rejected.mean() < 0.05
    got = [(r["lang_pred"], r["lang_score"], r["lang_rejected"]) for r in langid.identify(docs(spark, [None, "", "123 !?", rows[0]["text"]]), model).orderBy("doc_id").collect()]
    assert got[:3] == [("und", 0.0, True)] * 3 and got[3][0] in model.languages
    assert langid.identify(docs(spark, ["abc"]), langid.train(docs(spark, []))).first()["lang_pred"] == "und"


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    rng = np.random.default_rng(3)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 300, 30)] + [None, "", "<|endoftext|>", "a <|endoftext|> ünïcödé 漢字   \r\n\n  x", prose(rng, 5000), "same", "same"]
    pieces = packing.pack(docs(spark, texts).repartition(5)).collect()
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(texts)}
    seen: dict[int, list] = {}
    for p in pieces:
        ids = want[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for i, ids in want.items():
        assert np.cumsum([0] + [n for _, n in sorted(seen[i])])[:-1].tolist() == [s for s, _ in sorted(seen[i])] and sum(n for _, n in seen[i]) == len(ids)
    by: dict[int, list] = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    full = sorted(by)
    assert full == list(range(len(full)))
    for s, parts in by.items():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) == packing.WINDOW or s == full[-1]
    assert packing.pack(docs(spark, [])).count() == 0
    assert struct.pack("<I", 1) == np.array([1], "<u4").tobytes()


def test_secrets_in_every_member_line_and_encoding():
    import bz2
    import lzma
    import textwrap

    import zstandard

    rng = np.random.default_rng(41)
    filler = " ".join(rng.choice(WORDS, 90)).encode()
    hidden = f"{filler.decode()} {KEY} {filler.decode()}"

    def kinds(text):
        found, unread = secrets.unwrap(text)
        assert all(0 <= s < e <= len(text) for s, _, e in found)
        return {k for _, k, _ in found}, unread

    for squeeze in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        members = squeeze(filler) + squeeze(hidden.encode())
        assert kinds("x " + base64.b64encode(members).decode()) == ({1}, 0), squeeze
        assert kinds("x " + base64.b64encode(gzip.compress(members)).decode()) == ({1}, 0), squeeze
    for width in (64, 76):
        for raw in (hidden.encode(), gzip.compress(hidden.encode(), mtime=0)):
            coded = base64.b64encode(raw).decode()
            for text in ("Key:\n" + "\n".join(textwrap.wrap(coded, width)) + "\nend of it", "> " + "\r\n> ".join(textwrap.wrap(coded, width)), '"' + "\\n".join(textwrap.wrap(coded, width)) + '"', "NAMEOFTHEFOLLOWING\n" + "\n".join(textwrap.wrap(coded, width))):
                assert kinds(text) == ({1}, 0), text
    crossing = base64.b64encode(b"-" * 40 + KEY.encode() + b"-" * 40).decode()  # the secret lies on the break
    text = crossing[:64] + "\n" + crossing[64:]
    assert secrets.unwrap(text)[0] == [(0, 1, len(text))]
    for raw in (b"\x01\x02 " + hidden.encode() + b"\x00", hidden.encode("utf-16"), hidden.encode("utf-16-be"), b"odd" + hidden.encode("utf-16-le"), ("\xe9 " + hidden).encode("latin-1")):
        assert kinds(base64.b64encode(raw).decode()) == ({1}, 0), raw[:8]


def test_secrets_in_layers_above_a_piece(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", 1 << 20)
    rng = np.random.default_rng(42)
    filler = (prose(rng, 2000).encode() + b" ") * 400
    nested = base64.b64encode(gzip.compress(f"{KEY} ".encode())).decode().encode()
    for at in (1 << 20, len(filler) - 5):  # on the border of two pieces, and at the end
        for planted in (KEY.encode(), nested):
            big = filler[: at - 8] + b" " + planted + b" " + filler[at:]
            for data in (gzip.compress(big), gzip.compress(gzip.compress(big)), gzip.compress(filler) + gzip.compress(big)):
                found, unread = secrets.unwrap(base64.b64encode(data).decode())
                assert {k for _, k, _ in found} == {1} and not unread
    monkeypatch.setattr(secrets, "MAX_READ", 1 << 20)
    assert secrets.unwrap(base64.b64encode(gzip.compress(filler)).decode())[1] == 1


def test_escapes_of_escapes_take_time_in_proportion():
    import time

    for step, first in (("25", "%"), ("5cx", "\\x"), ("005cu", "\\u")):
        for n in (100, 100_000 // len(step)):
            last = {"25": "41", "5cx": "41", "005cu": "0041"}[step]  # the letter A, below n escapes
            text = "password = " + first + step * n + last + "bcdefghijklmnop end"
            began = time.perf_counter()
            found, unread = secrets.unwrap(text)
            assert (11 - 11, 0, len(text) - 4) in found and not unread, (step, n)
            assert time.perf_counter() - began < 20
    ends = "%4%31KIA" + "Q" * 20  # an escape that is complete only once the next one is undone
    assert (0, 1, len(ends)) in secrets.unwrap(ends)[0]
    assert secrets.unwrap("%C3%A9 " + "%41KIA" + "Q" * 16)[0] == [(7, 1, 29)]


def test_secrets_in_compressed_bytes_written_as_escapes():
    import bz2
    import lzma

    import zstandard

    hidden = f"some words before {KEY} and after, some words before and after".encode()
    for squeeze in (lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        data = squeeze(hidden)
        percent = "".join(f"%{b:02X}" for b in data)
        mixed = "".join(chr(b) if b < 128 and chr(b).isalnum() else f"%{b:02x}" for b in data)
        slashes = "".join(f"\\x{b:02x}" for b in data)
        for text in (percent, mixed, slashes, repr(data)[2:-1], "%25" .join(["", *percent.split("%")[1:]])):
            mark = repr(data)[1] if text == repr(data)[2:-1] else "'"
            found = secrets.unwrap(f"see {mark}{text}{mark} there")[0]
            assert 1 in {k for _, k, _ in found} and all(5 <= a < b <= 5 + len(text) for a, k, b in found if k == 1), (squeeze, text[:30])


def test_secrets_in_raw_deflate_and_short_lines(spark):
    import textwrap

    hidden = f"{KEY} with some words after it, and with some words after it".encode()
    squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = squeeze.compress(hidden) + squeeze.flush()
    assert {k for _, k, _ in secrets.unwrap("x " + base64.b64encode(raw).decode())[0]} == {1}
    assert {k for _, k, _ in secrets.unwrap(base64.b64encode(gzip.compress(raw)).decode())[0]} == {1}
    coded = base64.b64encode(hidden).decode()
    texts = ["Here:\n" + mark + ("\n" + mark).join(textwrap.wrap(coded, width)) + "\nbye now" for width in (4, 8, 12, 15) for mark in ("", "> ", "  ")]
    texts += ["a list\nof short\nlines\nwithout\nanything\nhidden\nhere"]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        assert [x.split(":")[0] for x in got[i].split(",")] == ["access"] and t[int(got[i].split(":")[1]) :][:4] == coded[:4], t
    assert got[len(texts) - 1] == ""


def test_redaction_holds_back_what_is_unread(spark, monkeypatch):
    monkeypatch.setattr(secrets, "MAX_READ", 1000)
    blob = base64.b64encode(gzip.compress((prose(np.random.default_rng(1), 60_000) + KEY).encode(), mtime=0)).decode()
    found, unread = secrets.unwrapped(f"before {blob} after")
    assert not found and unread == [(7, 7 + len(blob))]
    monkeypatch.undo()
    monkeypatch.setattr(secrets, "MOST_LEVELS", 1)
    twice = base64.b64encode(gzip.compress(gzip.compress(f"{KEY} ".encode() * 9))).decode()
    assert secrets.unwrapped(f"before {twice} after") == ([], [(7, 7 + len(twice))])
