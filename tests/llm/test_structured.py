"""WARC derivatives, mixing and chat rotation against DuckDB; the pipeline against its stages."""

import re
import zlib

import corpus_pipeline
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallygrove.llm import chat, mixing, warc
from tallygrove.llm.queries import TEMPER


@pytest.mark.parametrize("name", ["op2_warc_derivatives", "op6_mix_weights", "op10_chat_rotation"])
def test_query_equals_its_sql(spark, duck, name):
    got, want = rows_of(entry.queries()[name](spark, DATA)), rows_of(duck.execute(entry.oracle_sql()[name]).df())
    assert got == want and got[1]


def test_warc_edge_cases(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", "<html><title> A &amp; B </title><script>x()</script><p>one<br>two&nbsp;&lt;three&gt;</p><!-- open"), (2, None, None), (2, None, None), (None, "http://b/", ""), (3, "u", "x" * 200_000)],
        "page_id long, url string, html string",
    ).withColumn("block", F.lit("clash"))
    rows = warc.derive(warc.responses_from_pages(pages)).collect()
    assert len(rows) == 10
    one = {r["warc_type"]: r for r in rows if r["page_id"] == 1}
    assert one["conversion"]["block"] == "one\ntwo <three>" and "title: A & B\r\n" in one["metadata"]["block"]
    assert one["conversion"]["refers_to"] == one["metadata"]["refers_to"] != one["conversion"]["record_id"]
    assert f"WARC-Refers-To: {one['conversion']['refers_to']}" in one["conversion"]["warc_header"]
    two = [r for r in rows if r["page_id"] == 2]
    assert len({r["record_id"] for r in two}) == 2 and all("Target-URI" not in r["warc_header"] for r in two)
    assert warc.derive(warc.responses_from_pages(pages.limit(0))).count() == 0


def test_warc_files_hold_the_records(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "u", "<p>ü</p>")], "page_id long, url string, html string")
    warc.write_warc(warc.derive(warc.responses_from_pages(pages)).coalesce(1), f"file://{tmp_path}/w")
    text = gzip.open(next(iter((tmp_path / "w").glob("*.gz")))).read().decode()
    assert text.count("WARC/1.1\r\n") == 2 and "Content-Length: 2\r\n\r\nü\r\n\r\n" in text


def strict(record):
    """Header and fields of a record, by a reader that takes every line end for one and every line to be `name: value`."""
    first, *lines = re.split("\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]", record["warc_header"])
    assert first == "WARC/1.1"
    fields = [tuple(x.split(": ", 1)) for x in lines]
    assert all(len(f) == 2 and re.fullmatch("[A-Za-z-]+", f[0]) for f in fields) and len({n for n, _ in fields}) == len(fields)
    inner = []
    if record["warc_type"] == "metadata":
        *own, last = re.split("\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]", record["block"])
        assert last == ""
        inner = [tuple(x.split(": ", 1)) for x in own]
        assert all(len(f) == 2 and re.fullmatch("[A-Za-z0-9-]+", f[0]) for f in inner), inner
    return dict(fields), dict(inner)


EVIL = "\r\nWARC-Type: request\nContent-Length: 0\r\n\r\nWARC/1.1"


def test_no_page_writes_a_line_of_its_own(spark):
    entities = "T&#13;&#10;source-digest: sha256:forged&#10;x&#x0b;y&#x85;z&#8232;end"
    rows = [(1, "http://a/b c" + EVIL + "\t\u2028", f"<title>{entities}</title><p>body</p>"), (2, "http://ok/", "<title>a\r\nb</title>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.derive(warc.responses_from_pages(pages)).collect()
    want = {"WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "X-Source-Payload-Digest", "X-Source-HTTP-Headers", "Content-Type", "Content-Length"}
    for r in made:
        fields, inner = strict(r)
        assert set(fields) == want and fields["WARC-Type"] == r["warc_type"] and not re.search(r"[\x00-\x20\u2028]", fields["WARC-Target-URI"])
        if r["warc_type"] == "metadata":
            assert inner["source-digest"] == r["source_digest"] and inner["title"] == ("T source-digest: sha256:forged x y z end" if r["page_id"] == 1 else "a b")
    assert made[0]["target_uri"].startswith("http://a/b%20c%0D%0AWARC-Type:%20request%0A") and made[0]["target_uri"].endswith("%09%E2%80%A8")


def test_source_headers_become_single_lines(spark):
    headers = "HTTP/1.1 200 OK\nX-A: one\n two\r\n\tthree\r\n\r\nX-B: \x00b" + chr(0x2028) + "c\rX-C: d" + EVIL
    responses = spark.createDataFrame(
        [(1, "<urn:x>\r\nX: y", "http://a/", "2024-05-06T07:08:09Z", headers, "p"), (2, "<urn:y>", None, "yesterday\r\nX: y", None, None), (3, "<urn:z>", "u", None, "", "p")],
        "page_id long, record_id string, target_uri string, warc_date string, http_headers string, payload string",
    )
    made = {(r["page_id"], r["warc_type"]): strict(r) for r in warc.derive(responses).collect()}
    fields, inner = made[1, "metadata"]
    assert inner["source-http-status"] == "HTTP/1.1 200 OK" and inner["source-http-X-A"] == "one two three" and inner["source-http-X-B"] == "b c" and inner["source-http-X-C"] == "d"
    assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["WARC-Refers-To"] == "<urn:x>X: y" and "source-http-WARC-Type" in inner
    assert "WARC-Date" not in made[2, "metadata"][0] and "WARC-Target-URI" not in made[2, "metadata"][0] and "X-Source-HTTP-Headers" not in made[3, "conversion"][0]


def test_dates_come_from_a_column(spark):
    pages = spark.createDataFrame([(1, "u", "p", "2024-02-03 04:05:06"), (2, "u", "p", "2024-02-03T04:05:06Z"), (3, "u", "p", None), (4, "u", "p", "soon")], "page_id long, url string, html string, seen string")
    got = {r["page_id"]: r["warc_date"] for r in warc.responses_from_pages(pages, date=F.col("seen")).collect()}
    assert got == {1: "2024-02-03T04:05:06Z", 2: "2024-02-03T04:05:06Z", 3: None, 4: None}
    stamps = pages.where("page_id = 1").withColumn("seen", F.to_timestamp("seen"))
    assert warc.responses_from_pages(stamps, date=F.col("seen")).first()["warc_date"] == "2024-02-03T04:05:06Z"


def test_raking_meets_its_targets(spark):
    cells = spark.createDataFrame([(s, l, t, 10 * i + 5) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in ("en", "de") for t in ("x", "y"))], "mix_source string, mix_lang string, mix_topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2, "absent": 0.4}, "lang": {"en": 0.4, "de": 0.6}, "topic": {"x": 0.7, "y": 0.3}}
    rows = mixing.rake(cells, targets).collect()
    share = lambda d, g: sum(r["weight"] for r in rows if r[f"mix_{d}"] == g)
    assert abs(share("source", "a") - 0.5) < 1e-6 and abs(share("lang", "de") - 0.6) < 1e-6 and abs(share("topic", "x") - 0.7) < 1e-6
    assert max(r["keep_prob"] for r in rows) == pytest.approx(1.0)


def test_mixing_edge_cases(spark):
    d = spark.createDataFrame([(1, None, None, None), (1, "a b", "en", None), (2, "", None, "web"), (3, "a " * 5000, "en", "web")], "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit(1))
    rows = mixing.mix(d, temper=TEMPER).collect()
    assert len(rows) == 4 and all(0 <= r["mix_prob"] <= 1 for r in rows)
    assert mixing.mix(d.limit(0), temper=TEMPER).count() == 0


def test_rotation_edge_cases(spark):
    turns = spark.createDataFrame(
        [(1, 1, "system", "rules"), (1, 2, "ann", "hi <|im_end|>"), (1, 3, None, None), (1, None, "bob", ""), (2, 1, "system", "alone"), (None, 1, "ann", "x"), (1, 2, "ann", "hi <|im_end|>"), (1, 900, "bob", "late")],
        "conv_id long, turn int, role string, text string",
    ).withColumn("segment", F.lit("clash"))
    rows = chat.rotate_perspectives(turns).orderBy("perspective", "position").collect()
    assert {r["conv_id"] for r in rows} == {1} and {r["perspective"] for r in rows} == {"ann", "bob", "unknown"}
    for who in ("ann", "bob", "unknown"):
        mine = [r for r in rows if r["perspective"] == who]
        whole = "".join(r["segment"] for r in mine)
        assert [r["position"] for r in mine] == list(range(1, 7)) and mine[-1]["char_end"] == len(whole)
        for r in mine:
            assert whole[r["char_start"] : r["char_end"]] == r["segment"]
            assert (r["mask_start"] is not None) == (r["speaker"] == who) == r["segment"].startswith("<|im_start|>assistant\n")
            if r["mask_start"] is not None:
                assert whole[r["mask_start"] : r["mask_end"]].endswith("<|im_end|>") and whole[r["mask_start"] : r["mask_end"]].count("<|") == 1
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_pipeline_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns
        rows = after.collect()
        ids, gone = {r["doc_id"] for r in rows}, {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in rows}
        assert ids and len(rows) == len(ids)
        if name == "language ID":
            assert all(not any(c.isalpha() for c in r["text"] or "") for r in docs.where(F.col("doc_id").isin(list(gone))).collect()) or len(gone) < 10
        before = spark.createDataFrame(rows, after.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert {p["doc_id"] for p in pieces} == ids
    got = corpus_pipeline.run(spark, DATA).collect()
    per = lambda rows: sorted((p["doc_id"], p["doc_tokens"]) for p in rows if p["start"] == 0)
    assert per(got) == per(pieces)


def test_every_pipeline_stage_takes_odd_documents(spark):
    texts = [None, "", " ", "1234", "the cat sat on the mat and looked at the dog", "x" * 50_000, "token=" + "a" * 20]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "no id here at all", "en", "web", 1)], "doc_id long, text string, lang string, source string, n_chars int").withColumn("node", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).collect()
        stage(spark, docs.limit(0), DATA).collect()
    assert zlib.crc32(b"") == 0


def test_written_records_are_read_by_a_strict_reader(spark, tmp_path):
    """Every record begins right after the last: version, headers, an empty line, as many bytes as said, two line ends."""
    import glob
    import gzip
    import hashlib

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<title>T{i}</title><p>a&#8212;b &eacute;&amp;lt; &#x41;&unknown; {'x' * i}\n") for i in range(30)], "page_id long, url string, html string")
    derived = warc.derive(warc.responses_from_pages(pages))
    warc.write_warc(derived, f"file://{tmp_path}/w")
    seen = {}
    for path in glob.glob(f"{tmp_path}/w/*.gz"):
        data = gzip.open(path).read()
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            version, *lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1"
            size = int(headers["Content-Length"])
            block, end, data = rest[:size], rest[size : size + 4], rest[size + 4 :]
            assert end == b"\r\n\r\n" and headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            seen[headers["WARC-Record-ID"]] = (headers, block.decode())
    assert len(seen) == 60
    for headers, block in seen.values():
        assert headers["X-Source-HTTP-Headers"].startswith("HTTP/1.1 200 OK; Content-Type: text/html")
        if headers["WARC-Type"] == "metadata":
            assert f"source-digest: {headers['X-Source-Payload-Digest']}\r\n" in block and "source-http-Content-Type: text/html; charset=utf-8\r\n" in block
        else:
            assert block.startswith("a\u2014b \u00e9&lt; A&unknown;")


def test_raking_with_a_topic_of_the_caller_and_its_residual(spark):
    from pyspark.sql import functions as F

    rows = [(i, "a b c", "ab"[i % 2], "xy"[i % 3 == 0], f"t{i % 5}", 1, "own") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string, mix_prob int, topic string")
    out = mixing.mix(docs, temper={"source": 0.5, "lang": 0.5, "topic": 0.5}, topic=F.col("kind")).collect()
    assert {r["mix_topic"] for r in out} == {f"t{i}" for i in range(5)} and len(out) == 300
    assert all(r["mix_residual"] <= mixing.TOLERANCE and 0 <= r["mix_prob"] <= 1 for r in out)
    torn = mixing.rake(spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "mix_source string, mix_lang string, mix_topic string, tokens long"), {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}, "topic": {"t": 1}}, most_rounds=8)
    assert all(r["residual"] > 0.1 for r in torn.collect())  # targets that can't both be met are told


def test_the_language_query(spark):
    import zlib

    from tallygrove.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_language_id(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    known = {r["lang"] for r in docs.values() if r["lang"]}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")) and r["lang_pred"] in known | {"und"}
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(right) > 0.9 * len(right)


def test_language_columns_replace_those_of_the_same_name(spark):
    from tallygrove.llm import langid

    model = langid.fit(["the cat and the dog"] * 8 + ["le chat et le chien"] * 8, ["en"] * 8 + ["fr"] * 8)
    docs = spark.createDataFrame([("the dog", "mine", "x", 1)], "text string, lang_id string, lang_pred string, told int")
    out = langid.identify(docs, model)
    assert out.columns == ["text", "lang_id", "told", "lang_pred", "lang_score", "lang_rejected"]
    assert out.first()["lang_id"] == "mine" and out.first()["lang_pred"] == "en"


def test_blanks_and_lines_of_page_text(spark):
    """Runs of blanks and line ends as plain expressions give them, at random and at the ends."""
    import random

    draw = random.Random(3)
    texts = ["", " ", "\n", " \n ", "a", "\ta\n"] + ["".join(draw.choice("  \n\n\t\r\f\x0bab\u00a0\u00e9") for _ in range(draw.randrange(1, 24))) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    tidy = lambda x: re.sub(r"^[ \n]+|[ \n]+\Z", "", re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\x0b]+", " ", x)))
    assert [r[0] for r in df.select(warc._tidy(F.col("t"))).collect()] == [tidy(x) for x in texts]
    whole = df.select(warc.untagged(F.col("t")).alias("u")).select(warc._tidy(F.col("u")))
    assert [r[0] for r in whole.collect()] == [re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" ") for x in texts]
    assert "regexp_replace(t, ^" not in warc._tidy(F.col("t"))._jc.toString() and warc._tidy(F.col("t"))._jc.toString().count("regexp_replace") == 2
