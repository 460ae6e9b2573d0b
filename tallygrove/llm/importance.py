"""Importance resampling towards a target corpus, scored without exploding a document.

A document's features are its runs of one to two consecutive words; a feature's bucket is the crc32 of its UTF-8 bytes modulo
``BUCKETS``. Higher-order functions make each document's array of buckets; its weight is the floored mean over that array of
the buckets' gains, an array literal of ``BUCKETS`` entries. A gain tells how much likelier the bucket is in the target than
in the corpus. Only the counts of buckets are shuffled (at most ``BUCKETS`` rows a task, summed before), and one row of
numbers a document for the ranks.

Scores are the weights plus a Gumbel draw fixed by the id, so the highest ones are a sample without replacement in proportion to
exp(weight / 1000). Ranks are counted by ranges of the score; no row order is gathered in one task.

Defined cases: a null or empty text has no feature, weight 0, and is never drawn; a document without id has no score and is
never drawn, nor counted as one that could be; repeated ids count each, equal rows of one id in any order; an empty target leaves gains that are
still defined; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import stored
from tallygrove.llm.spelling import CRC_TABLE_SQL, LOWER, UPPER, crc32_sql

BUCKETS = 10_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of text whose A to Z are lower-cased
SHARE, LEAST_WORDS = 25, 20  # percent that is drawn of the documents with at least so many words


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of all single words and of all two words in a row."""
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    both = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: bucket(F.concat_ws(" ", a, b)))
    return F.concat(F.transform(words, bucket), F.slice(both, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall in each bucket: summed in each task, then over tasks; one number a bucket is returned."""
    found = texts.select(words_of(F.col(f"`{text}`")).alias("words")).select(F.explode(buckets_of(F.col("words"), buckets)).alias("bucket"))
    out = [0] * buckets
    for r in found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln) of each bucket's smoothed share in the target over its share in the corpus."""
    k, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1) * float(s_all + k) / ((s + 1) * float(t_all + k)))) for s, t in zip(corpus, target, strict=True)]


def weigh(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each document: one projection, nothing is exploded or shuffled."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded to a literal array
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("words"))
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), len(gain)).alias("buckets"))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    d = d.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    n = F.greatest(F.col("n_features"), F.lit(1))
    return d.select("doc_id", "n_words", "n_features", F.expr("(total - pmod(total, greatest(n_features, 1))) div greatest(n_features, 1)").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank (from 1, highest score first, ties to the smaller id) only of those drawn."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weigh(docs, gain, doc_id, text).withColumn("score", (F.col("weight") + gumbel).cast("long")), "scored")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    quota = share * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = stored(scored.where(able).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("range").count().collect()):  # a number a partition
        offsets.append((r[0], before))
        before += r[1]
    sent = F.broadcast(docs.sparkSession.createDataFrame(offsets, "range int, before long"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = dealt.join(sent, "range").withColumn("nth", nth).withColumn("rank", F.when(F.col("nth") <= quota, F.col("nth")).cast("long"))
    rest = scored.where(~F.coalesce(able, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def _features_sql(table: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"(SELECT *, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT *, {words} AS w FROM {table}))"


ORACLE_SQL = f"""
WITH {CRC_TABLE_SQL},
docs AS MATERIALIZED {_features_sql("documents")},
marks AS {_features_sql("benchmark")},
features AS (SELECT doc_id, unnest(f) AS feature FROM docs),
asked AS (SELECT unnest(f) AS feature FROM marks),
distinct_features AS (SELECT DISTINCT feature FROM (SELECT feature FROM features UNION ALL SELECT feature FROM asked)),
hashed AS MATERIALIZED (SELECT feature, CAST({crc32_sql("feature")} % 10000 AS BIGINT) AS bucket FROM distinct_features, crc_table),
s AS (SELECT bucket, count(*) AS n FROM features JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM asked JOIN hashed USING (feature) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s_all, coalesce((SELECT sum(n) FROM t), 0) AS t_all),
gain AS MATERIALIZED (SELECT b.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket) CROSS JOIN totals),
sums AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM features JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_features, CAST(coalesce((x.total - ((x.total % x.n) + x.n) % x.n) // x.n, 0) AS BIGINT) AS weight FROM docs d LEFT JOIN sums x USING (doc_id)),
scored AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN nth <= 25 * able // 100 THEN nth END AS BIGINT) AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
