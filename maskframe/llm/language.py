"""Language ID by Bayesian evidence fusion.

log P(language | row) = log P(text | language) + log P(declared | language) + log P(language | host) + constant

* text: naive Bayes over hashed byte trigrams, fitted on at most ``max_train`` labelled documents (least hash of id, of
  the rows that aren't held out: crc32(id as text) mod 3 is not 1). A long text counts as ``TRIGRAMS`` trigrams at most
  in weight, though all of it is read, so that other evidence can still speak.
* declared: the lang attribute of the html element, with its reliability estimated from the corpus.
* host: sums of the text's posteriors by host, shrunk to those by address suffix, and these to those of all rows
  (``STRENGTH`` rows of prior each); a row's own part is left out. All sums are grouped aggregations over all rows.

Documents have neither markup nor address: their source stands for the host.

Defined cases: null and empty text or html: text tells nothing, the priors decide; a missing host, suffix or declared
language tells nothing; without labelled documents the language is null; rows that share an id stay separate; of equal
probabilities the first language in alphabetical order is told; an empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_chunks, join_each, table

MAX_TRAIN, FEATURES, TRIGRAMS, STRENGTH = 20_000, 1 << 16, 100, 20.0
FOLD = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256)], np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts, first one of each text and the end); other than letters, bytes count as blanks."""
    data = FOLD[np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)].astype(np.uint32)
    at = np.cumsum([0, *(len(t) + 2 for t in texts)])
    three = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) if len(data) > 2 else np.empty(0, np.uint32)
    within = np.ones(len(data), bool)
    for edge in at[1:]:
        within[edge - 2 : edge] = False
    within = within[: len(three)] & (three != 0x202020)
    sums = np.concatenate([[0], np.cumsum(within)])
    return ((three[within] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), sums[np.minimum(at, len(three))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()
        for first, last in in_chunks(texts):
            grams, at = trigrams(texts[first:last])
            for lang, a, b in zip(langs[first:last], at[:-1], at[1:], strict=True):
                np.add.at(total.setdefault(lang, np.zeros(FEATURES)), grams[a:b], 1 / max(1, b - a) ** 0.5)
    for lang, n in total.items():
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(n[found])], names=["lang", "feature", "n"])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """(languages, FEATURES x languages log likelihoods)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.col("lang")).where("id is not null and text is not null and lang is not null")
    rows = rows.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1)
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(max_train).distinct()
    part = rows.join(F.broadcast(chosen), "id", "left_semi")  # at most max_train ids
    found = part.select("lang", "text").mapInArrow(_counts, "lang string, feature int, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(found.lang))
    n = np.full((FEATURES, len(langs)), 0.01)
    for k, lang in enumerate(langs):
        own = found[found.lang == lang]
        n[own.feature.to_numpy(), k] += own.n.to_numpy()
    return langs, np.log(n / n.sum(axis=0, keepdims=True)).astype(np.float32)


def _likelihoods(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            out = []
            for first, last in in_chunks(texts, 1 << 19):
                grams, at = trigrams(texts[first:last])
                sums = np.zeros((last - first, weights.shape[1]))
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    sums[some] = np.add.reduceat(weights[grams], at[some], axis=0)
                n = np.diff(at)[:, None]
                out += (sums / np.maximum(n, 1) * np.minimum(n, TRIGRAMS)).tolist()
            keep = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.list_(pa.float64()))], names=[*names, "ll"])

    return run


def softmax(x: Column) -> Column:
    high = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - high))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^/?#]*?://([^/?#]*)", 1))


def page_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z]+;|&#[0-9]+;", " ")


def identify(spark: SparkSession, rows: DataFrame, model: tuple[list[str], np.ndarray], ids: list[str]) -> DataFrame:
    """rows: the id columns, text, host, suffix, declared -> the id columns, lang, probability, text_lang, declared, host."""
    langs, weights = model
    size = len(langs)
    blank = F.lit(None).cast("string")
    if not size:
        return rows.select(*ids, blank.alias("lang"), F.lit(None).cast("double").alias("probability"), blank.alias("text_lang"), "declared", "host")
    scratch = Scratch(spark, "language")
    plain = rows.select(*ids, "host", "suffix", "declared", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "text") + ", ll array<double>"
    known = scratch.save(plain.mapInArrow(_likelihoods(spark.sparkContext.broadcast(weights)), schema), "likelihoods")
    # host and suffix as one key; rows with neither have none
    place = F.when(F.coalesce("host", "suffix").isNotNull(), F.concat_ws("\x01", F.coalesce("suffix", F.lit("\x02")), F.coalesce("host", F.lit("\x02"))))
    known = known.withColumns({"p": softmax(F.col("ll")), "place": place})
    sums = [F.sum(F.col("p")[k]) for k in range(size)]
    total = known.agg(F.array(*(F.coalesce(s, F.lit(0.0)) for s in sums)).alias("all_p"), F.count(F.lit(1)).alias("all_n"))
    places = scratch.save(known.where("place is not null").groupBy("place", "host", "suffix").agg(F.array(*sums).alias("host_p"), F.count(F.lit(1)).alias("host_n")), "places")
    hosts = places.where("host is not null")
    by_suffix = hosts.where("suffix is not null").groupBy("suffix").agg(F.array(*(F.sum(F.col("host_p")[k]) for k in range(size))).alias("suffix_p"), F.sum("host_n").alias("suffix_n"))
    own = F.col("host").isNotNull()
    of_place = places.select("place", "suffix", *(F.when(own, F.col(c)).alias(c) for c in ("host_p", "host_n")))
    of_place = scratch.save(join_each(of_place, scratch.save(by_suffix, "suffixes"), "suffix").drop("suffix"), "of-place")
    declared = known.where("declared is not null").groupBy("declared").agg(F.array(*sums).alias("told_p"))
    told = declared.agg(F.array(*(F.sum(F.col("told_p")[k]) for k in range(size))).alias("told_all"), F.count(F.lit(1)).alias("codes"))
    all_p, all_n = total.first()
    told_all, codes = told.first()
    prior = F.array(*(F.lit((p + 1.0) / (all_n + size)) for p in all_p))
    reliability = declared.select("declared", F.array(*(F.log((F.col("told_p")[k] + 0.1) / F.lit((told_all[k] or 0.0) + 0.1 * (codes + 1))) for k in range(size))).alias("told"))
    # both sides are written tables, so that Spark can split a code that very many rows declare
    out = join_each(known, of_place, "place").join(scratch.save(reliability, "reliability"), "declared", "left")

    def shrunk(sums: str, n: str, own: Column, to: Column) -> Column:
        mean = F.transform(F.col(sums), lambda s, k: (F.greatest(s - own[k], F.lit(0.0)) + STRENGTH * to[k]) / (F.col(n) - 1 + STRENGTH))
        return F.when(F.col(n).isNull(), to).otherwise(mean)

    out = out.withColumn("suffix_prior", shrunk("suffix_p", "suffix_n", F.col("p"), prior))
    out = out.withColumn("host_prior", shrunk("host_p", "host_n", F.col("p"), F.col("suffix_prior")))
    fused = F.transform(F.col("ll"), lambda v, k: v + F.log(F.col("host_prior")[k]) + F.coalesce(F.col("told")[k], F.lit(0.0)))
    out = out.withColumn("posterior", softmax(fused)).withColumn("best", F.array_position("posterior", F.array_max("posterior")).cast("int"))
    names = F.array(*map(F.lit, langs))
    text_lang = F.when(F.array_max("ll") < 0, names[F.array_position("p", F.array_max("p")).cast("int") - 1])
    return out.select(*ids, names[F.col("best") - 1].alias("lang"), F.col("posterior")[F.col("best") - 1].alias("probability"), text_lang.alias("text_lang"), "declared", "host")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")
    host = host_of(F.col("url"))
    known = F.when(host != "", host)
    of_docs = docs.select("doc_id", no_id.alias("page_id"), "text", F.concat(F.lit("source:"), "source").alias("host"), none.alias("suffix"), none.alias("declared"))
    code = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    of_pages = pages.select(
        no_id.alias("doc_id"), "page_id", page_text(F.col("html")).alias("text"), known.alias("host"), F.regexp_extract(known, r"([^.]+)$", 1).alias("suffix"), F.when(code != "", code).alias("declared")
    )
    return identify(spark, of_docs.unionByName(of_pages), fit(docs), ["doc_id", "page_id"])
