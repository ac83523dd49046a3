"""License scans by diagonal voting.

Words are longest runs of digits, letters and characters above 127, A-Z lowered. Every rolling word k-gram of every whole text
that could be a template's is hashed and joined, in Spark, with the positions of the templates' k-grams. A hit at word p of a text and t of a
template lies on diagonal p - t. Hits are added up by (text, template, diagonal); diagonals that are close, in offset and in
place, are merged (a word inserted or left out moves the rest by one diagonal); a merged span is verified by the share of the template's
words that its k-grams cover, the grams themselves compared as text. Spans of at least ``threshold`` give the template's label.

Only k-grams whose hash passes a sieve of the templates' hashes leave the scan: the others could join with nothing. The templates
are a fixed list, so their table is small whatever the corpus holds. Every template gram in a text is one row, however often it recurs.

Beside that, phrases are counted: places where their words stand consecutively.

Null or empty texts have no words and no labels. Repeated rows give their own results; rows with equal ids are told apart by their
place in the scan only until the result, so each keeps its own counts. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as W
from .license_texts import PHRASES, TEMPLATES
from .shared import arrow_batches, stored

K = 3
THRESHOLD = 0.8
#: Diagonals up to this far apart are neighbours.
DRIFT = 2
SIEVE_BITS = 20


def word_list(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    found = W.words(data, np.array([0, len(data)]), W.ALNUM)
    return [W.LOWER[data[a:b]].tobytes().decode("utf-8", "replace") for a, b in zip(found.start, found.end)]


def hashes(words: list[str], k: int) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return W.shingles(W.words(data, np.array([0, len(data)]), W.ALNUM).hash, k)


def template_grams(spark: SparkSession, templates, k: int) -> DataFrame:
    """(hash, gram, template, at, label, n_words): every k-gram of every template; templates of fewer than k words have none."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = word_list(text)
        for at, h in enumerate(hashes(words, k).view(np.int64).tolist() if len(words) >= k else []):
            rows.append((h, " ".join(words[at:at + k]), number, at, label, len(words)))
    return spark.createDataFrame(rows, "hash long, gram string, template int, at int, label string, n_words int")


def scan(docs: DataFrame, text: str, ids: str, phrases: dict[str, str], templates, k: int) -> DataFrame:
    """(row, doc_id, n_words, n_base, first_word, last_word, base_labels, grams): one row per text; grams are (hash, word, gram)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    wanted = [h for _, t in templates if len(word_list(t)) >= k for h in hashes(word_list(t), k).tolist()]
    looked = [(word_list(p), label) for p, label in phrases.items()]

    def read(batches):
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(np.array(wanted, np.uint64) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        exact = np.sort(np.array(wanted, np.uint64))
        keys = [(len(p), int(hashes(p, len(p))[0]), p, label) for p, label in looked]
        for batch in batches:
            doc = batch.column(0)
            for a, b, data, bounds in W.slices(batch.column(1)):
                found = W.words(data, bounds, W.ALNUM)
                n = np.bincount(found.unit, minlength=b - a)
                begin = np.concatenate(([0], np.cumsum(n)))

                def words_at(i, m):
                    return [W.LOWER[data[found.start[j]:found.end[j]]].tobytes().decode() for j in range(i, i + m)]

                rows = [[0, None, None, set(), []] for _ in range(b - a)]
                for m, h, phrase, label in keys:
                    every = W.shingles(found.hash, m)
                    for i in np.flatnonzero(every == np.uint64(h)).tolist():
                        u = int(found.unit[i])
                        if found.unit[i + m - 1] == u and words_at(i, m) == phrase:
                            at = i - int(begin[u])
                            r = rows[u]
                            r[0], r[1], r[2] = r[0] + 1, at if r[1] is None else min(at, r[1]), at if r[2] is None else max(at, r[2])
                            r[3].add(label)
                every = W.shingles(found.hash, k)
                maybe = np.flatnonzero(sieve[(every >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
                if len(exact) and len(maybe):
                    maybe = maybe[exact[np.minimum(np.searchsorted(exact, every[maybe]), len(exact) - 1)] == every[maybe]]
                for i in maybe.tolist():
                    u = int(found.unit[i])
                    if found.unit[i + k - 1] == u:
                        rows[u][4].append({"hash": int(every[i].view(np.int64)), "word": i - int(begin[u]), "gram": " ".join(words_at(i, k))})
                yield pa.RecordBatch.from_arrays([
                    doc.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([sorted(r[3]) for r in rows], pa.list_(pa.string())),
                    pa.array([r[4] for r in rows], pa.list_(pa.struct([("hash", pa.int64()), ("word", pa.int64()), ("gram", pa.string())])))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"])

    rows = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        read, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
              "grams array<struct<hash: long, word: long, gram: string>>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()))  # fixed by the written table


def spans(scanned: DataFrame, templates, k: int, threshold: float, drift: int) -> DataFrame:
    """(row, template, label, first_word, last_word, votes, similarity): verified spans of the scanned texts.

    A text is a group of its own and the rows of one (text, template) are its template grams, already added up by diagonal.
    """
    known = template_grams(scanned.sparkSession, templates, k)
    hit = (scanned.where(F.size("grams") > 0).select("row", F.explode("grams").alias("g"))
           .select("row", F.col("g.hash").alias("hash"), F.col("g.word").alias("word"), F.col("g.gram").alias("seen"))
           .join(F.broadcast(known), "hash").where("seen = gram"))  # the fixed templates
    votes = (hit.withColumn("diagonal", F.col("word") - F.col("at"))
             .groupBy("row", "template", "label", F.col("n_words").alias("size"), "diagonal")
             .agg(F.count(F.lit(1)).alias("votes"), F.min("word").alias("lo"), F.max("word").alias("hi"),
                  F.collect_set("at").alias("ats")))  # at most the template's grams
    along = Window.partitionBy("row", "template").orderBy("diagonal", "lo")
    before = F.lag("diagonal").over(along)
    apart = before.isNull() | (F.col("diagonal") - before > drift)
    merged = (votes.withColumn("apart", apart.cast("int"))
              .withColumn("span", F.sum("apart").over(along))
              .groupBy("row", "template", "label", "size", "span")
              .agg(F.sum("votes").alias("votes"), F.min("lo").alias("first_word"), (F.max("hi") + k - 1).alias("last_word"),
                   F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (k - 1))))))
    # Words of the template that stand in the span, over the longer of the two: inserted words count as well as missing ones.
    longer = F.greatest(F.col("size"), F.col("last_word") - F.col("first_word") + 1)
    verified = (merged.select("row", "template", "label", "first_word", "last_word", "votes", (covered / longer).alias("similarity"))
                .where(F.col("similarity") >= threshold))
    # Of spans that overlap, those of the best template stay: versions of one licence differ in a word.
    place = Window.partitionBy("row").orderBy("first_word", "last_word", "template")
    reach = F.max("last_word").over(place.rowsBetween(Window.unboundedPreceding, -1))
    clustered = (verified.withColumn("new", (reach.isNull() | (F.col("first_word") > reach)).cast("int"))
                 .withColumn("cluster", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0))))
    best = F.max("similarity").over(Window.partitionBy("row", "cluster"))
    return clustered.withColumn("best", best).where("similarity = best").drop("new", "cluster", "best")


def scan_licenses(docs: DataFrame, text: str = "text", ids: str = "doc_id", phrases: dict[str, str] = PHRASES, templates=TEMPLATES,
                  k: int = K, threshold: float = THRESHOLD, drift: int = DRIFT) -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``labels`` are the base labels and those of verified spans; the score is the best similarity, 1 for a phrase, 0 without label.
    """
    scanned = scan(docs, text, ids, phrases, templates, k)
    found = (spans(scanned, templates, k, threshold, drift).groupBy("row")
             .agg(F.collect_set("label").alias("more"), F.max("similarity").alias("best"),
                  F.array_sort(F.collect_list(F.struct("first_word", "last_word", "label", "similarity"))).alias("spans")))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", none)))
    return scanned.drop("grams").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"), "spans")
