"""Language identification by bit-sliced Bloom filters over character n-grams (operator 6)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stash, unstash

#: Length of an n-gram.
GRAM = 4
#: Labelled documents that are learned from, for each language: those of least hash.
PER_LANG = 1000
#: A gram belongs to each language that has it in this share of the documents that the best language has it in.
OWN = 0.4
#: Log2 of the positions of the filters, at least, and at most where languages have more grams, and positions for each gram.
BITS, MOST_BITS, HASHES = 20, 24, 2
#: Ids that are sent to all tasks at most; more, as of very many languages, are joined.
MOST_SENT = 500_000
#: Parts of the hashes of ids in which a language's documents are counted.
COUNTED = 1 << 16
UNKNOWN = "und"
#: A document whose score is less is in none of the learned languages.
ACCEPTED = 0.2

_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


@cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    return np.array([i if not 0xD800 <= i < 0xE000 and chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def gram_hashes(text: str, n: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each n-gram of the lower-cased letters of `` text `` that begins before a letter or at one."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points]
    # runs of spaces count as one
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    if len(points) < n:
        points = np.concatenate((points, np.full(n - len(points), 32, np.uint32)))
    size = len(points) - n + 1
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h += points[i : i + size] * _PRIMES[i]
    h ^= h >> np.uint64(29)
    h *= _PRIMES[4]
    return h


def positions(h: np.ndarray, bits: int = BITS, hashes: int = HASHES):
    for i in range(hashes):
        yield (h >> np.uint64(64 - bits - i * (bits + 1))) & np.uint64((1 << bits) - 1)


class Filters:
    """One Bloom filter for each language, sliced by bit: a position holds the set of languages, 64 to a word."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], bits: int = BITS, hashes: int = HASHES):
        self.langs, self.bits, self.hashes = langs, bits, hashes
        self.slices = np.zeros(((len(langs) + 63) // 64, 1 << bits), np.uint64)
        for k, lang in enumerate(langs):
            for at in positions(grams[lang].view(np.uint64), bits, hashes):
                self.slices[k // 64, at] |= np.uint64(1 << (k % 64))
        filled = [np.count_nonzero(self.slices[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(langs))]
        self.false_rate = (np.array(filled, float) / (1 << bits)) ** hashes

    def decide(self, text: str | None) -> tuple[str, float]:
        h = gram_hashes(text) if text and self.langs else np.zeros(0, np.uint64)
        if not len(h):
            return UNKNOWN, 0.0
        counts = np.zeros(len(self.langs))
        for at in range(0, len(h), 1 << 20):  # memory stays bounded on long texts
            part = h[at : at + (1 << 20)]
            for word, table in enumerate(self.slices):
                found = np.full(len(part), ~np.uint64(0))
                for p in positions(part, self.bits, self.hashes):
                    found &= table[p]
                for k in range(word * 64, min(len(self.langs), word * 64 + 64)):
                    counts[k] += np.count_nonzero(found & np.uint64(1 << (k % 64)))
        hits = np.clip((counts - self.false_rate * len(h)) / (1 - self.false_rate + 1e-12), 0, None)
        best = int(hits.argmax())
        total = hits.sum()
        # the share of the languages' hits, scaled by how much of the text is known at all
        return self.langs[best], float(hits[best] / total * min(1.0, hits[best] / len(h) + 0.5)) if total else 0.0


def sampled(known: DataFrame, id_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """The rows of ``known`` with the ``per_lang`` least hashes of ids of each language.

    Rows are counted by language and part of the hashes first, and only those of the parts that are needed are put in
    order, so that a language of very many documents is no single task's.
    """
    part = F.shiftright(F.xxhash64(id_col), 64 - (COUNTED - 1).bit_length()).alias("_part")
    counts = known.groupBy(F.col(lang_col).alias("_lang"), part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_lang").orderBy("_part")) - F.col("_n")
    needed = counts.withColumn("_before", before).where(F.col("_before") < per_lang).select("_lang", "_part")
    dealt = known.withColumn("_own", part)
    few = dealt.join(needed, (F.col(lang_col) == F.col("_lang")) & (F.col("_own") == F.col("_part")))
    rank = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), F.col(id_col))
    return few.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= per_lang).select(known.columns)


def learn(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_lang: int = PER_LANG) -> Filters:
    """Fit the filters on at most ``per_lang`` documents for each language.

    The documents of least id hash are taken, before any text is moved.  All their n-grams count that two of them
    have and no other language has much more often.  What comes to the driver are these grams' hashes.  Nulls in
    any of the columns are left out; without a row there is no language.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and id is not null")
    ids = stash(sampled(known.select("id", "lang"), "id", "lang", per_lang).select("id").distinct(), "sampled")
    sample = known.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "id")

    def grams(batches):
        for b in batches:
            lang, g = [], []
            for one, text in zip(b["lang"], b["text"]):
                h = np.unique(gram_hashes(text))
                lang += [one] * (len(h) + 1)
                g += [h, np.zeros(1, np.uint64)]  # 0 counts the documents
            yield pd.DataFrame({"lang": lang, "gram": np.concatenate(g).view(np.int64) if g else np.zeros(0, np.int64)})

    counts = sample.select("lang", "text").mapInPandas(lean(grams), "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n"))
    counts = stash(counts, "grams")
    sizes = counts.where("gram = 0").select("lang", F.col("n").alias("size"))
    rates = counts.where("gram <> 0 and n > 1").join(sizes, "lang").withColumn("rate", F.col("n") / F.col("size"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    kept = rates.withColumn("best", best).where(F.col("rate") >= OWN * F.col("best")).select("lang", "gram").toPandas()
    unstash(counts, ids)
    by = {lang: g.to_numpy(np.int64) for lang, g in kept.groupby("lang")["gram"]}
    langs = sorted(by)
    most = max(map(len, by.values()), default=0)
    return Filters(langs, by, min(max(BITS, (8 * most).bit_length()), MOST_BITS))


def identify(docs: DataFrame, filters: Filters, text_col: str = "text"):
    """``docs`` with the columns lang_pred and score, in place of columns of these names.

    Every whole text, however long, is judged by its own n-grams alone: a null text or one without letters is ``und``
    with score 0.  Of languages with as many hits the first by name is taken.  Repeated rows are judged each; other
    columns stay, whatever they are called; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**MOST_BITS words at most for each 64 languages

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.decide(t) for t in texts], columns=["lang", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.select(F.struct(*kept).alias("row"), judge(F.col(text_col)).alias("judged"))
    return judged.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score"))


def held_out(id_col: str = "doc_id"):
    """True for the documents that are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
