"""Language identification by the nearest of several centroids of each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import map_frames, small_batches, type_of


@dataclass(frozen=True)
class Languages:
    """sample: labelled documents of each language, about, that its centroids are learned from, all where it has fewer. centroids: of each language.

    reject: times the lower percentile of the sample's similarities to their nearest centroids; predictions below are marked.
    """

    sample: int = 1000
    centroids: int = 3
    log2_features: int = 12
    rounds: int = 10
    reject: float = 0.5
    #: Bytes of a text whose n-grams are counted at once.
    at_once: int = 1_000_000


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]
    least: float

    def nearest(self, counts: np.ndarray) -> tuple[str, float]:
        x = np.sqrt(counts) * self.idf
        sims = self.centres @ x / max(float(np.sqrt(x @ x)), 1e-12)
        at = int(np.argmax(sims))
        return self.langs[at], float(min(1.0, max(0.0, sims[at])))


def ngram_counts(text: str, how: Languages) -> np.ndarray:
    """Counts of the hashed byte n-grams of 1 to 3 bytes of a text in lower case, whitespace runs as one space."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" ", np.uint8)
    size, shift = 1 << how.log2_features, np.uint32(32 - how.log2_features)
    counts = np.zeros(size, np.int64)
    for at in range(0, len(data), how.at_once):
        b = data[at : at + how.at_once + 2].astype(np.uint32)
        own = min(how.at_once, len(data) - at)
        for n, salt in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
            m = min(own, len(b) - n + 1)
            if m > 0:
                gram = b[:m].copy()
                for i in range(1, n):
                    gram |= b[i : m + i] << np.uint32(8 * i)
                counts += np.bincount((gram + np.uint32(n)) * np.uint32(salt) >> shift, minlength=size)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame, how: Languages) -> tuple[int, np.ndarray]:
    """How many of docs(text) have a letter, and how many of these have each feature: each task sends one row of sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, np.zeros(1 << how.log2_features, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if has_letter(text):
                    n += 1
                    found += ngram_counts(text, how) > 0
        at = np.flatnonzero(found)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(found[at], n)})

    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(1 << how.log2_features), 0
    for r in rows:
        if r["at"] < 0:
            total = r["n"]
        else:
            out[r["at"]] = r["n"]
    return total, out


def fit(docs: DataFrame, how: Languages) -> Model | None:
    """Learn from docs(doc_id, text, lang) without null texts and langs.

    Document frequencies are of all of them. Of each language, documents are drawn by a hash, each with a probability
    that gives about `how.sample`, and their TF-IDF vectors are clustered; so a rare language is learned as well. What
    comes to the driver grows with the number of languages alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if has_letter(text):
                    counts = ngram_counts(text, how)
                    at = np.flatnonzero(counts)
                    rows.append((lang, at.astype(np.int32), counts[at]))
            yield pd.DataFrame(rows, columns=["lang", "at", "n"])

    shares = docs.groupBy("lang").agg((F.lit(float(how.sample)) / F.count("*")).alias("share"))
    drawn = (F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**52 - 1)) / float(2**52)) < F.col("share")
    chosen = docs.join(F.broadcast(shares), "lang").where(drawn)
    rows = chosen.select("lang", "text").mapInPandas(run, "lang string, at array<int>, n array<long>")
    with small_batches(docs.sparkSession):
        rows = rows.collect()
    if not rows:
        return None
    total, found = document_frequencies(docs, how)
    rows.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    x = np.zeros((len(rows), 1 << how.log2_features), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["n"]
    idf = (np.log((1 + total) / (1 + found)) + 1).astype(np.float32)
    x = np.sqrt(x) * idf
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    langs = np.array([r["lang"] for r in rows])
    centres, names = [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        c = own[_spread(own, min(how.centroids, len(own)))]
        for _ in range(how.rounds):
            near = np.argmax(own @ c.T, axis=1)
            c = np.stack([own[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
        centres.append(c)
        names += [str(lang)] * len(c)
    centres = np.concatenate(centres)
    least = how.reject * float(np.percentile((x @ centres.T).max(axis=1), 1))
    return Model(idf, centres, names, least)


def _spread(own: np.ndarray, k: int) -> list[int]:
    """The row nearest to the mean, then again and again the row that is least similar to those chosen."""
    chosen = [int(np.argmax(own @ own.mean(axis=0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((own @ own[chosen].T).max(axis=1))))
    return chosen


def languages(docs: DataFrame, how: Languages | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document of docs(doc_id, text, lang).

    Learned from documents whose CRC-32 of the doc_id as text is not 1 modulo 3 (held_out otherwise) and whose text
    and lang are not null. A whole text's n-gram counts, their square roots weighted by inverse document frequency,
    are compared with several centroids of each language by cosine, which is the score. rejected: the distance to the
    nearest centroid is too large to trust, by the distances in the sample; lang_pred is still the nearest one's.

    A null text, or one without a letter, is `und` with the score 0, and so is all text if nothing can be learned. A
    null doc_id is learned from and not held out. Rows are judged by themselves, whatever their doc_id; equal
    similarities go to the language that sorts first; an empty table gives an empty result; other columns are ignored.
    """
    how = how or Languages()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.where("not held_out and text is not null and lang is not null").select("doc_id", "text", "lang"), how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if model is None or not has_letter(text):
                    out.append(("und", 0.0, True))
                else:
                    lang, score = model.nearest(ngram_counts(text, how))
                    out.append((lang, round(score, 6), score < model.least))
            got = pd.DataFrame(out, columns=["lang_pred", "score", "rejected"], index=pdf.index)
            yield pd.concat([pdf[["doc_id", "held_out"]], got], axis=1)

    return map_frames(docs.select("doc_id", "text", "held_out"), run, f"doc_id {type_of(docs, 'doc_id')}, held_out boolean, lang_pred string, score double, rejected boolean")
