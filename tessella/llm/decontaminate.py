"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import discard, few_files, map_frames, materialize, numbered, type_of
from tessella.llm.text import WordHashes, mix, window_hashes


@dataclass(frozen=True)
class Tiling:
    """tile: the least length of a match in words. coverage: the share of an item's words in tiles from which a document is contaminated.

    log2_bits: of the filter of seeds, 2 ** log2_bits / 8 bytes that are sent to the executors whatever the benchmark's
    size; a very large benchmark fills it and lets more seeds through to the join, which decides. group: items that a
    row of a document with its candidates holds at most; a document with more has several rows.
    """

    tile: int = 5
    coverage: float = 0.5
    log2_bits: int = 28
    group: int = 64


def lowered(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in pattern, start in text, length) of greedy string tiling by running Karp-Rabin matching.

    Windows of s unmarked words are looked up by their hashes and grown to maximal matches, the longest of which are
    marked first. A match longer than 2 s starts over with its length as s; else s is halved, down to `least`. Hits
    are compared word by word (on 64-bit word hashes).
    """
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(20, len(pattern)))

    def free_windows(free: np.ndarray, size: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(total[size:] - total[:-size] == size)

    while True:
        matches: list[tuple[int, int, int]] = []
        longest = 0
        if min(len(pattern), len(text)) >= s:
            hashes = window_hashes(text, s)
            where: dict[int, list[int]] = {}
            wanted = window_hashes(pattern, s)
            at = free_windows(free_t, s)
            at = at[np.isin(hashes[at], wanted)]
            for t in at.tolist():
                where.setdefault(int(hashes[t]), []).append(t)
            for p in free_windows(free_p, s).tolist():
                for t in where.get(int(wanted[p]), ()):
                    if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                        continue  # the match that starts before has it
                    n = 0
                    while p + n < len(pattern) and t + n < len(text) and free_p[p + n] and free_t[t + n] and pattern[p + n] == text[t + n]:
                        n += 1
                    if n >= s:
                        matches.append((n, p, t))
                        longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        clashed = False
        for n, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if free_p[p : p + n].all() and free_t[t : t + n].all():
                free_p[p : p + n] = free_t[t : t + n] = False
                tiles.append((p, t, n))
            else:
                clashed = True
        if clashed:
            continue  # what is left of matches that a longer one cut into may still have s words
        if s == least:
            return tiles
        s = max(least, s // 2)


def item_seeds(items: DataFrame, how: Tiling) -> DataFrame:
    """(item, item_id, words, seeds) of the items of a tile or more: word hashes and the hash of each run of `tile` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            own = [hashes.of(lowered(text)) for text in pdf["text"]]
            long = [len(x) >= how.tile for x in own]
            made = pdf[["item_id"]][long].reset_index(drop=True)
            made["words"] = pd.Series([x.view(np.int64) for x in own if len(x) >= how.tile], dtype=object)
            made["seeds"] = pd.Series([window_hashes(x, how.tile).view(np.int64) for x in own if len(x) >= how.tile], dtype=object)
            yield made

    kind = type_of(items, "item_id")
    return numbered(map_frames(items.select("item_id", "text"), run, f"item_id {kind}, words array<long>, seeds array<long>"), "item", "items")


def _places(seeds: np.ndarray, how: Tiling) -> np.ndarray:
    return (mix(seeds) >> np.uint64(64 - how.log2_bits)).astype(np.int64)


def seed_filter(seeds: DataFrame, how: Tiling) -> np.ndarray:
    """The bits at the places of seeds(seed), put together by place on the executors: at most 2 ** log2_bits of them come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"place": _places(pdf["seed"].to_numpy(np.int64).view(np.uint64), how) + 1})

    places = seeds.mapInPandas(run, "place long").groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(max(1, (1 << how.log2_bits) // 32768) * 4096, np.uint8)
    for row in places.toLocalIterator():
        out[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def shared_seeds(docs: DataFrame, bits: np.ndarray, how: Tiling) -> DataFrame:
    """(doc_id, t, text, seeds): of documents, the distinct hashes of runs of `tile` words that the filter lets through, if any; t is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            keep, found = [], []
            for x, text in enumerate(pdf["text"]):
                own = window_hashes(hashes.of(lowered(text)), how.tile)
                at = _places(own, how)
                own = own[shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
                if len(own):
                    keep.append(x)
                    found.append(np.unique(own).view(np.int64))
            yield pdf[["doc_id", "t", "text"]].iloc[keep].reset_index(drop=True).assign(seeds=pd.Series(found, dtype=object))

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return map_frames(texts, run, f"doc_id {type_of(docs, 'doc_id')}, t long, text string, seeds array<long>")


def best_item(own: np.ndarray, items: list[tuple], how: Tiling) -> tuple | None:
    """(item_id, coverage, tiles, tiled words, longest tile) of the item (item_id, words, seeds) of the highest coverage from how.coverage, then the smallest id, null last."""
    runs = window_hashes(own, how.tile)
    ranked = []
    for item_id, words, seeds in items:
        words, hit = np.asarray(words, np.int64).view(np.uint64), np.isin(np.asarray(seeds, np.int64).view(np.uint64), runs)
        edge = np.zeros(len(words) + 1, np.int64)
        edge[: len(hit)] += hit
        edge[how.tile : how.tile + len(hit)] -= hit
        bound = int((np.cumsum(edge[:-1]) > 0).sum()) / len(words)  # tiles cover no more of an item than its seeds do
        ranked.append((-bound, item_id is None, item_id, words))
    found = None
    for bound, no_id, item_id, words in sorted(ranked, key=lambda x: x[:2] + ((x[2],) if x[2] is not None else (0,))):
        if -bound < how.coverage or found and -bound < found[0][1]:
            break
        tiles = greedy_tiles(words, own, how.tile)
        covered = sum(n for _, _, n in tiles)
        row = (item_id, covered / len(words), len(tiles), covered, max((n for _, _, n in tiles), default=0))
        order = (-row[1], no_id, item_id)
        if row[1] >= how.coverage and (found is None or order[:2] < found[1][:2] or order[:2] == found[1][:2] and not no_id and item_id < found[1][2]):
            found = (row, order)
    return found and found[0]


def contaminated(docs: DataFrame, items: DataFrame, how: Tiling | None = None) -> DataFrame:
    """(doc_id, t, item_id, coverage, tiles, tiled_words, longest_tile) of the documents that hold items(item_id, text).

    A document is joined with the items that share runs of `tile` words with it, as many as the coverage needs; tiles
    are marked greedily, longest first, so that passages in another order are found as well; it is contaminated if they
    cover `coverage` of an item's words, A-Z lower-cased. The item of the highest coverage is given, ties by the
    smallest id, null last.

    A filter of the benchmark's seeds, of a fixed size, is broadcast; the documents' seeds that pass it, few for clean
    ones, are joined with the benchmark's, and only texts with such a seed are kept and shuffled. Null and short texts, and items
    of fewer words than a tile, match nothing. Each row of items is an item. t is a hash of the text: rows that share
    doc_id and text give one row, others that share a doc_id are judged by themselves; null ids are as good as others.
    Empty tables give an empty result. Other columns are ignored.
    """
    how = how or Tiling()
    known = item_seeds(items, how)
    seeds = known.select("item", F.size("words").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    bits = seed_filter(seeds.select("seed"), how)
    held = materialize(shared_seeds(docs, bits, how), "seeds")
    own = held.groupBy("doc_id", "t").agg(F.first("seeds").alias("seeds")).select("doc_id", "t", F.explode("seeds").alias("seed"))
    both = own.join(seeds.hint("merge"), "seed").groupBy("doc_id", "t", "item", "n").agg(F.count("*").alias("hits"))
    pairs = both.where(F.col("hits") * how.tile >= F.col("n") * how.coverage).select("doc_id", "t", "item")
    pairs = pairs.withColumn("group", F.expr(f"(row_number() over (partition by doc_id, t order by item) - 1) div {how.group}"))
    pairs = pairs.join(known.hint("merge"), "item").groupBy("doc_id", "t", "group").agg(F.collect_list(F.struct("item_id", "words", "seeds")).alias("items"))
    pairs = materialize(few_files(pairs.select(F.col("doc_id").alias("id"), F.col("t").alias("h"), "items"), held.count()), "candidates")
    joined = held.select("doc_id", "t", "text").join(pairs.hint("merge"), F.expr("doc_id <=> id and t = h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            keep, rows = [], []
            for x, (text, got) in enumerate(zip(pdf["text"], pdf["items"], strict=True)):
                listed = [(i["item_id"], i["words"], i["seeds"]) for i in got]
                if (row := best_item(hashes.of(lowered(text)), listed, how)) is not None:
                    keep.append(x)
                    rows.append(row)
            made = pd.DataFrame(rows, columns=["item_id", "coverage", "tiles", "tiled_words", "longest_tile"], dtype=object)
            yield pd.concat([pdf[["doc_id", "t"]].iloc[keep].reset_index(drop=True), made], axis=1)

    schema = f"doc_id {type_of(docs, 'doc_id')}, t long, item_id {type_of(items, 'item_id')}, coverage double, tiles long, tiled_words long, longest_tile long"
    out = map_frames(joined.select("doc_id", "t", "text", "items"), run, schema)
    least = F.struct(-F.col("coverage"), F.col("item_id").isNull(), "item_id")
    best = F.min_by(F.struct("item_id", "coverage", "tiles", "tiled_words", "longest_tile"), least)
    found = out.groupBy("doc_id", "t").agg(best.alias("b"))
    found = found.select("doc_id", "t", "b.item_id", F.round("b.coverage", 6).alias("coverage"), "b.tiles", "b.tiled_words", "b.longest_tile")
    found = materialize(few_files(found, pairs.count()), "contaminated")
    for table in (known, held, pairs):
        discard(table)
    return found


def decontamination(docs: DataFrame, items: DataFrame, how: Tiling | None = None) -> DataFrame:
    """contaminated() for every row of docs, with `contaminated`; the other columns are null and the counts 0 where it is false."""
    hits = contaminated(docs, items, how).withColumn("contaminated", F.lit(True)).withColumnsRenamed({"doc_id": "id", "t": "h"})
    out = docs.select("doc_id", F.xxhash64("text").alias("t")).join(hits.hint("merge"), F.expr("doc_id <=> id and t = h"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", F.coalesce("contaminated", F.lit(False)).alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), zero("tiles"), zero("tiled_words"), zero("longest_tile"))


def clean_documents(docs: DataFrame, items: DataFrame, how: Tiling | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, with all columns."""
    hits = contaminated(docs, items, how).select(F.col("doc_id").alias("id"), F.col("t").alias("h")).alias("hit")
    rows = docs.alias("doc")
    return rows.join(hits.hint("merge"), F.expr("doc.doc_id <=> hit.id and xxhash64(doc.text) = hit.h"), "left_anti")
