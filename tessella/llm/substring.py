"""Removal of word windows that an earlier document has, with a count-min prefilter."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import discard, join_by_class, map_frames, materialize, release, small_batches, type_of
from tessella.llm.text import WordHashes, mix, sequence_digest, window_hashes, words_of


@dataclass(frozen=True)
class Sketch:
    """A count-min sketch of `rows` rows of 2 ** log2_cells counters that stop at two, for a slice of the hashes at a time.

    A window is counted by its anchor, the least hash of the runs of `run` words in it: equal windows have equal
    anchors, so that an anchor's counters never fall short of a window's count, and neighbouring windows mostly share
    one: a document has some 2 / (window - run + 2) of them a word. Of a slice's sketch only the cells that reach two are
    sent out, a bit for each cell: rows * 2 ** log2_cells / 8 bytes at most, whatever the input. There are so many slices
    that each has about `load` anchors.
    """

    rows: int = 2
    log2_cells: int = 29
    log2_block: int = 21
    run: int = 20
    load: int = 2**28
    #: Anchors that a task gathers before it sends them on.
    flush: int = 1_500_000
    #: Tasks whose counters meet in one merger.
    fan_in: int = 64


_SALTS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03], np.uint64)


def _cells(hashes: np.ndarray, row: int, sketch: Sketch) -> np.ndarray:
    return mix(hashes ^ _SALTS[row]) >> np.uint64(64 - sketch.log2_cells)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as the gaps between them, a byte each; 255 stands for 255 more."""
    gaps = np.diff(cells, prepend=np.uint64(0)).astype(np.int64)
    ends = np.cumsum(gaps // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    return out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    got = np.frombuffer(data, np.uint8)
    return np.cumsum(got, dtype=np.int64)[got != 255]


def anchors(own: np.ndarray, window: int, run: int) -> np.ndarray:
    """Of each window of a sequence of word hashes, the least hash of the runs of `run` words in it."""
    low = window_hashes(own, run)
    left, step = window - run, 1  # each low[i] is the least of `step` runs; it has to be of left + 1
    if len(low) <= left:
        return low[:0]
    while 2 * step <= left + 1:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    more = left + 1 - step
    return np.minimum(low[: len(low) - more], low[more:]) if more else low


def read_documents(docs: DataFrame, window: int, sketch: Sketch, slices: int) -> DataFrame:
    """(slice, doc_id, t, n_words, d1, d2, sha, starts, ends, hashes) of each document and slice of its anchors.

    t is a hash of the text; d1 and d2 are a digest of the words, sha is the SHA-256 of these joined; starts and ends
    are of the windows from first to last that share an anchor. Slice 0 has a row for every document.
    """
    run_words = min(sketch.run, window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out, ids = [], []
            for doc_id, t, text in zip(pdf["doc_id"], pdf["t"], pdf["text"], strict=True):
                words = words_of(text)
                own = hashes.of(words)
                low = anchors(own, window, run_words)
                starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
                ends = np.append(starts[1:] - 1, len(low) - 1)[: len(starts)]
                low = low[starts]
                part = (mix(low ^ _SALTS[2]) % np.uint64(slices)).astype(np.int64) if slices > 1 else np.zeros(len(low), np.int64)
                info = (len(words), *sequence_digest(own), hashlib.sha256(b" ".join(words)).hexdigest())
                for x in sorted({0, *part.tolist()}):
                    at = part == x
                    ids.append((doc_id, t))
                    out.append((x, *(info if not x else (None, None, None, None)), starts[at].astype(np.int32), ends[at].astype(np.int32), low[at].view(np.int64)))
            made = pd.DataFrame(out, columns=["slice", "n_words", "d1", "d2", "sha", "starts", "ends", "hashes"], dtype=object)
            made.insert(1, "doc_id", [x[0] for x in ids])
            made.insert(2, "t", [x[1] for x in ids])
            yield made

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return map_frames(texts, run, f"slice int, doc_id {type_of(docs, 'doc_id')}, t long, n_words long, d1 long, d2 long, sha string, starts array<int>, ends array<int>, hashes array<long>")


def anchor_counts(seen: DataFrame, sketch: Sketch) -> DataFrame:
    """(row, block, salt, once, twice) of each task: cells of one anchor, and cells of two or more, in its documents."""
    blocks, inside = 1 << (sketch.log2_cells - sketch.log2_block), np.uint64((1 << sketch.log2_block) - 1)

    def send(held: list[np.ndarray], salt: int) -> Iterator[pd.DataFrame]:
        hashes = np.concatenate(held)
        for row in range(sketch.rows):
            cells, counts = np.unique(_cells(hashes, row, sketch), return_counts=True)
            cuts = np.searchsorted(cells >> np.uint64(sketch.log2_block), np.arange(blocks + 1, dtype=np.uint64))
            out = []
            for block in range(blocks):
                part = slice(cuts[block], cuts[block + 1])
                if cuts[block] < cuts[block + 1]:
                    own, many = cells[part] & inside, counts[part] > 1
                    out.append((row, block, salt, _pack(own[~many]), _pack(own[many])))
            yield pd.DataFrame(out, columns=["row", "block", "salt", "once", "twice"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() // sketch.fan_in
        held, n = [], 0
        for pdf in batches:
            for got in pdf["hashes"]:
                held.append(np.unique(got.astype(np.int64).view(np.uint64)))
                n += len(got)
                if n >= sketch.flush:
                    yield from send(held, salt)
                    held, n = [], 0
        if n:
            yield from send(held, salt)

    return seen.select("hashes").mapInPandas(run, "row int, block int, salt int, once binary, twice binary")


def merged_counts(counts: DataFrame, sketch: Sketch, keys: list[str]) -> DataFrame:
    """Add up counters by keys, in rows that arrive in order: a task holds the counters of one block at a time."""
    size = 1 << sketch.log2_block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cells = None, np.zeros(size, np.uint8)

        def done() -> pd.DataFrame:
            once, twice = (np.flatnonzero(x).astype(np.uint64) for x in (cells == 1, cells == 2))
            return pd.DataFrame([(*at, _pack(once), _pack(twice))], columns=["row", "block", "salt", "once", "twice"])

        for pdf in batches:
            for row, block, salt, once, twice in pdf.itertuples(index=False):
                if (key := (row, block, salt)) != at:
                    if at is not None:
                        yield done()
                    at = key
                    cells[:] = 0
                own = _unpack(once)
                cells[own] = np.minimum(cells[own] + 1, 2)
                cells[_unpack(twice)] = 2
        if at is not None:
            yield done()

    if "salt" not in keys:
        counts = counts.withColumn("salt", F.lit(0))
    dealt = counts.repartition(*keys).sortWithinPartitions("row", "block", "salt")
    return dealt.mapInPandas(run, "row int, block int, salt int, once binary, twice binary")


def repeated_cells(seen: DataFrame, sketch: Sketch) -> bytes:
    """The bits of the cells that two documents or more may share, row after row, compressed."""
    counts = anchor_counts(seen, sketch)
    tasks = seen.rdd.getNumPartitions()
    if tasks > sketch.fan_in:
        counts = merged_counts(counts, sketch, ["row", "block", "salt"])
    merged = merged_counts(counts, sketch, ["row", "block"])
    bits = np.zeros((sketch.rows, 1 << (sketch.log2_cells - 3)), np.uint8)
    each = 1 << (sketch.log2_block - 3)
    with small_batches(seen.sparkSession):
        for row, block, twice in merged.select("row", "block", "twice").toLocalIterator(prefetchPartitions=True):
            own = np.zeros(1 << sketch.log2_block, np.uint8)
            own[_unpack(bytes(twice))] = 1
            bits[row, block * each : (block + 1) * each] = np.packbits(own, bitorder="little")
    return zlib.compress(bits.tobytes(), 1)


def repeated_ranges(seen: DataFrame, sketch: Sketch) -> DataFrame:
    """(doc_id, t, starts, ends) of the windows of a slice that the sketch estimates to be repeated."""
    shared = seen.sparkSession.sparkContext.broadcast(repeated_cells(seen, sketch))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(zlib.decompress(shared.value), np.uint8).reshape(sketch.rows, -1)
        for pdf in batches:
            keep, starts, ends = [], [], []
            for x, (first, last, got) in enumerate(zip(pdf["starts"], pdf["ends"], pdf["hashes"], strict=True)):
                h, may = got.astype(np.int64).view(np.uint64), np.arange(len(got))
                for row in range(sketch.rows):
                    cells = _cells(h[may], row, sketch)
                    may = may[(bits[row][(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                if len(may):
                    keep.append(x)
                    starts.append(first[may])
                    ends.append(last[may])
            made = pdf[["doc_id", "t"]].iloc[keep].reset_index(drop=True)
            yield made.assign(starts=pd.Series(starts, dtype=object), ends=pd.Series(ends, dtype=object))

    return map_frames(seen.select("doc_id", "t", "starts", "ends", "hashes"), run, f"doc_id {type_of(seen, 'doc_id')}, t long, starts array<int>, ends array<int>")


def _windows(docs: DataFrame, ranges: DataFrame, window: int) -> DataFrame:
    """(doc_id, t, positions, h1, h2): the 96-bit hashes of the windows of ranges(doc_id, t, starts, ends), arrays of arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for text, starts, ends in zip(pdf["text"], pdf["starts"], pdf["ends"], strict=True):
                own = hashes.of(words_of(text))
                edge = np.zeros(len(own) + 2, np.int64)
                for first, last in zip(starts, ends, strict=True):
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + 1, -1)
                may = np.flatnonzero(np.cumsum(edge))
                h2 = window_hashes(mix(own ^ _SALTS[3]), window)[may] >> np.uint64(33)
                out.append((may.astype(np.int32), window_hashes(own, window)[may].view(np.int64), h2.astype(np.int32)))
            yield pd.concat([pdf[["doc_id", "t"]], pd.DataFrame(out, columns=["positions", "h1", "h2"], index=pdf.index)], axis=1)

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(ranges.hint("merge"), ["doc_id", "t"])
    return map_frames(texts, run, f"doc_id {type_of(docs, 'doc_id')}, t long, positions array<int>, h1 array<long>, h2 array<int>")


def _without(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """found(doc_id, t, starts) joined with the texts: the words that no window starting at one of them covers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, starts in zip(pdf["text"], pdf["starts"], strict=True):
                words = words_of(text)
                edge, starts = np.zeros(len(words) + 1, np.int64), np.asarray(starts)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                kept = b" ".join([words[i] for i in keep])
                out.append((len(words), len(words) - len(keep), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pd.concat([pdf[["doc_id", "t"]], pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "kept_sha256"], index=pdf.index)], axis=1)

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").join(found.hint("merge"), ["doc_id", "t"])
    return map_frames(texts, run, f"doc_id {type_of(docs, 'doc_id')}, t long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 50, sketch: Sketch | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) of every document of docs(doc_id, text).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. kept_text is null where nothing was removed (the text stands), else the kept words
    joined by one space. In a first pass every task counts its documents' windows, by their anchors, in a count-min
    sketch, and the sketches are merged block by block; the merged counters never fall short, so windows of a smaller
    count are not repeated. In a second pass the others are grouped exactly, by 96-bit hashes; windows that many
    documents share are broadcast, so that no task receives all of them. Of documents with equal words, only the first
    sends its windows: the others are covered whole.

    Null, empty and short texts have no window and lose nothing. Windows repeated within one document alone stay. Each
    row of docs is a document: rows of an equal doc_id are none of them earlier than the other and are cut by their own
    words. A null doc_id is neither earlier nor later than any. An empty table gives an empty result. Other columns of
    docs are ignored.
    """
    sketch = sketch or Sketch()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / 6 * 2 / (window - min(sketch.run, window) + 2) / sketch.load))  # a word has some six bytes
    read = read_documents(docs, window, sketch, slices)
    if slices > 1:  # a slice is read alone, from few files
        read = read.repartition("slice", F.expr("pmod(t, 64)"))
    seen = materialize(read, "anchors", *["slice"] * (slices > 1))
    home = seen.where("slice = 0")
    keys = ["d1", "d2", "n_words"]
    first = home.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = join_by_class(home.select("doc_id", "t", *keys, "sha"), first, keys, home.count(), "inner")
    later = F.coalesce((F.col("n_words") >= window) & (F.col("doc_id") > F.col("first")), F.lit(False))
    ruled = materialize(copies.select("doc_id", "t", "n_words", "sha", later.alias("whole")), "ruled")

    may = None
    for x in range(slices):
        got = materialize(repeated_ranges(seen.where(F.col("slice") == x), sketch), "ranges")
        may = got if may is None else may.unionByName(got)
    discard(seen)
    release(docs.sparkSession)
    firsts = ruled.where("not whole and doc_id is not null").select("doc_id", "t").distinct()
    may = may.join(firsts.hint("merge"), ["doc_id", "t"], "left_semi").groupBy("doc_id", "t").agg(F.collect_set(F.struct("starts", "ends")).alias("r"))
    found = materialize(_windows(docs, may.select("doc_id", "t", F.col("r.starts").alias("starts"), F.col("r.ends").alias("ends")), window).dropDuplicates(["doc_id", "t"]), "windows")
    release(docs.sparkSession)

    own = found.select("doc_id", "t", F.explode(F.arrays_zip("positions", "h1", "h2")).alias("w")).select("doc_id", "t", F.col("w.positions").alias("start"), "w.h1", "w.h2")
    owner = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("owner < last").drop("last")
    owner = materialize(owner, "owners")
    total = found.agg(F.sum(F.size("positions").cast("long"))).first()[0] or 0
    covered = join_by_class(own, owner, ["h1", "h2"], total, "inner").where("doc_id > owner").groupBy("doc_id", "t").agg(F.collect_list("start").alias("starts"))
    covered = materialize(covered, "covered")
    for table in (found, owner):
        discard(table)
    release(docs.sparkSession)
    cut = materialize(_without(docs, covered, window), "cut")
    discard(covered)
    rest = ruled.join(cut.select("doc_id", "t").distinct(), ["doc_id", "t"], "left_anti")
    empty = hashlib.sha256(b"").hexdigest()
    whole = F.col("whole")
    rest = rest.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(whole, F.lit("")).cast("string").alias("kept_text"),
        F.when(whole, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return cut.drop("t").unionByName(rest)
