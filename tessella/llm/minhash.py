"""MinHash near-duplicate detection with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.shared import discard, free_name, join_by_class, map_frames, materialize, numbered, release, type_of
from tessella.llm.text import WordHashes, mix, sequence_digest

#: Multipliers of the five words of a shingle.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class Banding:
    """Two collections of `halves` half keys, each of `rows` minhashes; every pair of half keys is a table.

    2 * halves * rows minhashes give halves ** 2 tables of 2 * rows minhashes each. A pair of similarity s is missed
    with a probability of about 2 * (1 - s ** rows) ** halves: 4e-5 at 0.75, 1e-6 at 0.8.
    """

    halves: int = 20
    rows: int = 3
    words: int = 5
    percent: int = 75
    #: Of all 2 * halves * rows minhashes, in one byte each, so many must agree before texts are compared. A pair at
    #: 0.75 agrees in 90 +- 4.7 of 120, so that 68 loses some three in a million, fewer than the tables do.
    least_agreeing: int = 68
    #: Heads of buckets, and neighbours within buckets, that a document is compared with first: those of most of its
    #: buckets. They only save comparisons; what they leave out is compared afterwards.
    heads: int = 4
    neighbours: int = 8
    #: Documents, and bytes of their sets, on either side of a block in which documents of several components are compared.
    block: int = 2048
    block_bytes: int = 64_000_000


def shingle_set(text: str | None, hashes: WordHashes, words: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct word shingles of a text, A-Z lower-cased.

    A text of fewer words is one shingle, its whole sequence; a null text or one without words has none.
    """
    got = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not got:
        return np.zeros(0, np.uint64)
    a = hashes.of(got)
    if len(a) < words:
        return mix(np.array([np.uint64(sequence_digest(a)[0] & (2**64 - 1))], np.uint64))
    n = len(a) - words + 1
    total = a[:n] * _ODD[0]
    for i in range(1, words):
        total = total + mix(a[i : n + i] ^ _ODD[i % 5]) * _ODD[i % 5]
    return np.unique(mix(total))


def sketches(docs: DataFrame, banding: Banding) -> DataFrame:
    """(doc_id, t, n_shingles, d1, d2, halves, sketch): a hash of the text, size and digest of its set, its half keys and one byte of each minhash."""
    k, rows, words = 2 * banding.halves * banding.rows, banding.rows, banding.words
    rng = np.random.default_rng(20240501)
    salts = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)[:, None]
    odds = (rng.integers(0, 2**31, k, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
    which = rng.integers(0, 2**63, 2 * banding.halves, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                got = shingle_set(text, hashes, words)
                if not len(got):
                    out.append((0, 0, 0, [], b""))
                    continue
                small = (got >> np.uint64(32)).astype(np.uint32)
                low = np.full(k, 2**32 - 1, np.uint32)
                for at in range(0, len(small), 2048):
                    np.minimum(low, ((small[None, at : at + 2048] ^ salts) * odds).min(axis=1), out=low)
                wide = mix(low.astype(np.uint64))
                key = which
                for part in wide.reshape(-1, rows).T:
                    key = mix(key + part)
                d1, d2 = sequence_digest(got)
                out.append((len(got), d1, d2, key.view(np.int64), (wide & np.uint64(255)).astype(np.uint8).tobytes()))
            made = pd.DataFrame(out, columns=["n_shingles", "d1", "d2", "halves", "sketch"], index=pdf.index)
            yield pd.concat([pdf[["doc_id", "t"]], made], axis=1)

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return map_frames(texts, run, f"doc_id {type_of(docs, 'doc_id')}, t long, n_shingles long, d1 long, d2 long, halves array<long>, sketch binary")


def classes_of(sketched: DataFrame) -> DataFrame:
    """(node, n_shingles, d1, d2, n, doc_id, t, halves, sketch): a node for each distinct set, its documents' number, and the least of them."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    made = sketched.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(first, F.count("*").alias("n"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
    return materialize(made.select(F.monotonically_increasing_id().alias("node"), "n_shingles", "d1", "d2", "n", "first.doc_id", "first.t", "halves", "sketch"), "classes")


def tensored_tables(nodes: DataFrame, banding: Banding) -> DataFrame:
    """(node, n_shingles, sketch, first, second): per node the half keys of either collection that another node shares.

    A table's key needs both its halves to be shared, so that half keys which one node alone has are dropped before the
    halves ** 2 combinations are formed. Half keys that very many nodes share make skewed partitions, which Spark's
    adaptive execution splits in a merge join.
    """
    half = nodes.select("node", F.posexplode("halves").alias("i", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    kept = half.join(shared.hint("merge"), "half")
    side = lambda first: F.collect_list(F.when((F.col("i") < banding.halves) == F.lit(first), F.col("half")))
    both = kept.groupBy("node").agg(side(True).alias("first"), side(False).alias("second"))
    return materialize(both.where("size(first) > 0 and size(second) > 0").join(nodes.select("node", "n_shingles", "sketch"), "node"), "half-keys")


def _keys(tables: DataFrame, *columns: str) -> DataFrame:
    """(key, half, columns...): a row for each bucket that a row of tables is in, with the bucket's half key of the first collection."""
    one = tables.select(*columns, "second", F.explode("first").alias("half")).select(*columns, "half", F.explode("second").alias("_b"))
    return one.select(F.xxhash64("half", "_b").alias("key"), "half", *columns)


def bucket_pairs(tables: DataFrame, banding: Banding) -> DataFrame:
    """(a, b, near, n): b with the least node of a bucket (near 0) or with one of the two before it (near 1), in n buckets.

    A bucket's rows are sorted by eight more bytes of the sketch, at a place that depends on the key, so that those next
    to each other are the most alike. Rows are dealt out by ranges of key and bytes: a large bucket is spread over many
    tasks, and each of its parts, a batch at least, has a head of its own. Every row gives three pairs at most.
    """
    k = 2 * banding.halves * banding.rows
    rows = _keys(tables, "node", "sketch").select("key", F.expr(f"substring(sketch, cast(pmod(key, {k - 8}) as int) + 1, 8)").alias("more"), "node")
    rows = rows.repartitionByRange("key", "more").sortWithinPartitions("key", "more", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_doc, last_head = None, 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            key, doc = pdf["key"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            heads = np.minimum.reduceat(doc, starts)
            before = np.concatenate([[last_doc], doc[:-1]])
            first = np.zeros(len(key), bool)
            first[starts] = True
            if key[0] == last_key:
                heads[0], first[0] = min(heads[0], last_head), False
            head = np.repeat(heads, np.diff(np.append(starts, len(key))))
            last_key, last_doc, last_head = key[-1], doc[-1], head[-1]
            far, near = head != doc, ~first & (before != head) & (doc != head)
            two = near[1:] & near[:-1]  # and the one before that
            yield pd.DataFrame({"a": np.concatenate([head[far], before[near], before[:-1][two]]), "b": np.concatenate([doc[far], doc[near], doc[1:][two]]), "near": np.repeat([0, 1], [far.sum(), near.sum() + two.sum()])})

    return rows.select("key", "node").mapInPandas(run, "a long, b long, near int").groupBy("b", "a", "near").agg(F.count("*").alias("n"))


def _agreeing(pairs: DataFrame, nodes: DataFrame, banding: Banding) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow the similarity, with the number of agreeing bytes."""
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * banding.percent)
    least, k = banding.least_agreeing, 2 * banding.halves * banding.rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sa, sb = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, k) for c in ("sa", "sb"))
                agree = (sa == sb).sum(axis=1)
                yield pdf[["a", "b"]].assign(agree=agree)[agree >= least]

    return joined.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long, agree long")


def _linked(pairs: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """Of pairs (a, b), those whose full sets have a Jaccard similarity of the least percentage."""
    words, percent = banding.words, banding.percent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, held = WordHashes(), None, None
        for pdf in batches:
            keep = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"], strict=True):
                if a != last:
                    last, held = a, shingle_set(ta, hashes, words)
                other = shingle_set(tb, hashes, words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pdf[["a", "b"]][keep]

    pairs = pairs.hint("merge")  # their number grows with the input, so they are never broadcast
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    joined = joined.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _components_of(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").select(*pairs.columns, F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text): the text, of texts(doc_id, text, t), of the least document of each node of wanted(node)."""
    wanted = nodes.select("node", F.col("doc_id").alias("id"), F.col("t").alias("h")).join(wanted.hint("merge"), "node", "left_semi")
    return texts.join(wanted.hint("merge"), F.expr("doc_id <=> id and t = h")).select("node", "text").dropDuplicates(["node"])


def _with_components(tables: DataFrame, labels: DataFrame) -> DataFrame:
    return tables.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _blocks(rows: DataFrame, about: DataFrame, banding: Banding) -> DataFrame:
    """rows(node, half, component) with about(node, n_shingles, sketch, own, ...), dealt out in blocks (half, i, j) of two sides.

    Side 0 has nodes outside the half key's largest component, side 1 all of its nodes; a block has some `block` nodes
    or `block_bytes` bytes of sets of either side, and each node of side 0 meets each of side 1 in one block.
    """
    sized = rows.join(about.select("node", "n_shingles"), "node")
    sizes = sized.groupBy("half", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")).groupBy("half")
    sizes = sizes.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("n", "m", "component")).alias("most"))
    many = lambda n, m: F.greatest(F.ceil(n / F.lit(banding.block)), F.ceil(m * 8 / F.lit(banding.block_bytes)))
    sizes = sizes.select("half", "n", F.col("most.component").alias("major"), many(F.col("n"), F.col("m")).alias("n_all"), many(F.col("n") - F.col("most.n"), F.col("m") - F.col("most.m")).alias("n_minor"))
    sizes = materialize(sizes.where("n_minor > 0"), "sizes")
    rows = join_by_class(rows, sizes, ["half"], rows.count(), "inner")
    rows = rows.select("half", "node", "component", "n_all", "n_minor", (F.col("component") != F.col("major")).alias("outside"))
    place = lambda n: F.expr(f"pmod(xxhash64(node, 7), {n})")
    left = rows.where("outside").withColumn("i", place("n_minor")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)))
    right = rows.withColumn("j", place("n_all")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_minor") - 1)))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    both = both.select("half", "i", "j", "side", "node", "component", "outside").join(about, "node")
    return both.repartition("half", "i", "j").sortWithinPartitions("half", "i", "j", "side")


def _by_block(dealt: DataFrame, compare, schema: str) -> DataFrame:
    """compare(block) -> frame for every block of _blocks()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last block, which the next batch may go on with
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            at = pdf[["half", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                yield compare(pdf.iloc[start:end])
            rest = pdf.iloc[starts[-1] :]
        if rest is not None:
            yield compare(rest)

    return dealt.mapInPandas(run, schema)


class _Block:
    """The two sides of a block, and which nodes of side 1 a node of side 0 may be linked with."""

    def __init__(self, rows: pd.DataFrame, banding: Banding):
        self.least, self.percent, k = banding.least_agreeing, banding.percent, 2 * banding.halves * banding.rows
        self.node, self.component, self.size = (rows[c].to_numpy(np.int64) for c in ("node", "component", "n_shingles"))
        self.outside, self.half = rows["outside"].to_numpy(bool), rows["half"].iloc[0]
        self.middle = int(np.searchsorted(rows["side"].to_numpy(), 1))
        self.sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, k)
        self.own = np.full((len(rows), banding.halves), np.iinfo(np.int64).max, np.int64)
        for x, got in enumerate(rows["own"]):
            self.own[x, : len(got)] = got

    def partners(self, x: int) -> np.ndarray:
        """Rows of side 1 of other components than row x that share this as the least half key and whose sizes and sketches allow the similarity, the most agreeing first."""
        d, c, o, n = (v[self.middle :] for v in (self.node, self.component, self.outside, self.size))
        small, large = np.minimum(n, self.size[x]), np.maximum(n, self.size[x])
        at = np.flatnonzero((c != self.component[x]) & (~o | (d > self.node[x])) & (small * 100 >= large * self.percent)) + self.middle
        agree = (self.sketch[at] == self.sketch[x]).sum(axis=1)
        at, agree = at[agree >= self.least], agree[agree >= self.least]
        theirs = self.own[at]
        here = np.where(np.isin(theirs, self.own[x]), theirs, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == self.half
        return at[here][np.argsort(-agree[here], kind="stable")]


def links_across(tables: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, banding: Banding) -> DataFrame:
    """(a, b): links that join all components of labels(node, component) which any pair of a common bucket links.

    Buckets that hold several components are found first. Their nodes then meet by the buckets' half keys of the first
    collection, of which a node has `halves` at most and which hold all of those buckets' pairs; of half keys with the
    same nodes, one is kept. There, nodes outside the largest component are compared with all of the group, in blocks
    that are groups of their own, so that no task holds a large one, and a pair counts at the least half key that it
    shares. A first round finds by sketches which nodes have a partner left at which half key. A second one has the
    sets of these: each pair of a block that the sketches allow is confirmed on the full sets, unless links of the same
    block have already joined its components; so a block has fewer links than nodes, and no pairs leave it. A group of
    n nodes, m of them outside, costs n * m comparisons of sketches.
    """
    held = _with_components(tables, labels)
    several = _keys(held, "component").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    mixed = materialize(_keys(tables, "node").join(several.hint("merge"), "key").select("node", "half").distinct(), "mixed")
    sizes = mixed.groupBy("half").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("r1"), F.expr("bit_xor(xxhash64(node, 1))").alias("r2"))
    chosen = materialize(sizes.groupBy("size", "r1", "r2").agg(F.min("half").alias("half")).select("half", F.col("size").alias("n")), "chosen")
    rows = join_by_class(mixed, chosen, ["half"], mixed.count(), "inner")
    rows = materialize(_with_components(rows, labels), "rows")
    own = rows.groupBy("node").agg(F.collect_list("half").alias("own"))
    about = materialize(own.join(tables.select("node", "n_shingles", "sketch"), "node"), "about")
    columns = ["half", "i", "j", "side", "node", "component", "outside", "n_shingles", "sketch", "own"]

    def with_partners(rows: pd.DataFrame) -> pd.DataFrame:
        block, seen = _Block(rows, banding), [np.zeros(0, np.int64)]
        for x in range(block.middle):
            if len(got := block.partners(x)):
                seen += [block.node[got], block.node[x : x + 1]]
        found = np.unique(np.concatenate(seen))
        return pd.DataFrame({"node": found, "half": np.full(len(found), block.half, np.int64)})

    left = _by_block(_blocks(rows, about, banding).select(*columns), with_partners, "node long, half long").distinct()
    left = materialize(_with_components(left, labels), "left")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    sets = _sets_of(left.select("node").distinct(), nodes, texts, banding)

    def confirmed(rows: pd.DataFrame) -> pd.DataFrame:
        block, out, joined = _Block(rows, banding), [], {}
        shingles = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]

        def root(c: int) -> int:
            while (up := joined.get(c, c)) != c:
                joined[c] = c = joined.get(up, up)
            return c

        for x in range(block.middle):
            for y in block.partners(x).tolist():
                c, d = root(int(block.component[x])), root(int(block.component[y]))
                if c != d:
                    small, large = sorted((shingles[x], shingles[y]), key=len)
                    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * both >= banding.percent * (len(small) + len(large) - both):
                        joined[c] = d
                        out.append((block.node[x], block.node[y]))
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    dealt = _blocks(left, about.join(sets, "node"), banding).select(*columns, "shingles")
    found = materialize(_by_block(dealt, confirmed, "a long, b long"), "links")
    for table in (mixed, chosen, rows, about, left, sets):
        discard(table)
    return found


def _sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, banding: Banding) -> DataFrame:
    """(node, shingles): the full set of each wanted node, sorted 64-bit hashes one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            yield pdf[["node"]].assign(shingles=[shingle_set(text, hashes, banding.words).tobytes() for text in pdf["text"]])

    return materialize(_texts_of(wanted, nodes, texts).mapInPandas(run, "node long, shingles binary"), "sets")


def near_duplicates(docs: DataFrame, banding: Banding | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document of docs(doc_id, text).

    Documents whose sets of word shingles are equal form a node. Each node gets minhashes in two small collections; a
    table's key is a half key of the one with a half key of the other. In its buckets, a node is paired with the heads
    and with the neighbours in an order by further minhashes; those of most of its buckets are candidates. They pass a
    filter on one byte of each minhash and are then confirmed on the full sets: first each node's most agreeing one,
    then the others that are still in another component. That costs a bounded number of comparisons for each node and
    leaves few buckets with several components; in those, all pairs of different components follow, block by block, so
    that no link of a pair that shares a bucket is left out.

    Null, empty and wordless texts have the size 0, are linked with nothing and stay. Each row is a document: rows that
    share a doc_id are judged by their own texts. A null doc_id is linked like others, but a component is named by
    its least id that is not null, and is null where it has none. An empty table gives an empty result. Other columns
    of docs are ignored.
    """
    banding = banding or Banding()
    spark = docs.sparkSession
    sketched = materialize(sketches(docs, banding), "sketches")
    nodes = classes_of(sketched)
    tables = tensored_tables(nodes, banding)
    release(spark)
    ranked = bucket_pairs(tables, banding).withColumn("place", F.expr("row_number() over (partition by b, near order by n desc, a)"))
    chosen = ranked.where(F.col("place") <= F.when(F.col("near") == 0, banding.heads).otherwise(banding.neighbours))
    first = materialize(chosen.select("a", "b").distinct(), "pairs")
    release(spark)

    likely = _agreeing(first, nodes, banding).withColumn("place", F.expr("row_number() over (partition by b order by agree desc, a)"))
    pairs = materialize(likely.select("a", "b", "place"), "likely")
    discard(first)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = materialize(_texts_of(ends, nodes, docs.select("doc_id", "text", F.xxhash64("text").alias("t"))), "texts")
    best = materialize(_linked(pairs.where("place = 1").select("a", "b"), texts, banding), "links")
    rest = _components_of(pairs.where("place > 1").select("a", "b"), connected_components(best)).where("ca <> cb").select("a", "b")
    more = materialize(_linked(rest, texts, banding), "links")
    links = best.unionByName(more)
    labels = connected_components(links)
    for table in (pairs, texts):
        discard(table)
    release(spark)

    across = links_across(tables, labels, nodes, docs, banding)
    labels = connected_components(links.unionByName(across))
    for table in (tables, best, more, across):
        discard(table)
    release(spark)

    keys = ["n_shingles", "d1", "d2"]
    named = _with_components(nodes.select("node", "doc_id", *keys, F.col("n").alias("rows")), labels)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = join_by_class(named, least, ["component"], nodes.count()).select(*keys, F.col("rows").alias("n"), "component_id")
    named = materialize(named, "named")
    discard(nodes)
    rows = sketched.select("doc_id", *keys)
    with_words = join_by_class(rows.where("n_shingles > 0"), named, keys, rows.count(), "inner").select("doc_id", "n_shingles", "component_id")
    out = with_words.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, banding: Banding | None = None) -> DataFrame:
    """The rows of docs, with all columns, without all but one of each component of near duplicates: the one of the least doc_id.

    Null ids come last, and of equal ids one is kept. Texts without words are no duplicates of each other and stay.
    """
    row, null = free_name(docs, "row"), F.col("doc_id").isNull()
    rows = numbered(docs, row, "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), banding).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, "doc_id").join(found, row)
    kept = ids.groupBy("component_id").agg(F.min(F.struct(null.alias("no_id"), "doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
