"""Mixing of sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.shared import free_name, materialize, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Signs that are scarce in prose; their share lowers a document's quality weight.
SCARCE_SIGNS = "0123456789%&$#*|@=<>{}[]()!~^_+/\\"


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code point order, null last, repeating. cap: times a source's size that its target may reach."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    seed: int = 42
    #: Documents that one bin of sampling keys holds about.
    bin_rows: int = 5_000
    #: The least number of bins of a source.
    least_bins: int = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1, less for a larger share of signs that are scarce in prose; 0.25 for a null or empty text."""
    plain = F.length(F.translate(text, SCARCE_SIGNS, "")) / F.length(text)
    return F.lit(0.25) + F.lit(0.75) * F.when(F.length(text) > 0, plain).otherwise(F.lit(0.0))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """An exponential variable of the rate `weight`: the documents of the least keys are a weighted sample. A null id is drawn by its text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.xxhash64(text).cast("string")))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / weight


#: Rates between which the quality weights are; key_bin() divides their exponential distributions.
RATES = (0.25, 0.5, 0.75, 1.0)


def key_bin(key: Column, bins: int) -> Column:
    """A number that never falls as the key grows. Whatever the weights of the documents, a bin has six times its share at most.

    It is the mean of the distribution functions of the rates in RATES, each of which has its share in all bins.
    """
    below = sum((F.lit(1.0) - F.exp(-key * rate) for rate in RATES), F.lit(0.0)) / len(RATES)
    return F.least(F.floor(below * bins), F.lit(bins - 1))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """sizes(source, source_size), a row for each source: adds `target`.

    All words are shared by weight; a source of less than the share of its weight stops at `cap` times its size, and
    the others share what is left by weight. With the sources in order of cap * size / weight, the capped ones come
    first, so that one pass of running sums finds the common share for a unit of weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    listed = F.array(*map(F.lit, mix.weights))
    ranked = ranked.withColumn("weight", F.element_at(listed, ((F.col("rank") - 1) % len(mix.weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("limit", F.col("source_size") * mix.cap).withColumn("ratio", F.col("limit").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("share", (total - before).cast("double") / left).withColumn("free", F.col("ratio") > F.col("share"))
    ahead = F.row_number().over(order)
    ranked = ranked.withColumn("ahead", ahead)
    start = F.min(F.when(F.col("free"), F.struct("ahead", "share"))).over(Window.partitionBy())
    ranked = ranked.withColumn("start", start)
    capped = F.col("start").isNull() | (F.col("ahead") < F.col("start.ahead"))
    target = F.when(capped, F.col("limit").cast("double")).otherwise(F.col("start.share") * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _taken(docs: DataFrame, mix: Mix, *keep: str) -> DataFrame:
    """mix_sources() of docs(doc_id, text, source, keep...), with the columns `keep`."""
    text = F.col("text")
    sized = docs.select("doc_id", "source", *keep, word_count(text).alias("size"), sampling_key(F.col("doc_id"), text, quality_weight(text), mix.seed).alias("key"))
    sized = materialize(sized, "sized")
    bins = max(mix.least_bins, sized.count() // mix.bin_rows)
    sized = sized.withColumn("bin", key_bin(F.col("key"), bins))
    per_bin = materialize(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    targets = source_targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), mix)
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bin.withColumn("start", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)))
    starts = starts.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).selectExpr("b.source", "b.bin", "start", "source_size", "target")
    joined = sized.alias("d").join(starts.alias("b"), F.expr("d.source <=> b.source and d.bin = b.bin"))
    joined = joined.selectExpr("d.source", "d.bin", "doc_id", *keep, "size", "key", "start", "source_size", "target")
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.greatest("source_size", F.lit(1)))).otherwise(0)
    out = joined.withColumn("ahead", ahead).withColumn("epochs", epochs).withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return out.select("doc_id", *keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document of docs(doc_id, text, source).

    A source gets as many complete epochs as its target holds; of the rest, documents are taken in order of their
    sampling keys, until the running sum of their sizes reaches the budget, the last one in part. So taken words add
    up to the target, rounded down. Running sums come from sums of key bins, of which a source has many, and from
    sums within a bin: no task holds a source.

    Null and wordless texts have the size 0 and give 0 words. A null source is a source. Ties in the key go to the
    smaller doc_id, then to the smaller size; each row counts by itself where a doc_id is repeated. A null doc_id has
    a key by its text. The same rows give the same mix. An empty table gives an empty result. Other columns are ignored.
    """
    return _taken(docs.select("doc_id", "text", "source"), mix or Mix())


def mixed_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """docs with a row for each time that the mix takes a document, and `copy` from 0; the last may hold only its first words.

    Documents of which nothing is taken go. Each row of docs counts by itself, whatever its doc_id. A column `copy` of
    docs is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != "copy"]
    docs = docs.select(*columns)
    row, many, taken = (free_name(docs, c) for c in ("row", "words", "taken"))
    rows = numbered(docs, row, "rows")
    found = _taken(rows.select("doc_id", "text", "source", F.col(row).alias("row")), mix or Mix(), "row").where("taken > 0")
    out = rows.join(found.select(F.col("row").alias(row), F.col("size").alias(many), F.col("taken").alias(taken)), row)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col(taken) / F.col(many)) - 1).cast("int"))))
    left = F.col(taken) - F.col("copy") * F.col(many)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    out = out.withColumn("text", F.when(left < F.col(many), first).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns, "copy")
