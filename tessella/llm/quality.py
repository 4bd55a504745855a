"""A quality classifier from weak labels: heuristic labelers, expectation-maximisation and a hashed linear scorer."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tessella.llm.shared import free_name, materialize
from tessella.llm.text import words_of
from tessella.llm.weak import fit_reliabilities

LABELERS = ("signs", "letters", "capitals", "repetition", "variety", "stops")
_SIGN = re.compile(r"[%&$#*|@=<>{}\\^~_]|!!|\?\?")
#: The largest number of words that a worker remembers shapes of.
MEMO_SHAPES = 300_000
_RUN = re.compile(r"(.)\1+")
#: Characters of a piece: longer words count as their consecutive pieces, so that all of a text has a part in its score.
PIECE = 40


@dataclass(frozen=True)
class Quality:
    """sample: documents, of the least hashes, on which the scorer is trained; all documents count in the labelers' reliabilities.

    span: words of a text among which variety is measured at a time: the mean over a text's spans is that of all its words.
    """

    sample: int = 8000
    log2_features: int = 12  # 17 at most
    rounds: int = 60
    steps: int = 400
    least: float = 0.5
    span: int = 2000


class _Classes(dict):
    """A for upper-case letters, a for others, 0 for digits, and other signs themselves: a table for str.translate()."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return value


_CLASSES = _Classes()


def _flags(text: str) -> int:
    return bool(_SIGN.search(text)) | (len(text) > 1 and text.isupper()) << 1 | (text[-1] in ".,;:!?") << 2


def _pieces(word: bytes) -> list[bytes]:
    if len(word) <= PIECE:
        return [word]
    text = word.decode("utf-8", "replace")
    return [text[at : at + PIECE].encode() for at in range(0, len(text), PIECE)]


class _Shapes(dict):
    """The hashed shape of a word of PIECE characters at most (letters' case, digits and signs, runs as one), with bits for a sign, capitals and a stop at its end, its length and its letters and digits."""

    def __init__(self, log2_features: int):
        super().__init__()
        self.mask = (1 << log2_features) - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_SHAPES:
            self.clear()
        text = word.decode("utf-8", "replace")
        kinds = text.translate(_CLASSES)
        shape = _RUN.sub(r"\1", kinds)
        value = (xxhash.xxh3_64_intdigest(shape.encode()) & self.mask) << 3
        value |= _flags(text)
        value |= len(text) << 20 | (kinds.count("a") + kinds.count("A") + kinds.count("0")) << 32
        self[word] = value
        return value


def _vote(share: float, good: float, bad: float) -> int:
    """1 up to the share `good`, -1 from the share `bad`, and no vote between."""
    return 1 if share <= good else -1 if share >= bad else 0


class Reader:
    """Votes and hashed features of texts."""

    def __init__(self, how: Quality):
        self.shapes, self.size, self.span = _Shapes(how.log2_features), 1 << how.log2_features, how.span

    def variety(self, words: list[bytes]) -> float:
        """The share of distinct words, a mean over even spans of about `span` words."""
        n = len(words)
        spans = max(1, round(n / self.span))
        cuts = [n * i // spans for i in range(spans + 1)]
        return sum(len(set(words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)) / n

    def read(self, text: str | None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray] | None:
        """The labelers' votes, and indices and counts of the features; None for a text without words."""
        words = words_of(text)
        if not words:
            return None
        n = len(words)
        long = max(map(len, words)) > PIECE
        parts = [part for word in words for part in _pieces(word)] if long else words
        codes = np.fromiter(map(self.shapes.__getitem__, parts), np.int64, len(parts))
        flags = np.fromiter((self.shapes[w] & 7 if len(w) <= PIECE else _flags(w.decode("utf-8", "replace")) for w in words), np.int64, n) if long else codes
        signs, capitals, stops = ((flags >> bit & 1).sum() / n for bit in range(3))
        letters = (codes >> 32).sum() / (codes >> 20 & 4095).sum()
        same = np.fromiter(map(operator.eq, words[1:], words), np.int64, n - 1)
        repetition, variety = same.sum() / n, self.variety(words)
        few = n < 8
        votes = (
            _vote(signs, 0.02, 0.1),
            0 if few else 1 if letters >= 0.93 else -1 if letters < 0.9 else 0,
            _vote(capitals, 0.2, 0.5),
            _vote(repetition, 0.05, 0.15),
            0 if few else 1 if variety >= 0.35 else -1 if variety < 0.2 else 0,
            0 if few else 1 if 0.03 <= stops <= 0.4 else -1 if stops < 0.01 or stops > 0.7 else 0,
        )
        if long:
            same = np.fromiter(map(operator.eq, parts[1:], parts), np.int64, len(parts) - 1)
        shape = codes >> 3 & (self.size - 1)
        pair = (shape[1:] * 31 + shape[:-1] * 17 + same * 7 + 1) & (self.size - 1)
        counts = np.bincount(np.concatenate([shape, pair]), minlength=self.size)
        at = np.flatnonzero(counts)
        return votes, at, counts[at]


@dataclass(frozen=True)
class Scorer:
    """posterior: of each vote pattern; weights and bias: of the linear scorer over the square roots of the features' shares."""

    posterior: dict[tuple[int, ...], float]
    weights: np.ndarray
    bias: float

    def score(self, at: Column, counts: Column) -> Column:
        weights = F.split(F.lit(",".join(map(repr, self.weights.tolist()))), ",").cast("array<double>")
        products = F.zip_with(at, counts, lambda i, n: F.element_at(weights, i + 1) * F.sqrt(n.cast("double")))
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, n: acc + n).cast("double")
        logit = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) / F.sqrt(total) + self.bias
        return F.when(at.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit)))))

    def likely(self, marks: Column) -> Column:
        """The posterior of votes written as +, 0 and -."""
        if not self.posterior:
            return F.lit(None).cast("double")
        keys, values = (",".join(x) for x in zip(*((_marks(k), repr(float(p))) for k, p in self.posterior.items()), strict=True))
        return F.element_at(F.map_from_arrays(F.split(F.lit(keys), ","), F.split(F.lit(values), ",").cast("array<double>")), marks)


def _marks(votes) -> str:
    return "".join("-0+"[v + 1] for v in votes)


@dataclass(frozen=True)
class Names:
    """Columns that read_documents() adds, with names that docs does not have."""

    votes: str
    at: str
    counts: str


def read_documents(docs: DataFrame, how: Quality, *drop: str) -> tuple[DataFrame, Names]:
    """docs(text, ...), written without the columns `drop`, with the votes (+, 0, -) and features of each text, null without words: each text is read once."""
    names = Names(*(free_name(docs, c) for c in ("votes", "at", "counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(how)
        for batch in batches:
            read = [reader.read(text) or (None, None, None) for text in batch.column("text").to_pylist()]
            votes = pa.array([x[0] and _marks(x[0]) for x in read], pa.string())
            at, counts = (pa.array([x[i] for x in read], pa.list_(pa.int32())) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, votes, at, counts], names=[*batch.schema.names, names.votes, names.at, names.counts])

    more = DataType.fromDDL(f"`{names.votes}` string, `{names.at}` array<int>, `{names.counts}` array<int>")
    schema = StructType([*docs.schema.fields, *more.fields])
    return materialize(docs.mapInArrow(run, schema).drop(*drop), "read"), names


def fit(read: DataFrame, names: Names, how: Quality) -> Scorer:
    """Estimate the labelers' reliabilities over all rows of read_documents(), and train the scorer on the posteriors of a sample.

    Of vote patterns, 3 ** 6 rows at most come to the driver; of features, `how.sample` rows of the least hashes.
    """
    read = read.select("doc_id", *(F.col(c).alias(n) for c, n in ((names.votes, "votes"), (names.at, "at"), (names.counts, "counts")))).where("votes is not null")
    read = read.withColumn("h", F.xxhash64("doc_id", "at", "counts"))
    rows = read.groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not rows:
        return Scorer({}, np.zeros(1 << how.log2_features), 0.0)
    counts = {tuple("-0+".index(v) - 1 for v in r["votes"]): r["n"] for r in sorted(rows, key=lambda r: r["votes"])}
    doubt = [0.2 if min(votes) < 0 else 0.9 for votes in counts]  # any vote against speaks against a document at first
    post, _ = fit_reliabilities([("document", votes, n) for votes, n in counts.items()], how.rounds, doubt, silent=True)
    posterior = dict(zip(counts, post, strict=True))

    last = read.select("h").orderBy("h").limit(how.sample).agg(F.max("h")).first()[0]
    rows = read.where(F.col("h") <= last).orderBy("h").limit(how.sample).select("votes", "at", "counts").collect()
    rows = [(tuple("-0+".index(v) - 1 for v in r["votes"]), np.array(r["at"], np.int64), np.array(r["counts"])) for r in rows]
    p = np.array([posterior[votes] for votes, _, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(at) for _, at, _ in rows])
    at = np.concatenate([x for _, x, _ in rows])
    share = np.concatenate([np.sqrt(x / x.sum()) for _, _, x in rows])
    order = np.lexsort((share, at, p[row]))  # the same sums whatever the order of the rows
    row, at, share = row[order], at[order], share[order]
    # The bias is the last weight; gradient descent with momentum.
    row = np.concatenate([row, np.arange(len(rows))])
    at, share = np.concatenate([at, np.full(len(rows), 1 << how.log2_features)]), np.concatenate([share, np.ones(len(rows))])
    weights = np.zeros((1 << how.log2_features) + 1)
    pace = np.zeros(len(weights))
    for _ in range(how.steps):
        error = (1 / (1 + np.exp(-np.clip(np.bincount(row, share * weights[at], len(p)), -40, 40))) - p) / len(p)
        pace = 0.9 * pace - 3.0 * (np.bincount(at, share * error[row], len(weights)) + 1e-6 * weights)
        weights += pace
    weights, bias = weights[:-1], float(weights[-1])
    return Scorer(posterior, weights, bias)


def quality_scores(docs: DataFrame, how: Quality | None = None) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every document of docs(doc_id, text).

    Six overlapping labelers vote on whole texts: shares of words with signs, of letters and digits, of words in capitals and of
    words that repeat the one before, variety, and share of words that end in a stop. Expectation-maximisation over all documents
    estimates how reliable each is; the posteriors label a bounded sample, on which a linear scorer over hashed word
    shapes and pairs of them is trained; it scores all. Words of more than PIECE characters are scored by all their pieces. kept: the score is `how.least` or more. votes has +, 0 or -
    of each labeler. Texts are read once: a table of the shared folder keeps their votes and features.

    Null, empty and wordless texts have null votes and posterior and the score 0, and are rejected. Rows are judged by themselves,
    so repeated rows and ids give equal values, and null ids stay null; an empty table gives an empty result; other
    columns are ignored.
    """
    how = how or Quality()
    read, names = read_documents(docs.select("doc_id", "text"), how, "text")
    scorer = fit(read, names, how)
    score = F.coalesce(scorer.score(F.col(names.at), F.col(names.counts)), F.lit(0.0))
    return read.select("doc_id", names.votes, F.round(scorer.likely(F.col(names.votes)), 6).alias("posterior"), F.round(score, 6).alias("score"), (F.col(names.votes).isNotNull() & (score >= how.least)).alias("kept"))


def good_documents(docs: DataFrame, how: Quality | None = None) -> DataFrame:
    """The rows of docs whose text quality_scores() keeps, with all columns. Each row is judged by itself."""
    how = how or Quality()
    read, names = read_documents(docs, how)
    score = fit(read, names, how).score(F.col(names.at), F.col(names.counts))
    return read.where(F.col(names.votes).isNotNull() & (score >= how.least)).select(*docs.columns)
