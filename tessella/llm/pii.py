"""Personal data by weak supervision, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import free_name, materialize
from tessella.llm.weak import fit_reliabilities, sigmoid

#: What a text must contain, and the pattern, of each kind. All are written so that matching takes linear time and no
#: recursion: runs are possessive, a match starts at a run's first sign, and long repetitions are of single signs.
BASE = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+"),
    "ip": (".", r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"(?=[0-9])(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){12}[0-9])[0-9](?:(?![ -](?![0-9]))[0-9 -])++"),
    "phone": ("+", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Candidates that the method may add.
MORE = {
    "pan": ("", r"(?=[0-9])(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])"),
    "tel": ("", r"(?=[(0-9])(?<![0-9(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "id": ("-", r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": ("", r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{20,}+"),
}
KINDS = [*BASE, *MORE]
_DIGITS = "0123456789"

#: Regex labeler: the usual shape of each kind.
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$",
    "card": r"^(?:[0-9]{4}[ -]?){3}[0-9]{1,7}$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
    "pan": r"^(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "tel": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
    "id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"^(?:[0-9a-f]{32,64}|[A-Z0-9]{20}|(?=.{0,64}[a-z])(?=.{0,64}[A-Z])[A-Za-z0-9]{20,64})$",
}
#: Gazetteer labeler: endings or beginnings that are known for a kind, and those known not to be meant.
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-58])",
    "pan": r"^(?:4|5[1-5]|2[2-7]|6011|65|35)",
    "tel": r"555[ .-]",
    "id": r"^(?:[0-6][0-9]{2}|7[0-6][0-9])",
    "secret": r"^(?:AKIA|ASIA|ghp|xox|sk)",
}
NOT_MEANT = {"ip": r"^(?:0|127|255)\.", "email": r"\.(?:png|jpg|gif|css|js)$", "id": r"^(?:123-45-6789|078-05-1120)$"}
#: Context labeler: words in the forty signs before a span that speak for a kind, or against all.
NEAR = {
    "email": "mail|contact|write|@",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|master|credit|payment|iban",
    "phone": "phone|tel|call|mobile|fax|mail",
    "pan": "card|visa|master|credit|payment|\\+",
    "tel": "phone|tel|call|mobile|fax|mail|\\+",
    "id": "ssn|social|passport|identity",
    "secret": "token|key|secret|password|auth|credential",
}
AGAINST = "version|page|chapter|isbn|issn|figure|section"
VOTERS = ("shape", "known", "near", "edge", "sum")
#: Kinds that have no octets, digits or checksum to check: the labeler `sum` does not vote on them.
UNCHECKED = ("email", "tel", "id")
#: What the classifier sees besides the votes: classes of length and of digits, how parts are divided, and what leads up to a span.
SHAPES = ("long", "digits", "parts", "lead")


@dataclass(frozen=True)
class Supervision:
    """rounds: of expectation-maximisation and of the classifier's training; least: the probability from which a span is added."""

    rounds: int = 50
    steps: int = 400
    least: float = 0.5


def _digits(value: Column) -> Column:
    return F.translate(value, " +().-", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    digits = F.reverse(_digits(value))
    place = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substr(digits, i, F.lit(1)).cast("int").alias("d")))
    doubled = lambda p: F.when(p["i"] % 2 == 1, p["d"]).otherwise(p["d"] * 2 - F.when(p["d"] > 4, 9).otherwise(0))
    return F.aggregate(place, F.lit(0), lambda acc, p: acc + doubled(p)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The check of each kind: octets, digits, checksum."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda x: F.ltrim(x, F.lit("0")))
        return F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    if kind in ("card", "pan"):
        n = F.length(_digits(value))
        return F.when(n.between(13, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "secret":
        return (F.length(F.translate(value, _DIGITS, "")) >= 4) & (F.length(value) - F.length(F.translate(value, _DIGITS, "")) >= 2)
    return F.lit(True)


#: Elements of an array that are added up at a time: appending one by one to a long array would copy it each time.
CHUNK = 256


def running(items: Column, kind: str, step) -> Column:
    """The results of step(place before, item) -> struct(place after, result as `kind`), for items in order, from place 0.

    Items are taken in chunks, so that appending costs little however many there are.
    """
    chunks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())
    empty = F.array().cast(f"array<{kind}>")
    pair = lambda at, got: F.struct(at.cast("int").alias("at"), got.alias("got"))

    def one(acc, item):
        made = step(acc["at"], item)
        return pair(made["at"], F.concat(acc["got"], F.array(made["got"])))

    def chunk(acc, own):
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(own, pair(start, empty), one)))

    parts = F.aggregate(chunks, F.array().cast(f"array<struct<at:int,got:array<{kind}>>>"), chunk)
    return F.flatten(F.transform(parts, lambda p: p["got"]))


def _found(docs: DataFrame, kind: str, need: str, pattern: str) -> DataFrame:
    """Adds the column `kind`: start, end, value, before, after of each leftmost match, and whether it passes the kind's check.

    The starts are sums of the lengths of what split() leaves between the matches and of the matches, in code points.
    before has the last forty signs of what stands since the match before the last, after the next sign.
    """
    text = F.col("text")
    has = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    docs = docs.withColumn("m", F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    docs = docs.withColumn("g", F.when(F.size("m") > 0, F.split(text, pattern, -1)).otherwise(none))
    at = lambda name, i: F.coalesce(F.try_element_at(F.col(name), i), F.lit(""))

    def around(i):
        gap, value = at("g", i), at("m", i)
        earlier = F.when(i > 1, F.concat(at("g", F.greatest(i - 1, F.lit(1))), at("m", F.greatest(i - 1, F.lit(1))))).otherwise(F.lit(""))
        before = F.right(F.when(F.length(gap) >= 40, gap).otherwise(F.concat(earlier, gap)), F.lit(40))
        after = F.left(F.concat(F.left(at("g", i + 1), F.lit(1)), at("m", i + 1)), F.lit(1))
        return F.struct(F.length(gap).alias("gap"), value.alias("value"), before.alias("before"), after.alias("after"))

    def step(place, p):
        start = place + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["before"].alias("before"), p["after"].alias("after")).alias("got"))

    items = F.when(F.size("m") > 0, F.transform(F.sequence(F.lit(1), F.size("m")), around)).otherwise(F.array())
    spans = running(items, "struct<start:int,end:int,value:string,before:string,after:string>", step)
    full = F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["value"], s["before"], s["after"], _valid(kind, s["value"]).alias("valid")))
    return docs.withColumn(kind, F.when(F.size("m") > 0, full)).drop("m", "g")


_SPAN = "start:int,end:int,value:string,before:string,after:string,valid:boolean"


def candidates(docs: DataFrame, name: str = "cands") -> DataFrame:
    """docs(doc_id, text) with `name`: all spans of all kinds, those of the base patterns with base = valid."""
    kept = docs.columns
    whole = F.struct(*[F.col(c) for c in kept]).alias("doc")
    out = docs.select(whole, F.coalesce("text", F.lit("")).alias("text"))
    for kind, (need, pattern) in {**BASE, **MORE}.items():
        out = _found(out, kind, need, pattern)
    empty = F.array().cast(f"array<struct<{_SPAN}>>")
    fields = ("start", "end", "value", "before", "after", "valid")

    def named(kind: str) -> Column:
        base = lambda s: s["valid"] if kind in BASE else F.lit(False)
        return F.transform(F.coalesce(F.col(kind), empty), lambda s: F.struct(F.lit(kind).alias("kind"), *[s[x].alias(x) for x in fields], base(s).alias("base")))

    return out.select(*[F.col("doc").getField(c).alias(c) for c in kept], F.concat(*map(named, KINDS)).alias(name))


def _by_kind(kind: Column, make) -> Column:
    out = F.lit(None)
    for k in KINDS:
        out = F.when(kind == k, make(k)).otherwise(out)
    return out


def _votes(s: Column) -> Column:
    """1, 0 or -1 of each labeler, the length class and the digit class of a span."""
    value, near = s["value"], F.lower(s["before"])
    yes = lambda c: F.when(c, 1).otherwise(-1)
    known = lambda k: F.when(value.rlike(NOT_MEANT[k]), -1).when(value.rlike(KNOWN[k]), 1).otherwise(0) if k in NOT_MEANT else F.when(value.rlike(KNOWN[k]), 1).otherwise(0)
    edge = s["before"].rlike(r"[\p{L}\p{N}]$") | s["after"].rlike(r"^[\p{L}\p{N}]")
    digits = F.length(value) - F.length(F.translate(value, _DIGITS, ""))
    return F.struct(
        s["kind"].alias("kind"),
        _by_kind(s["kind"], lambda k: yes(value.rlike(SHAPE[k]))).alias("shape"),
        _by_kind(s["kind"], known).alias("known"),
        F.when(near.rlike(AGAINST), -1).otherwise(_by_kind(s["kind"], lambda k: F.when(near.rlike(NEAR[k]), 1).otherwise(0))).alias("near"),
        (-yes(edge)).alias("edge"),
        F.when(s["kind"].isin(*UNCHECKED), 0).otherwise(yes(s["valid"])).alias("sum"),
        F.least(F.floor(F.length(value) / 8), F.lit(5)).cast("int").alias("long"),
        F.floor(digits * 4 / F.length(value)).cast("int").alias("digits"),
        F.when(value.rlike(r"[0-9] [0-9]"), 1).when(value.rlike("[0-9]-[0-9]"), 2).when(value.rlike("[^A-Za-z0-9]"), 3).otherwise(0).alias("parts"),
        F.when(s["before"].rlike(r"[:=#] ?$"), 2).when(s["before"].rlike(r"^$|[.!?\n] ?$"), 1).otherwise(0).alias("lead"),
    )


def fit_classifier(rows: list[tuple[list[str], float, int]], steps: int, rate: float = 1.0, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model over named features, from rows of (features, probability, count), by gradient descent."""
    weights = {name: 0.0 for row in rows for name in row[0]}
    total = sum(r[2] for r in rows)
    for _ in range(steps):
        slope = {name: decay * w for name, w in weights.items()}
        for names, p, n in rows:
            error = (sigmoid(sum(weights[x] for x in names)) - p) * n / total
            for x in names:
                slope[x] += error
        for x, g in slope.items():
            weights[x] -= rate * g
    return weights


def _features(row: dict) -> list[str]:
    return ["bias", f"kind={row['kind']}", *(f"{v}={row[v]}" for v in VOTERS), *(f"{v}={row[v]}" for v in SHAPES), *(f"{row['kind']}:{v}={row[v]}" for v in SHAPES)]


def fit(cands: DataFrame, how: Supervision, name: str = "cands") -> dict[str, float]:
    """The span classifier's weights from the counts of all vote patterns of all documents.

    A row for each pattern of kind, votes and classes comes to the driver: at most 8 * 3 ** 5 * 6 * 5 * 4 * 3 of them,
    whatever the input, and a few hundred as a rule.
    """
    keys = ["kind", *VOTERS, *SHAPES]
    votes = cands.select(F.explode(name).alias("s")).select(_votes(F.col("s")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    rows = sorted((r.asDict() for r in votes.select(*[F.col(f"v.{k}").alias(k) for k in keys], "n").collect()), key=lambda r: [str(r[k]) for k in keys])
    if not rows:
        return {}
    post, _ = fit_reliabilities([(r["kind"], tuple(r[v] for v in VOTERS), r["n"]) for r in rows], how.rounds)
    return fit_classifier([(_features(r), p, r["n"]) for r, p in zip(rows, post, strict=True)], how.steps)


def _score(s: Column, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    vote = _votes(s)
    weight = lambda key: F.coalesce(F.element_at(table, key), F.lit(0.0))
    total = F.lit(float(weights.get("bias", 0.0)))
    for name in ["kind", *VOTERS, *SHAPES]:
        total = total + weight(F.concat(F.lit(f"{name}="), vote[name].cast("string")))
    for name in SHAPES:
        total = total + weight(F.concat(vote["kind"], F.lit(f":{name}="), vote[name].cast("string")))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _judged(docs: DataFrame, how: Supervision, name: str, *drop: str) -> DataFrame:
    """docs, written without `drop`, with the spans of private_spans() in the column `name`."""
    cands = materialize(candidates(docs, name).drop(*drop), "spans")
    weights = fit(cands, how, name)
    sure = F.filter(name, lambda s: s["base"])
    apart = lambda s: ~F.exists(sure, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(name, lambda s: ~s["base"] & (_score(s, weights) >= how.least) & apart(s)) if weights else F.filter(name, lambda s: F.lit(False))
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    place = F.array(*map(F.lit, KINDS))
    rank = lambda s: F.array_position(place, s["kind"]).cast("int")
    order = lambda a, b: F.when(a["kind"] != b["kind"], rank(a) - rank(b)).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])
    return cands.withColumn(name, F.array_sort(F.concat(F.transform(sure, slim), F.transform(more, slim)), order))


def private_spans(docs: DataFrame, how: Supervision | None = None) -> DataFrame:
    """(doc_id, spans) of every document of docs(doc_id, text): array of kind, start, end, base, in order of kind and start.

    The base patterns' valid matches are always in. Other candidates (invalid matches, card numbers and telephone
    numbers within longer runs, identity numbers, keys) are in if the classifier gives them `how.least` and they
    overlap no base span. Labelers by pattern, gazetteer, context, edges and checksum vote on each candidate;
    expectation-maximisation over the counts of all votes estimates how reliable they are; its posteriors train the
    classifier. Positions are code points, the end exclusive.

    Null texts are empty and have no spans; equal matches repeat at their own positions; each row is judged by
    itself, whatever its doc_id; an empty table gives an empty result; other columns are ignored.
    """
    return _judged(docs.select("doc_id", "text"), how or Supervision(), "spans", "text")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts, the SHA-256 of the base spans and the list of all spans of private_spans()."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


#: Code points of a block of a text: a piece of it is cut from its blocks, so that a piece far from the start costs no more.
BLOCK = 1024


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, exclusive, of a text in blocks."""
    cut = lambda b: F.substr(F.element_at(blocks, (b + 1).cast("int")), F.greatest(start - b * BLOCK, F.lit(0)) + 1, F.least(end - b * BLOCK, F.lit(BLOCK)) - F.greatest(start - b * BLOCK, F.lit(0)))
    numbers = F.sequence(F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
    return F.when(end > start, F.array_join(F.transform(numbers, cut), "")).otherwise(F.lit(""))


def redact(docs: DataFrame, how: Supervision | None = None) -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets, and n_chars, if there, by the new length.

    Where spans overlap, the first (then the longest) is replaced, and the rest of the others with it. Each row is
    judged and replaced by itself, whatever its doc_id; null texts stay null; an empty table gives an empty result.
    """
    name = free_name(docs, "spans")
    found, text = _judged(docs, how or Supervision(), name), F.col("text")
    spans = F.array_sort(name, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(place, s):
        new = s["start"] >= place
        gap = F.struct(F.when(new, place).alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.struct(F.greatest(place, s["end"]).alias("at"), gap.alias("got"))

    blocks, gaps, last = (free_name(found, c) for c in ("blocks", "gaps", "last"))
    found = found.withColumn(blocks, F.when(F.size(name) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    found = found.withColumn(gaps, F.filter(running(spans, "struct<from:int,start:int,kind:string>", step), lambda g: g["from"].isNotNull()))
    found = found.withColumn(last, F.array_max(F.transform(name, lambda s: s["end"])))
    kept = F.transform(gaps, lambda g: F.concat(_piece(F.col(blocks), g["from"], g["start"]), F.lit("["), F.upper(g["kind"]), F.lit("]")))
    made = F.concat(F.array_join(kept, ""), _piece(F.col(blocks), F.col(last), F.length(text)))
    out = found.withColumn("text", F.when(F.size(name) > 0, made).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
