import duckdb
import pytest

import corpus_pipeline
from tessella.llm import decontaminate, minhash, mixing, pii, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_change_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        made[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = made["near_dedup"]
    kept = {r["doc_id"] for r in minhash.near_duplicates(before).where("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept and len(kept) < before.count()
    before, after = made["decontamination"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(after, items).isEmpty() and after.count() < before.count()
    before, after = made["personal_data"]
    assert before.count() == after.count() and after.where("text rlike '[a-z0-9]@[a-z0-9]+[.]example'").isEmpty()
    before, after = made["mixing"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()} and "copy" in after.columns


def test_stages_match_brute_force(spark):
    from test_dedup import brute_components
    from test_filters import brute_contaminated, brute_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def made(name, rows):
        before = docs.join(spark.createDataFrame([r[:1] for r in rows], "doc_id long"), "doc_id").select(*docs.columns)
        return sorted((r["doc_id"], r["text"]) for r in stages[name](spark, before, SF).collect())

    good = [r for r, (votes, _, score) in zip(rows, brute_quality(rows, quality.Quality()), strict=True) if votes and score >= 0.5]
    assert made("quality", rows) == good and len(good) < len(rows)
    groups = brute_components(good)
    first = [r for r in good if groups[r[0]][1] == r[0]]
    assert made("near_dedup", good) == first and len(first) < len(good)
    dirty = brute_contaminated(first, items)
    clean = [r for x, r in enumerate(first) if x not in dirty]
    assert made("decontamination", first) == clean
    frame = spark.createDataFrame(clean, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.private_spans(frame).collect()}

    def cut(text, spans):
        out, at = "", 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        return out + text[at:]

    safe = [(i, cut(t, spans[i])) for i, t in clean]
    assert made("personal_data", clean) == safe and safe != clean
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.select("doc_id", "source").join(spark.createDataFrame(safe, "doc_id long, text string"), "doc_id")).collect()}
    words = {}
    for r in stages["mixing"](spark, docs.drop("text").join(spark.createDataFrame(safe, "doc_id long, text string"), "doc_id").select(*docs.columns), SF).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {i: n for i, n in taken.items() if n}


def test_run_gives_the_stages_rows(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_over_odd_and_empty_tables(spark, tmp_path, odd, odd_rows, none):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    big = [(2**60 + 1 + i, f"{odd_rows[5][1]} {i} and some more plain words follow here, as they should.", "en", "s", 1, 2**60 + i, 0.5, True, "k", 1, 2, 3) for i in range(3)]
    for name, docs in (("odd", odd.union(spark.createDataFrame(big, odd.schema))), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        if name == "none":
            assert got == []
        else:
            assert {r["size"] for r in got} <= {7, 2**60, 2**60 + 1, 2**60 + 2} and all(r["text"] for r in got)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r[n] for n in names) for r in got.collect()) == order(want.fetchall())
