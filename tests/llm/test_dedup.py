import hashlib
from itertools import combinations

import numpy as np
import pytest

from tessella.llm import minhash, substring
from tessella.llm.components import connected_components
from tessella.llm.text import WordHashes, window_hashes, words_of


def brute_shingles(text):
    w = [x.lower() for x in words_of(text)]
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute_components(docs):
    sets = {i: brute_shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components([tuple(r) for r in docs.collect()])


def test_near_copies_of_one_text_form_one_group(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 6)):
            own[at] = f"v{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def near_copies(seed=7):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 8)):
            own[at] = f"v{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("how", [{"heads": 0, "neighbours": 0, "block": 16}, {"heads": 0, "neighbours": 0}, {"heads": 1, "neighbours": 1, "block": 16}])
def test_near_duplicates_do_not_depend_on_the_first_candidates(spark, how):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, minhash.Banding(**how)).collect()}
    assert got == brute_components(rows)


def fast_components(rows):
    """brute_components() of many documents, all pairs by a product of incidence matrices in blocks."""
    sets = [brute_shingles(t) for _, t in rows]
    number = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    have = np.zeros((len(rows), len(number)), np.float32)
    for i, own in enumerate(sets):
        have[i, [number[g] for g in own]] = 1
    size = have.sum(axis=1)
    label = np.arange(len(rows))
    both = have @ have.T
    link = (100 * both >= 75 * (size[:, None] + size[None, :] - both)) & (both > 0)
    while True:
        low = np.where(link, label[None, :], len(rows)).min(axis=1)
        low = np.minimum(low, label)
        if (low == label).all():
            break
        label = low
    ids = np.array([i for i, _ in rows])
    return {i: (len(s), int(ids[r])) for (i, _), s, r in zip(rows, sets, label, strict=True)}


def test_a_large_group_of_one_template_is_whole(spark):
    """1500 texts of one template with three edits each: most pairs are links, many others share buckets."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        own = [f"w{j}" for j in range(150)]
        for at in rng.integers(0, 150, 3 if i % 3 else 9):
            own[at] = f"v{rng.integers(100_000)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == fast_components(rows)


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(2, a), (2, b), (2**60 + 1, a), (None, b), (None, "x y"), (7, b), (None, b)]
    docs = spark.createDataFrame([(*r, 2**60 + 3, "k") for r in rows], "doc_id long, text string, node long, row string")
    got = sorted(map(tuple, minhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(2, 2, True), (2, 2, True), (2**60 + 1, 2, False), (None, 2, False), (None, None, True), (7, 2, False), (None, 2, False)], key=str)
    kept = minhash.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(((r["doc_id"], r["text"], r["node"]) for r in kept.collect()), key=str) == sorted([(2, a, 2**60 + 3), (2, b, 2**60 + 3), (None, "x y", 2**60 + 3)], key=str)


def test_near_duplicates_of_odd_rows(odd, odd_rows, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3))
    assert [by[i]["component_id"] for i in (6, 7, 8, 15)] == [6, 6, 6, 6] and by[10]["component_id"] == 9 and by[12]["component_id"] == 11
    assert by[4]["n_shingles"] == 1 and by[14]["component_id"] == 14
    assert by[None]["kept"] and by[None]["component_id"] is None  # a null id is the first of its class where no other is
    assert minhash.near_duplicates(none).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (5, 1), (20, 19), (19, 18), (18, 17), (None, 3)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 17: 17, 18: 17, 19: 17, 20: 17}
    assert connected_components(links.limit(0)).collect() == []


def brute_repeats(docs, size=50):
    """Of rows, each a document: (doc_id, words, removed words, SHA-256 of the others)."""
    words = [(i, words_of(t)) for i, t in docs]
    owner = {}
    for i, w in words:
        for j in range(len(w) - size + 1):
            if i is not None:
                h = tuple(w[j : j + size])
                owner[h] = min(i, owner.get(h, i))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - size + 1):
            if i is not None and owner[tuple(w[j : j + size])] < i:
                gone[j : j + size] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("sketch", [substring.Sketch(log2_cells=22, log2_block=18), substring.Sketch(log2_cells=10, log2_block=8, flush=500, fan_in=1, load=3000)])
def test_repeats_match_brute_force_whatever_the_sketch(spark, sf, sketch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    assert digests(substring.remove_repeats(docs, sketch=sketch)) == brute_repeats([tuple(r) for r in docs.collect()])


def test_repeats_of_odd_rows(odd, odd_rows, none):
    sketch = substring.Sketch(log2_cells=20, log2_block=16)
    got = digests(substring.remove_repeats(odd, sketch=sketch))
    assert got == brute_repeats([(r[0], r[1]) for r in odd_rows])
    by = {r[0]: r for r in got}
    assert by[7][2] == 120 and by[16][2] == 120 and by[14][2] == 0
    assert substring.remove_repeats(none, sketch=sketch).collect() == []


@pytest.mark.parametrize("parts", [1, 1000])
def test_repeats_of_rows_that_share_ids(spark, monkeypatch, parts):
    from tessella.llm import shared

    monkeypatch.setattr(shared, "HOT_PARTS", parts)
    a, q = [f"a{i}" for i in range(60)], [f"q{i}" for i in range(80)]
    rows = [(1, " ".join(a)), (2, " ".join(a + ["z0", "z1"])), (2, " ".join(q)), (2, " ".join(q)), (2**60 + 1, " ".join(a[:55])), (None, "  ".join(a)), (2**60 + 3, " ".join(["x"] + a + q))]
    rows += [(100 + i, " ".join([f"u{i}"] + a)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(substring.remove_repeats(docs, sketch=substring.Sketch(log2_cells=16, log2_block=12))) == brute_repeats(rows)


def test_anchors_are_the_least_runs_of_windows():
    own = np.random.default_rng(2).integers(0, 2**63, 300).astype(np.uint64)
    for window, run in ((50, 20), (50, 50), (7, 1), (50, 19)):
        h = window_hashes(own, run)
        want = [min(h[i : i + window - run + 1]) for i in range(len(own) - window + 1)]
        assert substring.anchors(own, window, run).tolist() == [int(x) for x in want]
    assert len(substring.anchors(own[:49], 50, 20)) == 0 and len(substring.anchors(own[:50], 50, 20)) == 1


def test_sketch_packing_and_windows():
    cells = np.unique(np.random.default_rng(1).integers(0, 2**20, 5000)).astype(np.uint64)
    assert (substring._unpack(substring._pack(cells)) == cells.astype(np.int64)).all()
    assert len(substring._unpack(substring._pack(cells[:0]))) == 0
    h = WordHashes().of([b"a", b"b", b"c", b"a", b"b", b"c"])
    w = window_hashes(h, 3)
    assert len(w) == 4 and w[0] == w[3] and len(set(w.tolist())) == 3 and len(window_hashes(h, 7)) == 0


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_classes_are_joined_alike_hot_or_not(spark, monkeypatch, parts):
    from tessella.llm import shared

    monkeypatch.setattr(shared, "HOT_PARTS", parts)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate("aaaaaaabbc")] + [(10, None)], "id long, k string")
    classes = spark.createDataFrame([("a", 7, "x"), ("b", 2, "y")], "k string, n long, v string")
    got = {r["id"]: r["v"] for r in shared.join_by_class(rows, classes, ["k"], 11).collect()}
    assert got == {**dict.fromkeys(range(7), "x"), 7: "y", 8: "y", 9: None, 10: None}
