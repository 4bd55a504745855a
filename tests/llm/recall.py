"""python tests/llm/recall.py DIR: the components of near_duplicates() over a folder's documents against brute force.

Brute force counts the shingles that every document shares with every other, from lists of the documents that have each
shingle, on all cores; nothing is sampled.
"""

import multiprocessing
import os
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tessella.llm.text import words_of  # noqa: E402

_data: tuple = ()


def _links(part: range) -> np.ndarray:
    number, starts, post, sizes, own = _data
    out = []
    for i in part:
        got = np.concatenate([post[starts[g] : starts[g + 1]] for g in own[i]]) if len(own[i]) else np.zeros(0, np.int64)
        both = np.bincount(got[got > i], minlength=1)
        at = np.flatnonzero(both)
        at = at[100 * both[at] >= 75 * (sizes[i] + sizes[at] - both[at])]
        out.append(np.column_stack([np.full(len(at), i), at]))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def brute_force(rows: list[tuple]) -> tuple[np.ndarray, int]:
    """The smallest row of each row's component, and the number of links between different sets."""
    global _data
    number: dict[tuple, int] = {}
    keys: dict[tuple, int] = {}
    own, rep = [], np.zeros(len(rows), np.int64)
    for i, (_, text) in enumerate(rows):
        w = [x.lower() for x in words_of(text)]
        grams = sorted({number.setdefault(g, len(number)) for g in ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ())})
        key = tuple(grams) if grams else ("row", i)
        if key not in keys:
            keys[key] = len(own)
            own.append(grams)
        rep[i] = keys[key]
    sizes = np.array([len(x) for x in own])
    doc, gram = np.repeat(np.arange(len(own)), sizes), np.concatenate([np.array(x, np.int64) for x in own])
    order = np.argsort(gram, kind="stable")
    _data = (number, np.searchsorted(gram[order], np.arange(len(number) + 1)), doc[order], sizes, own)
    with multiprocessing.get_context("fork").Pool() as pool:
        found = np.concatenate(pool.map(_links, [range(a, min(a + 200, len(own))) for a in range(0, len(own), 200)], chunksize=1))
    label = np.arange(len(own))
    while True:
        before = label.copy()
        np.minimum.at(label, found[:, 0], label[found[:, 1]])
        np.minimum.at(label, found[:, 1], label[found[:, 0]])
        label = label[label]
        if (label == before).all():
            break
    first = np.full(len(own), len(rows))
    np.minimum.at(first, label[rep], np.arange(len(rows)))
    return first[label[rep]], len(found)


def main(folder: str) -> None:
    import pyarrow.dataset as ds

    table = ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"]).sort_by("doc_id")
    rows = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    start = time.time()
    want, links = brute_force(rows)
    print(f"brute force: {links} links between different sets, {len(set(want.tolist()))} components of {len(rows)} documents, {time.time() - start:.0f} s", flush=True)
    from tessella.llm.minhash import near_duplicates
    from tessella.session import local_session

    spark = local_session("*", 16, "recall")
    spark.sparkContext.setLogLevel("ERROR")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    same = sum(got[i] == rows[w][0] for (i, _), w in zip(rows, want.tolist(), strict=True))
    print(f"near_duplicates: {len(set(got.values()))} components; {same} of {len(rows)} documents in the component of brute force")


if __name__ == "__main__":
    main(sys.argv[1])
