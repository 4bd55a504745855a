"""Reliabilities of labelers that vote for, against or not at all, by expectation-maximisation."""

from __future__ import annotations

import math


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_reliabilities(rows: list[tuple], rounds: int, start: list[float] | None = None, silent: bool = False) -> tuple[list[float], list]:
    """Posterior of each row (kind, votes, count) by expectation-maximisation of a two-class model.

    Every kind has a share of true cases, and every labeler the probabilities of its answers (1, -1, and 0 for none)
    given the class, in common for all kinds. It starts from `start`, by default the share of votes in favour. Where
    `silent`, no answer says nothing about the class. Returns the posteriors and the reliabilities, a dict by class
    and answer for each labeler.
    """
    kinds = sorted({r[0] for r in rows})
    post = start or [(1 + sum(v > 0 for v in r[1])) / (2 + sum(v != 0 for v in r[1])) for r in rows]
    counted = (-1, 1) if silent else (-1, 0, 1)
    table: list = []
    for _ in range(rounds):
        prior = {}
        for k in kinds:
            own = [(p, r[2]) for p, r in zip(post, rows, strict=True) if r[0] == k]
            prior[k] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        table = []
        for j in range(len(rows[0][1])):
            given = {}
            for c in (0, 1):
                mass = {v: 1.0 for v in counted}
                for p, r in zip(post, rows, strict=True):
                    if r[1][j] in mass:
                        mass[r[1][j]] += (p if c else 1 - p) * r[2]
                total = sum(mass.values())
                given[c] = {v: m / total for v, m in mass.items()}
            table.append(given)
        post = [sigmoid(math.log(prior[k] / (1 - prior[k])) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(votes) if v in counted)) for k, votes, _ in rows]
    return post, table
