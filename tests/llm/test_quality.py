"""The robust estimate of the quality rules against a search in NumPy, and
junk planted in every language."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
pytest.importorskip("tidemark.llm")
from tidemark.llm import quality as M  # noqa: E402

NAMES = list(M.VECTOR)
FLOOR = np.array(list(M.VECTOR.values()))


def searched(x, starts=200, seed=3):
    """The least log determinant, centre and scatter over random starts, each
    concentrated on exact nearest shares until nothing changes."""
    rng = np.random.default_rng(seed)
    best = (np.inf, None, None)
    h = int(np.ceil(len(x) * M.H))
    for _ in range(starts):
        part = x[rng.choice(len(x), 12, replace=False)]
        last = None
        while True:
            m, c = part.mean(0), np.cov(part.T, bias=True)
            c[np.diag_indices(5)] = np.maximum(np.diag(c), FLOOR ** 2)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = np.sort(np.argpartition(d, h - 1)[:h])
            if last is not None and np.array_equal(near, last):
                break
            last, part = near, x[near]
        det = np.linalg.slogdet(c)[1]
        if det < best[0]:
            best = (det, m, c)
    return best


def test_estimate_against_search(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(5, 5)) + 2 * np.eye(5)
    plain = rng.normal(size=(600, 5)) @ mix + 20
    shifted = np.concatenate([plain[:480], rng.normal(size=(120, 5)) * 0.4 + 60])  # a fifth of the rows lies together, far away
    apart = np.concatenate([plain[:500], 20 + rng.normal(size=(100, 5)) * 60])
    flat = plain.copy()
    flat[:, 3] = 4.0
    data = {"plain": plain, "shifted": shifted, "apart": apart, "flat": flat}
    rows = [(g, *map(int, np.floor(v * M.UNIT + 0.5))) for g, x in data.items() for v in x]
    got = {r.g: r for r in M.robust_estimates(spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} long" for n in NAMES))).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        det, m, c = searched(x)
        r = got[g]
        assert r.n == len(x) and r.steps >= 2
        assert r.logdet < det + 0.15  # shares are cut at bins of distance, so a few rows more than the nearest 75 %
        w = np.array([[r[f"w_{a}_{b}"] if j <= i else 0.0 for j, b in enumerate(NAMES)] for i, a in enumerate(NAMES)])
        mine = (((x - [r[f"m_{a}"] for a in NAMES]) @ w.T) ** 2).sum(1) * r.scale
        other = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        other *= M.CHI5[1] / np.median(other)
        assert abs(np.median(mine) / M.CHI5[1] - 1) < 0.05
        assert np.array_equal(mine > r.limit, other > r.limit) or np.mean((mine > r.limit) != (other > r.limit)) < 0.005
    far = got["shifted"]
    assert all((((x - [far[f"m_{a}"] for a in NAMES]) @ np.array([[far[f"w_{a}_{b}"] if j <= i else 0.0 for j, b in enumerate(NAMES)]
                                                                 for i, a in enumerate(NAMES)]).T) ** 2).sum() * far.scale > far.limit for x in shifted[480:])


def test_planted_junk_in_every_language(spark):
    rng = random.Random(5)
    rows, junk = [], set()
    for lang, step in (("en", 0), ("de", 2), (None, 1)):
        stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8) + step)) for _ in range(400)]
        for source in ("a", "b"):
            for i in range(230 if source == "a" else 60):  # the second source is too small for an estimate of its own
                rows.append((len(rows), " ".join(rng.choice(stock) for _ in range(rng.randint(12, 300))), lang, source))
            for _ in range(4):
                junk.add(len(rows))
                rows.append((len(rows), " ".join(rng.choice(stock) + "##$%" for _ in range(rng.randint(12, 300))), lang, source))
    got = {r.doc_id: r for r in M.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()}
    assert not [d for d in junk if got[d].kept]
    assert not [d for d, *_ in rows if d not in junk and not got[d].kept]
    again = {r.doc_id: r.distance for r in M.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)).collect()}
    assert again == {d: r.distance for d, r in got.items()}  # sums do not hang on partitions


def test_estimates_are_read_in_one_scan(spark, monkeypatch):
    """The plan of the estimates must not grow with the number of steps taken."""
    rng = np.random.default_rng(1)
    rows = [(g, *map(int, np.floor(v * M.UNIT + 0.5))) for g in "abc" for v in rng.normal(size=(300, 5)) @ (rng.normal(size=(5, 5)) + np.eye(5))]
    staged, plans = M.staged, {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(M, "staged", kept)
    got = M.robust_estimates(spark.createDataFrame(rows, "g string, " + ", ".join(f"{n} long" for n in NAMES)))
    assert max(r.steps for r in got.collect()) >= 3
    assert "Union" not in plans["mcd-best"]


def test_steps_read_vectors_only(spark, monkeypatch):
    """A step joins its rows with the estimates and these with the new ones; the
    driver keeps no further broadcasts or shuffles for each step."""
    staged, joins = M.staged, []

    def kept(df, name):
        if name == "mcd":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return staged(df, name)

    monkeypatch.setattr(M, "staged", kept)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(12, 60))), "en", "ab"[i % 2]) for i in range(500)]
    assert M.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).count() == 500
    assert joins[0] == 1 and max(joins) <= 2
