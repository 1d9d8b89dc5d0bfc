import random

import numpy as np
import pytest

from lodestone.llm import mixing as M

SIZED = "doc_id long, source string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def test_settling_keeps_the_total_and_is_fair():
    rnd = np.random.default_rng(1)
    w = rnd.integers(1, 500, 200).astype(float)
    p = np.full(200, 0.3)
    out, open_ = M.settle(p, w, rnd.random(200))
    assert abs((out * w).sum() - (p * w).sum()) < 1e-6
    assert np.all((out == 0) | (out == 1) | (np.arange(200) == open_))
    share = np.mean([M.settle(p, w, rnd.random(200))[0] for _ in range(300)], axis=0)
    assert abs(share.mean() - 0.3) < 0.02 and np.all(np.abs(share - 0.3) < 0.15)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("tied", [True, False])
@pytest.mark.parametrize("together", [True, False])
def test_every_document_keeps_its_chance(parts, tied, together):
    """1,500 draws of 60 documents over one part and a tree of several: no document beyond 4 sigma, the total off by one document."""
    rnd = np.random.default_rng(7)
    w = rnd.choice([3.0, 50.0, 200.0], 60) if tied else rnd.permutation(np.arange(1.0, 61.0))
    chance = np.full(60, 0.37)
    taken = np.zeros(60)
    for _ in range(1500):
        out = np.zeros(60)
        left, mass = [], []
        for part in np.array_split(np.arange(60), parts):
            luck = rnd.random(len(part))
            p, open_ = M.settle_together(0.37, w[part], luck) if together else M.settle(chance[part], w[part], luck)
            out[part] = p
            if open_ >= 0:
                left.append(part[open_])
                mass.append(p[open_])
        p, open_ = M.settle(np.array(mass), w[left], rnd.random(len(left)))
        if open_ >= 0:
            p[open_] = float(rnd.random() < p[open_])
        out[left] = p
        assert set(out) <= {0.0, 1.0}
        assert abs(out @ w - chance @ w) <= max(w[left], default=0) + 1e-6
        taken += out
    sigma = np.sqrt(0.37 * 0.63 / 1500)
    assert np.abs(taken / 1500 - 0.37).max() < 4 * sigma


def test_a_long_document_is_made_good_by_the_others():
    rnd = np.random.default_rng(3)
    w = np.array([5000.0, *rnd.integers(1, 40, 500)])
    taken = np.zeros(501)
    for _ in range(600):
        p, open_ = M.settle_together(0.6, w, rnd.random(501))
        assert open_ != 0 and abs(p @ w - 0.6 * w.sum()) < 1e-6
        taken += p
    assert abs(taken[0] / 600 - 0.6) < 4 * np.sqrt(0.24 / 600) and abs(taken[1:].mean() / 600 - 0.6) < 0.01


def test_draws_of_the_operator_are_fair(spark):
    sized = spark.createDataFrame([(i, "a" if i % 2 else "b", 10 + i % 3) for i in range(400)], SIZED)
    targets = spark.createDataFrame([("a", 0.15, 1), ("b", 0.15, 1)], TARGETS)
    runs = [{r.doc_id for r in M.mix(sized, targets, seed=k).where("copies = 1").collect()} for k in range(1, 6)]
    assert len({frozenset(r) for r in runs}) == 5
    assert all(abs(sum(i in r for r in runs for i in range(k, 400, 3)) / (5 * len(range(k, 400, 3))) - 0.3) < 0.1 for k in range(3))


@pytest.mark.parametrize("part", [20_000, 200])
def test_shares(spark, monkeypatch, part):
    monkeypatch.setattr(M, "PART", part)
    monkeypatch.setattr(M, "FAN_IN", 3)
    rnd = random.Random(4)
    rows = [(i, rnd.choice([" Wiki", "wiki", "WIKI ", "forum", "rare" if i < 30 else "wiki", None, "other"]), rnd.choice([0, 3, 50, 200, 900]) if i else 40_000) for i in range(1500)]
    sized = spark.createDataFrame(rows, SIZED)
    targets = spark.createDataFrame([("wiki", 0.5, 2), ("forum", 0.45, 5), ("Rare", 0.05, 3), ("absent", 0.1, 2)], TARGETS)
    mixed = M.mix(sized, targets).cache()
    out = {r.source: r for r in M.shares(mixed, targets).collect()}
    listed = [r for r in rows if (r[1] or "").strip().lower() in ("wiki", "forum", "rare")]
    assert mixed.count() == len(listed) and mixed.select("doc_id").distinct().count() == len(listed)
    total = sum(r[2] for r in listed)
    for name, cap in (("wiki", 2), ("forum", 5), ("rare", 3)):
        r = out[name]
        assert r.total == total and r.max_copies <= cap
        want = min(r.target_share * total, cap * r.n_tokens)
        assert abs(r.taken_tokens - want) <= 25, (name, r)  # there are only five sizes
    assert (out["absent"].taken_tokens, out["absent"].reached_share) == (0, 0.0)
    again = {(r.doc_id, r.copies) for r in M.mix(sized.repartition(7), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in mixed.collect()}


def test_empty_and_null(spark):
    targets = spark.createDataFrame([("a", 1.0, None), (None, 0.5, 1)], TARGETS)
    none = spark.createDataFrame([], SIZED)
    assert M.mix(none, targets).count() == 0
    out = M.shares(M.mix(none, targets), targets).collect()
    assert [(r.source, r.reached_share) for r in out] == [("a", 0.0)]
    zero = spark.createDataFrame([(1, "a", None), (2, "a", 0)], SIZED)
    assert M.mix(zero, targets).count() == 2
