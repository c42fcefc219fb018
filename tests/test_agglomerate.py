"""Merges by Bayes factors against a plain loop; cuts of known trees."""

import math

import numpy as np

from lattica.operators import agglomerate as ag


def test_log_gamma():
    x = np.concatenate([10.0 ** np.arange(-12, 9), np.linspace(0.01, 20, 500)])
    want = np.array([math.lgamma(v) for v in x])
    assert (np.abs(ag.log_gamma(x) - want) <= 1e-12 * np.maximum(1, np.abs(want))).all()


def plain(t, s, n, gamma):
    lg = lambda v: np.array([math.lgamma(x) for x in np.ravel(v)]).reshape(np.shape(v))
    live = [c for c in range(len(n)) if n[c] > 0]
    prior = gamma * np.maximum(t[live].sum(axis=0) / s[live].sum(), 1e-9)
    prior = prior[t[live].sum(axis=0) > 0]
    t = t[:, t[live].sum(axis=0) > 0]
    f = lambda x, size: math.lgamma(gamma) - math.lgamma(gamma + size) + (lg(prior + x) - lg(prior)).sum()
    node = {c: (t[c] * (n[c] / s[c] if s[c] > 0 else 0), float(n[c])) for c in live}
    out, new = [], len(n)
    while len(node) > 1:
        score = {(a, b): f(node[a][0] + node[b][0], node[a][1] + node[b][1]) - f(*node[a]) - f(*node[b]) for a in node for b in node if a < b}
        a, b = min(score, key=lambda p: (-score[p], p))
        out.append((new, a, b, score[a, b], int(node[a][1] + node[b][1])))
        node[new] = (node[a][0] + node[b][0], node[a][1] + node[b][1])
        del node[a], node[b]
        new += 1
    return out


def test_merges_as_plain(spark, monkeypatch):
    monkeypatch.setattr(ag, "FEATURES", 7)
    rng = np.random.default_rng(2)
    profiles = rng.dirichlet(np.full(40, 0.5), 3)
    t = np.array([rng.multinomial(400 + 50 * c, profiles[c % 3]) for c in range(9)]).astype(float)
    t[:, 11] = 0
    n = np.array([40, 30, 50, 0, 45, 35, 60, 20, 25]) * 8  # enough to tell the profiles apart
    s = t.sum(axis=1)
    mass = spark.createDataFrame([(c, g, float(t[c, g])) for c in range(9) for g in range(40) if t[c, g]], "cluster int, feature int, val double")
    sizes = spark.createDataFrame([(c, float(s[c]), int(n[c])) for c in range(9)], "cluster int, size double, effective long")
    got, want = ag.agglomerate(mass, sizes, 2.0), plain(t, s, n, 2.0)
    assert [m[:3] + m[4:] for m in got] == [m[:3] + m[4:] for m in want]
    assert np.allclose([m[3] for m in got], [m[3] for m in want], atol=1e-8)
    label = ag.cut(got, 9)
    assert label[3] == -1 and label[0] == label[6] != label[1] == label[4] == label[7] != label[2] == label[5] == label[8]
    assert ag.agglomerate(mass, sizes.where("cluster = 1"), 2.0) == [] and ag.agglomerate(mass.where("false"), sizes.where("false")) == []


def test_cuts():
    merges = [(5, 0, 2, 3.0, 2), (6, 3, 5, 0.0, 3), (7, 4, 6, -1.0, 4)]
    assert ag.cut(merges, 5) == [0, -1, 0, 0, 1]
    assert ag.cut(merges, 5, 1.0) == [0, -1, 0, 1, 2] and ag.cut(merges, 5, -9.0) == [0, -1, 0, 0, 0]
    assert ag.cut([], 2) == [-1, -1]
