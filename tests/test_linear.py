"""Logistic regression against a dense numpy twin that knows no cells."""

import random

import numpy as np
import pytest

from sparktally.operators import counts as C
from sparktally.operators import linear as Z

ATTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for _ in range(400):
        a, b, c = rng.choice("xyz"), rng.choice("uv"), rng.choice(["m", "n", None])
        y = rng.choices("pqr", [3 if a == "x" else 1, 3 if b == "u" else 1, 2])[0]
        out.append((y, a, b, c))
    return out


@pytest.fixture(scope="module")
def cells(spark, rows):
    return C.cuboid(spark.createDataFrame(rows, "y string, a string, b string, c string"), ATTS)


def design(rows):
    names = [""] + [(i, v) for i in range(3) for v in sorted({r[1 + i] for r in rows if r[1 + i]})]
    x = np.array([[1.0] + [float(r[1 + i] == v) for i, v in names[1:]] for r in rows])
    y = np.array(["pqr".index(r[0]) for r in rows])
    return names, x, y


def posterior(x, w):
    z = x @ w.T
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def newton(x, y, steps=50):
    """Damped Newton steps with a pseudo-inverse, as the weights are not unique though the posterior is."""
    k, d = 3, x.shape[1]
    w = np.zeros((k, d))
    for _ in range(steps):
        p = posterior(x, w)
        g = (p - np.eye(k)[y]).T @ x
        h = np.zeros((k * d, k * d))
        for i in range(k):
            for j in range(k):
                h[i * d : (i + 1) * d, j * d : (j + 1) * d] = x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None])
        w = w - (np.linalg.pinv(h, rcond=1e-10) @ g.ravel()).reshape(k, d)
    return posterior(x, w)


def test_loss_and_gradient(rows, cells):
    names, x, y = design(rows)
    domains = Z.domains_of(cells, ATTS)
    rng = np.random.default_rng(1)
    w, scale = rng.normal(size=(3, x.shape[1])), rng.normal(size=(3, x.shape[1]))
    loss, grad = Z.loss_and_gradient(Z.code_cells(cells, ATTS, list("pqr"), domains), w, scale)
    p = posterior(x, w * scale)
    assert loss == pytest.approx(-np.log(p[np.arange(len(y)), y]).sum())
    assert grad == pytest.approx(((p - np.eye(3)[y]).T @ x) * scale)


def test_naive_bayes_scale(rows, cells):
    names, x, y = design(rows)
    scale = Z.naive_bayes_scale(cells, ATTS, list("pqr"), Z.domains_of(cells, ATTS))
    sizes = [None, 3, 3, 3, 2, 2, 2, 2]
    for c in range(3):
        ny = (y == c).sum()
        assert scale[c, 0] == pytest.approx(np.log((ny + 1 / 3) / (len(y) + 1)))
        for j in range(1, x.shape[1]):
            assert scale[c, j] == pytest.approx(np.log((x[y == c, j].sum() + 1 / sizes[j]) / (ny + 1)))


@pytest.mark.parametrize("scaled", [False, True])
def test_posterior_to_six_digits(rows, cells, scaled):
    _, x, y = design(rows)
    want = {r[1:]: p for r, p in zip(rows, newton(x, y), strict=True)}
    model = Z.fit_logistic(cells, ATTS, scaled=scaled, epsilon=1e-8, iterations=200)
    for r in model.score(cells).collect():
        assert r.p == pytest.approx(want[r.a, r.b, r.c], abs=1e-6)


def test_minimise_on_a_narrow_valley():
    def f(v):
        x, y = v
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    x, value, _ = Z.minimise(f, np.array([-1.2, 1.0]), epsilon=1e-9)
    assert x == pytest.approx([1, 1], abs=1e-6) and value < 1e-12
