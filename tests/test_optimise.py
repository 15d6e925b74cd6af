"""The minimiser on functions whose minimum is known."""

import numpy as np

from lexiflow.operators.optimise import Lbfgs


def run(f, start, **kw):
    m = Lbfgs(start, **kw)
    while not m.done:
        m.tell(*f(m.trial))
    return m


def test_quadratic_minimum():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 12))
    h, b = a.T @ a + 0.1 * np.eye(12), rng.normal(size=12)
    m = run(lambda x: (x @ h @ x / 2 - b @ x, h @ x - b), np.zeros(12), tolerance=1e-8)
    assert np.allclose(m.point, np.linalg.solve(h, b), atol=1e-5) and m.round < 200


def test_curved_valley():
    def f(x):
        return (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array(
            [-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    assert np.allclose(run(f, [-1.2, 1.0], tolerance=1e-6).point, [1, 1], atol=1e-4)


def test_overflow_shortens_the_step():
    m = run(lambda x: (float(np.exp(np.minimum(x, 800)).sum() - x.sum()), np.exp(np.minimum(x, 800)) - 1), np.full(3, -20.0), tolerance=1e-6)
    assert np.allclose(m.point, 0, atol=1e-5)


def test_rounds_bind():
    assert run(lambda x: (float(x @ x), 2 * x), np.ones(4), rounds=0).round == 0
