"""The positive-unlabelled fit against a plain minimiser of the same risk, and the prior on known mixtures."""

import numpy as np
import pytest

from selroute.llm import pu_quality


def mixture(prior, n=3000, shift=2.2, seed=0, width=4):
    rng = np.random.default_rng(seed)
    positive = rng.normal(size=(n, width)) + np.eye(width)[0] * shift
    is_good = rng.random(n) < prior
    unlabelled = rng.normal(size=(n, width)) + np.where(is_good[:, None], np.eye(width)[0] * shift, 0)
    return positive, unlabelled, is_good


def risk(theta, p, u, prior, decay):
    """Non-negative unbiased risk with the logistic loss, and its penalty."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    sure, rest = prior * loss(p @ theta), loss(-(u @ theta)) - prior * loss(-(p @ theta))
    return sure + max(0.0, rest) + decay / 2 * theta @ theta, rest


def plain_minimum(p, u, prior, decay):
    """While its second part is above zero the risk is convex: a line search down the gradient finds the least value."""
    theta = np.zeros(p.shape[1])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    value, _ = risk(theta, p, u, prior, decay)
    step = 1.0
    for _ in range(4000):
        g = prior * p.T @ (sigmoid(p @ theta) - 1) / len(p) + u.T @ sigmoid(u @ theta) / len(u) - prior * p.T @ sigmoid(p @ theta) / len(p) + decay * theta
        while step > 1e-12 and risk(theta - step * g, p, u, prior, decay)[0] > value:
            step /= 2
        theta = theta - step * g
        new = risk(theta, p, u, prior, decay)[0]
        if value - new < 1e-12:
            break
        value, step = new, step * 2
    return theta, value


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_fit_reaches_the_least_risk(prior):
    positive, unlabelled, is_good = mixture(prior)
    model = pu_quality.fit(positive, unlabelled)
    p, u = (np.c_[pu_quality._expand((x - model.mean) / model.scale), np.ones(len(x))] for x in (positive, unlabelled))
    decay = 1e-3 + 2 / min(len(p), len(u))
    _, least = plain_minimum(p, u, model.prior, decay)
    got, rest = risk(np.append(model.weights, model.bias), p, u, model.prior, decay)
    assert got <= least + 2e-3 and rest > -1e-3
    found = model.logits(unlabelled) >= 0
    assert (found == is_good).mean() > 0.82  # two normal clouds 2.2 apart: 0.87 at best for even shares


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
@pytest.mark.parametrize("seed", [1, 2])
def test_prior_of_known_mixtures(prior, seed):
    positive, unlabelled, _ = mixture(prior, shift=3.5, seed=seed)
    assert abs(pu_quality.fit(positive, unlabelled).prior - prior) < 0.08


def test_equal_inputs_give_equal_models():
    positive, unlabelled, _ = mixture(0.5, n=400)
    a, b = (pu_quality.fit(positive, unlabelled) for _ in range(2))
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior
