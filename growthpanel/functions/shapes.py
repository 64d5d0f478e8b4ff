"""Shapes of the growth curves and their derivatives, written once for columns and for arrays.

A curve is ``offset + height * shape`` (or ``offset + (height - offset) * shape``). A shape takes a namespace ``m`` with ``exp``,
``log1p`` and ``bounded``, the place x, and k, t0 and d (rate, midpoint and asymmetry; a curve uses those it has). ``bounded``
keeps an exponent where ``exp`` neither overflows nor vanishes, which sums of products need; for columns it does nothing.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# shapes travel to the workers with a job, so they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Arrays:
    """The namespace for NumPy arrays."""

    exp, log1p = staticmethod(np.exp), staticmethod(np.log1p)

    @staticmethod
    def bounded(z):
        return np.clip(z, -340.0, 340.0)


def _decay(m, x, k, t0):
    return m.exp(m.bounded(-k * (x - t0)))


def exponential(m, x, k, t0, d):
    return m.exp(m.bounded(k * x))


def exponential_slopes(m, x, k, t0, d):
    return x * exponential(m, x, k, t0, d), 0.0, 0.0


def logistic(m, x, k, t0, d):
    return 1.0 / (1.0 + _decay(m, x, k, t0))


def logistic_slopes(m, x, k, t0, d):
    e = _decay(m, x, k, t0)
    slope = e / ((1.0 + e) * (1.0 + e))
    return slope * (x - t0), -slope * k, 0.0


def richards(m, x, k, t0, d):
    return m.exp(-m.log1p(_decay(m, x, k, t0)) / d)


def richards_slopes(m, x, k, t0, d):
    e = _decay(m, x, k, t0)
    rise = m.log1p(e)
    u = m.exp(-rise / d)
    slope = u / d * (e / (1.0 + e))
    return slope * (x - t0), -slope * k, u * rise / (d * d)


def gompertz(m, x, k, t0, d):
    return m.exp(-_decay(m, x, k, t0))


def gompertz_slopes(m, x, k, t0, d):
    e = _decay(m, x, k, t0)
    slope = m.exp(-e) * e
    return slope * (x - t0), -slope * k, 0.0


def monomolecular(m, x, k, t0, d):
    """Growth that slows down from the first week: not among the four known curves, ready to be registered."""
    return 1.0 - m.exp(m.bounded(-k * x))


def monomolecular_slopes(m, x, k, t0, d):
    return x * m.exp(m.bounded(-k * x)), 0.0, 0.0
