"""The growth curves: a registry of shapes from which columns, fits, reports and ensembles are made.

Every curve is linear in two of its parameters once the others are given::

    y = alpha + beta * shape(x; k, t0, d)

so a fit only has to search over ``k``, ``t0`` and ``d``; ``alpha`` and ``beta`` follow in closed form from sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from growthpanel.functions import shapes
from growthpanel.functions.columns import nan_to_null

ASYMMETRY_BOUNDS = (0.1, 10.0)
#: what a parameter can be: every curve has the first two and the last one
ROLES = ("height", "rate", "midpoint", "asymmetry", "offset")


@dataclass(frozen=True)
class Curve:
    """One curve; ``register`` makes it known.

    ``shape(m, x, k, t0, d)`` and ``slopes(...)``, its derivatives by k, t0 and d, are written once for columns and arrays (see
    ``shapes``). ``roles`` says what each of ``parameters`` is. Heights are bounded by multiples of the series' maximum;
    ``absolute`` marks curves whose height is their upper asymptote, offset included.
    """

    name: str
    parameters: tuple[str, ...]
    roles: tuple[str, ...]
    shape: Callable
    slopes: Callable
    start_rate: float
    rate_bounds: tuple[float, float]
    start_height: float = 1.2
    #: start height where the series has no positive maximum
    spare_height: float = 1.2
    height_bounds: tuple[float, float] = (1.0, 2.0)
    absolute: bool = False
    asymmetry_bounds: tuple[float, float] = ASYMMETRY_BOUNDS

    def __post_init__(self):
        if len(self.parameters) != len(self.roles) or len(set(self.parameters)) != len(self.parameters):
            raise ValueError(f"{self.name}: every parameter needs a name and a role of its own")
        if not set(self.roles) <= set(ROLES) or len(set(self.roles)) != len(self.roles) or not {"height", "rate", "offset"} <= set(self.roles):
            raise ValueError(f"{self.name}: roles are height, rate and offset, and at most one midpoint and asymmetry")
        if not 0 < self.rate_bounds[0] < self.rate_bounds[1] or not 0 < self.asymmetry_bounds[0] < self.asymmetry_bounds[1]:
            raise ValueError(f"{self.name}: bounds must be positive and ascend")

    @property
    def order(self) -> int:
        """The place in fit order, which breaks ties between models."""
        return CURVE_NAMES.index(self.name)

    @property
    def rate(self) -> str:
        return self.parameters[self.rate_index]

    @property
    def rate_index(self) -> int:
        return self.roles.index("rate")

    @property
    def fits_midpoint(self) -> bool:
        return "midpoint" in self.roles

    @property
    def fits_asymmetry(self) -> bool:
        return "asymmetry" in self.roles

    def place(self, role: str) -> int | None:
        return self.roles.index(role) if role in self.roles else None

    def for_workers(self) -> SimpleNamespace:
        """What a fit needs, as plain values and functions, so that workers need not have this package."""
        names = ("name", "shape", "slopes", "rate_bounds", "height_bounds", "absolute", "asymmetry_bounds", "fits_midpoint", "fits_asymmetry")
        return SimpleNamespace(**{n: getattr(self, n) for n in names})


#: all known curves, and their names in fit order
CURVES: dict[str, Curve] = {}
CURVE_NAMES: list[str] = []


def register(curve: Curve) -> Curve:
    """Make a curve known to fits, ensembles, forecasts and reports of this session. Names are not taken twice."""
    if curve.name in CURVES:
        raise ValueError(f"there is a curve named {curve.name}")
    CURVES[curve.name] = curve
    CURVE_NAMES.append(curve.name)
    return curve


def unregister(name: str) -> None:
    del CURVES[name]
    CURVE_NAMES.remove(name)


@contextmanager
def registered(curve: Curve) -> Iterator[Curve]:
    """A curve that is known inside a block only; what is read lazily must be read inside it."""
    try:
        yield register(curve)
    finally:
        unregister(curve.name)


# Names, parameter order, start values and bounds that results depend on.
_FOUR, _SIGMOID = ("height", "rate", "midpoint", "offset"), (0.001, 0.1)
register(
    Curve(
        "Exponential", ("a", "b", "c"), ("height", "rate", "offset"), shapes.exponential, shapes.exponential_slopes,
        0.005, (0.0001, 0.1), start_height=0.5, spare_height=1.0, height_bounds=(0.0, 2.0),
    )
)
register(Curve("Logistic", ("L", "k", "t0", "c_offset"), _FOUR, shapes.logistic, shapes.logistic_slopes, 0.01, _SIGMOID))
register(Curve("Richards", ("L", "k", "t0", "nu", "c_offset"), ROLES, shapes.richards, shapes.richards_slopes, 0.01, _SIGMOID))
register(Curve("Gompertz", ("L", "k", "t0", "c_offset"), _FOUR, shapes.gompertz, shapes.gompertz_slopes, 0.01, _SIGMOID, absolute=True))


class _Columns:
    """The namespace of shapes for Spark columns, which keep infinities."""

    exp, log1p = staticmethod(F.exp), staticmethod(F.log1p)

    @staticmethod
    def bounded(z):
        return z


def evaluate(name: str, x: Column, params: Column) -> Column:
    """One curve at ``x`` with its parameters in an array column; NaN becomes NULL."""
    curve = CURVES[name]
    at = {role: F.get(params, F.lit(i)) for i, role in enumerate(curve.roles)}
    shape = curve.shape(_Columns, x, at["rate"], at.get("midpoint", F.lit(0.0)), at.get("asymmetry", F.lit(1.0)))
    rise = at["height"] - at["offset"] if curve.absolute else at["height"]
    return nan_to_null(rise * shape + at["offset"])


def evaluate_by_name(model: Column, x: Column, params: Column) -> Column:
    """The curve named in ``model`` at ``x``, chosen row by row."""
    return by_curve(model, lambda curve: evaluate(curve.name, x, params))


def by_curve(model: Column, value_of) -> Column:
    """A constant or column per curve as a Column, e.g. its order or its number of parameters; NULL is None."""
    chosen = None
    for curve in CURVES.values():
        value = value_of(curve)
        value = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(model == curve.name, value) if chosen is None else chosen.when(model == curve.name, value)
    return chosen
