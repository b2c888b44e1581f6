"""Two-way prices: margin removal, expected value, stakes and disagreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwise.functions.numeric import clip, known, logit

EDGE = 1e-6
METHODS = ("shin", "multiplicative", "additive", "power")


def overround(a: Column, b: Column) -> Column:
    return 1.0 / a + 1.0 / b


def _usable(a: Column, b: Column) -> Column:
    finite = ~F.isnan(a) & ~F.isnan(b) & (a < float("inf")) & (b < float("inf"))
    return known(finite & (a > 1.0) & (b > 1.0))


def _additive(x: Column, y: Column) -> Column:
    return clip((x - y + 1.0) / 2.0, EDGE, 1 - EDGE)


def _power(x: Column, y: Column, steps: int = 60) -> Column:
    """Exponent k in [1, 6] with x^k + y^k = 1, halving the bracket.

    Only the lower end is carried, as the width follows from the step: each power is taken once.
    """
    def halve(low: Column, half: Column) -> Column:
        return low + F.when(F.pow(x, low + half) + F.pow(y, low + half) > 1.0, half).otherwise(0.0)

    halves = F.array(*[F.lit(5.0 / 2**step) for step in range(1, steps + 1)])
    k = F.aggregate(halves, F.lit(1.0), halve)
    value = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.pow(x, k)))
    return F.when(x.isNotNull() & y.isNotNull(), value)


def _shin(x: Column, y: Column) -> Column:
    """With two outcomes the insider share solves in closed form: it equals the additive
    result while the prices add up to at least one, and is zero below that."""
    total = x + y
    return F.when(total >= 1.0, _additive(x, y)).otherwise(
        clip(x / F.sqrt(total), EDGE, 1 - EDGE))


def implied_probability(a: Column, b: Column, method: str = "shin") -> Column:
    """Margin-free probability of the first outcome; null without two valid prices."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    x, y = 1.0 / a, 1.0 / b
    value = {
        "multiplicative": lambda: x / (x + y), "additive": lambda: _additive(x, y),
        "power": lambda: _power(x, y), "shin": lambda: _shin(x, y),
    }[method]()
    return F.when(_usable(a, b), value)


def expected_value(probability: Column, odds: Column) -> Column:
    return probability * odds - 1.0


def kelly(probability: Column, odds: Column, cap: float = 1.0) -> Column:
    gain = odds - 1.0
    stake = F.when(gain != 0, (probability * gain - (1.0 - probability)) / gain)
    return F.coalesce(clip(stake, 0.0, cap), F.lit(0.0))


def closing_line_value(model: Column, market: Column) -> Column:
    return logit(model) - logit(market)


def bets(y: Column, p: Column, a: Column, b: Column, edge: float, scale: float | None) -> dict:
    """Stake and profit per row; a flat unit stake when ``scale`` is None."""
    back_a = known(expected_value(p, a) > edge)
    back_b = ~back_a & known(expected_value(1.0 - p, b) > edge)
    if scale is None:
        stake = F.when(back_a | back_b, 1.0).otherwise(0.0)
    else:
        stake = F.when(back_a, kelly(p, a) * scale).when(
            back_b, kelly(1.0 - p, b) * scale).otherwise(0.0)
    profit = F.when(back_a, F.when(y == 1, stake * (a - 1)).otherwise(-stake)).when(
        back_b, F.when(y == 0, stake * (b - 1)).otherwise(-stake)).otherwise(0.0)
    return {"stake": stake, "profit": profit}
