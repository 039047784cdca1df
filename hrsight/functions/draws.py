"""Seeded random draws as SQL text that Spark and another SQL engine evaluate alike.

A draw is a function of (seed, stream, key): the md5 of the three, of which 13
hex digits make a 52-bit integer and so a uniform number in (0, 1). No state is
carried from row to row, so a draw depends neither on partitioning nor on
reruns, and a recomputed partition repeats it. One md5 holds two uniforms.

Normal draws are the inverse normal distribution of one uniform by a rational
approximation (relative error under 1.2e-9): between its two tails it takes
plain arithmetic only, which every IEEE engine rounds the same way.

All builders take and return SQL text; ``key`` is the text of a non-NULL string
expression. The dialects differ in how hex digits become an integer.
"""

from __future__ import annotations

import math

# Coefficients of the inverse normal approximation (Acklam): numerator and denominator of the middle part,
# then of the tails, and where the tails begin.
MID_NUM = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
           -3.066479806614716e+01, 2.506628277459239e+00)
MID_DEN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
           -1.328068155288572e+01, 1.0)
TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
            4.374664141464968e+00, 2.938163982698783e+00)
TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
TAIL = 0.02425

#: Hex digits of one uniform; 52 bits are exact in a double.
DIGITS = 13

SPARK, DUCKDB = "spark", "duckdb"


def num(x: float) -> str:
    """A double literal (an exponent makes it one in both engines) that reads back as ``x``."""
    return f"{x:.17e}"


def uniform(key: str, stream: int, seed: int, dialect: str = SPARK) -> str:
    """Uniform in (0, 1); streams 2n and 2n + 1 share one md5."""
    digest = f"md5(concat('{seed}:{stream // 2}:', {key}))"
    digits = f"substr({digest}, {1 + stream % 2 * DIGITS}, {DIGITS})"
    whole = f"conv({digits}, 16, 10)" if dialect == SPARK else f"concat('0x', {digits})"
    return f"((CAST(CAST({whole} AS BIGINT) AS DOUBLE) + {num(0.5)}) / {num(float(1 << 4 * DIGITS))})"


def _poly(coefficients, x: str) -> str:
    text = num(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {num(c)})"
    return text


def normal(u: str, mean: float = 0.0, sd: float = 1.0) -> str:
    """Normal draw from the text of a uniform; name long texts first (a column), ``u`` is repeated often."""
    q = f"({u} - {num(0.5)})"
    r = f"({q} * {q})"
    mid = f"{_poly(MID_NUM, r)} * {q} / {_poly(MID_DEN, r)}"
    low = f"sqrt({num(-2.0)} * ln({u}))"
    high = f"sqrt({num(-2.0)} * ln({num(1.0)} - {u}))"
    z = (f"CASE WHEN {u} < {num(TAIL)} THEN {_poly(TAIL_NUM, low)} / {_poly(TAIL_DEN, low)} "
         f"WHEN {u} > {num(1.0 - TAIL)} THEN -({_poly(TAIL_NUM, high)} / {_poly(TAIL_DEN, high)}) ELSE {mid} END")
    return f"({num(mean)} + {num(sd)} * ({z}))"


def exponential(u: str, scale: float) -> str:
    return f"({num(-scale)} * ln({num(1.0)} - {u}))"


def integer(u: str, lo: int, hi: int) -> str:
    """Integer in [lo, hi)."""
    return f"({lo} + CAST(floor({u} * {num(float(hi - lo))}) AS INT))"


def literal(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def ladder(u: str, steps) -> str:
    """The first value of ``steps`` (value, probability) whose cumulated probability exceeds ``u``; the last one has the rest."""
    steps, upto, cases = list(steps), 0.0, []
    for v, p in steps[:-1]:
        upto += p
        cases.append(f"WHEN {u} < {num(upto)} THEN {literal(v)}")
    return f"CASE {' '.join(cases)} ELSE {literal(steps[-1][0])} END" if cases else literal(steps[-1][0])


def choice(u: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values[:-1]))
    return f"CASE CAST(floor({u} * {num(float(len(values)))}) AS INT) {cases} ELSE {literal(values[-1])} END"


def poisson(u: str, lam: float, cap: int) -> str:
    """Poisson draw, at most ``cap``."""
    steps, p = [], math.exp(-lam)
    for k in range(cap):
        steps.append((k, p))
        p *= lam / (k + 1)
    return ladder(u, [*steps, (cap, 0.0)])


def clipped(x: str, lo: int, hi: int) -> str:
    """Cut to [lo, hi], then to an integer (towards zero)."""
    kept = f"least(greatest({x}, {num(float(lo))}), {num(float(hi))})"
    return f"CAST(CASE WHEN {kept} < 0 THEN ceil({kept}) ELSE floor({kept}) END AS INT)"
