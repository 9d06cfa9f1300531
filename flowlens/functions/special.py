"""Special functions as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Stirling series of the logarithm of the gamma function.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
HALF_LOG_TAU = 0.9189385332046727
SHIFT = 8


def log_gamma_sql(x: str) -> str:
    """Logarithm of the gamma function for x > 0: Stirling's series at an argument shifted upwards."""
    z = f"(CAST({x} AS double) + {SHIFT})"
    series = "0D"
    for coefficient in reversed(STIRLING):
        series = f"({series} / ({z} * {z}) + {coefficient!r}D)"
    product = " * ".join(f"(CAST({x} AS double) + {step})" for step in range(SHIFT))
    return f"(({z} - 0.5D) * ln({z}) - {z} + {HALF_LOG_TAU!r}D + {series} / {z} - ln({product}))"


def log_factorial_sql(n: str) -> str:
    return log_gamma_sql(f"({n} + 1)")


def log_factorial(n: str) -> Column:
    return F.expr(log_factorial_sql(n))
