"""p-values of the drift tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value with Stephens' small-sample correction."""
    en = F.sqrt(F.try_divide(n1.cast("double") * n2.cast("double"), (n1 + n2).cast("double")))
    lam = (en + 0.12 + 0.11 / en) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * lam * lam))
    series = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    # the series converges slowly near 0, where the p-value is 1 to many digits
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution; 1 when there are no degrees of freedom."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        from math import exp, lgamma, log

        def upper(a, z):
            # regularised upper incomplete gamma: power series below a + 1, continued fraction above
            if z <= 0:
                return 1.0
            scale = exp(-z + a * log(z) - lgamma(a))
            if z < a + 1:
                term = total = 1.0 / a
                n = a
                while abs(term) > 1e-16 * abs(total):
                    n += 1
                    term *= z / n
                    total += term
                return max(0.0, 1.0 - total * scale)
            b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
            h, i = d, 0
            while i < 100000:
                i += 1
                an = -i * (i - a)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return h * scale

        return pd.Series([1.0 if df < 1 else upper(df / 2, v / 2) for v, df in zip(x, k)], dtype="float64")

    return tail(stat.cast("double"), dof.cast("double"))
