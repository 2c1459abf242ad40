"""BM25: the inverse document frequency on the driver, the rest as a Column."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class PythonSimilarity:
    """Any object with term_score(tf, df, n, dl, avgdl) as a similarity, by an Arrow-batched UDF: slower, but free."""

    def __init__(self, scorer):
        self.scorer, self.n = scorer, 0

    def idf(self, df: int, n: int) -> float:
        """Carries df to the column; n is the same for all terms."""
        self.n = n
        return float(df)

    def column(self, idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
        scorer, n = self.scorer, self.n

        def score(tf: pd.Series, df: pd.Series, dl: pd.Series, avgdl: pd.Series) -> pd.Series:
            return pd.Series([float(scorer.term_score(int(t), int(d), n, int(x), float(a))) for t, d, x, a in zip(tf, df, dl, avgdl, strict=True)])

        return F.pandas_udf(score, "double")(tf, idf, dl, avgdl)


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if not math.isfinite(self.k1) or self.k1 <= 0:
            raise ValueError("k1 must be finite and above 0")
        if not math.isfinite(self.b) or not 0 <= self.b <= 1:
            raise ValueError("b must be between 0 and 1")

    def idf(self, df: int, n: int) -> float:
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) if df > 0 and n > 0 else 0.0

    def term_score(self, tf: int, df: int, n: int, dl: float, avgdl: float) -> float:
        if tf <= 0 or df <= 0 or n <= 0:
            return 0.0
        norm = 1 - self.b + self.b * (dl / avgdl if avgdl > 0 else 0.0)
        return self.idf(df, n) * (tf * (self.k1 + 1)) / (tf + self.k1 * norm)

    def column(self, idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
        """The same in the same order of operations, so results agree to the last bit."""
        k1, b = F.lit(float(self.k1)), F.lit(float(self.b))
        ratio = F.when(avgdl > 0, dl.cast("double") / avgdl).otherwise(0.0)
        norm = F.lit(1.0) - b + b * ratio
        return idf * (tf * (k1 + 1.0)) / (tf + k1 * norm)
