"""One-way trading costs by company size."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions.columns import col, log10_points, piecewise_linear

# Fixed values: (market cap in dollars, one-way cost in basis points).
SIZE_ANCHORS = ((1e7, 150.0), (5e7, 80.0), (2.5e8, 40.0), (1e9, 20.0), (1e10, 8.0), (1e11, 5.0))
CAP_WHEN_MISSING = 1e7
CAP_FLOOR = 1e5


@dataclass(frozen=True)
class CostModel:
    kind: str = "size"
    flat_bps: float = 20.0
    size_anchors: tuple[tuple[float, float], ...] = SIZE_ANCHORS
    multiplier: float = 1.0

    def one_way(self, market_cap: Column | str) -> Column:
        """Cost per unit of traded weight: flat, or interpolated on the logarithm of the capitalisation."""
        if self.kind == "flat":
            bps = F.lit(float(self.flat_bps))
        elif self.kind == "size":
            size = F.log10(F.greatest(F.coalesce(col(market_cap), F.lit(CAP_WHEN_MISSING)), F.lit(CAP_FLOOR)))
            bps = piecewise_linear(size, log10_points(self.size_anchors))
        else:
            raise ValueError(f"unknown cost model {self.kind!r}")
        return bps * F.lit(self.multiplier / 1e4)


NO_COST = CostModel("flat", 0.0)
