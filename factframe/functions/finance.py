"""Derived metrics as null-safe column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return a / F.nullif(b, F.lit(0.0)) * scale


def derived() -> dict[str, Column]:
    """Name -> expression over a wide snapshot; null where an input is null or a divisor zero."""
    c = F.col
    ebit = c("revenue") - c("total_tax")
    return {
        "net_debt": c("total_debt") - c("cash"),
        "net_cash": c("cash") - c("total_debt"),
        "ebit": ebit,
        "ebitda": ebit + c("capex"),
        "ebit_margin_pct": ratio(ebit, c("revenue"), 100.0),
        "ebitda_margin_pct": ratio(ebit + c("capex"), c("revenue"), 100.0),
        "pat_margin_pct": ratio(c("revenue") - c("finance_cost") - c("total_tax"), c("revenue"), 100.0),
        "capex_intensity_pct": ratio(c("capex"), c("revenue"), 100.0),
        "fcf_gaap": c("cash") - c("capex"),
        "cost_of_debt_pct": ratio(c("finance_cost"), c("total_debt"), 100.0),
        "effective_tax_pct": ratio(c("total_tax"), c("revenue"), 100.0),
        "interest_coverage": ratio(ebit, c("finance_cost")),
    }


DERIVED_SQL = {
    "net_debt": "total_debt - cash",
    "net_cash": "cash - total_debt",
    "ebit": "revenue - total_tax",
    "ebitda": "revenue - total_tax + capex",
    "ebit_margin_pct": "(revenue - total_tax) / nullif(revenue, 0) * 100",
    "ebitda_margin_pct": "(revenue - total_tax + capex) / nullif(revenue, 0) * 100",
    "pat_margin_pct": "(revenue - finance_cost - total_tax) / nullif(revenue, 0) * 100",
    "capex_intensity_pct": "capex / nullif(revenue, 0) * 100",
    "fcf_gaap": "cash - capex",
    "cost_of_debt_pct": "finance_cost / nullif(total_debt, 0) * 100",
    "effective_tax_pct": "total_tax / nullif(revenue, 0) * 100",
    "interest_coverage": "(revenue - total_tax) / nullif(finance_cost, 0)",
}
