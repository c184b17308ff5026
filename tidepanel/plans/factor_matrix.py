"""The daily factor panel: core, secondary and style factors from one return panel.

Three dependency levels make three passes: raw factors and core regressors, residuals on
two factors, residuals on four. All factors of a level are rows of one table. ``by`` names
further key columns (universes, currencies of account): all of them run in the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import factors as X
from tidepanel.operators import panel as P
from tidepanel.session import cut_lineage

# Index tickers by role, in order of preference.
EQUITY = ["MXCXDMHR", "MXWD"]
RATES = ["LGY7TRUH", "LBUSTRUU"]
CREDIT_REQUIRED = ["LUACTRUU", "LF98TRUU"]
CREDIT_OPTIONAL = ["LP05TRUH", "LP01TRUH"]
COMMODITIES = ["BCOMTR", "SPGSCITR"]
EM_EQUITY = ["MXEF", "M1EF"]
WORLD_EQUITY = "MXWD"
EM_CREDIT = ["EMUSTRUU", "JPEIGLBL"]
US_CREDIT = "LUACTRUU"
INFLATION_LINKED = ["BCIT5T", "LBUTTRUU"]
PUT_WRITE = ["PUT"]
LOCAL_EQUITY = ["RU30INTR"]
TREND_ASSETS = ["MXCXDMHR", "MXWD", "LGY7TRUH", "LBUSTRUU", "LUACTRUU", "BCOMTR", "SPGSCITR"]
STYLE_FACTORS = {"Mkt_RF": "FF_Market", "SMB": "FF_SMB", "HML": "FF_HML", "RMW": "FF_RMW", "CMA": "FF_CMA"}
ALL_TICKERS = [
    "MXCXDMHR", "LGY7TRUH", "LUACTRUU", "LF98TRUU", "LP05TRUH", "LP01TRUH", "BCOMTR", "MXEF", "EMUSTRUU", "BCIT5T", "PUT", "MXWD",
    "LEGATRUU", "RU30INTR", "SPGSCITR", "LBUSTRUU", "JPEIGLBL", "M1EF",
]
# First daily date of series that were monthly before.
DAILY_FROM = {
    "MXCXDMHR": "2002-01-02", "LGY7TRUH": "2001-11-22", "LUACTRUU": "1989-01-03", "LF98TRUU": "1998-08-07", "LBUSTRUU": "1989-01-03",
    "LEGATRUU": "1999-01-04", "EMUSTRUU": "1997-01-02", "LP05TRUH": "2000-08-17", "LP01TRUH": "2000-07-07",
}
# Series whose flat prices are holiday carries.
HOLIDAY_CARRY = ["BCIT5T", "LUACTRUU", "LF98TRUU", "LP05TRUH", "LP01TRUH", "LBUSTRUU", "PUT", "EMUSTRUU", "MXCXDMHR"]
# Currency pairs, those quoted per dollar, and the economies behind them.
FX_INVERT = ["USDJPY", "USDCHF", "USDCAD", "USDNOK", "USDSEK"]
FX_ECONOMIES = {
    "EURUSD": ["France", "Germany", "Italy", "Spain"], "USDJPY": ["Japan"], "USDCHF": ["Switzerland"], "USDCAD": ["Canada"],
    "AUDUSD": ["Australia"], "NZDUSD": ["New Zealand"], "USDNOK": ["Norway"], "USDSEK": ["Sweden"], "GBPUSD": ["United Kingdom"],
}
# Recommended first dates by scope.
STARTS = {"full": "2002-01-02", "reduced": "1999-01-04", "extended": "1987-07-01"}


@dataclass
class FactorPlan:
    """Factors in long form ``(by…, factor, date, value)`` and the ones that could not be built."""

    factors: DataFrame
    names: list[str]
    skipped: list[tuple[str, str]] = field(default_factory=list)
    by: tuple[str, ...] = ()


def clean_prices(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Business-day prices: mixed-frequency fill, then stale runs of carried series removed."""
    from tidepanel.sources.shaping import with_daily_from

    panel = P.align_to_calendar(with_daily_from(prices, DAILY_FROM), ["series_id"], "price", start, end, daily_from="daily_from")
    daily = F.col("date") >= F.coalesce("daily_from", F.lit(start).cast("date"))
    panel = panel.withColumn("_daily", daily).withColumn("_kept", F.col("price"))
    stripped = P.strip_stale(panel, ["series_id"], "price", section="_daily")
    chosen = F.when(F.col("series_id").isin(*HOLIDAY_CARRY) & F.col("_daily"), F.col("price")).otherwise(F.col("_kept"))
    return stripped.select("series_id", "date", chosen.alias("price"))


def _present(returns: DataFrame, names: Sequence[str]) -> set[str]:
    rows = returns.where(F.col("series_id").isin(*names) & F.col("ret").isNotNull()).select("series_id").distinct().collect()
    return {r["series_id"] for r in rows}


def _first(present: set[str], names: Sequence[str]) -> str | None:
    return next((n for n in names if n in present), None)


def _series(returns: DataFrame, name: str, factor: str, by: Sequence[str] = ()) -> DataFrame:
    return returns.where(F.col("series_id") == name).select(*by, F.lit(factor).alias("factor"), "date", F.col("ret").alias("value"))


def _regressors(factors: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per date with the named factors as an array."""
    cells = [F.max(F.when(F.col("factor") == n, F.col("value"))) for n in names]
    return factors.where(F.col("factor").isin(*names)).groupBy(*by, "date").agg(F.array(*cells).alias("x"))


def residualise(targets: DataFrame, factors: DataFrame, on: Sequence[str], halflife: int, min_periods: int, by: Sequence[str] = ()) -> DataFrame:
    x = _regressors(factors, on, by)
    joined = targets.join(x if by else P.per_date(x), [*by, "date"]).withColumnRenamed("value", "y")
    out = X.ew_residual(joined, [*by, "factor"], len(on), halflife=halflife, min_periods=min_periods, out="value")
    return out.select(*by, "factor", "date", "value")


def core_factors(returns: DataFrame, halflife: int = 60, min_periods: int = 126, present: set[str] | None = None, by: Sequence[str] = ()) -> FactorPlan:
    """Equity and rates as they are; credit and commodities net of both."""
    present = present if present is not None else _present(returns, ALL_TICKERS)
    equity, rates, commodity = _first(present, EQUITY), _first(present, RATES), _first(present, COMMODITIES)
    missing = [n for n in CREDIT_REQUIRED if n not in present]
    if not (equity and rates and commodity) or missing:
        raise KeyError(f"core series missing: {missing or [EQUITY, RATES, COMMODITIES]}")
    base = _series(returns, equity, "Equity", by).unionByName(_series(returns, rates, "Interest_Rates", by))
    legs = returns.where(F.col("series_id").isin(*CREDIT_REQUIRED, *[n for n in CREDIT_OPTIONAL if n in present]))
    credit = X.inverse_vol_mix(legs.withColumn("factor", F.lit("Credit")), [*by, "factor"], "series_id")
    raw = credit.unionByName(_series(returns, commodity, "Commodities", by))
    residual = residualise(raw, base, ["Equity", "Interest_Rates"], halflife, min_periods, by)
    return FactorPlan(base.unionByName(residual), ["Equity", "Interest_Rates", "Credit", "Commodities"], by=tuple(by))


def _spread(returns: DataFrame, left: str, right: str, leg: str, by: Sequence[str]) -> DataFrame:
    out = P.spread(returns.withColumnRenamed("ret", "value"), left, right, leg, by=by)
    return out.select(*by, F.lit("Emerging_Markets").alias("factor"), F.col("series_id").alias("leg"), "date", F.col("value").alias("ret"))


def secondary_factors(
    returns: DataFrame, core: FactorPlan, currency: DataFrame | None = None, halflife: int = 60, min_periods: int = 126, lookback: int = 252,
    include_trend: bool = True, include_local_equity: bool = True, present: set[str] | None = None,
) -> FactorPlan:
    """Factors net of the four core ones; those whose series are missing are skipped and named."""
    by = core.by
    present = present if present is not None else _present(returns, [*ALL_TICKERS, *INFLATION_LINKED])
    raw: dict[str, DataFrame] = {}
    skipped: list[tuple[str, str]] = []

    def single(factor: str, names: Sequence[str]) -> None:
        found = _first(present, names)
        if found:
            raw[factor] = _series(returns, found, factor, by)
        else:
            skipped.append((factor, f"none of {list(names)} available"))

    legs = []
    em_equity, em_credit = _first(present, EM_EQUITY), _first(present, EM_CREDIT)
    if em_equity and WORLD_EQUITY in present:
        legs.append(_spread(returns, em_equity, WORLD_EQUITY, "equity", by))
    if em_credit and US_CREDIT in present:
        legs.append(_spread(returns, em_credit, US_CREDIT, "credit", by))
    if len(legs) == 2:
        raw["Emerging_Markets"] = X.inverse_vol_mix(legs[0].unionByName(legs[1]), [*by, "factor"], "leg")
    elif legs:
        raw["Emerging_Markets"] = legs[0].select(*by, "factor", "date", F.col("ret").alias("value"))
    else:
        skipped.append(("Emerging_Markets", "no spread can be formed"))
    if currency is not None:
        raw["Foreign_Currency"] = currency.select(*by, F.lit("Foreign_Currency").alias("factor"), "date", "value")
    else:
        skipped.append(("Foreign_Currency", "no currency basket given"))
    single("Local_Inflation", INFLATION_LINKED)
    single("Short_Volatility", PUT_WRITE)
    if include_trend:
        assets = [n for n in TREND_ASSETS if n in present]
        if assets:
            panel = returns.where(F.col("series_id").isin(*assets)).withColumn("factor", F.lit("Trend_Following"))
            raw["Trend_Following"] = X.momentum(panel, [*by, "factor"], "series_id", lookback=lookback)
        else:
            skipped.append(("Trend_Following", "no asset returns"))
    if include_local_equity:
        single("Local_Equity", LOCAL_EQUITY)
    return FactorPlan(residualise(_union(list(raw.values()), by), core.factors, core.names, halflife, min_periods, by), list(raw), skipped, by)


def style_factors(style: DataFrame, core: FactorPlan, residual: bool = True, halflife: int = 60, min_periods: int = 126) -> FactorPlan:
    """Five style series, net of the core factors unless ``residual`` is off."""
    names = F.create_map(*[F.lit(x) for kv in STYLE_FACTORS.items() for x in kv])
    raw = style.where(F.col("series_id").isin(*STYLE_FACTORS)).select(*core.by, names[F.col("series_id")].alias("factor"), "date", F.col("ret").alias("value"))
    out = residualise(raw, core.factors, core.names, halflife, min_periods, core.by) if residual else raw
    return FactorPlan(out, list(STYLE_FACTORS.values()), by=core.by)


def _union(frames: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    columns = [*by, "factor", "date", "value"]
    out = frames[0].select(*columns)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*columns))
    return out


def factor_matrix(returns: DataFrame, style: DataFrame | None = None, currency: DataFrame | None = None, halflife: int = 60,
                  min_periods: int = 126, threshold: float = 0.5, by: Sequence[str] = ()) -> FactorPlan:
    """All factors, on the dates where at most ``threshold`` of them are missing.

    Three small tables are read many times and therefore written once: the returns of the
    named tickers, the core factors, and the assembled panel.
    """
    returns = cut_lineage(returns.where(F.col("series_id").isin(*ALL_TICKERS, *INFLATION_LINKED)))
    present = _present(returns, [*ALL_TICKERS, *INFLATION_LINKED])
    core = core_factors(returns, halflife, min_periods, present, by)
    core = FactorPlan(cut_lineage(core.factors), core.names, by=tuple(by))
    second = secondary_factors(returns, core, currency, halflife, min_periods, present=present)
    parts, names = [core.factors, second.factors], [*core.names, *second.names]
    if style is not None:
        styled = style_factors(style, core, halflife=halflife, min_periods=min_periods)
        parts.append(styled.factors)
        names += styled.names
    everything = cut_lineage(_union(parts, by))
    return FactorPlan(P.null_fraction_rows(everything, threshold, len(names), by=by), names, second.skipped, tuple(by))


def complete_vectors(plan: FactorPlan, factors: Sequence[str] | None = None) -> DataFrame:
    """Dates on which every chosen factor is known, as ``(date, x)``; unknown names raise."""
    names = list(factors) if factors is not None else plan.names
    unknown = [n for n in names if n not in plan.names]
    if unknown:
        raise KeyError(f"factors not in the panel: {unknown}")
    wide = _regressors(plan.factors, names, plan.by)
    return wide.where(F.forall("x", lambda v: v.isNotNull()))
