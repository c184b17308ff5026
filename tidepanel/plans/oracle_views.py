"""The panels of ``views`` as DuckDB common table expressions, by name, with their dependencies."""

from __future__ import annotations

from tidepanel.plans.views import END, EVENT_TYPES, GAMMAS, MACRO_CODES, PORTFOLIOS, START


def r(expr: str, digits: int = 6) -> str:
    """The rounding of ``functions.expr.rounded``."""
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})"


def _cents(c: str) -> str:
    return f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS BIGINT)"


_CODES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MACRO_CODES.items())
_TYPES = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(EVENT_TYPES))
_BOOKS = ", ".join(f"('{s}', {g}::DOUBLE, {ws}::DOUBLE[])" for s, ws in PORTFOLIOS.items() for g in GAMMAS)

VIEWS: dict[str, str] = {
    "prices_raw": """SELECT p_brand AS series_id, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey,
        l_suppkey, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "prices": f"""SELECT p_brand AS series_id, CAST(l_shipdate AS DATE) AS date, {_cents('l_extendedprice')} / (100.0::DOUBLE * sum(l_quantity)) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "calendar": f"""SELECT CAST(d AS DATE) AS date, row_number() OVER (ORDER BY d) AS bidx
        FROM generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6""",
    "grid": "SELECT s.series_id, c.date, c.bidx FROM (SELECT DISTINCT series_id FROM prices) s CROSS JOIN calendar c",
    "reindexed": "SELECT g.series_id, g.date, g.bidx, p.price FROM grid g LEFT JOIN prices p USING (series_id, date)",
    "dense_prices": """SELECT series_id, date, bidx, last_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date
        ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price FROM reindexed""",
    "returns": """SELECT series_id, date, bidx, ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY date)) AS ret
        FROM dense_prices""",
    "asset_values": f"""SELECT o_orderstatus AS universe, o_orderpriority AS asset, CAST(date_trunc('month', o_orderdate) AS DATE)
        AS month, {_cents('o_totalprice')} / 100.0::DOUBLE AS v FROM orders GROUP BY ALL""",
    "asset_returns": """SELECT a.universe, a.asset, a.month, a.v / b.v - 1 AS ret FROM asset_values a JOIN asset_values b
        ON a.universe = b.universe AND a.asset = b.asset AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)""",
    "full_returns": """SELECT * FROM asset_returns QUALIFY count(*) OVER (PARTITION BY universe, month) =
        (SELECT count(DISTINCT asset) FROM asset_returns b WHERE b.universe = asset_returns.universe)""",
    "states": f"""SELECT user_id AS seq_id, ts, event_id, CAST(CASE event_type {_TYPES} END AS BIGINT) AS state FROM events""",
    "states_monthly": f"""SELECT universe, month, state FROM (SELECT o_orderstatus AS universe,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderpriority[1] AS BIGINT) - 1 AS state,
        {_cents('o_totalprice')} AS v FROM orders GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY universe, month ORDER BY v DESC, state) = 1""",
    "month_share": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
        avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM orders GROUP BY ALL""",
    "flag_monthly": """SELECT month, CAST(CASE WHEN share > (SELECT quantile_cont(share, 0.5) FROM month_share) THEN 1 ELSE 0 END
        AS BIGINT) AS flag FROM month_share""",
    "macro_sums": f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag || '|' || l_linestatus AS series_id,
        {_cents('l_extendedprice')} AS v FROM lineitem GROUP BY ALL""",
    "macro_monthly": f"""SELECT month, series_id, value, CAST(CASE series_id {_CODES} END AS BIGINT) AS tcode FROM (
        SELECT month, series_id, floor(v / 100.0::DOUBLE) AS value FROM macro_sums UNION ALL
        SELECT month, 'TOTAL', floor(CAST(sum(v) AS BIGINT) / 100.0::DOUBLE) FROM macro_sums GROUP BY month)""",
    "annual_weights": f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS year, n_nationkey AS nationkey, n_name AS nation, r_name AS bloc,
        {_cents('o_totalprice')} / 100.0::DOUBLE AS gdp FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "features": "SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS BIGINT) AS label FROM embeddings",
    "features_long": """SELECT row_id, label, CAST(unnest(range(len(x))) AS BIGINT) AS feature, unnest(x) AS value FROM features""",
    "event_features": f"""SELECT user_id AS entity, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n_events,
        {_cents('value')} / (100.0::DOUBLE * count(value)) AS mean_value FROM events GROUP BY ALL""",
    "return_matrix": """SELECT universe, month, array_agg(ret ORDER BY asset) AS r FROM full_returns GROUP BY ALL""",
    "books": f"SELECT * FROM (VALUES {_BOOKS}) b(strategy, gamma, w)",
    "backtest_small": """SELECT m.universe, b.gamma, b.strategy, m.month,
        list_sum(list_transform(list_zip(m.r, b.w), lambda z: z[1] * z[2])) - b.gamma * 0.01 AS ret, s.prev_state
        FROM return_matrix m CROSS JOIN books b JOIN (SELECT universe, month, lag(state) OVER (PARTITION BY universe ORDER BY month)
        AS prev_state FROM states_monthly) s ON s.universe = m.universe AND s.month = m.month""",
}

_NEEDS: dict[str, list[str]] = {
    "grid": ["prices", "calendar"], "reindexed": ["grid"], "dense_prices": ["reindexed"],
    "returns": ["dense_prices"], "asset_returns": ["asset_values"], "full_returns": ["asset_returns"],
    "flag_monthly": ["month_share"], "macro_monthly": ["macro_sums"], "features_long": ["features"],
    "return_matrix": ["full_returns"], "backtest_small": ["return_matrix", "books", "states_monthly"],
}


def sql(query: str, *views: str, **extra: str) -> str:
    """``query`` behind the common table expressions it needs, then ``extra`` ones in the given order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in ordered]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
