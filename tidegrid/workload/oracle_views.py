"""DuckDB text of the stand-in views and of shared sub-results (the Spark side is ``views``)."""

from __future__ import annotations

from tidegrid.functions.coords import Albers

CRS = Albers()
_E = CRS.e


def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    q = (
        f"({1 - CRS.e2!r}::DOUBLE * ({s} / (1 - {CRS.e2!r}::DOUBLE * {s} * {s})"
        f" - ln((1 - {_E!r}::DOUBLE * {s}) / (1 + {_E!r}::DOUBLE * {s})) / {2 * _E!r}::DOUBLE))"
    )
    rho = f"({CRS.a!r}::DOUBLE * sqrt({CRS.c!r}::DOUBLE - {CRS.n!r}::DOUBLE * {q}) / {CRS.n!r}::DOUBLE)"
    theta = f"({CRS.n!r}::DOUBLE * radians({lon} - ({CRS.lon0!r}::DOUBLE)))"
    return (
        f"({CRS.x0!r}::DOUBLE + {rho} * sin({theta}))",
        f"({CRS.rho0!r}::DOUBLE - {rho} * cos({theta}))",
    )


_X, _Y = albers_sql("lon", "lat")

def value_sql(number: str | int, e: str = "e") -> str:
    """The stand-in value of a numbered parameter, as in views.value."""
    k = f"({number})"
    return f"({e}[CAST(1 + {k} % 64 AS BIGINT)] * cos({k}::DOUBLE) + {e}[CAST(1 + ({k} * 7 + 3) % 64 AS BIGINT)] * sin({k}::DOUBLE))"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, text: str, *needs: str) -> None:
    VIEWS[name] = (needs, text)


view(
    "surveys",
    """
    SELECT l_suppkey AS site,
           concat(l_returnflag, l_linestatus) AS source,
           CAST(l_shipdate AS DATE) AS obs_date,
           CAST(year(l_shipdate) AS INTEGER) AS year,
           CASE WHEN l_partkey % 97 <> 0 THEN 48e0 + (l_partkey % 400) / 1e2 END AS lat,
           CASE WHEN l_partkey % 97 <> 0 THEN -(123e0 + (l_partkey % 700) / 1e2) END AS lon,
           CASE WHEN l_partkey % 89 = 0 THEN NULL
                WHEN l_partkey % 5 < 3 AND l_orderkey % 13 <> 0 THEN 0e0
                ELSE CAST(CAST(l_quantity AS BIGINT) % 13 AS DOUBLE) END AS num_target,
           CASE WHEN l_linestatus = 'F' AND l_partkey % 7 <> 0 THEN l_quantity END AS bottom_time,
           CASE WHEN l_linestatus = 'O' AND l_partkey % 7 <> 0 THEN l_tax * 100 + l_quantity END AS area,
           l_orderkey, l_linenumber, l_partkey
    FROM lineitem
    """,
)
view(
    "text_dates",
    """
    SELECT event_id AS formid,
           CAST((user_id % 4 + 1) * 10000 + user_id AS VARCHAR) AS geogr,
           CASE WHEN event_id % 2 = 0
                THEN concat(month(ts), '/', day(ts), '/', lpad(CAST(year(ts) % 100 AS VARCHAR), 2, '0'))
                ELSE strftime(ts, '%Y-%m-%d') END AS date_text,
           CASE WHEN user_id % 3 = 0 THEN 'N' ELSE 'E' END AS exp,
           value AS btime
    FROM events
    """,
)
view(
    "scores",
    """
    SELECT CASE WHEN user_id % 20 = 0 THEN event_id + 10000000 ELSE event_id END AS form,
           CAST((user_id % 4 + 1) * 10000 + user_id AS VARCHAR) AS geozone,
           CAST(event_id % 4 + 1 AS INTEGER) AS abundance
    FROM events WHERE event_type = 'purchase'
    """,
)
view(
    "species_rows",
    """
    SELECT event_id AS row_id,
           CAST(ts AS DATE) AS date_observed,
           user_id % 20 AS place,
           user_id AS observer,
           event_type AS species,
           CASE event_id % 14
                WHEN 0 THEN 'none' WHEN 1 THEN 'few' WHEN 2 THEN 'present' WHEN 3 THEN 'some'
                WHEN 4 THEN 'many' WHEN 5 THEN 'very many' WHEN 6 THEN 'abundant'
                WHEN 7 THEN 'very abundant' WHEN 8 THEN '5+' WHEN 9 THEN '?' WHEN 10 THEN NULL
                ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS tags,
           CASE WHEN event_id % 23 <> 0 THEN value END AS max_depth
    FROM events
    """,
)
view(
    "site_text",
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS geogid,
           CASE WHEN s_suppkey % 17 = 0 THEN 'NULL'
                ELSE concat(48 + s_suppkey % 4, ' ', s_suppkey * 7 % 60, '.', s_suppkey % 10) END AS lat,
           CASE WHEN s_suppkey % 17 = 0 THEN 'NULL'
                ELSE concat('-', 123 + s_suppkey % 5, ' ', s_suppkey * 11 % 60, '.', s_suppkey % 10) END AS lon
    FROM supplier
    """,
)
view(
    "catches",
    """
    SELECT o_orderkey AS haul,
           CASE o_custkey % 4 WHEN 0 THEN 'crab' WHEN 1 THEN 'prawn'
                WHEN 2 THEN 'trawl' ELSE 'longline' END AS fishery,
           CASE WHEN o_orderpriority LIKE '1%' THEN 'TGT' ELSE 'OTH' END AS species_code,
           CAST(year(o_orderdate) AS INTEGER) AS year,
           CAST(48 + o_custkey % 4 AS DOUBLE) AS lat_deg,
           (o_orderkey * 7 % 600) / 1e1 AS lat_min,
           CAST(123 + o_custkey % 5 AS DOUBLE) AS lon_deg,
           (o_orderkey * 11 % 600) / 1e1 AS lon_min,
           o_totalprice / 1e4 AS max_depth,
           CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'M' END AS depth_unit,
           CAST(o_orderkey % 4 AS INTEGER) AS catch_count
    FROM orders
    """,
)
view(
    "vertices",
    """
    SELECT p_partkey // 40 AS poly_id, CAST(p_partkey % 40 AS INTEGER) AS seq,
           (1e3 + p_retailprice) * cos(2 * pi() * (p_partkey % 40) / 4e1) AS x,
           (1e3 + p_retailprice) * sin(2 * pi() * (p_partkey % 40) / 4e1) AS y
    FROM part
    """,
)
view(
    "draws",
    """
    SELECT vec_id AS draw, CAST(vec_id % 4 AS INTEGER) AS chain, vec_id // 4 AS iteration,
           [CAST(v AS DOUBLE) FOR v IN embedding] AS e
    FROM embeddings
    """,
)
view(
    "params",
    """
    SELECT draw, chain, iteration, e,
           e[29] AS x0, e[30] AS u_pre, e[31] AS u_crash, e[32] AS u_post,
           abs(e[33]) + 0.05e0 AS sd_q, abs(e[34]) + 0.05e0 AS sd_r,
           e[35] AS a_b, e[36] AS a_c, abs(e[37]) + 0.5e0 AS phi, e[38] AS theta,
           e[39] AS beta_time, e[40] AS beta_area, e[41] AS a_area,
           abs(e[42]) + 0.05e0 AS sd_site, abs(e[43]) + 0.05e0 AS sd_source,
           e[23] AS c1,
           e[23] + (abs(e[24]) + 0.1e0) AS c2,
           e[23] + (abs(e[24]) + 0.1e0) + (abs(e[25]) + 0.1e0) AS c3,
           e[23] + (abs(e[24]) + 0.1e0) + (abs(e[25]) + 0.1e0) + (abs(e[26]) + 0.1e0) AS c4,
           e[23] + (abs(e[24]) + 0.1e0) + (abs(e[25]) + 0.1e0) + (abs(e[26]) + 0.1e0)
             + (abs(e[27]) + 0.1e0) AS c5,
           e[23] + (abs(e[24]) + 0.1e0) + (abs(e[25]) + 0.1e0) + (abs(e[26]) + 0.1e0)
             + (abs(e[27]) + 0.1e0) + (abs(e[28]) + 0.1e0) AS c6
    FROM draws
    """,
    "draws",
)
view(
    "states",
    f"""
    SELECT draw, t, dev_r,
           x0 + sum(CASE WHEN t = 1 OR t <= 14 THEN u_pre WHEN t = 15 THEN u_crash ELSE u_post END
                    + dev * sd_q) OVER (PARTITION BY draw ORDER BY t) AS x,
           sd_r, a_b, a_c, c1, c2, c3, c4, c5, c6
    FROM (SELECT p.*, CAST(g.t AS INTEGER) AS t, e[g.t] AS dev, {value_sql('500000 + g.t')} AS dev_r
          FROM params p, (SELECT unnest(generate_series(1, 22)) AS t) g)
    """,
    "params",
)
view("points", f"SELECT *, {_X} AS x, {_Y} AS y FROM surveys WHERE lat IS NOT NULL", "surveys")
view(
    "regime_points",
    """
    SELECT *, CASE WHEN year <= 1997 THEN 'pre' WHEN year = 1998 THEN 'crash'
                   WHEN year >= 1999 THEN 'post' END AS regime
    FROM points
    """,
    "points",
)
view(
    "deduped",
    """
    SELECT * EXCLUDE (rn), CAST(num_surveys > 1 AS INTEGER) AS multiple_surveys FROM (
      SELECT *, count(*) OVER (PARTITION BY site, obs_date) AS num_surveys,
             row_number() OVER (PARTITION BY site, obs_date
               ORDER BY num_target DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey,
                        source NULLS FIRST, lat NULLS FIRST, lon NULLS FIRST,
                        bottom_time NULLS FIRST, area NULLS FIRST) AS rn
      FROM surveys) WHERE rn = 1
    """,
    "surveys",
)
view(
    "site_years",
    """
    SELECT source, year, lat, lon, count(*) AS num_visits, avg(num_target) AS mean_count,
           median(num_target) AS median_count,
           max(CASE WHEN num_target > 0 THEN 1 ELSE 0 END) AS presence
    FROM surveys GROUP BY ALL
    """,
    "surveys",
)
view(
    "site_year_points",
    f"""
    SELECT *, CASE WHEN year <= 1997 THEN 'pre' WHEN year = 1998 THEN 'crash'
                   WHEN year >= 1999 THEN 'post' END AS regime
    FROM (SELECT *, {_X} AS x, {_Y} AS y FROM site_years WHERE lat IS NOT NULL)
    """,
    "site_years",
)


def cell_sql(source: str, sizes: str = "[2000e0, 10000e0]") -> str:
    """Cells with closed edges: a point on a shared edge is listed under every cell it touches."""
    return (
        f"SELECT s.*, c.cell_size, CAST(floor(x / c.cell_size) AS BIGINT) - dx AS ix, "
        f"CAST(floor(y / c.cell_size) AS BIGINT) - dy AS iy "
        f"FROM {source} s, (SELECT unnest({sizes}) AS cell_size) c, "
        f"(VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) "
        f"WHERE (dx = 0 OR x / c.cell_size = floor(x / c.cell_size)) "
        f"AND (dy = 0 OR y / c.cell_size = floor(y / c.cell_size))"
    )


view("cells", cell_sql("regime_points"), "regime_points")
view("site_year_cells", cell_sql("site_year_points"), "site_year_points")
view(
    "median_change",
    """
    SELECT *, CASE WHEN change > 0 THEN 100 * change / after
                   WHEN change < 0 THEN 100 * change / before ELSE 0 END AS pct_change
    FROM (SELECT cell_size, ix, iy,
                 median(median_count) FILTER (WHERE regime = 'pre') AS before,
                 median(median_count) FILTER (WHERE regime = 'post') AS after,
                 after - before AS change
          FROM site_year_cells GROUP BY cell_size, ix, iy)
    WHERE change IS NOT NULL
    """,
    "site_year_cells",
)
view(
    "presence_change",
    """
    SELECT *, after - before AS change_presence
    FROM (SELECT cell_size, ix, iy,
                 max(presence) FILTER (WHERE regime = 'pre') AS before,
                 max(presence) FILTER (WHERE regime = 'post') AS after
          FROM site_year_cells GROUP BY cell_size, ix, iy)
    WHERE before IS NOT NULL AND after IS NOT NULL
    """,
    "site_year_cells",
)
view(
    "presence_design",
    """
    SELECT * EXCLUDE (scaled_time, scaled_area),
           CASE WHEN time IS NULL THEN 0e0 ELSE scaled_time END AS time_term,
           CASE WHEN area IS NULL THEN 0e0 ELSE scaled_area END AS area_term
    FROM (
      SELECT *, CASE WHEN area IS NOT NULL THEN scaled_area ELSE scaled_time END AS scaled_effort,
             CASE WHEN area IS NOT NULL THEN 0 ELSE 1 END AS effort_type
      FROM (SELECT s.*, bottom_time AS time,
                   CASE WHEN num_target > 0 THEN 1 ELSE 0 END AS presence,
                   (bottom_time - avg(bottom_time) OVER ()) / stddev_samp(bottom_time) OVER () AS scaled_time,
                   (area - avg(area) OVER ()) / stddev_samp(area) OVER () AS scaled_area,
                   dense_rank() OVER (ORDER BY source) AS source_id,
                   year - 1994 AS year_id,
                   site + 1 AS site_id
            FROM surveys s))
    WHERE scaled_effort IS NOT NULL
    """,
    "surveys",
)


def _order(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _order(VIEWS[name][0], done)
            done.append(name)
    return done


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """``sql`` with the named views, and those they need, in front as CTEs."""
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(names, []))
    body = sql.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(lead):
            return f"{lead}{ctes},\n{body[len(lead):]}"
    return f"WITH {ctes}\n{body}"
