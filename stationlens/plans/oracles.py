"""The registered queries as SQL for an independent engine (DuckDB)."""

from __future__ import annotations

from stationlens.plans import registry as r
from stationlens.plans.indicator_map import LEVELS
from stationlens.operators.kriging import LAGS, LEAST_NUGGET
from stationlens.schema import CLUSTER_INDICATORS, MAP_INDICATORS, NUMERIC_COLUMNS

F_COLS = ("f_lon", "f_lat", "tmpf", "dwpf", "relh", "drct")


def _coordinate(key: str, factor: int, shift: int, origin: int) -> str:
    return f"(CAST(({key} * {factor} + {shift}) % 1400 + ({origin}) AS DOUBLE) / CAST(100 AS DOUBLE))"


def _slon(key: str) -> str:
    return _coordinate(key, 37, 0, -500)


def _slat(key: str) -> str:
    return _coordinate(key, 91, 0, 3900)


def _plon(key: str) -> str:
    return _coordinate(key, 53, 17, -500)


def _plat(key: str) -> str:
    return _coordinate(key, 67, 29, 3900)


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"2 * 6371000 * asin(sqrt(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"
    )


def _mean(value: str) -> str:
    return (
        f"CAST(sum(CAST(round({value} * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / count({value})"
    )


ORDERS = """
obs AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS station, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month, CAST(o_orderdate AS DATE) AS day, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _events(hours: int = 1) -> str:
    lon, lat = _slon("user_id"), _slat("user_id")
    reading = "CASE WHEN event_type <> 'error' THEN value END"
    return f"""
obs AS (
  SELECT CAST(user_id AS VARCHAR) AS station, ts, CAST(ts AS DATE) AS day,
         CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
         CAST(day(ts) AS INTEGER) AS day_of_month,
         CAST(hour(ts) - hour(ts) % {hours} AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute,
         {lon} AS lon, {lat} AS lat, {reading} AS tmpf,
         TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS relh,
         10 * sin({lon} / 3) + 5 * cos({lat} / 2) + ({reading}) * CAST(0.01 AS DOUBLE) AS feel,
         event_id AS _seq
  FROM events)"""


LINEITEM = f"""
obs AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS station, CAST(l_shipdate AS DATE) AS day,
         {_slon("l_suppkey")} AS lon, {_slat("l_suppkey")} AS lat,
         CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS tmpf,
         l_extendedprice AS dwpf, l_discount AS relh, l_tax AS drct
  FROM lineitem)"""

OTHER_NUMBERS = [c for c in NUMERIC_COLUMNS if c not in ("lon", "lat", "tmpf")]
RAW = f"""
clock AS (
  SELECT *, CAST(second(ts) AS INTEGER) AS s, CAST(minute(ts) AS INTEGER) AS mi,
         CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo,
         CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h
  FROM events),
raw AS (
  SELECT event_id AS _seq, CAST(user_id AS VARCHAR) AS station,
    CASE WHEN s = 0 THEN 'bad'
         WHEN s = 1 THEN printf('%04d-13-%02d %02d:00', y, d, h)
         WHEN s <= 10 THEN printf('%d-%d-%d %d:0', y, mo, d, h)
         WHEN s <= 20 THEN printf('%04d-%02d-%02d %02d:00:59', y, mo, d, h)
         ELSE printf('%04d-%02d-%02d %02d:00', y, mo, d, h) END AS valid,
    CASE WHEN mi = 0 THEN '' WHEN mi = 1 THEN 'null' ELSE CAST({_slon("user_id")} AS VARCHAR) END AS lon,
    CAST({_slat("user_id")} AS VARCHAR) AS lat,
    CASE WHEN event_type = 'error' THEN 'null' WHEN s = 30 THEN 'M' WHEN s = 31 THEN 'NaN' WHEN s = 32 THEN ''
         ELSE CAST(value AS VARCHAR) END AS tmpf,
    CASE WHEN event_type = 'error' THEN 'null' ELSE event_type END AS skyc1,
    props AS metar, {", ".join(
      f"CASE WHEN event_id % {7 + i} = 0 THEN 'null' ELSE CAST(event_id % {50 + i} AS VARCHAR) END AS {c}"
      for i, c in enumerate(OTHER_NUMBERS))}
  FROM clock),
parts AS (
  SELECT *, {", ".join(
      f"TRY_CAST(regexp_extract(valid, '^([0-9]+)-([0-9]+)-([0-9]+) ([0-9]+):([0-9]+)', {i}) AS INTEGER) AS {n}"
      for i, n in enumerate(("year", "month", "day_of_month", "hour", "minute"), 1))}
  FROM raw),
parsed AS (
  SELECT *, TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:00', year, month, day_of_month, hour, minute) AS TIMESTAMP) AS ts
  FROM parts),
judged AS (
  SELECT *, CASE WHEN year IS NULL THEN 'bad_time' WHEN lon = '' OR lat = '' THEN 'no_location'
                 WHEN ts IS NULL THEN 'impossible_time' END AS reason
  FROM parsed)"""

STATIONS = """
stations AS (
  SELECT station, arg_max(lon, _seq) FILTER (WHERE minute % 3 <> 0) AS lon,
         arg_max(lat, _seq) FILTER (WHERE minute % 3 <> 0) AS lat, min(_seq) AS station_seq
  FROM obs GROUP BY station)"""


UNPLACED = f"CASE WHEN c_custkey % 50 <> 0 THEN {_plon('c_custkey')} END"


def _nearest(points: str) -> str:
    return f"""
points AS ({points}),
pairs AS (
  SELECT p.point_id, s.station, s.station_seq, {_haversine("s.lon", "s.lat", "p.lon", "p.lat")} AS d
  FROM points p, stations s),
nearest AS (
  SELECT point_id, station, d FROM (
    SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, station_seq) AS rn FROM pairs)
  WHERE rn = 1)"""


def _quantile(p: float) -> str:
    h = f"((total - 1) * CAST({p} AS DOUBLE))"
    at = [f"max(value) FILTER (WHERE rank = {f}({h}))" for f in ("floor", "ceil")]
    t, step = f"max({h} - floor({h}))", f"({at[1]} - {at[0]})"
    return f"CASE WHEN {t} < 0.5 THEN {at[0]} + {step} * {t} ELSE {at[1]} - {step} * (1 - {t}) END"


def _box(source: str) -> str:
    return f"""
known AS (
  SELECT station, CAST(ceil(month / 3.0) AS INTEGER) AS quarter, value FROM ({source}) WHERE value IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY station, quarter ORDER BY value) - 1 AS rank,
         count(*) OVER (PARTITION BY station, quarter) AS total FROM known),
box AS (
  SELECT station, quarter, count(*) AS n, {_quantile(0.25)} AS q1, {_quantile(0.5)} AS median, {_quantile(0.75)} AS q3,
         {_mean("value")} AS mean
  FROM ranked GROUP BY station, quarter)"""


def _features(period: tuple[str, str]) -> str:
    means = ", ".join(
        f"{_mean(c)} AS {n}" for c, n in zip(("lon", "lat", *F_COLS[2:]), F_COLS)
    )
    return f"""{LINEITEM},
features AS (
  SELECT station, round_even(lon, 2) AS lon, round_even(lat, 2) AS lat, {means}
  FROM (SELECT * FROM obs WHERE day BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'
          AND tmpf IS NOT NULL AND dwpf IS NOT NULL AND relh IS NOT NULL AND drct IS NOT NULL) kept
  GROUP BY station, round_even(kept.lon, 2), round_even(kept.lat, 2))"""


def _bounds() -> str:
    return "SELECT " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in F_COLS) + " FROM features"


def _scaled() -> str:
    cols = ", ".join(f"({c} - {c}_min) / coalesce(nullif({c}_max - {c}_min, 0), 1) AS {c}" for c in F_COLS)
    return f"""{_features(r.FULL_PERIOD)},
bounds AS ({_bounds()}),
scaled AS (SELECT station, lon, lat, {cols} FROM features, bounds),
c0 AS (
  SELECT row_number() OVER (ORDER BY station, lon, lat) - 1 AS label, {", ".join(F_COLS)} FROM scaled)"""


def _centres(k: int) -> str:
    return f", k0 AS (SELECT * FROM c0 WHERE label < {k})"


def _assigned(i: int) -> str:
    gap = " + ".join(f"(p.{c} - k.{c}) * (p.{c} - k.{c})" for c in F_COLS)
    cols = ", ".join(f"p.{c}" for c in F_COLS)
    return f""",
a{i} AS (
  SELECT * FROM (
    SELECT p.station, p.lon, p.lat, {cols}, k.label, sqrt({gap}) AS distance,
           row_number() OVER (PARTITION BY p.station, p.lon, p.lat ORDER BY sqrt({gap}), k.label) AS rn
    FROM scaled p, k{i} k) WHERE rn = 1)"""


def _lloyd(k: int) -> str:
    """Centres ``final`` and points ``labelled``: rounds until the centres move at most EPS."""
    cols = ", ".join(F_COLS)
    gap = " + ".join(f"(p.{c} - k.{c}) * (p.{c} - k.{c})" for c in F_COLS)
    means = ", ".join(f"coalesce(m.{c}, k.{c}) AS {c}" for c in F_COLS)
    moved = " + ".join(f"(coalesce(m.{c}, k.{c}) - k.{c}) * (coalesce(m.{c}, k.{c}) - k.{c})" for c in F_COLS)

    def labelled(centres: str) -> str:
        return f"""SELECT p.station, p.lon, p.lat, {", ".join(f"p.{c}" for c in F_COLS)}, k.label, sqrt({gap}) AS distance,
           row_number() OVER (PARTITION BY p.station, p.lon, p.lat ORDER BY sqrt({gap}), k.label) AS rn
    FROM scaled p, {centres} k"""

    return f"""{_scaled()}{_centres(k)},
rounds AS (
  SELECT 0 AS i, label, {cols}, CAST(1 AS DOUBLE) AS shift FROM k0
  UNION ALL
  SELECT k.i + 1, k.label, {means}, sqrt(sum({moved}) OVER ()) AS shift
  FROM (SELECT * FROM rounds WHERE shift > {r.EPS} AND i < {r.MAX_ROUNDS}) k
  LEFT JOIN (SELECT label, {", ".join(f"avg({c}) AS {c}" for c in F_COLS)}
             FROM ({labelled("rounds")}) a WHERE rn = 1 GROUP BY label) m ON k.label = m.label),
final AS (SELECT * FROM rounds WHERE i = (SELECT max(i) FROM rounds)),
labelled AS (SELECT * FROM ({labelled("final")}) f WHERE rn = 1)"""


PLACES = """
places AS (
  SELECT day, hour, lon, lat, avg(feel) AS z FROM obs WHERE feel IS NOT NULL GROUP BY day, hour, lon, lat)"""

VARIOGRAM = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY day, hour ORDER BY lon, lat) AS i FROM places),
pairs AS (
  SELECT a.day, a.hour, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS h,
         CAST(0.5 AS DOUBLE) * (a.z - b.z) * (a.z - b.z) AS g
  FROM numbered a JOIN numbered b ON a.day = b.day AND a.hour = b.hour AND a.i < b.i),
extent AS (SELECT day, hour, min(h) AS h_min, max(h) AS h_max FROM pairs GROUP BY day, hour),
binned AS (
  SELECT p.*, CASE WHEN h_max > h_min
    THEN CAST(least(floor((h - h_min) / ((h_max - h_min) / {LAGS})), {LAGS - 1}) AS INTEGER) ELSE 0 END AS bin
  FROM pairs p JOIN extent e ON p.day = e.day AND p.hour = e.hour),
bins AS (
  SELECT day, hour, bin, count(*) AS n, sum(h) / count(*) AS lag, sum(g) / count(*) AS gamma
  FROM binned GROUP BY day, hour, bin)"""

FIT = """
tops AS (SELECT *, max(lag) OVER (PARTITION BY day, hour) AS top FROM bins),
tried AS (
  SELECT day, hour, top * j / 20 AS range, lag, gamma FROM tops, generate_series(1, 20) AS c(j)),
xs AS (SELECT *, 1 - exp(-power(lag / nullif(range * 4 / 7, 0), 2)) AS x FROM tried),
moments AS (
  SELECT day, hour, range, count(*) AS m, sum(x) AS sx, sum(gamma) AS sg, sum(x * x) AS sxx, sum(x * gamma) AS sxg,
         sum(gamma * gamma) AS sgg FROM xs GROUP BY day, hour, range),
slopes AS (
  SELECT *, CASE WHEN m * sxx - sx * sx > 1e-12 THEN (m * sxg - sx * sg) / (m * sxx - sx * sx) END AS b FROM moments),
lines AS (SELECT *, (sg - b * sx) / m AS a FROM slopes),
bent AS (
  SELECT *, CASE WHEN a IS NULL OR a < 0 THEN 0 ELSE a END AS c0,
            CASE WHEN a IS NULL OR a < 0 THEN sxg / nullif(sxx, 0) ELSE b END AS c1 FROM lines),
models AS (
  SELECT *, NOT coalesce(c1 > 0, FALSE) AS flat, CASE WHEN c1 > 0 THEN c0 ELSE sg / m END AS nugget,
            CASE WHEN c1 > 0 THEN c1 ELSE 0 END AS psill FROM bent),
errors AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), CASE WHEN flat THEN sgg - 2 * nugget * sg + m * nugget * nugget
    ELSE sgg - 2 * nugget * sg - 2 * psill * sxg + m * nugget * nugget + 2 * nugget * psill * sx + psill * psill * sxx
    END) AS sse FROM models),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY day, hour ORDER BY flat, sse, range) AS rn FROM errors)"""


def _elimination(right: str) -> str:
    """Gauss-Jordan elimination of each snapshot's covariance matrix; ``right`` is the list of right-hand sides of line i."""
    return f"""
best AS (
  SELECT day, hour, n, greatest(nugget, {LEAST_NUGGET} * psill) AS nugget, psill, range * 4 / 7 AS reach
  FROM ranked JOIN (SELECT day, hour, count(*) AS n FROM places GROUP BY day, hour) USING (day, hour) WHERE rn = 1),
system AS (
  SELECT a.day, a.hour, a.i, any_value(n) AS n, list_concat(list(
    CASE WHEN a.i = b.i THEN nugget + psill
         ELSE psill * exp(-(power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2)) / (reach * reach)) END ORDER BY b.i), {right}) AS line
  FROM numbered a JOIN numbered b USING (day, hour) JOIN best USING (day, hour) GROUP BY a.day, a.hour, a.i),
steps AS (
  SELECT 1 AS k, * FROM system
  UNION ALL
  SELECT k + 1, day, hour, i, n, CASE WHEN i = k THEN list_transform(head, lambda x: x / top)
    ELSE list_transform(list_zip(line, head), lambda x: x[1] - f * x[2]) END
  FROM (SELECT e.*, p.line AS head, p.line[p.k] AS top, e.line[e.k] / p.line[p.k] AS f
        FROM steps e JOIN steps p ON e.day = p.day AND e.hour = p.hour AND p.i = e.k WHERE e.k <= e.n)),
solved AS (SELECT day, hour, i, line[n + 1 :] AS x FROM steps WHERE k = n + 1)"""


WEIGHTS = f"""{_elimination("[any_value(a.z), CAST(1 AS DOUBLE)]")},
constants AS (SELECT day, hour, sum(x[1]) / sum(x[2]) AS constant FROM solved GROUP BY day, hour),
weights AS (
  SELECT day, hour, i, lon, lat, x[1] - constant * x[2] AS weight, constant, nugget, psill, reach
  FROM solved JOIN constants USING (day, hour) JOIN numbered USING (day, hour, i) JOIN best USING (day, hour))"""

AXES = """
axes AS (
  SELECT CAST(k AS INTEGER) AS k, CAST(-5 AS DOUBLE) + k * CAST(0.07 AS DOUBLE) AS lon,
         CAST(39 AS DOUBLE) + k * CAST(0.07 AS DOUBLE) AS lat FROM range(200) AS g(k))"""

# The covariance is a product over the axes, so a cell is one inner product over the places.
SURFACE = f"""{AXES},
across AS (
  SELECT day, hour, k AS ix, a.lon, any_value(constant) AS constant,
         list(weight * psill * exp(-power((a.lon - w.lon) / reach, 2)) ORDER BY i) AS e
  FROM weights w, axes a GROUP BY day, hour, k, a.lon),
along AS (
  SELECT day, hour, k AS iy, a.lat, list(exp(-power((a.lat - w.lat) / reach, 2)) ORDER BY i) AS e
  FROM weights w, axes a GROUP BY day, hour, k, a.lat),
hits AS (
  SELECT day, hour, x.k AS ix, y.k AS iy, weight * nugget AS more
  FROM weights w JOIN axes x ON abs(x.lon - w.lon) <= 1e-10 JOIN axes y ON abs(y.lat - w.lat) <= 1e-10),
surface AS (
  SELECT day, hour, ix, iy, lon, lat, constant + list_inner_product(across.e, along.e) + coalesce(more, 0) AS z
  FROM across JOIN along USING (day, hour) LEFT JOIN hits USING (day, hour, ix, iy))"""

# Forms c'Qc with the inverse Q, the pairs of places as one list per grid column and one per grid row.
VARIANCE = f"""
norms AS (SELECT day, hour, sum(list_sum(x)) AS yy, list(list_sum(x) ORDER BY i) AS sums FROM solved GROUP BY day, hour),
located AS (SELECT * FROM numbered JOIN best USING (day, hour)),
easts AS (SELECT day, hour, i, k AS ix, a.lon, exp(-power((a.lon - w.lon) / reach, 2)) AS e FROM located w, axes a),
norths AS (SELECT day, hour, i, k AS iy, a.lat, psill * exp(-power((a.lat - w.lat) / reach, 2)) AS e FROM located w, axes a),
column_pairs AS (
  SELECT a.day, a.hour, a.ix, list(a.e * b.e ORDER BY a.i, b.i) AS e
  FROM easts a JOIN easts b USING (day, hour, ix) WHERE a.i <= b.i GROUP BY ALL),
line_pairs AS (
  SELECT a.day, a.hour, a.iy, list(CASE WHEN a.i = b.i THEN 1 ELSE 2 END * x[b.i] * a.e * b.e ORDER BY a.i, b.i) AS e
  FROM norths a JOIN norths b USING (day, hour, iy) JOIN solved s ON s.day = a.day AND s.hour = a.hour AND s.i = a.i
  WHERE a.i <= b.i GROUP BY ALL),
column_list AS (SELECT day, hour, ix, list(e ORDER BY i) AS e FROM easts GROUP BY day, hour, ix),
line_list AS (
  SELECT day, hour, iy, list(e * sums[i] ORDER BY i) AS e FROM norths JOIN norms USING (day, hour) GROUP BY day, hour, iy),
-- A place in a cell has variance 0 there.
same AS (
  SELECT DISTINCT day, hour, x.k AS ix, y.k AS iy, TRUE AS hit
  FROM located w JOIN axes x ON abs(x.lon - w.lon) <= 1e-10 JOIN axes y ON abs(y.lat - w.lat) <= 1e-10),
variances AS (
  SELECT day, hour, ix, iy, CASE WHEN hit THEN 0 ELSE nugget + psill - list_inner_product(cp.e, lp.e)
         + power(1 - list_inner_product(cl.e, ll.e), 2) / yy END AS variance
  FROM column_pairs cp JOIN line_pairs lp USING (day, hour) JOIN column_list cl USING (day, hour, ix)
  JOIN line_list ll USING (day, hour, iy) JOIN norms USING (day, hour) JOIN best USING (day, hour)
  LEFT JOIN same USING (day, hour, ix, iy))"""

NO_PLACE = "list(CASE WHEN a.i = b.i THEN CAST(1 AS DOUBLE) ELSE 0 END ORDER BY b.i)"


def _at_instant(places: str) -> str:
    return places.replace("feel IS NOT NULL", f"feel IS NOT NULL AND {_hour_filter()}")


def _hour_filter() -> str:
    y, m, d, h = r.INSTANT
    return f"day = make_date({y}, {m}, {d}) AND hour = {h}"


def _build() -> dict[str, str]:
    e1, e12 = _events(), _events(r.HALF_DAY)
    lo, hi = r.PERIOD
    raw_numbers = ["lon", "lat", "tmpf"]

    def number(c):
        return f"CASE WHEN isfinite(TRY_CAST({c} AS FLOAT)) THEN CAST(TRY_CAST({c} AS FLOAT) AS DOUBLE) END"

    quality = [("accepted", "reason IS NULL")]
    quality += [(n, f"reason = '{n}'") for n in ("bad_time", "no_location", "no_station", "impossible_time")]
    quality += [
        (f"unreadable {c}", f"reason IS NULL AND {c} NOT IN ('null', '') AND ({number(c)}) IS NULL"
         if c in raw_numbers else "FALSE")
        for c in NUMERIC_COLUMNS
    ]
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in F_COLS)
    accepted = f"""{RAW},
accepted AS (
  SELECT station, ts, CAST(ts AS DATE) AS day, year, month, hour, {", ".join(f"{number(c)} AS {c}" for c in NUMERIC_COLUMNS)}, _seq
  FROM (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY _seq DESC) AS rn FROM judged WHERE reason IS NULL)
  WHERE rn = 1),
placed AS (
  SELECT station, arg_max(lon, _seq) FILTER (WHERE lon IS NOT NULL AND lat IS NOT NULL) AS lon,
         arg_max(lat, _seq) FILTER (WHERE lon IS NOT NULL AND lat IS NOT NULL) AS lat, min(_seq) AS station_seq
  FROM accepted GROUP BY station)"""
    lon, lat = (f"CAST({v} AS DOUBLE)" for v in r.POSITION)
    year, month, day, hour = r.STORED_INSTANT
    third = "CAST(0.005 AS DOUBLE) * (hour % 3)"
    thousandths = lambda c: f"CAST(sum(CAST(round_even({c} * 1000, 0) AS BIGINT)) AS DOUBLE) / CAST(1000 AS DOUBLE) / count({c})"
    exact = lambda c: f"CAST(printf('%.2f', {c}) AS DOUBLE)"
    stored = "station, ts, day, hour, minute, lon, lat, tmpf, relh, _seq"
    return {
        "month_profile": f"""WITH {ORDERS}
SELECT station, month, count(*) AS n, min(value) AS minimum, max(value) AS maximum, {_mean("value")} AS mean
FROM obs GROUP BY station, month""",
        "point_history_station": f"""WITH {e1}
SELECT station, year, month, day, tmpf AS value FROM obs WHERE station = '{r.STATION}'""",
        "point_history_coord": f"""WITH {e1}, {STATIONS},
{_nearest(f"SELECT s_suppkey AS point_id, {_plon('s_suppkey')} AS lon, {_plat('s_suppkey')} AS lat FROM supplier")},
wanted AS (SELECT station, count(*) AS n_points FROM nearest GROUP BY station)
SELECT obs.station, year, month, day, ts, tmpf AS value, n_points FROM obs JOIN wanted ON obs.station = wanted.station""",
        "quarter_box_stats": f"""WITH {ORDERS}, {_box("SELECT * FROM obs")},
ends AS (
  SELECT k.station, k.quarter,
    least(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), min(q1)) AS whisker_low,
    greatest(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), max(q3)) AS whisker_high,
    count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM known k JOIN box b ON k.station = b.station AND k.quarter = b.quarter GROUP BY k.station, k.quarter),
every AS (SELECT station, CAST(q AS INTEGER) AS quarter
  FROM (SELECT DISTINCT station FROM obs), generate_series(1, 4) AS g(q))
SELECT e.station, e.quarter, coalesce(b.n, 0) AS n, q1, median, q3, mean, whisker_low, whisker_high,
       coalesce(n_outliers, 0) AS n_outliers
FROM every e LEFT JOIN box b ON e.station = b.station AND e.quarter = b.quarter
LEFT JOIN ends w ON e.station = w.station AND e.quarter = w.quarter""",
        "quarter_outliers": f"""WITH {e1},
{_box("SELECT CAST(hour AS VARCHAR) AS station, month, tmpf AS value FROM obs")}
SELECT k.station, k.quarter, value, count(*) AS n
FROM known k JOIN box b ON k.station = b.station AND k.quarter = b.quarter
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) GROUP BY k.station, k.quarter, value""",
        "year_month_mean": f"""WITH {ORDERS}
SELECT station, year, month, count(*) AS n, {_mean("value")} AS mean FROM obs GROUP BY station, year, month""",
        "year_month_matrix": f"""WITH {ORDERS},
means AS (SELECT station, year, month, {_mean("value")} AS mean FROM obs GROUP BY station, year, month)
SELECT station, year, {", ".join(
    f"coalesce(max(CASE WHEN month = {m} THEN mean END), 0) AS m{m:02d}" for m in range(1, 13))}
FROM means GROUP BY station, year""",
        "seasonal_anomaly": f"""WITH {ORDERS},
means AS (SELECT station, year, month, count(*) AS n, {_mean("value")} AS mean FROM obs GROUP BY station, year, month),
normals AS (SELECT station, month, {_mean("value")} AS climatology FROM obs GROUP BY station, month)
SELECT m.station, year, m.month, n, mean, climatology, mean - climatology AS anomaly
FROM means m JOIN normals c ON m.station = c.station AND m.month = c.month""",
        "haversine_m": f"""SELECT c_custkey, round({_haversine(
            _plon("c_custkey"), _plat("c_custkey"), _slon("n_nationkey"), _slat("n_nationkey"))}, 3) AS distance_m
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        "station_dim": f"""WITH {e1}
SELECT station, arg_max(lon + day_of_month / CAST(100 AS DOUBLE), _seq) FILTER (WHERE minute % 3 <> 0) AS lon,
       arg_max(lat, _seq) FILTER (WHERE minute % 3 <> 0) AS lat, min(_seq) AS station_seq FROM obs GROUP BY station""",
        "nearest_station": f"""WITH {e1}, {STATIONS},
{_nearest(f"SELECT c_custkey AS point_id, {UNPLACED} AS lon, {_plat('c_custkey')} AS lat FROM customer")}
SELECT point_id, CASE WHEN d IS NULL THEN '' ELSE station END AS station, round(d, 3) AS distance_m FROM nearest""",
        "resolve_points": f"""WITH {e1}, {STATIONS},
{_nearest(f"SELECT c_custkey AS point_id, {UNPLACED} AS lon, {_plat('c_custkey')} AS lat FROM customer "
          "WHERE c_mktsegment <> 'MACHINERY'")}
SELECT c_custkey AS point_id, CAST(c_nationkey AS VARCHAR) AS station FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT point_id, CASE WHEN d IS NULL THEN '' ELSE station END FROM nearest""",
        "parse_valid": f"WITH {RAW} SELECT _seq, valid, year, month, day_of_month, hour, minute, ts FROM judged",
        "ingest_quality": f"WITH {RAW} " + " UNION ALL ".join(
            f"SELECT '{n}' AS reason, count(*) FILTER (WHERE {c}) AS n FROM judged" for n, c in quality),
        "dedup_last": f"""WITH {e1}
SELECT station, day, hour, _seq, tmpf FROM (
  SELECT *, row_number() OVER (PARTITION BY station, day, hour ORDER BY _seq DESC) AS rn FROM obs) WHERE rn = 1""",
        "ingest_observations": f"""WITH {RAW}
SELECT station, ts, CAST(ts AS DATE) AS day, year, month, day_of_month, hour, minute,
       {", ".join(f"{number(c)} AS {c}" for c in NUMERIC_COLUMNS)},
       skyc1, {", ".join(f"'null' AS {c}" for c in ("skyc2", "skyc3", "skyc4", "wxcodes"))}, metar,
       peak_wind_time AS peak_wind_time_raw
FROM (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY _seq DESC) AS rn FROM judged WHERE reason IS NULL)
WHERE rn = 1""",
        "layout_by_station": f"WITH {e1} SELECT {stored} FROM obs",
        "layout_by_hour": f"WITH {e1} SELECT {stored} FROM obs",
        "layout_by_day": f"""WITH {e1} SELECT {stored} FROM obs
WHERE day BETWEEN DATE '{r.MONTH[0]}' AND DATE '{r.MONTH[1]}'""",
        "day_coverage": f"""WITH {ORDERS},
days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM obs),
counts AS (SELECT day, count(*) AS n FROM obs GROUP BY day)
SELECT days.day, coalesce(n, 0) AS n FROM days LEFT JOIN counts ON days.day = counts.day""",
        "stored_stations": f"WITH {accepted} SELECT * FROM placed",
        "stored_history": f"""WITH {accepted}
SELECT station, year, month, day, tmpf AS value FROM accepted WHERE station = (
  SELECT station FROM placed WHERE lon IS NOT NULL ORDER BY {_haversine("lon", "lat", lon, lat)}, station_seq LIMIT 1)""",
        "stored_points": f"""WITH {accepted}, stations AS (SELECT * FROM placed WHERE lon IS NOT NULL),
{_nearest(f"SELECT c_custkey AS point_id, {_plon('c_custkey')} AS lon, {_plat('c_custkey')} AS lat FROM customer")}
SELECT point_id, station, round(d, 3) AS distance_m FROM nearest""",
        "stored_snapshot": f"""WITH {accepted}
SELECT station, day, hour, lon, lat, {", ".join(MAP_INDICATORS)} FROM accepted
WHERE day = make_date({year}, {month}, {day}) AND hour = {hour}""",
        "stored_bounds": f"WITH {accepted} " + " UNION ALL ".join(
            f"SELECT day, hour, min({c}) AS low, max({c}) AS high, count({c}) AS n, '{c}' AS indicator FROM accepted "
            f"WHERE {c} IS NOT NULL GROUP BY day, hour" for c in MAP_INDICATORS),
        "stored_features": f"""WITH {accepted},
moved AS (
  SELECT station, round(lon, 2) + {third} AS lon, round(lat, 2) + {third} AS lat, {", ".join(CLUSTER_INDICATORS)}
  FROM accepted WHERE day BETWEEN DATE '{r.MONTH[0]}' AND DATE '{r.MONTH[1]}'),
whole AS (SELECT *, {exact("lon")} AS k_lon, {exact("lat")} AS k_lat FROM moved
  WHERE lon IS NOT NULL AND lat IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in CLUSTER_INDICATORS)})
SELECT station, k_lon AS lon, k_lat AS lat, {thousandths("lon")} AS f_lon, {thousandths("lat")} AS f_lat,
       {", ".join(f"{thousandths(c)} AS {c}" for c in CLUSTER_INDICATORS)}
FROM whole GROUP BY station, k_lon, k_lat""",
        "month_profile_plain": f"""WITH {ORDERS}
SELECT station, month, count(*) AS n, min(value) AS minimum, max(value) AS maximum, round(avg(value), 4) AS mean
FROM obs GROUP BY station, month""",
        "period_scan": f"""WITH {LINEITEM} SELECT station, lon, lat, tmpf, dwpf, relh, drct FROM obs
WHERE day BETWEEN DATE '{lo}' AND DATE '{hi}'""",
        "complete_cases": f"WITH {LINEITEM} SELECT * FROM obs WHERE tmpf IS NOT NULL AND dwpf IS NOT NULL "
                          "AND relh IS NOT NULL AND drct IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL",
        "period_features": f"WITH {_features(r.FULL_PERIOD)} SELECT * FROM features",
        "minmax_bounds": f"WITH {_features(r.FULL_PERIOD)} {_bounds()}",
        "minmax_scale": f"WITH {_scaled()} SELECT * FROM scaled",
        "euclidean_distance": """WITH parts AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
centres AS (SELECT label, i, avg(x) AS c FROM parts GROUP BY label, i)
SELECT vec_id, p.label, round(sqrt(sum((x - c) * (x - c))), 6) AS distance
FROM parts p JOIN centres m ON p.label = m.label AND p.i = m.i GROUP BY vec_id, p.label""",
        "kmeans_init": f"""WITH {_features(r.FULL_PERIOD)}
SELECT CAST(row_number() OVER (ORDER BY lot, station, lon, lat) - 1 AS INTEGER) AS centre, station, lon, lat, {", ".join(F_COLS)}
FROM (SELECT *, md5(concat_ws(':', '42', station, lon, lat)) AS lot FROM features
      ORDER BY lot, station, lon, lat LIMIT {r.CENTRES})""",
        "kmeans_assign": f"""WITH {_scaled()}{_centres(r.CENTRES)}{_assigned(0)}
SELECT station, CAST(label AS INTEGER) AS label, round(distance, 6) AS distance FROM a0""",
        "kmeans_step": f"""WITH {_scaled()}{_centres(r.CENTRES)}{_assigned(0)}, means AS (
  SELECT CAST(label AS INTEGER) AS label, count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in F_COLS)}
  FROM a0 GROUP BY label)
SELECT label, n, {rounded} FROM means""",
        "kmeans_fit": f"""WITH RECURSIVE {_lloyd(r.CENTRES)}
SELECT station, CAST(label AS INTEGER) AS label, round(distance, 6) AS distance FROM labelled""",
        "cluster_period": f"""WITH RECURSIVE {_lloyd(r.CENTRES)}
SELECT station, lon, lat, CAST(label AS INTEGER) AS label FROM labelled""",
        "cluster_map_layer": f"""WITH RECURSIVE {_lloyd(r.MAP_CENTRES)}
SELECT lon, lat, CAST(label AS INTEGER) AS label, station AS popup FROM labelled""",
        "hour_snapshot": f"""WITH {e12}
SELECT station, day, hour, lon, lat, tmpf, relh, round(feel, 6) AS feel FROM obs WHERE {_hour_filter()}""",
        "snapshot_bounds": f"""WITH {e12}
SELECT day, hour, min(tmpf) AS low, max(tmpf) AS high, count(*) AS n FROM obs WHERE tmpf IS NOT NULL
GROUP BY day, hour""",
        "grid_cells": f"""WITH boxes AS (
  SELECT n_regionkey, min({_plon("c_custkey")}) AS w, max({_plon("c_custkey")}) AS e,
         min({_plat("c_custkey")}) AS s, max({_plat("c_custkey")}) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey),
xs AS (SELECT *, unnest(range(CAST(ceil(round((e - w) / CAST(0.07 AS DOUBLE), 9)) AS BIGINT))) AS ix FROM boxes),
cells AS (SELECT *, unnest(range(CAST(ceil(round((n - s) / CAST(0.07 AS DOUBLE), 9)) AS BIGINT))) AS iy FROM xs)
SELECT n_regionkey, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, w + ix * CAST(0.07 AS DOUBLE) AS lon,
       s + iy * CAST(0.07 AS DOUBLE) AS lat FROM cells""",
        "semivariogram": f"""WITH {e12}, {PLACES}, {VARIOGRAM}
SELECT day, hour, bin, n, round(lag, 6) AS lag, round(gamma, 6) AS gamma FROM bins""",
        "variogram_fit": f"""WITH {e12}, {PLACES}, {VARIOGRAM}, {FIT}
SELECT day, hour, round(nugget, 6) AS nugget, round(psill, 6) AS psill, round(range, 6) AS range,
       round(sse, 6) AS sse FROM ranked WHERE rn = 1""",
        "krige_weights": f"""WITH RECURSIVE {e12}, {PLACES}, {VARIOGRAM}, {FIT}, {WEIGHTS}
SELECT day, hour, lon, lat, round(weight, 6) AS weight, round(constant, 6) AS constant FROM weights""",
        "krige_surface": f"""WITH RECURSIVE {e12}, {PLACES}, {VARIOGRAM}, {FIT}, {WEIGHTS}, {SURFACE}
SELECT day, hour, ix, iy, lon, lat, round(z, 3) AS z FROM surface""",
        "indicator_map": f"""WITH RECURSIVE {e12}, {_at_instant(PLACES)}, {VARIOGRAM}, {FIT}, {WEIGHTS}, {SURFACE},
ends AS (SELECT min(feel) AS low, max(feel) AS high FROM obs WHERE {_hour_filter()})
SELECT day, hour, ix, iy, lon, lat, round(z, 6) AS z, CAST(CASE WHEN z < low THEN 0 WHEN z >= high THEN {LEVELS}
    ELSE floor(CAST({LEVELS - 1} AS DOUBLE) * (z - low) / (high - low)) + 1 END AS INTEGER) AS band
FROM surface, ends""",
        "variance_map": f"""WITH RECURSIVE {e12}, {_at_instant(PLACES)}, {VARIOGRAM}, {FIT}, {_elimination(NO_PLACE)}, {AXES}, {VARIANCE}
SELECT day, hour, ix, iy, round(variance, 6) AS variance FROM variances""",
        "contour_bands": f"""WITH {e12},
means AS (SELECT day, hour, lon, lat, {_mean("tmpf")} AS z FROM obs WHERE tmpf IS NOT NULL GROUP BY day, hour, lon, lat),
bounds AS (SELECT day, hour, min(z) AS low, max(z) AS high FROM means GROUP BY day, hour)
SELECT o.day, o.hour, lon, lat, tmpf AS z, CAST(CASE WHEN tmpf IS NULL THEN NULL WHEN high = low THEN 1
    WHEN tmpf < low THEN 0 WHEN tmpf >= high THEN {LEVELS}
    ELSE floor(CAST({LEVELS - 1} AS DOUBLE) * (tmpf - low) / (high - low)) + 1 END AS INTEGER) AS band
FROM obs o JOIN bounds b ON o.day = b.day AND o.hour = b.hour""",
    }


ORACLES = _build()
