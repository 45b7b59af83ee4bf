"""Every operator as a query over the sample tables, whole tables each time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlens.functions.geo import Grid, axis_size, explode_grid, haversine_m
from stationlens.functions.stats import euclidean
from stationlens.operators import clustering
from stationlens.operators.dedup import keep_last
from stationlens.operators.kriging import krige_surface, location_means, semivariogram, variogram_fit
from stationlens.operators.nearest import nearest_station, open_index, resolve_points
from stationlens.operators.skew import salted_join
from stationlens.plans import indicator_map as im
from stationlens.plans import point_history as ph
from stationlens.plans import space_clusters as sc
from stationlens.schema import MAP_INDICATORS, NUMERIC_COLUMNS
from stationlens.session import new_path, written
from stationlens.sources import layouts, reports
from stationlens.sources import sample_tables as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the SQL texts.
HALF_DAY = 12  # hours per snapshot
INSTANT = (2024, 1, 15, 12)
STATION = "7"
FULL_PERIOD = ("1995-01-01", "2001-12-31")
PERIOD = ("1997-03-01", "1998-02-28")
MONTH = ("2024-01-01", "2024-01-31")
CENTRES = 5
MAP_CENTRES = 10
# Where the clustering stops.
EPS = 1e-4
MAX_ROUNDS = 100_000


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _orders(spark, sf):
    return ph.history(st.obs_orders(spark, sf), "tmpf")


def _snapshots(spark, sf):
    return st.obs_events(spark, sf, HALF_DAY)


def _sometimes_lost(lon):
    """Every third minute the longitude is missing, often on the last row of a station."""
    return F.when(F.col("minute") % 3 != 0, lon)


def _stations(spark, sf):
    obs = st.obs_events(spark, sf)
    return layouts.station_dimension(obs.withColumn("lon", _sometimes_lost(F.col("lon"))))


def _sometimes_unplaced(key):
    """Every fiftieth point has no longitude."""
    return F.when(F.col(key) % 50 != 0, F.col("lon"))


# --- history of a point ---------------------------------------------------


@query("month_profile")
def month_profile(spark, sf):
    return ph.month_profile(_orders(spark, sf), decimals=2)


@query("point_history_station")
def point_history_station(spark, sf):
    return ph.history_of_station(st.obs_events(spark, sf), STATION, "tmpf")


@query("point_history_coord")
def point_history_coord(spark, sf):
    points = st.points_of(spark, sf, "supplier", "s_suppkey").withColumn("station", F.lit(None).cast("string"))
    return ph.history_of_points(st.obs_events(spark, sf), points, _stations(spark, sf), "tmpf")


@query("quarter_box_stats")
def quarter_box_stats(spark, sf):
    return ph.quarter_box_stats(_orders(spark, sf), decimals=2)


@query("quarter_outliers")
def quarter_outliers(spark, sf):
    events = st.obs_events(spark, sf).withColumn("station", F.col("hour").cast("string"))
    return ph.quarter_outliers(ph.history(events, "tmpf"))


@query("year_month_mean")
def year_month_mean(spark, sf):
    return ph.year_month_mean(_orders(spark, sf), decimals=2)


@query("year_month_matrix")
def year_month_matrix(spark, sf):
    return ph.year_month_matrix(_orders(spark, sf), decimals=2)


@query("seasonal_anomaly")
def seasonal_anomaly(spark, sf):
    return ph.seasonal_anomaly(_orders(spark, sf), decimals=2)


# --- stations and distances -----------------------------------------------


@query("haversine_m")
def haversine_distance(spark, sf):
    customer = st.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = st.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    d = haversine_m(st.point_lon(c), st.point_lat(c), st.station_lon(n), st.station_lat(n))
    return customer.join(nation, "c_nationkey").select("c_custkey", F.round(d, 3).alias("distance_m"))


@query("station_dim")
def station_dim(spark, sf):
    moving = F.col("lon") + F.col("day_of_month") / F.lit(100.0)
    return layouts.station_dimension(st.obs_events(spark, sf).withColumn("lon", _sometimes_lost(moving)))


@query("nearest_station")
def nearest(spark, sf):
    points = st.points_of(spark, sf, "customer", "c_custkey").withColumn("lon", _sometimes_unplaced("point_id"))
    found = nearest_station(points, _stations(spark, sf))
    return found.select("point_id", "station", F.round("distance_m", 3).alias("distance_m"))


@query("resolve_points")
def resolved_points(spark, sf):
    customer = st.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("point_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_nationkey").cast("string")).alias("station"),
        st.point_lon(F.col("c_custkey")).alias("lon"),
        st.point_lat(F.col("c_custkey")).alias("lat"),
    )
    return resolve_points(customer.withColumn("lon", _sometimes_unplaced("point_id")), _stations(spark, sf))


# --- ingest and layouts ---------------------------------------------------


@query("parse_valid")
def parse_valid(spark, sf):
    raw = st.raw_reports(spark, sf)
    return raw.select("_seq", "valid", *[c.alias(n) for n, c in reports.time_parts(F.col("valid")).items()])


@query("ingest_quality")
def ingest_quality(spark, sf):
    return reports.ingest_quality(st.raw_reports(spark, sf))


@query("dedup_last")
def dedup_last(spark, sf):
    return keep_last(st.obs_events(spark, sf), ["station", "day", "hour"]).select(
        "station", "day", "hour", "_seq", "tmpf"
    )


@query("ingest_observations")
def ingest_observations(spark, sf):
    """Two report files read in the order given: the second has its columns reversed, and one more."""
    first, second = new_path(spark, "reports-z"), new_path(spark, "reports-a")
    raw = st.raw_reports(spark, sf)
    middle = st.table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    columns = [c for c in raw.columns if c != "_seq"]
    for path, rows, names in (
        (first, raw.filter(F.col("_seq") <= middle), columns),
        (second, raw.filter(F.col("_seq") > middle).withColumn("note", F.lit("x")), ["note", *reversed(columns)]),
    ):
        rows.orderBy("_seq").select(*names).write.option("header", True).option("escape", '"').csv(path)
    obs = reports.observations(reports.read_reports(spark, [first, second]))
    number = {c: F.col(c).cast("double") for c in NUMERIC_COLUMNS}
    return obs.withColumns(number).drop("_seq")


STORED = ("station", "ts", "day", "hour", "minute", "lon", "lat", "tmpf", "relh", "_seq")


@query("layout_by_station")
def layout_by_station(spark, sf):
    path = new_path(spark, "obs_by_station")
    obs = st.obs_events(spark, sf).select(*STORED)
    layouts.write_by_station(obs, path)
    return spark.read.schema(obs.schema).parquet(path)


@query("layout_by_hour")
def layout_by_hour(spark, sf):
    path = new_path(spark, "obs_by_instant")
    obs = st.obs_events(spark, sf).select(*STORED)
    layouts.write_by_instant(obs, path)
    return spark.read.schema(obs.schema).parquet(path)


@query("layout_by_day")
def layout_by_day(spark, sf):
    path = new_path(spark, "obs_by_instant")
    obs = st.obs_events(spark, sf).select(*STORED)
    layouts.write_by_instant(obs, path)
    return layouts.period_rows(spark.read.schema(obs.schema).parquet(path), *MONTH)


@query("day_coverage")
def day_coverage(spark, sf):
    return layouts.day_coverage(st.obs_orders(spark, sf))


# --- the three questions over the stored tables -----------------------------

#: A position, an hour and a month asked for.
POSITION = (2.35, 48.85)
STORED_INSTANT = (2024, 1, 15, 13)


def _stored(spark, sf):
    """All tables of the layout, built from the report lines."""
    root = new_path(spark, "layouts")
    layouts.build_layouts(reports.observations(st.raw_reports(spark, sf)), root)
    return root, layouts.open_layouts(spark, root)


@query("stored_stations")
def stored_stations(spark, sf):
    return _stored(spark, sf)[1]["stations"].select(
        "station", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), "station_seq"
    )


@query("stored_history")
def stored_history(spark, sf):
    """The past of a position: its nearest station looked up, then read from the table by station."""
    _, t = _stored(spark, sf)
    past = ph.history_of_coordinates(t["obs_by_station"], *POSITION, t["stations"], "tmpf")
    return past.withColumn("value", F.col("value").cast("double"))


@query("stored_points")
def stored_points(spark, sf):
    """Nearest stations of all customers by the stored index."""
    root, _ = _stored(spark, sf)
    points = st.points_of(spark, sf, "customer", "c_custkey")
    found = nearest_station(points, open_index(spark, f"{root}/station_index"))
    return found.select("point_id", "station", F.round("distance_m", 3).alias("distance_m"))


@query("stored_snapshot")
def stored_snapshot(spark, sf):
    """All 21 indicators of all stations in one hour, asked for in SQL."""
    _stored(spark, sf)
    year, month, day, hour = STORED_INSTANT
    values = ", ".join(f"cast({c} as double) as {c}" for c in ("lon", "lat", *MAP_INDICATORS))
    return spark.sql(
        f"select station, day, hour, {values} from obs_by_instant where day = make_date({year}, {month}, {day}) and hour = {hour}"
    )


@query("stored_bounds")
def stored_bounds(spark, sf):
    """Number, least and greatest value of each of the 21 indicators in every hour."""
    _, t = _stored(spark, sf)
    each = [im.snapshot_bounds(t["obs_by_instant"], c).withColumn("indicator", F.lit(c)) for c in MAP_INDICATORS]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    return found


@query("stored_features")
def stored_features(spark, sf):
    """Means of all nine indicators per place over a month, at places with three decimals."""
    _, t = _stored(spark, sf)
    third = F.lit(0.005) * (F.col("hour") % 3)
    moved = t["obs_by_instant"].withColumns({c: F.round(F.col(c).cast("double"), 2) + third for c in ("lon", "lat")})
    return sc.period_features(moved, *MONTH, decimals=3)


@query("month_profile_plain")
def month_profile_plain(spark, sf):
    """The monthly profile with plain means, as it is called without ``decimals``."""
    return ph.month_profile(_orders(spark, sf)).withColumn("mean", F.round("mean", 4))


# --- clusters of space ----------------------------------------------------

FEATURES = sc.feature_names(st.LINEITEM_INDICATORS)


def _features(spark, sf):
    return sc.period_features(st.obs_lineitem(spark, sf), *FULL_PERIOD, st.LINEITEM_INDICATORS, decimals=2)


def _scaled(spark, sf):
    return clustering.minmax_scale(written(_features(spark, sf), "features"), FEATURES)


def _start(points, k):
    return clustering.collect_centres(points.orderBy(*sc.PLACE), FEATURES, k)


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("period_scan")
def period_scan(spark, sf):
    return sc.period_scan(st.obs_lineitem(spark, sf), *PERIOD, st.LINEITEM_INDICATORS)


@query("complete_cases")
def complete_cases(spark, sf):
    return sc.complete_cases(st.obs_lineitem(spark, sf), st.LINEITEM_INDICATORS)


@query("period_features")
def period_features(spark, sf):
    return _features(spark, sf)


@query("minmax_bounds")
def minmax_bounds(spark, sf):
    return clustering.minmax_bounds(_features(spark, sf), FEATURES)


@query("minmax_scale")
def minmax_scale(spark, sf):
    return _scaled(spark, sf)


@query("euclidean_distance")
def euclidean_distance(spark, sf):
    vectors = st.table(spark, sf, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg("x").alias("x"))
        .groupBy("label")  # one element per vector position
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
        .select("label", F.col("c.x").alias("centre"))
    )
    d = euclidean(F.col("embedding"), F.col("centre"))
    return salted_join(vectors, means, ["label"], ["vec_id"]).select("vec_id", "label", F.round(d, 6).alias("distance"))


@query("kmeans_init")
def kmeans_init(spark, sf):
    return clustering.sample_centres(_features(spark, sf), sc.PLACE, FEATURES, CENTRES)


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    points = _scaled(spark, sf)
    found = clustering.assign(points, FEATURES, _start(points, CENTRES))
    return _rounded(found.select("station", "label", "distance"), ["distance"])


@query("kmeans_step")
def kmeans_step(spark, sf):
    points = _scaled(spark, sf)
    assigned = clustering.assign(points, FEATURES, _start(points, CENTRES))
    return _rounded(clustering.centre_means(assigned, FEATURES), FEATURES)


@query("kmeans_fit")
def kmeans_fit(spark, sf):
    points = _scaled(spark, sf)
    start = points.orderBy(*sc.PLACE).limit(CENTRES)
    found = clustering.kmeans(points, sc.PLACE, FEATURES, CENTRES, start, max_iter=MAX_ROUNDS, eps=EPS)
    return _rounded(found.select("station", "label", "distance"), ["distance"])


def _clusters(fn, spark, sf, k):
    return fn(
        st.obs_lineitem(spark, sf), *FULL_PERIOD, k=k, indicators=st.LINEITEM_INDICATORS, decimals=2,
        first_as_centres=True, max_iter=MAX_ROUNDS, eps=EPS,
    )


@query("cluster_period")
def cluster_period(spark, sf):
    return _clusters(sc.cluster_period, spark, sf, CENTRES)


@query("cluster_map_layer")
def cluster_map_layer(spark, sf):
    return _clusters(sc.cluster_map_layer, spark, sf, MAP_CENTRES)


# --- map of an instant ----------------------------------------------------


@query("hour_snapshot")
def hour_snapshot(spark, sf):
    snapshot = im.hour_snapshot(_snapshots(spark, sf), *INSTANT)
    return snapshot.withColumn("feel", F.round("feel", 6))


@query("snapshot_bounds")
def snapshot_bounds(spark, sf):
    return im.snapshot_bounds(_snapshots(spark, sf), "tmpf")


@query("grid_cells")
def grid_cells(spark, sf):
    nation = st.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    lon, lat = st.point_lon(F.col("c_custkey")), st.point_lat(F.col("c_custkey"))
    step = F.lit(Grid().step)
    boxes = (
        st.table(spark, sf, "customer")
        .join(nation, "c_nationkey")
        .groupBy("n_regionkey")
        .agg(
            F.min(lon).alias("w"), F.max(lon).alias("e"), F.min(lat).alias("s"), F.max(lat).alias("n"),
        )
    )
    cells = explode_grid(
        boxes, F.col("w"), F.col("s"),
        axis_size(F.col("w"), F.col("e"), step), axis_size(F.col("s"), F.col("n"), step), step,
    )
    return cells.select("n_regionkey", "ix", "iy", "lon", "lat")


def _places(spark, sf):
    return written(location_means(_snapshots(spark, sf), im.SNAPSHOT, "feel"), "places")


@query("semivariogram")
def semivariogram_bins(spark, sf):
    return _rounded(semivariogram(_places(spark, sf), im.SNAPSHOT), ["lag", "gamma"])


@query("variogram_fit")
def variogram_model(spark, sf):
    model = variogram_fit(semivariogram(_places(spark, sf), im.SNAPSHOT), im.SNAPSHOT)
    return _rounded(model, ["nugget", "psill", "range", "sse"])


@query("krige_weights")
def krige_weights(spark, sf):
    """The weight of each place and the constant of its snapshot."""
    solved = im.fitted_weights(_snapshots(spark, sf), "feel").blocks
    each = solved.selectExpr(*im.SNAPSHOT, "constant", "explode(arrays_zip(lons, lats, weights)) as s")
    return _rounded(each.selectExpr(*im.SNAPSHOT, "s.lons as lon", "s.lats as lat", "s.weights as weight", "constant"), ["weight", "constant"])


@query("krige_surface")
def krige_surface_all(spark, sf):
    weights = im.fitted_weights(_snapshots(spark, sf), "feel")
    surface = krige_surface(weights, im.SNAPSHOT, Grid())
    path = new_path(spark, "surface")
    im.write_surface(surface, path)
    return spark.read.schema(surface.schema).parquet(path).withColumn("z", F.round("z", 3))


@query("contour_bands")
def contour_bands(spark, sf):
    rows = _snapshots(spark, sf)
    means = location_means(rows, im.SNAPSHOT, "tmpf", decimals=2)
    readings = rows.select(*im.SNAPSHOT, "lon", "lat", F.col("tmpf").alias("z"))
    return im.contour_bands(readings, im.snapshot_bounds(means, "z"))


@query("indicator_map")
def indicator_map(spark, sf):
    return im.indicator_map(_snapshots(spark, sf), *INSTANT, "feel").withColumn("z", F.round("z", 6))


@query("variance_map")
def variance_map(spark, sf):
    """How uncertain the map of one instant is, cell by cell."""
    rows = im.hour_rows(_snapshots(spark, sf), *INSTANT)
    surface = im.indicator_surface(rows, "feel", Grid(), variance=True)
    return _rounded(surface.select(*im.SNAPSHOT, "ix", "iy", "variance"), ["variance"])


@query("krige_variance")
def krige_variance(spark, sf):
    return im.indicator_surface(_snapshots(spark, sf), "feel", Grid(), variance=True)
