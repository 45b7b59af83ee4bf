"""A small report file with every fault the loaders meet."""

import datetime as dt

import pytest

from stationlens.schema import REPORT_COLUMNS
from stationlens.sources import layouts, reports


def line(**given):
    row = {c: "null" for c in REPORT_COLUMNS} | {"lon": "1.50", "lat": "45.00"} | given
    return ",".join(row[c] for c in REPORT_COLUMNS)


@pytest.fixture()
def report_file(tmp_path):
    rows = [
        line(station="AAA", valid="2005-01-01 00:30", tmpf="32.0", metar="plain"),
        line(station="BBB", valid="bad"),
        line(station="CCC", valid="2005-01-01 00:30", lon=""),
        line(station="DDD", valid="2005-01-01 00:30", lat=""),
        line(station="EEE", valid="2005-01-01 00:30", lon="null"),
        line(station="FFF", valid="2005-01-01 00:30:59", tmpf="M"),
        line(station="GGG", valid="2005-1-1 0:30", tmpf="NaN"),
        line(station="AAA", valid="2005-01-01 00:30", tmpf="45.14", metar='"LF, X\'Y ""Q"""'),
        line(station="HHH", valid="2005-13-45 00:30"),
        line(station="III", valid="99999999999999-01-01 00:30"),
        line(station="", valid="2005-01-01 00:30"),
        line(station="JJJ", valid="2005-01-01 00:30", tmpf="", skyc1="", peak_wind_time="2005-01-01 00:10"),
    ]
    head = ["#DEBUG: Format Typ    -> comma", "#DEBUG: Entries Found -> -1", ",".join(REPORT_COLUMNS)]
    path = tmp_path / "reports.txt"
    path.write_text("\n".join(head + rows) + "\n")
    return str(path)


def test_observations(spark, report_file):
    obs = {r["station"]: r for r in reports.observations(reports.read_reports(spark, report_file)).collect()}
    assert set(obs) == {"AAA", "EEE", "FFF", "GGG", "JJJ"}
    last = obs["AAA"]
    assert last["tmpf"] == pytest.approx(45.14, abs=1e-5)
    assert last["metar"] == 'LF, X\'Y "Q"'
    assert last["skyc1"] == "null"
    assert last["ts"] == dt.datetime(2005, 1, 1, 0, 30) and last["day"] == dt.date(2005, 1, 1)
    assert obs["EEE"]["lon"] is None and obs["EEE"]["lat"] == 45.0
    assert obs["FFF"]["tmpf"] is None and obs["FFF"]["minute"] == 30
    assert obs["GGG"]["tmpf"] is None and obs["GGG"]["month"] == 1
    assert obs["JJJ"]["tmpf"] is None and obs["JJJ"]["skyc1"] == ""
    assert obs["JJJ"]["peak_wind_time"] is None and obs["JJJ"]["peak_wind_time_raw"] == "2005-01-01 00:10"


def test_quality(spark, report_file):
    counts = {r["reason"]: r["n"] for r in reports.ingest_quality(reports.read_reports(spark, report_file)).collect()}
    assert counts["accepted"] == 6
    assert counts["bad_time"] == 1
    assert counts["no_location"] == 2
    assert counts["impossible_time"] == 2
    assert counts["no_station"] == 1
    assert counts["unreadable tmpf"] == 2
    assert counts["unreadable peak_wind_time"] == 1
    assert counts["unreadable dwpf"] == 0


def test_last_row_wins_across_splits(spark, tmp_path):
    rows = [line(station=f"S{i % 7}", valid="2005-01-01 00:30", tmpf=str(i)) for i in range(4000)]
    path = tmp_path / "long.txt"
    path.write_text("\n".join(["#DEBUG", ",".join(REPORT_COLUMNS), *rows]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        raw = reports.read_reports(spark, str(path))
        assert raw.rdd.getNumPartitions() > 3
        got = {r["station"]: r["tmpf"] for r in reports.observations(raw).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"S{i % 7}": float(i) for i in range(3993, 4000)}


def test_duplicates_are_cut_before_the_shuffle(spark, report_file):
    plan = reports.observations(reports.read_reports(spark, report_file))._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan


def test_layouts(spark, report_file, tmp_path):
    obs = reports.observations(reports.read_reports(spark, report_file))
    root = str(tmp_path / "tables")
    assert layouts.build_layouts(obs, root) == {"obs_by_station": 5, "obs_by_instant": 5, "stations": 5}
    tables = layouts.open_layouts(spark, root)
    columns = sorted(c for c in obs.columns if c != "_seq")
    want = sorted(map(str, obs.select(columns).collect()))
    for name in ("obs_by_station", "obs_by_instant"):
        assert sorted(map(str, tables[name].select(columns).collect())) == want
    assert spark.sql("select count(*) from obs_by_instant where day = date'2005-01-01' and hour = 0").first()[0] == 5
    hour = layouts.hour_rows(tables["obs_by_instant"], 2005, 1, 1, 0)
    assert "PartitionFilters: [isnotnull(day" in hour._jdf.queryExecution().executedPlan().toString()
    one = layouts.station_rows(tables["obs_by_station"], "AAA").select("tmpf")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(station,AAA)" in plan and "ReadSchema: struct<station:string,tmpf:float>" in plan
    assert [r.station for r in tables["stations"].orderBy("station_seq").collect()][0] == "EEE"


def test_hot_station_is_split_over_files(spark, tmp_path):
    obs = spark.range(200_000).selectExpr(
        "if(id % 3 = 0, 'HOT', concat('S', id % 50)) as station",
        "timestamp_ntz'2005-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as ts",
        "date'2005-01-01' as day", "cast(id % 24 as int) as hour", "cast(id % 60 as int) as minute",
    )
    for write, name in ((layouts.write_by_station, "s"), (layouts.write_by_instant, "i")):
        path = str(tmp_path / name)
        before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert write(obs, path) == 200_000
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        per_file = spark.read.parquet(path).groupBy("_metadata.file_name").count()
        assert per_file.count() >= 6
        assert max(r["count"] for r in per_file.collect()) < 60_000


def test_day_coverage(spark):
    obs = spark.sql("select * from values (date'2024-01-02'), (date'2024-01-02'), (date'2024-01-04') as t(day)")
    assert [r.n for r in layouts.day_coverage(obs).orderBy("day").collect()] == [2, 0, 1]
    wide = layouts.day_coverage(obs, "2024-01-01", "2024-01-03").orderBy("day").collect()
    assert [r.n for r in wide] == [0, 2, 0]


def write_file(path, columns, rows):
    path.write_text("\n".join(["#DEBUG", ",".join(columns), *[",".join(r) for r in rows]]) + "\n")
    return str(path)


def row_of(columns, **values):
    base = dict.fromkeys(REPORT_COLUMNS, "null") | {"station": "A", "valid": "2005-01-01 00:30", "lon": "1", "lat": "2"} | values
    return [base.get(c, "extra") for c in columns]


def test_fields_are_found_by_header_name(spark, tmp_path):
    swapped = ["note", *reversed(REPORT_COLUMNS)]
    path = write_file(tmp_path / "a.txt", swapped, [row_of(swapped, tmpf="50", dwpf="10")])
    (got,) = reports.observations(reports.read_reports(spark, path)).collect()
    assert (got["tmpf"], got["dwpf"], got["station"]) == (50.0, 10.0, "A")


def test_missing_field_is_an_error_or_null(spark, tmp_path):
    columns = [c for c in REPORT_COLUMNS if c != "dwpf"]
    path = write_file(tmp_path / "a.txt", columns, [row_of(columns, tmpf="50")])
    with pytest.raises(ValueError, match="a.txt: no column dwpf"):
        reports.read_reports(spark, path)
    (got,) = reports.observations(reports.read_reports(spark, path, missing="null")).collect()
    assert (got["tmpf"], got["dwpf"]) == (50.0, None)


@pytest.mark.parametrize("names, last", [(["z.txt", "y.txt"], "y.txt"), (["y.txt", "z.txt"], "z.txt")])
def test_last_file_of_the_list_wins(spark, tmp_path, names, last):
    for name in names:
        write_file(tmp_path / name, REPORT_COLUMNS, [row_of(REPORT_COLUMNS, tmpf="1" if name == last else "2")])
    (got,) = reports.observations(reports.read_reports(spark, [str(tmp_path / n) for n in names])).collect()
    assert got["tmpf"] == 1.0


def test_numbers_in_file_names_count(spark, tmp_path):
    for name, value in (("part-99999", "1"), ("part-100000", "2")):
        write_file(tmp_path / name, REPORT_COLUMNS, [row_of(REPORT_COLUMNS, tmpf=value)])
    (got,) = reports.observations(reports.read_reports(spark, str(tmp_path))).collect()
    assert got["tmpf"] == 2.0


def test_only_the_heads_of_the_files_are_read_for_the_header(spark, tmp_path):
    body = "\n".join(line(station=f"S{i % 50}", valid="2005-01-01 00:30", tmpf=str(i)) for i in range(40_000))
    for n in range(3):
        (tmp_path / f"part-{n}.txt").write_text("\n".join(["#DEBUG", "", ",".join(REPORT_COLUMNS), body]) + "\n")
    (tmp_path / "part-3.txt").write_text("# nothing\n")
    size = sum(f.stat().st_size for f in tmp_path.iterdir())

    def bytes_read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")

    files = sorted(str(f) for f in tmp_path.iterdir())
    before = bytes_read()
    found = reports.file_headers(spark, files)
    assert 0 < bytes_read() - before < size / 10
    assert found == dict.fromkeys(files[:3], ",".join(REPORT_COLUMNS))
    (tmp_path / "part-4.txt").write_text("# one more\n" * 5000 + ",".join(REPORT_COLUMNS) + "\n")
    assert reports.file_headers(spark, [str(tmp_path / "part-4.txt")]) == {str(tmp_path / "part-4.txt"): ",".join(REPORT_COLUMNS)}
    raw = reports.read_reports(spark, str(tmp_path))
    assert raw.count() == 120_000


def test_headers_of_files_longer_than_a_split(spark, tmp_path):
    body = "\n".join(line(station=f"S{i % 50}", valid="2005-01-01 00:30", tmpf=str(i)) for i in range(4000))
    heads = {"a": "#DEBUG\n", "b": "# one more\n" * 200, "c": "# one more\n" * 20_000}
    for name, comments in heads.items():
        (tmp_path / name).write_text(f"{comments}{','.join(REPORT_COLUMNS)}\n{body}\n")
    files = [str(tmp_path / name) for name in heads]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.text(files[0]).rdd.getNumPartitions() > 3
        # A limit behind a shuffle takes the lines of any split.
        assert "Exchange" not in reports._heads(spark, files, 64)._jdf.queryExecution().executedPlan().toString()
        assert reports.file_headers(spark, files) == dict.fromkeys(files, ",".join(REPORT_COLUMNS))
        assert reports.read_reports(spark, files[:2]).count() == 8000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
