"""Models, feeds and streams survive a round trip."""

from meridion.sources import files
from meridion.sources.model import Model
from meridion.streaming import events


def test_model(spark, tmp_path):
    m = Model({"zones": spark.createDataFrame([("a", 1.0)], "zone string, x double")}, {"k": [1, 2]})
    m.save(f"{tmp_path}/m")
    back = Model.load(spark, f"{tmp_path}/m")
    assert back.params == m.params and back.zones.collect() == m.zones.collect()
    assert m.merged(back).zones.count() == 2


def test_feed(spark, tmp_path):
    (tmp_path / "trips.txt").write_text("trip_id,route_id,service_id\nt1,r1,w\nt2,r2,s\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence,arrival_time,departure_time\nt1,a,1,25:10:00,25:10:00\nt2,b,1,08:00:00,08:00:00\n")
    (tmp_path / "stops.txt").write_text("stop_id,stop_lat,stop_lon\na,1,2\nb,3,4\n")
    (tmp_path / "calendar.txt").write_text("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nw,1,1,1,1,1,0,0,20240101,20241231\ns,0,0,0,0,0,1,1,20240101,20241231\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date,exception_type\ns,20240108,1\nw,20240109,2\n")
    feed = files.read_gtfs(spark, str(tmp_path))
    on = lambda d: {r[0] for r in files.services_on(feed, d).collect()}
    assert on("20240108") == {"w", "s"} and on("20240109") == set() and on("20240113") == {"s"}
    alone = {k: v for k, v in feed.items() if k != "calendar"}
    assert {r[0] for r in files.services_on(alone, "20240108").collect()} == {"s"}
    cut = files.restrict(feed, feed["trips"].filter("service_id = 'w'"))
    assert [r["stop_id"] for r in cut["stops"].collect()] == ["a"]


def test_geojson(spark, tmp_path):
    (tmp_path / "n.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"index":"n1"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    r = files.read_geojson(spark, f"{tmp_path}/n.geojson").first()
    assert (r["properties"]["index"], r["kind"], r["coordinates"]) == ("n1", "Point", "[1,2]")


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    q = events.write(events.windowed(events.read_events(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = events.windowed(src)
    assert got.exceptAll(want).count() == 0 and got.count() > 0.9 * want.count()


def test_document(spark, tmp_path):
    from meridion.sources import exchange as X

    nodes = spark.createDataFrame([("n1", 1.0, 2.0), ("n2", 3.0, 4.0)], "node string, x double, y double")
    volumes = spark.createDataFrame([("n1", "n2", 5.5)], "origin string, destination string, volume double")
    m = Model({"nodes": nodes, "volumes": volumes}, {"epsg": 4326, "name": "small", "list": [1, 2]})
    X.write_document(m, f"{tmp_path}/d", {"nodes": ("x", "y")})
    back = X.read_document(spark, f"{tmp_path}/d", {"nodes": "node string", "volumes": "origin string, destination string, volume double"})
    assert sorted(map(tuple, back.nodes.collect())) == sorted(map(tuple, nodes.collect()))
    assert back.volumes.collect() == volumes.collect() and back.params == m.params


def test_parameters_inherit(spark):
    from meridion.sources import exchange as X

    rows = [("general", "parent", None, "base", "base", "dense"), ("speed", "car", None, "50", None, "30"), ("speed", "bus", None, "20", "25", None), ("speed", "bus", "AM", "15", None, None)]
    sheet = spark.createDataFrame(rows, "category string, parameter string, period string, base string, dense string, quiet string")
    get = lambda s, p=None: {(r[0], r[1]): r[2] for r in X.inherited(sheet, s, p).collect()}
    assert get("quiet")["speed", "car"] == "30" and get("quiet")["speed", "bus"] == "25" and get("dense")["speed", "car"] == "50"
    assert get("base", "am")["speed", "bus"] == "15" and get("base")["speed", "bus"] == "20"
    assert X.ancestry({"a": "b", "b": "b"}, "a") == ["a", "b"]
    assert [X.typed(*x) for x in (("1.5", "float"), ("2", "int"), ("True", "bool"), ("[1]", "json"), ("x", "str"), (None, "int"))] == [1.5, 2, True, [1], "x", None]


def test_reshaping(spark):
    from meridion.sources import exchange as X

    df = spark.createDataFrame([("l1", 50.0, 40.0, 45.0), ("l1_r", 30.0, 20.0, 25.0), ("l2", 60.0, 60.0, 60.0)], "link string, speed double, `speed#AM` double, `speed#PM` double")
    am = X.variant(df, "AM")
    assert sorted(map(tuple, am.collect())) == [("l1", 40.0), ("l1_r", 20.0), ("l2", 60.0)]
    assert sorted(map(tuple, X.folded(am, "link", ["speed"]).collect())) == [("l1", 40.0, 20.0), ("l2", 60.0, None)]
    m = Model({"los": spark.createDataFrame([("pt", 1), ("car", 2), ("pt", 3)], "mode string, x int")})
    cut = X.split(m, "los", "mode")
    assert sorted(cut.tables) == ["los_car", "los_pt"] and sorted(r[0] for r in X.unsplit(cut, "los").los.collect()) == [1, 2, 3]
    assert sum(c.count() for c in X.chunks(m.los, 3, ["mode"])) == 3
    links, nodes = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1,), (2,)], "node int")
    both = X.networks_merged((links, nodes), (links, nodes), "node")
    assert sorted(map(tuple, both[0].collect())) == [("1_left", "2_left"), ("1_right", "2_right")] and both[1].count() == 4
    assert sorted(map(tuple, X.stacked({"s": links, "t": links}).collect())) == [(1, 2, "s"), (1, 2, "t")]
    trips = spark.createDataFrame([("t", 1, 5, 6, 600.0), ("t", 2, 6, 9, 600.0)], "trip string, link_sequence int, a int, b int, headway double")
    assert X.line_text(trips).first()["value"] == 'LINE NAME="t", HEADWAY=10.00, N=5,6,9'
