"""Snapshot rules, readers and sinks."""

import pytest
from pyspark.sql import functions as F

from barrio.operators import match
from barrio.plans import ingest, snapshot
from barrio.session import shared_folder
from barrio.sources import scans, sinks

def run():
    return F.lit(7).cast("bigint")


def now():
    return F.lit("2026-06-03 10:00:00").cast("timestamp_ntz")


def stores(spark, rows):
    df = spark.createDataFrame(
        rows, "id long, source_name string, source_local_id string, name string, badges array<string>, confidence_level string, last_import_run_id long, is_published boolean, "
              "opening_hours_web string, postal_code string, district string")
    return snapshot.as_stores(df)


def osm_batch(spark, rows):
    df = spark.createDataFrame(rows, "id string, lat double, lng double, tags map<string,string>")
    return ingest.osm_batch(df)


def test_map_upsert_keeps_what_it_must(spark):
    old = stores(spark, [
        (1, "osm", "n1", "Old", ["oficial"], "excluded", 3, False, "24/7", "28001", "Centro"),
        (2, "osm", "n2", "Gone", [], "high", 3, True, None, None, None),
        (3, "censo_madrid", "n1", "Other", [], "high", 3, False, None, None, "D"),
    ])
    batch = osm_batch(spark, [("n1", 40.0, -3.0, {"amenity": "bar", "name": "New"}), ("n9", 41.0, -3.0, {"shop": "kiosk"})])
    once = snapshot.upsert(old, batch, "osm", run(), now())
    rows = {(r.source_name, r.source_local_id): r for r in once.collect()}
    new = rows["osm", "n1"]
    assert (new.id, new.name, new.badges, new.opening_hours_web, new.postal_code) == (1, "New", ["oficial"], "24/7", "28001")
    assert (new.district, new.is_published, new.confidence_level) == (None, True, "medium")
    assert rows["osm", "n2"].last_import_run_id == 3 and rows["censo_madrid", "n1"].district == "D"
    assert rows["osm", "n9"].scoring_version == "osm-v1" and rows["osm", "n9"].badges == []
    twice = snapshot.upsert(once, batch, "osm", run(), now())
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_missing_rows_are_marked_once(spark):
    old = stores(spark, [
        (1, "censo_diba", "a", "A", [], "high", 7, False, None, None, None),
        (2, "censo_diba", "b", "B", ["bar"], "high", 3, False, None, None, None),
        (3, "censo_diba", "c", "C", ["posible_cerrado"], "low", None, False, None, None, None),
        (4, "osm", "d", "D", [], "high", 3, True, None, None, None),
    ])
    out = {r.id: (r.badges, r.confidence_level) for r in snapshot.deactivate_missing(old, "censo_diba", run()).collect()}
    assert out == {1: ([], "high"), 2: (["bar", "posible_cerrado"], "excluded"), 3: (["posible_cerrado"], "low"), 4: ([], "high")}


@pytest.mark.parametrize("unseen,pruned", [(0, 0), (15, 15), (16, 0), (100, 0)])
def test_prune_guard(spark, unseen, pruned):
    rows = [(i, "osm", str(i), "x", [], "high", 3 if i < unseen else 7, True, None, None, None) for i in range(100)]
    out = snapshot.prune_vanished(stores(spark, rows), run())
    assert out.where("confidence_level = 'excluded' and not is_published").count() == pruned


def test_refinement_is_idempotent_and_one_to_one(spark, data):
    from barrio.catalog.registry import Data

    first_in = Data(spark, data).stores
    matches = match.accepted_matches(first_in)
    first = snapshot.refine(first_in, matches)
    second = snapshot.refine(first, match.accepted_matches(first))
    columns = ["id", "is_published", "publication_reason", "badges", *snapshot.EVIDENCE]
    assert sorted(map(str, first.select(columns).collect())) == sorted(map(str, second.select(columns).collect()))
    assert matches.select("osm_id").distinct().count() == matches.select("censo_id").distinct().count() == matches.count()


def test_csv_with_mark_quotes_and_breaks(spark, tmp_path):
    header = ";".join(scans.MADRID_COLUMNS[:45] + ["desc_epigrafe"])
    cells = [""] * 46
    cells[0], cells[39] = "10", '"BAR ""EL; SOL""\nNORTE"'
    (tmp_path / "m.csv").write_text("\ufeff" + header + "\n" + ";".join(cells) + "\n", encoding="utf-8")
    row = scans.scan_madrid(spark, str(tmp_path)).first()
    assert (row.id_local, row.rotulo, row.fx_carga, row.desc_vial_edificio) == ("10", 'BAR "EL; SOL"\nNORTE', None, None)


def test_bad_fixture_coordinates_fail_the_run(spark, tmp_path):
    (tmp_path / "s.csv").write_text("source_local_id,name,x_25830,y_25830\nL1, A ,1,2\nL2,B,NaN,2\n")
    with pytest.raises(Exception, match="invalid coordinates for L2"):
        scans.scan_sample(spark, str(tmp_path)).collect()


def test_log_files_by_name(spark, tmp_path):
    import gzip

    line = '{"ts": 1700000000.5, "request": {"uri": "/a", "client_ip": "1.1.1.1"}}\n'
    (tmp_path / "access.log").write_text(line + "junk\n")
    (tmp_path / "access-1.log.gz").write_bytes(gzip.compress(line.encode()))
    (tmp_path / "error.log").write_text(line)
    rows = scans.scan_access_log(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].ts_epoch == 1700000000.5


def test_readers_stay_on_the_last_sound_version(spark, tmp_path):
    base = stores(spark, [(1, "osm", "a", "A", [], "high", 3, True, None, None, None)])
    runs = spark.createDataFrame([(3,)], "id long")
    acts = spark.createDataFrame([(1,)], "store_id long")
    tables = {"stores": base, "import_runs": runs, "store_activities": acts}
    root = str(tmp_path / "snap")
    assert sinks.publish_snapshot(tables, root, 1).first().valid
    lost = {**tables, "import_runs": runs.where("id > 3")}
    assert not sinks.publish_snapshot(lost, root, 2).first().valid
    assert sinks.read_snapshot(spark, root, "import_runs").count() == 1
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.publish_snapshot(tables, root, 1)


class _Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


class _Session:
    def __init__(self, spark, folder):
        self.conf, self.sparkContext = _Conf(folder), spark.sparkContext


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(_Session(spark, "hdfs:///shared/")) == "hdfs:///shared"
    own = shared_folder(_Session(spark, None))
    assert own == shared_folder(_Session(spark, "")) and "spark-" in own
