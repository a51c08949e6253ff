"""Readers and sinks on files, with the odd names and formats they must take."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import labels, text
from veilgrid.functions import numeric as N
from veilgrid.sources import files, readers, sinks

POINTS = [(-120.50, 36.50, -6.0, 0.8, 0.1), (-120.49, 36.51, -2.0, 0.7, 0.2), (-120.48, 36.52, -0.1, 0.9, 0.1), (-120.47, 36.53, 1.2, 0.6, 0.3), (-120.46, 36.54, -10.5, 0.5, 0.2)]
NAMES = ["Lon Deg", "Lat Deg", "V_UP mm yr", "Temp Coh", "Amp Dispersion"]


@pytest.mark.parametrize("name", ["p.csv", "p.csv.gz", "p.parquet", "p.pq"])
def test_point_formats(spark, tmp_path, name):
    df = spark.createDataFrame(POINTS, [f"`{n}`" for n in NAMES]).toDF(*NAMES)
    path = str(tmp_path / name)
    if name.endswith(("parquet", "pq")):
        df.write.parquet(path)
    else:
        df.write.option("header", True).option("compression", "gzip" if name.endswith("gz") else "none").csv(path)
    got = readers.resolve_points(readers.read_points(spark, path))
    assert got.columns == ["longitude", "latitude", "velocity_mm_per_year", "temporal_coherence", "amplitude_dispersion"]
    assert got.count() == 5 and got.filter("velocity_mm_per_year <= -5").count() == 2


def test_unsupported_and_missing_columns(spark):
    with pytest.raises(ValueError, match="unsupported point format"):
        readers.read_points(spark, "/x/y.gpkg")
    with pytest.raises(ValueError, match="no latitude column"):
        readers.find_column(["lon", "speed"], ["latitude", "lat"], "latitude")
    assert readers.find_column(["MEAN VEL.", "up"], readers.POINT_ALIASES["velocity_mm_per_year"], "v") == "MEAN VEL."


def test_bom(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("\ufeffname,value\na,1\n".encode())
    got = readers.read_csv(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["name", "value"] and got.first().name == "a"


def test_hash(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    path = str(tmp_path / "f.bin")
    rows = files.file_hashes(spark, [path, path]).collect()
    assert [r.sha256 for r in rows] == [hashlib.sha256(b"abc").hexdigest().upper()]
    with pytest.raises(Exception):
        files.file_hashes(spark, [str(tmp_path / "absent")]).collect()


def test_preflight_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("Longitude,Latitude,mean_velocity\n1,2,3\n")
    (tmp_path / "odd.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "pack.zip").write_bytes(b"PK")
    (tmp_path / "note.doc").write_text("-")
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    (tmp_path / "DOWNLOAD_HERE.txt").write_text("-")
    heads = files.file_headers(spark, [str(p) for p in sorted(tmp_path.iterdir())])
    got = {r.file_name: r.status for r in heads.select("file_name", text.preflight_status("file_name", "suffix", F.col("header"), F.col("readable")).alias("status")).collect()}
    assert got == {"good.csv": "candidate", "odd.csv": "inspect_columns", "pack.zip": "needs_conversion", "note.doc": "unsupported_suffix", "bad.parquet": "unreadable", "DOWNLOAD_HERE.txt": "placeholder"}


def test_files_are_streamed(spark, tmp_path):
    big = bytes(range(256)) * 40_000
    (tmp_path / "t.parquet").mkdir()
    for name in ("part-0", "part-1", "_SUCCESS"):
        (tmp_path / "t.parquet" / name).write_bytes(big + name.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "long.csv").write_text("\ufeff" + ",".join(f'"c, {i}"' for i in range(9000)) + "\r\n1\n")
    with gzip.open(tmp_path / "z.csv.gz", "wt") as out:
        out.write("lon,lat,vel\n1,2,3\n")
    table = spark.createDataFrame([(str(tmp_path / "t.parquet"),), (f"file://{tmp_path}/empty.csv",), (None,), (str(tmp_path / "t.parquet"),)], "path string")
    got = {r.path.rsplit("/", 1)[-1]: (r.bytes, r.sha256) for r in files.file_hashes(spark, table).collect()}
    want = {n: big + n.encode() for n in ("part-0", "part-1")} | {"empty.csv": b""}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest().upper()) for n, b in want.items()}
    heads = {r.file_name: (r.header, r.readable) for r in files.file_headers(spark, [str(tmp_path / n) for n in ("empty.csv", "long.csv", "z.csv.gz", "gone.csv")]).collect()}
    assert heads == {"empty.csv": ([], False), "gone.csv": ([], False), "long.csv": ([f"c, {i}" for i in range(9000)], True), "z.csv.gz": (["lon", "lat", "vel"], True)}


def test_banded_raster_prunes(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") / 40).cast("bigint").alias("row"), (F.col("id") % 40).alias("col"), F.col("id").alias("v"))
    path = str(tmp_path / "r")
    sinks.write_raster(df, path, band_rows=10)
    got = readers.raster_window(spark.read.parquet(path), 23, 41, 5, 9, "row_band", 10)
    assert got.count() == 18 * 4 and len(got.inputFiles()) <= len(spark.read.parquet(path).inputFiles())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(row_band" in plan and "GreaterThanOrEqual(row,23)" in plan


def test_manifest_blank_frame(spark):
    rows = [("b", "F1", "ok", "r/1"), ("a", "", "ok", "r/2"), ("c", None, "ok", "r/3"), ("d", "F2", "ok", "r/1"), ("e", "F1", "failed", "r/1"), ("f", "F1", "ok", "r/9")]
    m = spark.createDataFrame(rows, "pair string, frame_id string, download_status string, local_path string")
    r = spark.createDataFrame([("r/1",), ("r/2",), ("r/3",), ("r/1",)], "local_path string")
    assert [x.pair for x in readers.manifest_pairs(m, "F1", r).collect()] == ["a", "b", "c"]


def test_ledger_numbers(spark):
    runs = spark.createDataFrame([("x", 2), ("y", 1)], "stack string, o int")
    got = sorted((r.run_id, r.stack) for r in sinks.ledger_rows(runs, 7, "o").collect())
    assert got == [("freeze-0007", "y"), ("freeze-0008", "x")]


def test_numeric_edges(spark):
    vals = [float("nan"), 1e30, -1e30, -9999.0, -3.0, None, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    keep = lambda c: [r.x for r in df.filter(c).collect()]
    assert keep(N.finite("x")) == [1e30, -1e30, -9999.0, -3.0, 4.0]
    assert keep(N.within_sentinel("x", -9999.0)) == [-3.0, 4.0]
    assert keep(N.valid_exposure("x", -9999.0)) == [1e30, 4.0]
    r = spark.range(1).select(N.ratio0(F.lit(1), F.lit(0)), N.ratio_null(F.lit(1), F.lit(0)), N.haldane_or(*[F.lit(0)] * 4), N.clamp01(F.lit(9.0), 2.0)).first()
    assert list(r) == [0.0, None, 1.0, 1.0]
    t = spark.createDataFrame([("",), ("nan",), ("1.5",), ("x",), (None,)], "s string")
    assert [r[0] for r in t.select(N.blank_to_null("s")).collect()] == [None, None, 1.5, None, None]


def test_strict_bbox(spark):
    ok = spark.range(1).select(labels.require_valid_bbox(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    assert ok.first()[0] is True
    with pytest.raises(Exception, match="exceeds_side_limit"):
        spark.range(1).select(labels.require_valid_bbox(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(1.0))).collect()


def test_text_edges(spark):
    df = spark.createDataFrame([("  A--b C!  ",), ("***",), ("",)], "s string")
    assert [r[0] for r in df.select(text.slugify("s")).collect()] == ["a_b_c", "term", "term"]
    page = '<tr>\n<td class="region"><span title="T">Land</span></td><td class="proper">1.5</td><td class="proper">2.5</td></tr>'
    html = spark.createDataFrame([(page + page.replace("1.5", "7"),)], "h string")
    rows = html.select(F.explode(text.html_rows("h", r'(?s)<tr>\s*<td class="region">.*?</tr>')).alias("r"))
    cells = [r[0] for r in rows.select(text.html_cells("r", '<td class="proper">([^<]+)</td>')).collect()]
    assert cells == [["1.5", "2.5"], ["7", "2.5"]]
    tags = spark.range(1).select(text.transport_category(F.create_map(F.lit("highway"), F.lit(""))), text.transport_category(F.create_map(F.lit("railway"), F.lit(""))))
    assert list(tags.first()) == [None, "railway"]


def test_typed_csv_is_read_by_name(spark, tmp_path):
    (tmp_path / "n.csv").write_text("﻿b,a,c\n7,1,x\nbad,2,y\n")
    got = readers.read_csv(spark, str(tmp_path / "n.csv"), "a int, b int")
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, 7), (2, None)]
    with pytest.raises(ValueError, match="no column d"):
        readers.read_csv(spark, str(tmp_path / "n.csv"), "a int, d int")


def test_ledger_ties_go_by_the_other_columns(spark):
    runs = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (0.5, "c")], "o double, stack string")
    got = sorted((r.run_id, r.stack) for r in sinks.ledger_rows(runs, 1, "o").collect())
    assert got == [("freeze-0001", "c"), ("freeze-0002", "a"), ("freeze-0003", "b")]
