"""Flows over drawn images and records, sources, streaming, and the registry without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphframe.operators import generate, raster, shapes, text
from glyphframe.plans import compare, measure
from glyphframe.sources import files
from glyphframe.streaming import windows

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def drawings(spark):
    def image(i):
        m = np.zeros((40, 40), bool)
        m[18:23, 4:36] = True
        if i % 2:
            m[4:36, 18:23] = True
        if i % 3 == 0:
            m[2:12, 2:12] = True
            m[5:9, 5:9] = False
        return np.where(m, 0.0, 255.0)

    return spark.createDataFrame([(i, 40, 40, image(i).ravel().tolist()) for i in range(1, 13)], "img_id int, h int, w int, px array<double>").cache()


def test_measurements_to_neighbours(spark, drawings):
    masks = measure.masks_of(drawings).cache()
    bones = shapes.skeletons(masks).cache()
    f, t, g = measure.features(masks), measure.topology(masks, bones), measure.lines(drawings)
    rows = compare.combined(f, t, g).cache()
    by = {r.id: r for r in rows.collect()}
    assert len(by) == 12 and by[1].ink_ratio > by[2].ink_ratio and by[3].holes == 1 and by[2].holes == 0
    assert all(sum(r.angle_histogram) == r.n_lines for r in by.values())
    near = compare.neighbour_lists(rows, 3).collect()
    assert len(near) == 36 and {r.distance for r in near if r["rank"] == 1} == {0.0}
    clusters = {r.id: r.cluster for r in compare.clusters(rows, 4).collect()}
    assert len(set(clusters.values())) == 4 and clusters[1] == clusters[5] and clusters[2] == clusters[4]
    profile = compare.cluster_profile(rows, spark.createDataFrame(list(clusters.items()), "id int, cluster int"))
    assert profile.count() == 4 * 12
    scores, trend, thirds = compare.complexity(rows)
    assert scores.count() == 12 and 0 <= trend.first().p <= 1 and thirds.count() == 3
    assert compare.order_trends(rows, ["ink_ratio", "holes"]).count() == 2
    assert measure.stroke_graphs(bones).where("n_nodes > 0").count() == 12
    assert measure.fourier(masks).select(F.size("descriptor")).distinct().first()[0] == 160
    assert measure.terminals(bones).count() > 0


def test_nested_documents(spark):
    spine, names = spark.range(1, 79).select(F.col("id").cast("int")), spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    part = spark.createDataFrame([(1, 0.5)], "id int, ink double")
    rows = compare.documents(spine, names, {"features": part}).orderBy("id").collect()
    assert len(rows) == 72 and rows[0].features.ink == 0.5 and rows[1].features is None and rows[2].name == "Sigil 3"


def test_blank_and_full_rasters(spark):
    blank, full = [0] * 64, [1] * 64
    m = spark.createDataFrame([(1, 8, 8, blank), (2, 8, 8, full)], "img_id int, h int, w int, px array<int>")
    b = {r.img_id: r for r in raster.basics(m).collect()}
    assert b[1].compactness == 0 and b[2].compactness == 1
    assert {r.img_id: round(r.dimension, 9) for r in raster.box_dimension(m).collect()} == {1: 0.0, 2: 2.0}
    assert {(r.horizontal, r.vertical) for r in raster.symmetry(m).collect()} == {(0.0, 0.0)}
    assert {r.img_id: r.components for r in shapes.topology(m).collect()} == {1: 0, 2: 1}


def test_page_cells(spark):
    page = spark.createDataFrame([(1, 4, 6, [float(v) for v in range(24)])], "img_id int, h int, w int, px array<double>")
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, None), (1, 1, 2)], "row int, col int, number int")
    rows = {r.number: r for r in measure.page_cells(page, [0, 2, 4], [0, 3, 6], cells).collect()}
    assert rows[1].px == [0.0, 1.0, 2.0, 6.0, 7.0, 8.0] and rows[2].px == [15.0, 16.0, 17.0, 21.0, 22.0, 23.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"},\n {"id": 2}]')
    (tmp_path / "k.json").write_text('{"1": [3, 4],\n "2": []}')
    (tmp_path / "p.pgm").write_bytes(files.to_graymap(2, 3, [0, 1, 2, 3, 4, 300]))
    (tmp_path / "bad.pgm").write_bytes(b"no image")
    assert [tuple(r) for r in files.read_records(spark, f"{tmp_path}/a.json", "id int, name string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert {r.key: r.value for r in files.read_keyed(spark, f"{tmp_path}/k.json", "array<int>").collect()} == {"1": [3, 4], "2": []}
    assert files.read_optional(spark, f"{tmp_path}/none.json", "id int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.require(spark, f"{tmp_path}/none.json")
    images = {r.path.rpartition("/")[2]: r for r in files.read_graymaps(spark, f"{tmp_path}/*.pgm").collect()}
    assert images["p.pgm"].px == [0.0, 1.0, 2.0, 3.0, 4.0, 255.0] and images["bad.pgm"].px is None
    files.write_records(spark.range(3), f"{tmp_path}/out")
    files.write_records(spark.range(2), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(["a", "b"], "A Woman sang", -7.0)], "tags array<string>, t string, x double")
    row = df.select(text.categories(F.col("t"), {"m": ["man"], "s": ["song", "sang"], "z": ["zzz"]}).alias("c"), text.floor_cell(F.col("x"), 15).alias("k"), text.fixed_length(F.array(F.lit(1.0)), 3).alias("f"), text.normalised(F.array(F.lit(0.0))).alias("n")).first()
    assert row.c == ["m", "s"] and row.k == -1 and row.f == [1.0, 0.0, 0.0] and row.n == [0.0]


def test_generator_repeats_itself(spark):
    grammar = {"angle_probabilities": [0.5, 0.5], "terminal_probabilities": {"simple": 0.5, "circle": 0.5}, "symmetry_probability": 0.5, "hole_probability": 1.0}
    a, b = (sorted(map(tuple, generate.generate(spark, grammar).collect())) for _ in range(2))
    assert a == b and {r[0] for r in a} == set(range(42, 66))
    assert generate.rasterise(generate.generate(spark, grammar)).count() == 24


def test_streams_equal_batches(spark, small, tmp_path):
    source = spark.read.parquet(f"{small}/events.parquet")
    source.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/events")
    for name, f in (("runs", lambda e: windows.runs(e, "user_id")), ("profiles", lambda e: windows.profiles(e, "event_type", "value"))):
        q = f(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        batch = f(source).select(F.col(f(source).columns[0]), "start", "n")
        got = spark.table(name).select(batch.columns)
        assert got.count() > 0 and got.exceptAll(batch).count() == 0  # what the watermark has closed


def test_registry_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'pipeline' not in names and not any(n.startswith('op1_') for n in names) and set(e.oracle_sql()) <= names; print(len(names))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 80


def test_images_are_written_read_and_joined(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = {k: rng.integers(0, 256, (5, 7)) for k in range(4)}
    images = spark.createDataFrame([(k, 5, 7, m.ravel().astype(float).tolist()) for k, m in pixels.items()] + [(9, None, None, None)], "img_id long, h int, w int, px array<double>")
    for kind in ("png", "pgm"):
        for _ in range(2):  # the same again replaces
            assert files.write_images(images, f"file://{tmp_path}/{kind}", kind) == 4
        listed = spark.createDataFrame([(10 + k, f"{k}.{kind}") for k in (0, 2, 77)], "id long, file string")
        got = {r.img_id: np.array(r.px).reshape(r.h, r.w) for r in files.read_listed_images(spark, f"{tmp_path}/{kind}/*", listed).collect()}
        assert got.keys() == {10, 12} and (got[10] == pixels[0]).all() and (got[12] == pixels[2]).all()


def test_png_lines_of_every_kind():
    import zlib

    rng = np.random.default_rng(1)
    for channels, colour in ((1, 0), (3, 2), (2, 4), (4, 6)):
        m = rng.integers(0, 256, (5, 6 * channels)).astype(int)
        raw = b""
        for y in range(5):  # a line of each kind, differences taken one by one
            up = m[y - 1] if y else np.zeros(6 * channels, int)
            line = []
            for i in range(6 * channels):
                a, b, c = (m[y, i - channels] if i >= channels else 0), up[i], (up[i - channels] if i >= channels else 0)
                guess = sorted((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[0][2]
                line.append((m[y, i] - (0, a, b, (a + b) // 2, guess)[y]) % 256)
            raw += bytes([y, *line])
        body = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + b"\0\0\0\0"
        head = (6).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
        found = files.png(files.PNG + body(b"IHDR", head) + body(b"IDAT", zlib.compress(raw)) + body(b"IEND", b""))
        v = m.reshape(5, 6, channels)
        want = v[:, :, 0] if channels < 3 else np.rint(v[:, :, :3] @ np.array([0.299, 0.587, 0.114]))
        assert (found == want).all()
    assert files.png(files.PNG) is None and files.png(files.to_png(2, 2, [1, 2, 3, 4])[:-30]) is None
