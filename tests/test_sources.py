import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom.operators import histogram
from rasterloom.session import new_folder, release
from rasterloom.sources import gazetteer, images, lines, matrices, runs, sinks

RNG = np.random.default_rng(21)


def number(pattern):
    return F.regexp_extract("path", pattern, 1)


@pytest.fixture
def small_splits(spark):
    """Files are cut into pieces of a few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    text = [f"line {i} of the first file" for i in range(150)]
    (tmp_path / "a.txt").write_text("\n\n".join(text) + "\n")
    (tmp_path / "b.txt").write_text("\nonly\n\n")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = lines.numbered_lines(spark, str(tmp_path)).orderBy("path", "line").collect()
    assert [(r.line, r.value) for r in got] == [*enumerate(text), (0, "only")]


@pytest.mark.parametrize("split", [False, True])
def test_matrices(spark, tmp_path, raster, split, request):
    if split:
        request.getfixturevalue("small_splits")
    image = RNG.integers(-40, 300, (25, 9))
    (tmp_path / "m3.csv").write_text("\n".join(", ".join(map(str, row)) for row in image) + "\n")
    (tmp_path / "m4.csv").write_bytes(b"1,2,3\r\n\r\n4,5,6")
    read = matrices.read_matrices(spark, str(tmp_path), number(r"m(\d+)\.csv"))
    assert (raster(read, 3) == np.clip(image, 0, 255)).all()
    assert raster(read, 4).tolist() == [[1, 2, 3], [4, 5, 6]]
    kept = matrices.read_matrices(spark, str(tmp_path), number(r"m(\d+)\.csv"), clamp=False)
    assert raster(kept.where("image_id = 4"), 4).tolist() == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(PySparkException, match="outside 0..255"):
        kept.collect()


def test_empty_and_bad_matrices(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n")
    (tmp_path / "b.csv").write_text("\n\n")
    (tmp_path / "c +d.csv").write_text("")
    (tmp_path / "e f+%20.csv").write_text("7,8\n")
    with pytest.raises(ValueError) as error:
        matrices.read_matrices(spark, str(tmp_path))
    assert all(name in str(error.value) for name in ("b.csv", "c +d.csv")) and "e f" not in str(error.value)
    (tmp_path / "c +d.csv").unlink()
    (tmp_path / "e f+%20.csv").unlink()
    assert matrices.read_matrices(spark, str(tmp_path), strict=False).count() == 2
    (tmp_path / "b.csv").write_text("1,x\n")
    with pytest.raises(PySparkException):
        matrices.read_matrices(spark, str(tmp_path)).collect()


def test_matrix_round_trip(spark, gray, raster, small_splits):
    pictures = {1: RNG.integers(0, 256, (33, 12)), 2: RNG.integers(0, 256, (1, 5))}
    folder = new_folder(spark, "matrices")
    matrices.write_matrices(gray(pictures), folder)
    read = matrices.read_matrices(spark, folder)
    for i, picture in pictures.items():
        assert (raster(read, i) == picture).all()


def test_run_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("operation=kmeans\n note = a=b \nnothing\nK=5\nK=6\n\n")
    (tmp_path / "two.txt").write_text("rows=3")
    expected = spark.createDataFrame([("gone",)], "run STRING")
    table = runs.read_run_metadata(spark, str(tmp_path))
    found = {r.run.rsplit("/", 1)[1]: r.metadata for r in table.collect()}
    assert found == {"one.txt": {"operation": "kmeans", "note": "a=b", "K": "6"}, "two.txt": {"rows": "3"}}
    assert runs.read_run_metadata(spark, str(tmp_path), expected).first().metadata == {}


def test_centroid_and_range_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "r").mkdir()
    (tmp_path / "c" / "x.txt").write_text("0=58\n1=92\n\nskip\n")
    (tmp_path / "r" / "x.txt").write_text("0=0-74\n1=75-255\n")
    centroids = runs.read_centroids(spark, str(tmp_path / "c")).orderBy("cluster").collect()
    assert [(r.cluster, r.centroid) for r in centroids] == [(0, 58), (1, 92)]
    ranges = runs.read_ranges(spark, str(tmp_path / "r")).orderBy("cluster").collect()
    assert [(r.cluster, r.lo, r.hi) for r in ranges] == [(0, 0, 74), (1, 75, 255)]


def test_compact_ranges(spark):
    parsed = spark.range(1).select(runs.parsed_ranges(F.lit("0-50,x, 51-255 ,"))).first()[0]
    assert [tuple(r) for r in parsed] == [(0, 0, 50), (1, 51, 255)]


def test_gazetteer(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"f-8": {"lat": 1.5, "lon": 2.5}, "G-9": {"lat": 3, "lon": 4}}, indent=2))
    (tmp_path / "a.json").write_text('{"NUST": "h-12", "mall": "f-8",\n "nust": "g-9"}')
    assert {tuple(r) for r in gazetteer.read_locations(spark, str(tmp_path / "s.json")).collect()} == {
        ("F-8", 1.5, 2.5),
        ("G-9", 3.0, 4.0),
    }
    assert {tuple(r) for r in gazetteer.read_aliases(spark, str(tmp_path / "a.json")).collect()} == {
        ("nust", "G-9"),
        ("mall", "F-8"),
    }


def png(image, depth=8):
    """Minimal PNG writer: 2-D gray, or 3-D RGB / RGBA."""
    image = np.asarray(image, ">u2" if depth == 16 else np.uint8)
    kind = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, kind, 0, 0, 0)
    rows = zlib.compress(b"".join(b"\0" + row.tobytes() for row in image))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", rows) + chunk(b"IEND", b"")


def test_images(spark, tmp_path, raster):
    flat = RNG.integers(0, 256, (12, 7))
    rgb = RNG.integers(0, 256, (300, 90, 3))  # several strips
    rgba = RNG.integers(0, 256, (5, 6, 4))
    for name, image in (("0", flat), ("1", rgb), ("2", rgba)):
        (tmp_path / f"{name}.png").write_bytes(png(image))
    (tmp_path / "3.png").write_bytes(b"not an image")
    loaded = images.load_images(spark, str(tmp_path), number(r"(\d)\.png"))
    assert [r.image_id for r in images.unreadable(loaded).collect()] == [3]
    assert (raster(images.gray_pixels(loaded), 0) == flat).all()
    colour = images.colour_pixels(loaded)
    for i, band in enumerate("rgb"):
        assert (raster(colour, 1, band) == rgb[:, :, i]).all()
        assert (raster(colour, 2, band) == rgba[:, :, i]).all()
    assert (raster(colour, 2, "a") == rgba[:, :, 3]).all()
    assert colour.where("image_id = 1 AND a IS NOT NULL").count() == 0
    sizes = {r.image_id: (r.height, r.width) for r in images.image_sizes(loaded).collect()}
    assert sizes == {0: (12, 7), 1: (300, 90), 2: (5, 6)}


def test_deep_images_are_refused(spark, tmp_path):
    (tmp_path / "0.png").write_bytes(png(RNG.integers(0, 256, (4, 4))))
    assert images.gray_pixels(images.load_images(spark, str(tmp_path))).count() == 16
    (tmp_path / "1.png").write_bytes(png([[0, 256, 511], [1000, 65535, 7]], depth=16))
    with pytest.raises(PySparkException, match="more than 8 bits per sample.*1.png"):
        images.gray_pixels(images.load_images(spark, str(tmp_path))).collect()


def test_declared_bits():
    assert images.sample_bits(png([[1]])) == 8 and images.sample_bits(png([[1]], depth=16)) == 16
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 258, 3, 1, 16, 0)
    assert images.sample_bits(tiff) == 16
    wide = b"MM\0*" + struct.pack(">IH", 8, 1) + struct.pack(">HHII", 258, 3, 3, 26) + bytes(4) + struct.pack(">HHH", 8, 8, 12)
    assert images.sample_bits(wide) == 12
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc1\0\x0b\x0c" + bytes(20)
    assert images.sample_bits(jpeg) == 12
    assert images.sample_bits(b"") is None and images.sample_bits(b"GIF89a") is None


def test_files_with_one_number_are_refused(spark, monkeypatch, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n")
    (tmp_path / "b.csv").write_text("3,4\n")
    assert matrices.read_matrices(spark, str(tmp_path)).select("image_id").distinct().count() == 2
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    with pytest.raises(PySparkException, match="files with the same number.*a.csv and .*b.csv"):
        matrices.read_matrices(spark, str(tmp_path)).collect()


def test_made_folders_are_removed(spark, tmp_path):
    path = new_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    kept = tmp_path / "kept"
    kept.mkdir()
    release(spark)
    with pytest.raises(PySparkException):
        spark.read.parquet(path)
    assert kept.exists()


def test_saved_tables_come_back(spark, gray):
    counts = histogram.level_counts(gray({i: RNG.integers(0, 256, (4, 4)) for i in range(5)}))
    folder = new_folder(spark, "saved")
    sinks.save_table(counts, folder, buckets=3)
    back = spark.read.parquet(folder)
    assert back.drop("image_bucket").exceptAll(counts).count() == 0 and back.count() == counts.count()
    assert {r.image_bucket for r in back.select("image_bucket").distinct().collect()} == {0, 1, 2}


def test_a_box_meets_few_files(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    folder = str(tmp_path / "ordered")
    cells = spark.range(512 * 512)
    pixels = cells.selectExpr("7L AS image_id", "int(id div 512) AS y", "int(id % 512) AS x", "int(id * 7 % 256) AS v")
    pixels = pixels.unionByName(pixels.where("y < 9 AND x < 9").withColumn("image_id", F.lit(2).cast("long")))
    sinks.save_ordered(pixels, folder, files=64, block=16)
    box = sinks.read_box(spark, folder, 7, 100, 200, 115, 215)
    assert box.count() == 256 and box.exceptAll(pixels).count() == 0
    assert spark.read.parquet(folder).count() == pixels.count()
    files = glob.glob(f"{folder}/*.parquet")
    met = 0
    for path in files:
        group = pq.ParquetFile(path).metadata
        sides = [group.row_group(g).column(c).statistics for g in range(group.num_row_groups) for c in (1, 2)]
        met += any(y.min <= 115 and y.max >= 100 and x.min <= 215 and x.max >= 200 for y, x in zip(sides[::2], sides[1::2]))
    assert len(files) > 40 and met <= len(files) / 10
    plan = box._jdf.queryExecution().toString()
    assert "EqualTo(image_id,7), GreaterThanOrEqual(y,100)" in plan  # the rest is cut off in the plan's text


def test_bucketed_pixels_are_not_shuffled(spark, gray):
    """Beyond the broadcast bound, light images join their lookup inside the buckets."""
    from rasterloom.operators import cluster

    spark.sql("DROP TABLE IF EXISTS fleet")
    sinks.save_bucketed(gray({i: RNG.integers(0, 256, (4, 4)) for i in range(6)}), "fleet", buckets=4)
    pixels = spark.table("fleet")
    model = cluster.kmeans(pixels, 3)
    joined = cluster.with_cluster(pixels, model, broadcast_bytes=0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "SortMergeJoin" in plan and len(shuffled) == 1
    assert joined.count() == 96 and joined.where("cluster NOT BETWEEN 0 AND 2").count() == 0
    spark.sql("DROP TABLE fleet")


def _counting(folder):
    """An opener that notes how many bytes of a file were asked for."""

    def opener(path):
        import os
        import uuid

        from rasterloom.sources.heads import open_ranges

        read = open_ranges(path)

        def noted(at, n):
            got = read(at, n)
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write(str(len(got)))
            return got

        return noted

    return opener


def _asked(folder):
    return sum(int(f.read_text()) for f in folder.iterdir())


def test_audit_reads_heads_only(spark, tmp_path):
    """A container of a gigabyte costs as many bytes as an empty one."""
    from rasterloom import fixed_values as fixed
    from rasterloom.operators import huffman
    from rasterloom.sources import containers

    files, notes = tmp_path / "files", tmp_path / "notes"
    files.mkdir(), notes.mkdir()
    bits = 8 * (1 << 30)
    counts = [0] * 256
    counts[7] = 1 << 31
    words = [1 << 16, 1 << 15, bits & 0xFFFFFFFF]
    head = fixed.GRAY_MAGIC.encode() if isinstance(fixed.GRAY_MAGIC, str) else bytes(fixed.GRAY_MAGIC)
    head += b"".join(w.to_bytes(4, "little") for w in [*words, *counts])
    with open(files / "large.bin", "wb") as out:
        out.write(head)
        out.truncate(1 << 30)  # sparse
    (files / "none.bin").write_bytes(b"")
    (files / "short.bin").write_bytes(head[:50])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in huffman.audit(containers.read_containers(spark, str(files), _counting(str(notes)))).collect()}
    assert rows["large.bin"]["length"] == 1 << 30 and rows["large.bin"]["counted"] == 1 << 31
    assert rows["short.bin"]["problem"] == "truncated header" and rows["none.bin"]["problem"] == "bad magic"
    assert _asked(notes) <= 2 * containers.HEAD_BYTES


def test_depth_is_told_from_ranges(tmp_path):
    from rasterloom.sources.heads import open_ranges
    from rasterloom.sources.images import declared_bits, sample_bits

    entry = lambda tag, count, value: tag.to_bytes(2, "little") + b"\3\0" + count.to_bytes(4, "little") + value.to_bytes(4, "little")
    far = 1 << 28
    directory = (2).to_bytes(2, "little") + entry(256, 1, 9) + entry(258, 3, far - 8)
    path = tmp_path / "far.tif"
    with open(path, "wb") as out:
        out.write(b"II*\0" + far.to_bytes(4, "little"))
        out.seek(far - 8)
        out.write((16).to_bytes(2, "little") * 3)
        out.seek(far)
        out.write(directory)
    total = 0
    read = open_ranges(str(path))

    def noted(at, n):
        nonlocal total
        got = read(at, n)
        total += len(got)
        return got

    assert declared_bits(noted) == 16 and total < 100
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x10" + bytes(14) + b"\xff\xc0\x00\x11\x0c" + bytes(20)
    assert sample_bits(jpeg) == 12 and sample_bits(b"\x89PNG\r\n\x1a\n" + bytes(16) + b"\x10" + bytes(4)) == 16
    assert sample_bits(b"") is None and sample_bits(b"II*\0") in (1, None) and sample_bits(b"plain") is None


def test_matrix_text_is_read_twice_and_paths_stay_out_of_the_plan(spark, tmp_path):
    from rasterloom.sources import matrices

    for i in range(30):
        (tmp_path / f"matrix-{i:03d}.csv").write_text("\n".join(f"{i},{j}" for j in range(5)) + "\n\n")
    pixels = matrices.read_matrices(spark, str(tmp_path))
    plan = pixels._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "matrix-000" not in plan
    rows = pixels.groupBy("image_id").agg({"v": "sum", "y": "max", "*": "count"}).collect()
    assert sorted(r["sum(v)"] for r in rows) == sorted(5 * i + 10 for i in range(30))
    assert {(r["max(y)"], r["count(1)"]) for r in rows} == {(4, 10)}
