"""Rasters, clicks, places, scenes and prompts derived from the given tables.

Each builder has a Spark SQL form here and the same derivation as a SQL fragment in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HEIGHT, WIDTH = 100, 64

TEMPLATES = [
    "Show the G-9 satellite picture",
    "Load Melody Market",
    "Fetch sentinel imagery for PIMS",
    "Open Lok Virsa",
    "Display H-10",
    "How is cloud cover measured?",
    "Why do clusters differ",
    "Smooth it with a mean filter",
    "More brightness here",
    "Plot the histogram",
    "Get I-9",
    "classify the northern part",
    "apply compression now",
    "distance between both corners",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(e: str) -> str:
    return f"CAST(LEAST(255, GREATEST(0, FLOOR((CAST({e} AS DOUBLE) + 0.6D) / 1.2D * 256))) AS INT)"


def gray_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 x 64 gray rasters from the embedding components."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    return cells.selectExpr(
        "vec_id div 100 AS image_id", "CAST(vec_id % 100 AS INT) AS y", "pos AS x", f"{_level('e')} AS v"
    )


def colour_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: BGRA rasters on the same grid."""
    cells = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("p")
    )
    return cells.selectExpr(
        "vec_id div 100 AS image_id",
        "CAST(vec_id % 100 AS INT) AS y",
        "p AS x",
        f"{_level('embedding[p]')} AS b",
        f"{_level('embedding[(p + 21) % 64]')} AS g",
        f"{_level('embedding[(p + 42) % 64]')} AS r",
        "CAST((vec_id * 7 + p * 13) % 256 AS INT) AS a",
    )


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pixels without coordinates."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS image_id",
        "CAST(l_quantity AS INT) * 5 AS b",
        "CAST(ROUND(l_discount * 100) AS INT) * 25 AS g",
        "CAST(FLOOR(l_extendedprice / 105000 * 256) AS INT) AS r",
    )


def band_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectances for the composite: R2 levels over 400."""
    return colour_rasters(spark, sf_dir).selectExpr(
        "image_id", "y", "x", "b / 400D AS b02", "g / 400D AS b03", "r / 400D AS b04"
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked points, some of them off the image."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id",
        "event_id",
        "(user_id + event_id div 3) % 5 AS image_id",
        "CAST(event_id % 70 AS INT) AS x",
        "CAST((event_id div 70) % 105 AS INT) AS y",
        "CASE event_type WHEN 'view' THEN 'mm' WHEN 'signup' THEN 'cm' WHEN 'purchase' THEN 'inches'"
        " ELSE 'pixels' END AS unit",
        "CAST(1 + event_id % 10 AS INT) AS ppu",
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: gazetteer of nations."""
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('N-', n_nationkey) AS code", "33 + n_nationkey * 0.05D AS lat", "72.5D + n_regionkey * 0.2D AS lon"
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("lower(n_name) AS alias", "concat('N-', n_nationkey) AS code")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to resolve; a fourth of them unknown."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 4 WHEN 0 THEN concat('N-', c_nationkey) WHEN 1 THEN concat('  n-', c_nationkey, ' ')"
        " WHEN 2 THEN concat('NATION_', c_nationkey) ELSE 'Atlantis' END AS name",
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalogue."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS scene_id",
        "concat('N-', o_custkey % 25) AS tile",
        "o_orderdate AS ts",
        "CAST((o_orderkey * 37) % 101 AS INT) AS cloud_pct",
        "CASE o_orderkey % 3 WHEN 0 THEN 'sentinel-2-l2a' ELSE 'landsat-c2' END AS collection",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geolocated points."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "33 + (c_custkey % 1300) * 0.001D AS lat", "72.5D + ((c_custkey * 7) % 1000) * 0.001D AS lon"
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1t: every text as it is, and beside each of them a template, 1000 turns later."""
    choices = F.array(*[F.lit(t) for t in TEMPLATES])
    pick = F.get(choices, ((F.col("conv_id") * 3 + F.col("turn")) % len(TEMPLATES)).cast("int"))
    both = F.array(F.struct("turn", F.col("text").alias("prompt")), F.struct((F.col("turn") + 1000).alias("turn"), pick.alias("prompt")))
    return table(spark, sf_dir, "conversations").select("conv_id", F.inline(both))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2t: model answers with different kinds of reasoning around the text."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        r"""CASE (conv_id + turn) % 5
              WHEN 1 THEN concat('<think>', text, '</think>', text)
              WHEN 2 THEN concat('Reasoning: ', text, '\n', 'Final answer: ', text)
              WHEN 3 THEN concat('Step 1 ', text, '\n', 'Answer: ', text)
              WHEN 4 THEN concat(text, '\n\n\n\n', text)
              ELSE text END AS answer""",
    )


def edited_bounds(images: DataFrame) -> DataFrame:
    """One edited bound per image, some of them far enough to make a range invalid."""
    return images.selectExpr(
        "image_id",
        "CAST(image_id % 4 + 1 AS INT) AS cluster",
        "CASE WHEN image_id % 2 = 0 THEN 'hi' ELSE 'lo' END AS side",
        "CAST(60 + (image_id * 17) % 150 AS INT) AS value",
    )


def write_pngs(pixels: DataFrame, folder: str) -> None:
    """Write fixture rasters as PNG files ``<image_id>.png``, each of them one small group; gray, RGB or RGBA by the columns."""
    import struct
    import zlib

    import pandas as pd

    bands = [c for c in ("v", "r", "g", "b", "a") if c in pixels.columns]
    kind = {1: 0, 3: 2, 4: 6}[len(bands)]

    def png(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["y", "x"])
        height, width = int(cells.y.max()) + 1, int(cells.x.max()) + 1
        rows = cells[bands].to_numpy("uint8").reshape(height, width * len(bands))

        def chunk(name: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

        head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
        body = zlib.compress(b"".join(b"\0" + row.tobytes() for row in rows))
        image = int(cells["image_id"].iloc[0])
        _put(folder, f"{image}.png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b""))
        return pd.DataFrame({"image_id": [image]})

    pixels.groupBy("image_id").applyInPandas(png, "image_id BIGINT").write.parquet(folder + "/written")


def _put(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(content)


def write_containers(heads: DataFrame, folder: str) -> None:
    """Write containers ``<path>.bin`` of the heads, with an empty payload; by the image's number some are damaged.

    Of five images the second is cut inside its head, the third has another magic, the fourth misses its last byte
    and the fifth has no rows.
    """
    import pandas as pd

    def write(batches):
        for batch in batches:
            for path, length, content in zip(batch.path, batch.length, batch.content):
                damage = int(path.rsplit("-", 1)[1]) % 5
                whole = bytearray(bytes(content).ljust(length, b"\0"))
                if damage == 1:
                    whole = whole[:700]
                elif damage == 2:
                    whole[:4] = b"NONE"
                elif damage == 3:
                    whole = whole[:-1]
                elif damage == 4:
                    whole[4:8] = bytes(4)
                _put(folder, f"{path}.bin", bytes(whole))
            yield pd.DataFrame({"path": batch.path})

    heads.mapInPandas(write, "path STRING").write.parquet(folder + "/written")
