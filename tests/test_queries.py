"""Every registered query against its SQL in DuckDB."""

import os
import subprocess
import sys
import uuid

import pytest

import __spark_entry__ as entry
import check
from rasterloom.plans import catalog, oracles

QUERIES = catalog.QUERIES
ORACLES = oracles.sql()
# jobs that run while the plan is built: tables that the operators' documents say are settled, files that are written
SETTLED = {
    "inspect_points_coded": 37, "inspect_points_coded_color": 37, "decode_boxes": 27, "mean_filter_2049": 5, "read_saved_box": 5,
    "chain_decompress": 18, "huffman_roundtrip_rgb": 16, "huffman_audit_files": 14, "scenes_uncached": 11,
    "scenes_uncached_dash": 11, "scenes_cached": 11, "inspect_points": 10, "inspect_points_color": 10, "resolve_places": 10,
    "place_bboxes": 10, "scene_requests": 10, "huffman_segments": 10, "huffman_roundtrip": 10, "huffman_roundtrip_color": 10,
    "huffman_roundtrip_mixed": 10, "huffman_lossless": 10, "classify_recolor": 9, "distance_pairs": 9, "distance_units": 9,
    "ingest_csv_matrix": 9, "chain_distance": 9, "chain_kmeans": 8, "kmeans_labels": 7, "kmeans_labels_150": 7,
    "land_cover_map": 7, "map_recolor_bgr": 7, "points_in_sector": 7, "gazetteer_load": 6, "scene_search": 5,
    "centroid_drift": 5, "save_result": 5, "ingest_centroids": 4, "ingest_ranges": 4, "chain_prompts": 4,
    "kmeans_from_edited_ranges": 3, "classify_edit_bounds": 3, "ingest_images": 3, "ingest_images_gray": 3,
    "ingest_images_rgb": 3, "ingest_runs": 3, "operation_chain": 3, "operation_chain_metadata": 3, "chain_laplacian": 3,
    "chain_gray_brightness": 3, "chain_compress": 3, "chain_statistics": 3, "chain_histogram": 3,
}


@pytest.fixture(scope="module")
def con(sf):
    return check.tables(sf)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SETTLED)))
def test_plans_are_built_without_jobs(name, spark, sf):
    """But for one that reads the schema of a table."""
    assert _jobs(spark, lambda: QUERIES[name](spark, sf)) <= 1


@pytest.mark.parametrize("name", ["kmeans_labels", "huffman_roundtrip", "resolve_places", "operation_chain"])
def test_settled_tables_are_settled_once(name, spark, sf):
    assert _jobs(spark, lambda: QUERIES[name](spark, sf)) <= SETTLED[name]


def _jobs(spark, build):
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        build()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    result = QUERIES[name](spark, sf)
    relation = con.sql(ORACLES[name])
    types = {f.name: f.dataType.simpleString() for f in result.schema}
    other = dict(zip(relation.columns, map(str, relation.types)))
    assert sorted(types) == sorted(other)
    assert all(check._same(types[c], other[c]) for c in types)
    assert check.difference(result.toPandas(), relation.df()) is None


def test_lineitem_levels_beyond_a_byte_are_counted(spark, sf, tmp_path):
    """A price of 105000 or more is level 256 or more; a missing one has no level."""
    import duckdb

    odd = ["105000.0", "210000.0", "-1.0", "NULL::DOUBLE"]
    rows = " UNION ALL ".join(f"(SELECT * REPLACE ({price} AS l_extendedprice) FROM given LIMIT 3)" for price in odd)
    duckdb.sql(
        f"COPY (WITH given AS (SELECT * FROM '{sf}/lineitem.parquet') SELECT * FROM given UNION ALL {rows})"
        f" TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"
    )
    got = QUERIES["bench_hist_lineitem"](spark, str(tmp_path)).toPandas()
    want = check.tables(str(tmp_path)).sql(ORACLES["bench_hist_lineitem"]).df()
    assert {256, 512, -1} <= set(got.v.dropna()) and got.v.isna().any()
    assert check.difference(got, want) is None


def test_entry_is_the_flagship(spark):
    legend = entry.entry(spark).toPandas()
    assert len(legend) == 5 * 6
    assert (legend.groupby("image_id").n.sum() == 6400).all()
    assert legend.groupby("image_id").share.sum().round(9).eq(100).all()


def test_workers_need_no_installed_package(tmp_path):
    """From another folder, without the repository on the workers' path."""
    here = os.path.dirname(entry.__file__)
    code = (
        f"import sys; sys.path.insert(0, {here!r})\n"
        "import __spark_entry__ as e\n"
        "from rasterloom.session import local_session\n"
        "s = local_session(2)\n"
        "print('rows', e.entry(s).count(), e.queries()['huffman_roundtrip'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 30 32000" in done.stdout, done.stderr[-2000:]
