import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rasterloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def gray(spark):
    """Gray pixel table of {image_id: 2-D array}."""

    def build(images):
        rows = [
            (int(i), int(y), int(x), int(v))
            for i, a in images.items()
            for (y, x), v in np.ndenumerate(np.asarray(a))
        ]
        return spark.createDataFrame(rows, "image_id BIGINT, y INT, x INT, v INT")

    return build


@pytest.fixture(scope="session")
def raster():
    """2-D array of one image of a collected pixel table."""

    def build(pixels, image_id=0, value="v"):
        frame = pixels.where(f"image_id = {image_id}").toPandas()
        out = np.full((frame.y.max() + 1, frame.x.max() + 1), -1)
        out[frame.y, frame.x] = frame[value]
        assert (out >= 0).all() and len(frame) == out.size
        return out

    return build
