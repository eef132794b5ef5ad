"""Dense kernels against plain formulas."""

import math

import numpy as np
import pytest

from tessera.operators import kernels


def test_crops_keep_flat_colours_and_whole_images(spark):
    r = np.random.default_rng(1)
    some = r.integers(0, 256, (6, 6, 3), dtype=np.uint8)
    rows = [(1, 6, 6, some.tobytes(), 0, 0, 6, 6), (2, 9, 7, bytes([10, 20, 30] * 63), 1, 2, 5, 4), (3, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "id int, height int, width int, pixels binary, top int, left int, box_height int, box_width int")
    got = {x["id"]: x["view"] for x in kernels.resample(d, 6).collect()}
    assert bytes(got[1]) == some.tobytes() and bytes(got[2]) == bytes([10, 20, 30] * 36) and got[3] is None


def test_reduction_averages():
    weights = kernels.taps(0, 8, 8, 2)
    assert np.allclose(weights.sum(1), 1) and np.allclose(weights[0], weights[1][::-1]) and (weights[0, :4] > 0).all()


def test_hue_turns(spark):
    red, gray = [1.0, 0.0, 0.0], [0.5, 0.5, 0.5]
    d = spark.createDataFrame([(red, 1 / 3), (red, 0.0), (gray, 0.4), (None, 0.1)], "px array<double>, hue double")
    got = [x["px"] for x in kernels.shift_hue(d).collect()]
    assert np.allclose(got[0], [0, 1, 0]) and np.allclose(got[1], red) and np.allclose(got[2], gray) and got[3] is None


def test_head(spark):
    r = np.random.default_rng(2)
    layers = [(r.normal(size=(5, 3)), r.normal(size=5)), (r.normal(size=(2, 5)), r.normal(size=2))]
    prototypes, x = r.normal(size=(4, 2)), [0.1, -0.2, 0.3]
    hidden = layers[0][0] @ x + layers[0][1]
    hidden = np.array([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in hidden])
    out = layers[1][0] @ hidden + layers[1][1]
    d = spark.createDataFrame([(x,), (None,)], "embedding array<double>")
    got = [y["logits"] for y in kernels.project(d, layers, prototypes).collect()]
    assert np.allclose(got[0], prototypes @ (out / np.linalg.norm(out))) and got[1] is None
    with pytest.raises(ValueError, match="too large"):
        kernels.project(d, layers, np.zeros((kernels.MOST_WEIGHTS // 8 + 1,)))
