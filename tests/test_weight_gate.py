import tracemalloc

import numpy as np
import pyarrow as pa

from askloop.operators.gate import BIAS, STRETCH, _accepted, _gradient, _margins, _stretches


def test_a_step_takes_no_more_memory_for_a_larger_batch():
    """Texts of 0 to 400 features, some without any, one longer than a stretch; the parts add up to the whole."""
    rng = np.random.default_rng(1)
    sizes = [*rng.integers(0, 400, 8_000), STRETCH + 5, 0]
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    held = pa.ListArray.from_arrays(ends, pa.array(rng.integers(0, 1 << 12, sum(sizes))))
    klass, vote = rng.integers(0, 2, len(held)).astype(float), rng.integers(1, 4, len(held)).astype(float)
    weights = rng.normal(size=1 << 12)
    batch = pa.record_batch({"features": held, "class": klass, "vote": vote})
    tracemalloc.start()
    got = pa.Table.from_batches(_gradient(iter([batch]), weights, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * 8 * STRETCH
    margins, feature, value, text = _margins(held, weights, 0.5)
    error = vote * (1 / (1 + np.exp(-margins)) - klass)
    want = np.append(error.sum(), np.bincount(feature, value * error[text], 1 << 12))
    assert got.column("feature").to_pylist() == [BIAS, *range(1 << 12)]
    assert np.allclose(got.column("slope").to_numpy(), want)
    stretches = list(_stretches(pa.array([[1], None, []], pa.list_(pa.int64()))))
    assert stretches == [slice(0, 3)] and list(_stretches(held[:0])) == []


def test_texts_are_judged_in_stretches():
    rng = np.random.default_rng(2)
    sizes = [*rng.integers(0, 400, 8_000), 0]
    held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(rng.integers(0, 1 << 12, sum(sizes))))
    weights = rng.normal(size=1 << 12)
    tracemalloc.start()
    got = _accepted(held, weights, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * 8 * STRETCH
    assert got.to_pylist() == (1 / (1 + np.exp(-_margins(held, weights, 0.5)[0]))).tolist()
    assert _accepted(held[:0], weights, 0.5).to_pylist() == []
