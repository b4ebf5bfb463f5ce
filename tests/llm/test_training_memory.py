"""What training the quality rules takes of the driver's memory."""
import tracemalloc

import numpy as np

from vigil.llm import quality_rules as Q


def test_a_fit_holds_one_copy_of_its_rows():
    rng = np.random.default_rng(5)
    x = rng.random((2000, 512)).astype(np.float32)
    y = (x[:, 0] + 0.1 * rng.random(2000) > 0.55).astype(np.float64)
    tracemalloc.start()
    w, b = Q.fit_logistic(x, y, steps=30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * x.nbytes
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.9
