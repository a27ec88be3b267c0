"""Fits without each sample, together and one by one."""

import numpy as np
import pytest
from blocklens.operators import rowwise
from blocklens.operators.latent import DIABLO, SPLSDA, Moments


@pytest.mark.parametrize("model", [SPLSDA(2, 3), SPLSDA(3), SPLSDA(2, 2, max_iter=3), DIABLO([4, 3], 2, [[2, 2], [1, 2]]), DIABLO([3, 4], 2), DIABLO([4, 3], 1, design=0.0)])
def test_batch_equals_single_fits(monkeypatch, model):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(60, 7))
    x[:, 6] = 2.0
    x[20:24] = x[20]
    y = np.array(["a"] * 25 + ["b"] * 34 + ["c"], object)  # without its only sample, a class is no class
    x[:25, :3] += 1
    m = Moments.of(x, y)
    hot = (y[:, None] == np.array(m.classes, object)[None, :]).astype(float)
    single = np.stack([rowwise._response(m.without(x[i : i + 1], hot[i : i + 1]), model.fit) for i in range(len(x))])
    monkeypatch.setattr(rowwise, "TOGETHER_CELLS", 49 * 16)
    fits, fit = [], type(model).fit
    monkeypatch.setattr(type(model), "fit", lambda self, own: fits.append(1) or fit(self, own))
    got = rowwise._responses(m, x, hot, model)
    assert len(fits) == 1  # not one for each sample
    np.testing.assert_allclose(got, single, rtol=1e-7, atol=1e-9)
