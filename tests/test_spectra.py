import numpy as np
import pytest

from panelmill.operators import features as ft
from panelmill.operators import grid, spectra


@pytest.mark.parametrize("n, limit", [(240, 16), (251, 16), (1 << 12, 64), (65_537, 1000), (2 * 65_537, 65_536), (10**9, 65_536)])
def test_lengths_split_in_bounded_parts(n, limit):
    a, b, chirp = spectra.split_length(n, limit)
    assert a * b == n and b <= limit if not chirp else a * b >= 2 * n - 1 and b <= 2 * a


@pytest.mark.parametrize("steps", [16, 100, 65_536])
def test_spectrum_does_not_depend_on_blocks(make, rng, steps):
    """Composite, odd, square, prime and short lengths, a constant series, a missing value."""
    data = {f"n{n}": rng.normal(size=n) + 3 for n in (240, 225, 251, 509, 77, 12)}
    data["wave"] = np.sin(np.arange(480) * 2 * np.pi / 24)
    data["flat"] = np.full(300, 2.5)
    gap = rng.normal(size=210)
    gap[50] = np.nan
    df = grid.dense(make(data | {"gap": gap}), "H").where("core")
    got = spectra.spectrum(df, block_steps=steps).toPandas().sort_values(["unique_id", "k"])
    for uid, y in data.items():
        own = got[got["unique_id"] == uid]
        want = np.abs(np.fft.rfft(y - y.mean()))
        want[0] = 0
        assert own["k"].tolist() == list(range(len(y) // 2 + 1)) and (own["n"] == len(y)).all()
        np.testing.assert_allclose(own["magnitude"], want, atol=1e-9)
        np.testing.assert_allclose(own["f"], np.arange(len(y) // 2 + 1) / len(y))
    own = got[got["unique_id"] == "gap"]
    assert len(own) == 106 and own["magnitude"].isna().to_numpy()[1:].all()


def test_entropies_of_features_come_from_spectra(make, rng):
    df = ft.prepared(grid.dense(make({"a": rng.normal(size=300), "b": np.sin(np.arange(300) / 5)}), "H"))
    got = {r.unique_id: r.x_entropy for r in ft.spectral_entropy(spectra.spectrum(df, block_steps=32)).collect()}
    want = {r.unique_id: r.x_entropy for r in ft.spectral_entropy(spectra.spectrum(df)).collect()}
    assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], abs=1e-9) for u in got)
