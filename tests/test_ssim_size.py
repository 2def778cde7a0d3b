"""SSIM at the images' own size."""

import numpy as np

from siftmill.functions import pixels


def test_fine_differences_count():
    fine = (np.indices((512, 512)).sum(0) % 2 * 255).astype(np.uint8)[:, :, None]  # differs from its negative within each pixel pair only
    assert pixels.ssim_of(fine, 255 - fine, side=128) > 0.99
    assert pixels.ssim_of(fine, 255 - fine) < 0


def test_sizes():
    rng = np.random.default_rng(1)
    big = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    small = np.rint(pixels._resize(pixels._gray(big), 20, 30)).astype(np.uint8)[:, :, None]
    assert pixels.ssim_of(big, small) > 0.99 and abs(pixels.ssim_of(small, small) - 1) < 1e-9
    assert abs(pixels.ssim_of(big[:4, :5], big[:4, :5]) - 1) < 1e-9
