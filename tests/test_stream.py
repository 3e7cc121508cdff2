"""Recordings block by block: the same samples however they are cut, bounded memory, exact levels."""

import subprocess
import sys
import wave

import numpy as np
import pytest

from fieldecho.plans import inference
from fieldecho.signal import spectra, stream


def cut(y, sizes):
    at = 0
    while at < len(y):
        n = int(next(sizes))
        yield y[at:at + n]
        at += n


def sizes_of(seed, most):
    rng = np.random.default_rng(seed)
    while True:
        yield rng.integers(1, most)


@pytest.mark.parametrize("source, target", [(44100, 48000), (48000, 16000), (8000, 8000), (11025, 8000), (10, 16)])
def test_change_of_rate_does_not_depend_on_blocks(source, target):
    y = np.random.default_rng(1).normal(size=30_011)
    whole = np.concatenate(list(stream.through([y], source, target, None, 0, len(y))))
    parts = np.concatenate(list(stream.through(cut(y, sizes_of(2, 3000)), source, target, None, 0, len(y))))
    assert len(whole) == len(parts) == stream.resampled_length(len(y), source, target)
    assert np.abs(whole - parts).max() < 1e-12
    if source != target:  # against the sum itself
        scale = min(1.0, target / source)
        for k in (0, 7, len(whole) // 2, len(whole) - 1):
            want = (y * stream.kernel(k * source / target - np.arange(len(y)), scale)).sum()
            assert abs(whole[k] - want) < 1e-9


def test_change_of_rate_keeps_tones():
    t = np.arange(44100) / 44100
    got = np.concatenate(list(stream.through([np.sin(2 * np.pi * 3000 * t)], 44100, 48000, None, 0, 44100)))
    want = np.sin(2 * np.pi * 3000 * np.arange(48000) / 48000)
    assert np.abs(got - want)[500:-500].max() < 1e-4


@pytest.mark.parametrize("rate, low, high, n", [(8000, 150.0, 3000.0, 100_003), (48000, 150.0, 15000.0, 300_000), (8000, 150.0, 3000.0, 500), (8000, 150.0, 3000.0, 2), (8000, 150.0, 3000.0, 1)])
def test_band_pass_equals_that_of_the_whole_file(rate, low, high, n):
    y = np.random.default_rng(3).normal(size=n)
    want = spectra.bandpass(y, rate, low, high)
    got = np.concatenate(list(stream.through(cut(y, sizes_of(4, 5000)), rate, rate, low, high, n)))
    inside = slice(rate, -rate) if n > 3 * rate else slice(None)
    again = np.concatenate(list(stream.through([y], rate, rate, low, high, n)))
    assert len(got) == n and np.abs(got - again).max() < 1e-9
    if n > 3 * rate or n == 1:
        assert np.abs(got - want)[inside].max() < 1e-6


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 60_001])
def test_levels_are_exact(n):
    y = np.random.default_rng(n).normal(size=n).astype(np.float32)
    y[::3] = 0
    level = stream.Level(99.0)
    for part in cut(y, sizes_of(1, 700)):
        level.first(part)
    for part in cut(y, sizes_of(2, 700)):
        level.second(part)
    assert level.value() == pytest.approx(float(np.percentile(np.abs(y), 99.0)) if n else 0.0, rel=1e-6)
    for mode in ("file-peak", "file-percentile", "none"):
        want = inference.gain(y.astype(float), mode)
        assert np.allclose(y * inference.file_scale(lambda: cut(y, sizes_of(5, 300)), mode), want, rtol=1e-6)


def test_windows_of_blocks():
    y = np.arange(1000.0)
    for starts in (np.arange(0, 1000, 30), np.arange(17, 1000, 41), np.array([990]), np.array([], dtype=int)):
        got = list(inference.windows(cut(y, sizes_of(7, 90)), starts, 30))
        assert all((g == np.pad(y[s:s + 30], (0, 30 - len(y[s:s + 30])))).all() for g, s in zip(got, starts)) and len(got) == len(starts)


def test_an_hour_stays_small(tmp_path):
    """A process of its own, so that its peak is the job's: an hour at 44.1 kHz in all passes."""
    path = tmp_path / "hour.wav"
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(44100)
        minute = (3000 * np.random.default_rng(1).normal(size=60 * 44100)).astype("<i2").tobytes()
        for _ in range(60):
            f.writeframes(minute)
    code = f"""
import resource, sys
import numpy as np
from fieldecho.plans import inference
from fieldecho.signal.stream import through, resampled_length
from fieldecho.sources.audio import read_blocks
n = 3600 * 44100
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
passes = lambda: through(read_blocks({str(path)!r}, n, None), 44100, 48000, 150.0, 15000.0, n)
starts = np.arange(0, resampled_length(n, 44100, 48000) - 144000 + 1, 144000)
count = sum(1 for _ in inference.windows(passes(), starts, 144000))
print(count, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests", 1)[0], timeout=300)
    count, grown = out.stdout.split()
    assert int(count) == 1200 and float(grown) < 300, out.stderr
