"""Beams that go on together against one beam, step by step, for each score."""

import math

import numpy as np
import pytest

from melisma.operators import harmony


def one_beam(windows, chords, sevenths, color):
    """windows: of each {chord: value}; the chord of each window, or -1."""
    ahead, wanted = sum(bool(w) for w in windows), min(0.4, color)
    seven, more = [c.seventh is not None and not c.extensions for c in chords], [bool(c.extensions) for c in chords]
    # value, chosen, extended, sevenths, degrees, last chord, chords so far
    beam = [(0.0, 0, 0, 0, (), None, ())]
    for w in windows:
        if not w:
            beam = [(*p[:4], (), None, (*p[6], -1)) for p in beam]
            continue
        ahead -= 1
        plain = max((c for c in w if chords[c].seventh is None), key=w.get)
        near, paths = [c for c in w if c == plain or max(w.values()) - w[c] <= harmony.NEAR + 1e-9], []
        for value, chosen, extended, held, degrees, last, path in beam:
            for c in near:
                x, h = extended + more[c], held + seven[c]
                if (more[c] and x / (chosen + 1) > 0.4 + 1e-9) or h > math.floor(sevenths * (chosen + 1 - x + ahead) + 1e-9):
                    continue
                worth = harmony._moved(degrees, chords[last].degree if last is not None else 0, last == c, chords[c].degree)
                over = max(0.0, x - wanted * (chosen + 1)) - max(0.0, extended - wanted * chosen) if x else 0.0
                paths.append((value + w[c] + worth - 0.2 * over, chosen + 1, x, h, (*degrees, chords[c].degree)[-8:], c, (*path, c)))
        paths.sort(key=lambda p: -p[0])
        beam, spare = paths[: harmony.BEAM], {}
        for p in paths[harmony.BEAM :]:
            if not p[2] and p[3] not in {b[3] for b in beam if not b[2]}:
                spare.setdefault(p[3], p)
        beam += spare.values()
    return list(beam[0][6])


@pytest.mark.parametrize(("sevenths", "color"), [(0.3, 0), (0.6, 0), (0.1, 0.6), (0.3, 0.3), (0, 0)])
def test_beams_together_are_beams_alone(sevenths, color):
    rng, chords = np.random.default_rng(5), harmony.palette(color > 0)
    lengths = np.array([40, 0, 1, 17, 40, 3])
    tones = np.where(rng.random((lengths.sum(), 12)) < 0.25, rng.choice([4.0, 6.0, 8.0, 0.1, 0.3], (lengths.sum(), 12)), 0.0)
    tones[rng.random(len(tones)) < 0.5] *= np.isin(np.arange(12), harmony.SCALE)
    tones[rng.random(len(tones)) < 0.1] = 0
    found = harmony.fits(tones, chords, color)
    for t, fit, support in zip(tones.tolist(), found.fit, found.support, strict=True):
        assert all(s == sum(t[p] for p in set(c.tones)) / sum(t) for c, f, s in zip(chords, fit, support, strict=True) if f)
    got = harmony.best_paths(found, lengths, chords, sevenths, color)
    windows = [{int(c): float(v[c]) for c in np.flatnonzero(f)} for f, v in zip(found.fit, found.value, strict=True)]
    ends = np.cumsum(lengths)
    for a, z in zip(ends - lengths, ends, strict=True):
        assert got[a:z].tolist() == one_beam(windows[a:z], chords, sevenths, color)
