"""The flood's rules on drawn maps, and registration on known shifts."""

import numpy as np
import pytest

from panelforge.operators import flood, registration
from panelforge.operators.flood import Rules, grow
from panelforge.session import ship

R = 10.0


def stub(arrival, degrees, near, far, start, per_px=1.0, half=6.0):
    """A radial stub from ``near`` to ``far`` beyond the rim that arrives outwards from a bin on."""
    for x in range(-64, 65):
        for y in range(-64, 65):
            out = np.hypot(x, y) - R
            off = np.degrees(np.angle(np.exp(1j * (np.arctan2(y, x) - np.radians(degrees)))))
            if near <= out <= far and abs(off) <= half:
                arrival[x, y] = min(arrival.get((x, y), 10**6), start + int((out - near) * per_px))
    return arrival


def line(arrival, xs, start, step=1):
    for k, x in enumerate(xs):
        for y in (-1, 0, 1):
            arrival[x, y] = start + step * k
    return arrival


def test_it_follows_its_own_tip_past_an_older_crossing():
    arrival = line({}, range(13, 53), 5)
    for x in (30, 31, 32):
        for y in range(-50, 50):
            arrival[x, y] = min(arrival.get((x, y), 99), 2)
    emerged, lengths, tube = grow(arrival, R, 80)
    assert emerged == 5 and abs(lengths[25] - 24) <= 2.5 and lengths[-1] >= 40
    assert not any(abs(y) > 5 and 30 <= x <= 32 for x, y in tube)


def test_a_false_start_is_forgotten():
    arrival = line(line({}, range(13, 16), 3), range(-14, -44, -1), 60)
    emerged, lengths, _ = grow(arrival, R, 120)
    assert emerged == 60 and max(lengths[:60]) == 0 and lengths[-1] > 20


def test_a_slow_start_is_kept():
    emerged, lengths, _ = grow(line({}, range(13, 43), 5, 5), R, 200)
    assert emerged == 5 and lengths[-1] > 25


def test_the_halo_is_an_option():
    arrival = stub({}, 30, 1, 40, 10)
    (late, far, _), (soon, near, _) = grow(arrival, R, 60), grow(arrival, R, 60, Rules(halo=1.0))
    assert (late, soon) == (12, 10) and far[11] == 0 and 1.5 < near[11] < 3.5 and abs(far[-1] - near[-1]) < 1


def test_the_arc_and_what_is_old_and_far_are_options():
    arrival = {(x, y): 10 for x in range(-16, 17) for y in range(-16, 17) if 3 < np.hypot(x, y) - R < 5 and abs(np.degrees(np.arctan2(y, x))) < 40}
    stub(arrival, 0, 5, 40, 11)
    assert grow(arrival, R, 60)[0] == 11 and grow(arrival, R, 60, Rules(arc=90))[0] == 10
    arrival = stub(stub({}, 0, 9, 30, 5, per_px=0), 0, 3, 9.5, 20, per_px=0)
    assert grow(arrival, R, 60)[0] is None and grow(arrival, R, 60, Rules(old_far=40))[0] == 20


def test_a_tube_that_rests_at_the_rim_needs_patience_or_a_lower_bar():
    arrival = stub(stub({}, 45, 3, 7.5, 5), 45, 7.5, 30, 60)
    assert grow(arrival, R, 150)[0] is None or grow(arrival, R, 150)[0] > 5
    assert grow(arrival, R, 150, Rules(least=4.0))[0] == 5 and grow(arrival, R, 150, Rules(give_up=80))[0] == 5


def test_flood_of_entities(spark):
    ship(spark)
    rows = [(e, x, y, b, R) for e, first in ((1, 5), (2, 9)) for (x, y), b in line({}, range(13, 30), first).items()] + [(3, 200, 0, 1, R)]
    got = {(r["e"], r["bin"]): r for r in flood.flood(spark.createDataFrame(rows, "e long, x long, y long, arrival long, radius double"), ["e"], 40).collect()}
    assert len(got) == 120 and got[1, 0]["emerged"] == 5 and got[2, 39]["emerged"] == 9 and got[3, 0]["emerged"] is None
    assert got[2, 8]["length"] == 0 < got[2, 9]["length"] and got[1, 39]["length"] == got[2, 39]["length"] > 15


def textured(dx, dy, size=48):
    """A band-limited texture shifted exactly, through its spectrum."""
    rng = np.random.default_rng(3)
    f = np.fft.fft2(rng.normal(size=(size, size)))
    fy, fx = np.meshgrid(np.fft.fftfreq(size), np.fft.fftfreq(size), indexing="ij")
    return np.fft.ifft2(f * np.exp(-60 * (fx**2 + fy**2)) * np.exp(-2j * np.pi * (fx * dx + fy * dy))).real


@pytest.mark.parametrize("dx, dy", [(0, 0), (3, -2), (0.4, -0.3), (-7.35, 11.6), (2.5, 1.05)])
def test_shifts_are_found_to_a_tenth(dx, dy):
    got = registration.shift_of(textured(0, 0), textured(dx, dy))
    assert abs(got[0] - dx) <= 0.1 and abs(got[1] - dy) <= 0.1


def test_an_outlier_is_replaced_and_a_jump_is_kept(spark):
    ship(spark)
    true = [(0, 0)] * 3 + [(0.4, -0.3), (2.5, 1.0), (17.0, -13.0), (2.4, 0.9), (2.5, 1.0), (2.5, 1.0)]
    rows = [(0, b, textured(*t).ravel().tolist()) for b, t in enumerate(true)]
    found = registration.shifts(spark.createDataFrame(rows, "e long, bin long, patch array<double>"), ["e"], "bin", 48, 48)
    got = registration.corrected(found, ["e"], "bin", 2.5).orderBy("bin").collect()
    assert [r["outlier"] for r in got] == [False] * 5 + [True] + [False] * 3
    for b in (3, 4, 6, 7, 8):
        assert np.allclose((got[b]["dx"], got[b]["dy"]), true[b], atol=0.2)
    assert np.allclose((got[5]["dx"], got[5]["dy"]), (2.4, 0.9), atol=0.5)
