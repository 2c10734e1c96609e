"""Local contrast against a plain loop, colour round trips, tone and development."""

import numpy as np
import pytest

from plumage.operators import development as D


def plain_equalised(plane, clip, tiles):
    """One pixel after the other."""
    h, w = plane.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(plane, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect") if (th * tiles, tw * tiles) != (h, w) else plane
    tables = {}
    for i in range(tiles):
        for j in range(tiles):
            hist = [0] * 256
            for v in wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel():
                hist[int(v)] += 1
            limit, over = max(1, int(clip * th * tw / 256)), 0
            for v in range(256):
                if hist[v] > limit:
                    over += hist[v] - limit
                    hist[v] = limit
            hist = [n + over // 256 for n in hist]
            rest = over % 256
            if rest:
                step, v = max(256 // rest, 1), 0
                while v < 256 and rest > 0:
                    hist[v] += 1
                    v, rest = v + step, rest - 1
            total, table = 0, []
            for n in hist:
                total += n
                table.append(min(255, int(np.rint(total * (255.0 / (th * tw))))))
            tables[i, j] = table
    out = np.zeros_like(plane)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            fy, fx = fy - y0, fx - x0
            at = lambda i, j: tables[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1)][plane[y, x]]  # noqa: E731, B023
            value = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
            out[y, x] = min(255, max(0, int(np.rint(value))))
    return out


@pytest.mark.parametrize(("shape", "tiles", "clip"), [((32, 48), 4, 2.0), ((37, 50), 4, 1.0), ((64, 64), 8, 9.0), ((21, 30), 2, 40.0)])
def test_equalised_as_a_plain_loop(shape, tiles, clip):
    rng = np.random.default_rng(sum(shape))
    plane = np.clip(rng.normal(90, 25, shape) + np.linspace(0, 60, shape[1])[None, :], 0, 255).astype(np.uint8)
    assert (D.equalised(plane, clip, tiles) == plain_equalised(plane, clip, tiles)).all()


def test_small_and_flat_planes():
    for shape in ((1, 1), (3, 200), (200, 3), (8, 8)):
        assert D.equalised(np.full(shape, 7, np.uint8), 3.0).shape == shape
    assert len(np.unique(D.equalised(np.full((80, 80), 100, np.uint8), 3.0))) == 1


def test_lab_of_known_colours_and_back():
    known = {(255, 255, 255): (255, 128, 128), (0, 0, 0): (0, 128, 128), (255, 0, 0): (136, 208, 195), (0, 255, 0): (224, 42, 211), (0, 0, 255): (82, 207, 20), (128, 128, 128): (137, 128, 128)}
    assert [tuple(int(v) for v in D.to_lab(np.array([[c]], np.uint8))[0, 0]) for c in known] == list(known.values())
    grays = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, axis=2)
    assert np.abs(D.from_lab(D.to_lab(grays)).astype(int) - grays).max() <= 1
    rgb = np.random.default_rng(1).integers(0, 256, (60, 60, 3), dtype=np.uint8)
    assert np.abs(D.from_lab(D.to_lab(rgb)).astype(int) - rgb).mean() < 2


def test_tone():
    ramp = np.repeat(np.arange(0, 256, 2, dtype=np.uint8)[None, :, None], 64, axis=0).repeat(3, axis=2)
    assert D.toned(ramp) is ramp
    assert (D.toned(ramp, exposure=100) == np.clip(ramp * 1.5, 0, 255).astype(np.uint8)).all() and D.toned(ramp, exposure=-500)[0, 50, 0] == 50
    lifted = D.toned((ramp // 4).astype(np.uint8), shadow=80)
    assert lifted.mean() > ramp.mean() / 4 + 5  # shadows are no longer passed over
    assert D.toned(ramp, contrast=100).std() > ramp.std() > D.toned(ramp, contrast=-100).std()


def test_wildlife():
    rng = np.random.default_rng(4)
    dark = np.clip(rng.normal(40, 12, (96, 120, 3)), 0, 255).astype(np.uint8)
    out = D.wildlife(dark)
    assert out.shape == dark.shape and out.mean() > dark.mean() and out.std() > dark.std()
    seen = []
    D.wildlife(dark, lambda x, strength: seen.append(strength) or x)
    assert len(seen) == 1 and 2.5 <= seen[0] <= 8
    assert D.wildlife(np.zeros((0, 4, 3), np.uint8)).size == 0 and D.wildlife(np.zeros((2, 2, 3), np.uint8)).shape == (2, 2, 3)
    blurred = D._blurred(np.eye(9), 1.05)
    assert abs(blurred[4].sum() - np.eye(9)[4].sum()) < 0.2 and np.allclose(blurred, blurred.T)


def test_developed_files(spark):
    def decoder():
        return lambda content: None if content == b"none" else np.full((4, 5, 3), content[0], np.uint8)

    def encoder():
        return lambda pixels: bytes(pixels.shape)

    files = spark.createDataFrame([("a", bytearray(b"\x20")), ("b", bytearray(b"none"))], "dest string, content binary")
    got = {r.dest: r for r in D.developed_files(files, decoder, encoder).collect()}
    assert bytes(got["a"].content) == bytes((4, 5, 3)) and got["a"].error is None
    assert bytes(got["b"].content) == b"none" and got["b"].error == "ValueError: not decoded"
