import numpy as np
import pytest

from phasorlake.llm import webp

RNG = np.random.default_rng(5)
NOISE = RNG.integers(0, 1 << 32, (11, 13), dtype=np.uint32)


def _blocks(values):
    """One element for each block of 4 pixels a side, 3 by 4 of them."""
    return np.resize(np.asarray(values, np.uint32), (3, 4))


def _same(p, **options):
    got = webp.decode(webp.encode(p, **options))
    assert got.shape == p.shape and (got == p).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    _same(NOISE, modes=_blocks([0xFF000000 | mode << 8]))


def test_cross_colour_and_all_together():
    cross = RNG.integers(0, 1 << 24, (3, 4), dtype=np.uint32) | np.uint32(0xFF000000)
    _same(NOISE, cross=cross)
    _same(NOISE, cross=cross, green=True, modes=_blocks([0xFF000000 | m << 8 for m in range(14)]), cache_bits=4)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    palette = np.unique(RNG.integers(0, 1 << 32, 2 * colours, dtype=np.uint32))[:colours]
    _same(palette[np.resize(RNG.permutation(colours), (19, 29))], palette=True)


@pytest.mark.parametrize("bits", range(12))
def test_cache_sizes(bits):
    few = RNG.integers(0, 1 << 32, 9, dtype=np.uint32)
    _same(few[RNG.integers(0, 9, (11, 13))], cache_bits=bits)


def test_grey_images_refer_back():
    """Repeats are stored once: literals alone take four bits a sample of this text at least."""
    text = b" ".join(RNG.choice([b"alder", b"birch", b"cedar", b"maple", b"willow"], 40)) * 9
    samples = np.resize(np.frombuffer(text, np.uint8), (8, 576))
    file = webp.encode_grey(samples)
    assert (webp.decode_all([file], grey=True)[0] == samples).all()
    assert len(file) * 8 < samples.size


def test_grey_images_of_all_forms():
    slope = (np.arange(300)[:, None] * 3 + np.arange(300) * 5 + RNG.integers(0, 2, (300, 300))).astype(np.uint8)
    few = (RNG.random((60, 101)) < 0.1).astype(np.uint8) * 7
    tiny = [RNG.integers(0, 256, (h, w), dtype=np.uint8) for h, w in ((1, 1), (1, 2), (2, 1), (3, 1), (1, 5))]
    flat = np.full((40, 576), 255, np.uint8)
    images = [slope, few, flat, *tiny, *(RNG.integers(0, 9, (2, 40 + k), dtype=np.uint8) for k in range(150))]
    files = webp.encode_greys(images)
    assert all((a == b).all() for a, b in zip(webp.decode_all(files, grey=True), images, strict=True))
    assert files == [webp.encode_grey(i) for i in images]  # whatever is encoded beside it
    plain = webp._Tokens([webp._plain(i) for i in (slope, few)]).files()
    assert len(files[0]) < len(plain[0]) and len(files[1]) < len(plain[1])  # a predictor, a bundled palette
    for bits in range(1, 12):
        for image in (few, images[-1]):
            for file in (webp._Tokens([webp._plain(image, bits)]).files()[0], webp._Tokens([webp._predicted(image)]).files()[0]):
                assert (webp.decode_all([file], grey=True)[0] == image).all()


def test_long_images_are_read_beside_short_ones(monkeypatch):
    """Of images of very different sizes hardly a sample is left to be read one image after the other."""
    images = [RNG.integers(0, 40, (1 + (k % 50) ** 3 // 2000, 64), dtype=np.uint8) for k in range(1500)]
    alone, rest = [], webp._rest
    monkeypatch.setattr(webp, "_rest", lambda *given: (alone.append(len(given[-2]) - given[-1]), rest(*given))[1])
    got = webp.decode_all(webp.encode_greys(images), grey=True)
    assert all((a == b).all() for a, b in zip(got, images, strict=True))
    assert sum(alone) < 0.05 * sum(i.size for i in images)


def test_flattened_codes_are_full():
    """Longer codes than allowed are flattened; what occurs more often keeps the shorter code."""
    counts = [int(1.6**k) for k in range(30)]
    lengths = webp.code_lengths(counts, 11)
    assert max(lengths) <= 11 and sum(2.0**-n for n in lengths) == 1
    assert lengths == sorted(lengths, reverse=True)


def test_cut_streams_are_refused():
    files = webp.encode_greys([RNG.integers(0, 99, (3, 90), dtype=np.uint8) for _ in range(200)])
    cut = lambda f: f[:16] + (int.from_bytes(f[16:20], "little") - 40).to_bytes(4, "little") + f[20:]
    for some in ([cut(files[0])], [*files, cut(files[0])]):
        with pytest.raises(ValueError, match="ends early"):
            webp.decode_all(some)
