"""Codes, streams and marks."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.functions import codes
from glyphlake.operators import watermark as W


def test_known_values():
    assert codes.crc16(b"123456789") == 0x29B1
    assert codes.stream_length(16) == 193 and codes.stream_length(6) == 113


@given(st.binary(min_size=18, max_size=18), st.lists(st.tuples(st.integers(0, 21), st.integers(1, 255)), max_size=2, unique_by=lambda x: x[0]))
@settings(max_examples=200, deadline=None)
def test_two_wrong_bytes_are_mended(data, errors):
    word = bytearray(codes.rs_encode(data))
    for at, change in errors:
        word[at] ^= change
    assert codes.rs_decode(bytes(word)) == data
    assert codes.rs_decode(bytes(word), mode="detect") == (None if errors else data)


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=16), st.lists(st.tuples(st.integers(0, 19), st.integers(1, 255)), max_size=4)), min_size=1, max_size=30), st.sampled_from([2, 3, 4, 6, 9]))
@settings(max_examples=200, deadline=None)
def test_rows_are_coded_as_words_are(cases, parity):
    """Whatever is wrong with a word, in a matrix of words of many lengths, too."""
    data, words, length = np.zeros((len(cases), 16), np.uint8), np.zeros((len(cases), 16 + parity), np.uint8), []
    for k, (raw, errors) in enumerate(cases):
        data[k, 16 - len(raw) :] = list(raw)
        word = bytearray(codes.rs_encode(raw, parity))
        for at, change in errors:
            word[at % len(word)] ^= change
        words[k, 16 + parity - len(word) :] = list(word)
        length.append(len(word))
    coded = codes.rs_encode_rows(data, parity)
    assert [coded[k, 16 - len(raw) :].tobytes() for k, (raw, _) in enumerate(cases)] == [codes.rs_encode(raw, parity) for raw, _ in cases]
    for mode in ("correct", "detect"):
        back, ok = codes.rs_decode_rows(words, np.array(length), parity, mode)
        got = [back[k, 16 - len(raw) :].tobytes() if ok[k] else None for k, (raw, _) in enumerate(cases)]
        assert got == [codes.rs_decode(words[k, -n:].tobytes(), parity, mode) for k, n in enumerate(length)]


def test_a_megabyte_of_words_takes_seconds():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (65_536, 16), dtype=np.uint8)
    words, row = codes.rs_encode_rows(data), np.arange(len(data))
    words[row, row % 20] ^= 7
    words[row, row * 7 % 19] ^= 9
    began = time.process_time()
    back, ok = codes.rs_decode_rows(words, np.full(len(words), 20))
    assert ok.all() and (back == data).all() and time.process_time() - began < 3


@given(st.binary(min_size=16, max_size=16), st.lists(st.integers(0, 175), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_exact_or_nothing(payload, flips):
    bits = codes.stream(payload).copy()
    for at in flips:
        bits[16 + at] ^= 1
    assert codes.unstream(bits, 16) in (None, payload)


def image(kind, h=512, w=1024):
    y, x = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(0)
    rgb = {
        "gradient": np.stack([x * 255 / w, y * 255 / h, np.full((h, w), 128.0)], -1),
        "noise": np.clip(128 + 40 * rng.normal(size=(h, w, 3)), 0, 255),
        "grey": np.full((h, w, 3), 128.0),
    }[kind]
    return np.concatenate([rgb, np.full((h, w, 1), 255.0)], -1).astype(np.uint8)


def test_marks_survive_attacks():
    payload = b"+91 98765 43210\0"
    for kind in ("gradient", "noise", "grey"):
        before = image(kind)
        after, told = W.embed(before, payload)
        assert W.psnr(before, after) > 44
        assert told["placement"] == ("selective" if kind == "noise" else "dual")
        for attack in W.ATTACKS.values():
            assert W.extract(attack(after)) == payload
    assert W.extract(image("noise")) is None


def test_short_payloads():
    after, _ = W.embed(image("gradient"), b"V1\x01\x02\x03\x04")
    assert W.extract(after, 6) == b"V1\x01\x02\x03\x04" and W.extract(after, 16) is None
