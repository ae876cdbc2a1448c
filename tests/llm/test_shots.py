"""Cuts near the beginning of a clip or of a shot."""

import numpy as np

from corpusloom.llm import media

A, B = np.array([100] + [1] * 15), np.array([1] * 15 + [100])


def test_cuts_after_any_frame():
    for n in range(1, 6):
        assert media.shots(np.array([A] * n + [B] * 5)) == [(0, n), (n, n + 5)]
        assert media.shots(np.array([A] * 5 + [B] * n + [A] * 5)) == [(0, 5), (5, 5 + n), (5 + n, 10 + n)]
    assert media.shots(np.array([A, B])) == [(0, 1), (1, 2)] and media.shots(np.array([A] * 3)) == [(0, 3)]


def test_short_payload_with_two_halves():
    raw = media.padded(b"a" * 2048 + b"\xf0" * 2048)
    assert media.decode_video(media.write_avi(raw))[1] == [(0, 1), (1, 2)]


def test_filled_up_frame_is_no_cut():
    raw = media.padded(b"plain words here " * 250)  # 2 frames and a part
    assert len(raw) % 2048 and media.decode_video(media.write_avi(raw))[1] == [(0, 3)]
