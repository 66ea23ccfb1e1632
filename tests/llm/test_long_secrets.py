"""Secrets are found wherever they stand in a long run."""

from __future__ import annotations

import pytest

KEY = "Zq8Lw0Tn5Yk2Vb7Xc4Rm1Hd6"


@pytest.mark.parametrize("lead", ["com/services/T00000000/B00000000/", "com/en/articles/of/the/other/things/in/2024/here/", "word/" * 40])
def test_secret_late_in_a_long_run(lead):
    from lumenfold.llm.secretscan import BODY, masked, scan_text, trained_model, windows

    text = f"see the page {lead}{KEY} for more"
    _, spans = scan_text(text, trained_model())
    assert KEY not in masked(text, spans)
    seen = windows(text, 13, 13 + len(lead) + len(KEY))
    chars = "".join(map(chr, seen[-1, 24 : 24 + BODY]))
    assert chars == (lead + KEY)[-BODY:]


def test_every_character_of_a_long_run_is_in_a_window():
    from lumenfold.llm.secretscan import BODY, LEFT, windows

    for n in (16, 40, 41, 48, 49, 100, 1001):
        run = "".join(chr(33 + k % 90) for k in range(n))
        rows = windows(run, 0, n)
        pieces = ["".join(map(chr, r[LEFT : LEFT + min(n, BODY)])) for r in rows]
        at = [min(8 * k, max(0, n - BODY)) for k in range(len(rows))]
        assert [run[a : a + BODY] for a in at] == pieces and at[-1] + BODY >= n


def test_key_around_a_hexadecimal_stretch_is_masked_whole():
    from lumenfold.llm.secretscan import masked, scan_text, trained_model

    stretch = "0123456789abcdef01234567"
    text = f"use bearer {KEY}{stretch}{KEY[::-1]} now"
    base, spans = scan_text(text, trained_model())
    assert [k for _, k, _ in base] == ["hex"] and masked(text, spans) == "use bearer [SECRET] now"
