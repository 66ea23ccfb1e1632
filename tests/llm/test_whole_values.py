"""Personal values are found whole, whatever stands beside them."""

from __future__ import annotations

import re

import pytest


def changed(text):
    from lumenfold.llm.pseudonyms import compile_kinds, pseudonymize

    return pseudonymize(text, b"key", compile_kinds(), {})


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        ("card 4111111111111111 12/26", "4111111111111111", "card"),
        ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
        ("4111111111111111 99 apples", "4111111111111111", "card"),
        ("12 4111111111111111", "4111111111111111", "card"),
        ("DE89370400440532013000 BIC COBADEFF", "DE89370400440532013000", "iban"),
        ("GB82 WEST 1234 5698 7654 32 OR SO", "GB82 WEST 1234 5698 7654 32", "iban"),
        ("born 03/25/1990 here", "03/25/1990", "date"),
    ],
)
def test_value_with_more_beside_it(text, value, kind):
    new, found = changed(text)
    assert value not in new and found == {kind: 1}
    before, after = text.split(value)
    assert new.startswith(before) and new.endswith(after)


def test_values_side_by_side_and_none():
    new, found = changed("4111111111111111 4111111111111111 4041894974608795")
    one, two, three = new.split()
    assert found == {"card": 3} and one == two != "4111111111111111" and three != "4041894974608795"
    # no border inside an unbroken run of digits, and no date in either order
    for text in ("41111111111111110", "13/13/1990", "1234567890123456 12 words"):
        assert changed(text) == (text, {})


def test_month_first_stays_month_first():
    new, _ = changed("03/25/1990")
    assert re.fullmatch(r"(0[1-9]|1[0-2])/([0-2][0-9]|3[01])/[0-9]{4}", new)
