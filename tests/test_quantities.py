"""Figures of texts that repeat."""

from foliant.operators import quantities


def test_equal_texts_are_read_once(monkeypatch):
    read = []
    real = quantities.read
    monkeypatch.setattr(quantities, "read", lambda texts: read.extend(texts.to_pylist()) or real(texts))
    monkeypatch.setattr(quantities, "_known", {})
    monkeypatch.setattr(quantities, "REMEMBERED", 3)
    long = "5 mW " + "x" * 2000
    assert [r.get("power_mw") for r in quantities.fields_of(["3 mW", "4 mW", "none", long])] == [3.0, 4.0, None, 5.0]
    assert [r.get("power_mw") for r in quantities.fields_of(["4 mW", "3 mW", long])] == [4.0, 3.0, 5.0]
    assert read == ["3 mW", "4 mW", "none", long, long]
    # beyond what it may remember the worker starts anew, with the same results
    assert [r.get("power_mw") for r in quantities.fields_of(["3 mW", "6 mW", "7 mW"])] == [3.0, 6.0, 7.0]
    assert [r.get("power_mw") for r in quantities.fields_of(["7 mW", "3 mW"])] == [7.0, 3.0] and len(quantities._known) <= 3
