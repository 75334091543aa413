import pytest

from millrace.llm import roundtrip


@pytest.fixture(autouse=True)
def few_units(monkeypatch):
    """Small tables in few units: a unit is a task, and what a test costs."""
    monkeypatch.setattr(roundtrip, "LEAST", 4)
