"""The layout of the repository, as pytest and the driver need it."""

from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_test_modules_have_names_of_their_own():
    names = Counter(p.name for p in (ROOT / "tests").rglob("test_*.py"))
    assert [n for n, k in names.items() if k > 1] == []


def test_nothing_outside_imports_the_training_data_package():
    for path in (ROOT / "millrace").rglob("*.py"):
        if path.parent.name != "llm":
            assert "millrace.llm" not in path.read_text(), path
