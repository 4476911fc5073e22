"""No name is defined twice in a module: the later definition would hide the earlier one."""

from __future__ import annotations

import ast
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]


@pytest.mark.parametrize("path", sorted(ROOT.glob("oreline/**/*.py")), ids=lambda p: str(p.relative_to(ROOT)))
def test_no_name_is_defined_twice(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, (ast.Module, ast.ClassDef)):
            names = Counter(x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.ClassDef)))
            assert not [n for n, k in names.items() if k > 1]
