"""The helper scripts in tools/ and bench.py stay importable after refactors."""

import glob
import os
import py_compile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("path", sorted(glob.glob(os.path.join(ROOT, "tools", "*.py"))) + [os.path.join(ROOT, "bench.py")])
def test_script_compiles(path):
    py_compile.compile(path, doraise=True)


def test_sweep_uses_current_names():
    # the sweep imports the stage graph and catalogue helpers by name
    src = open(os.path.join(ROOT, "tools", "random_sweep.py")).read()
    assert "ContactStages" in src and "ATTEMPT_COLS" in src
