from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from slopebook.plans.session import get_spark
    s = get_spark("local[4]", 4, app_name="slopebook-tests")
    yield s
    s.stop()
