import random

import pytest


@pytest.fixture
def rnd():
    return random.Random(7)
