"""As-of joins take in each row of a bucket once, and still find the first match."""

import datetime
import io
import random
from contextlib import redirect_stdout

import pytest

from tidemark.operators import asof


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("parts", [1, 3])
def test_frames_grow_and_matches_are_those_of_brute_force(spark, forward, parts):
    rng, day = random.Random(5), datetime.date(2024, 1, 1)
    left = [(i, rng.choice("ab"), day + datetime.timedelta(rng.randrange(200))) for i in range(300)]
    right = [(i, rng.choice("ab"), day + datetime.timedelta(rng.randrange(200))) for i in range(40)]
    out = asof.asof(
        spark.createDataFrame(left, "id int, k string, at date"), spark.createDataFrame(right, "v int, k string, day date"),
        "k", "at", "day", ["day", "v"], forward=forward, how="left", parts=parts,
    )
    said = io.StringIO()
    with redirect_stdout(said):
        out.explain(mode="extended")
    assert "unboundedfollowing" not in said.getvalue().lower()
    want = {}
    for i, k, at in left:
        met = [(abs((d - at).days), v) for v, key, d in right if key == k and (d >= at if forward else d <= at)]
        want[i] = min(met)[1] if met else None
    assert {r["id"]: r["v"] for r in out.collect()} == want
