"""Filings of one company and day share a window; nulls keep their rows."""

import datetime as dt
import io
from contextlib import redirect_stdout

from tidemark.operators import labels


def test_a_window_is_worked_out_once(spark):
    day = dt.date(2024, 1, 1)
    filings = [(1, "A", day), (2, "A", day), (3, "A", day + dt.timedelta(3)), (4, "B", day), (5, None, day), (6, "A", None)]
    bars = [("A", day + dt.timedelta(k), 100.0 + k * k % 7) for k in range(40)]
    out = labels.realized_vol(spark.createDataFrame(filings, "filing_id int, ticker string, filed_date date"), spark.createDataFrame(bars, "ticker string, day date, close double"))
    said = io.StringIO()
    with redirect_stdout(said):
        out.explain(mode="extended")
    assert "windowspecdefinition(filing_id" not in said.getvalue()
    got = {r["filing_id"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1]["realized_vol"] == got[2]["realized_vol"] > 0 and got[1]["n_returns"] == 29 and got[3]["window_start"] == day + dt.timedelta(4)
    assert all(got[k]["realized_vol"] is None and got[k]["n_returns"] == 0 for k in (4, 5, 6)) and got[6]["window_end"] is None
