from __future__ import annotations

import json

import pytest

from monthloom.operators.history import checked_horizon, history, history_summary


@pytest.fixture(scope="module")
def panel(make_panel):
    # 2000-01 .. 2002-12, value = month number + 100 per year; a second series ends in 2000.
    long = [m + 100 * y for y in range(3) for m in range(1, 13)]
    return make_panel({"a": long, "b": list(range(1, 13))})


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_filters_and_order(panel):
    answer = history(panel, 2001, "2002", "monsoon")
    got = rows(answer.records, "series_id", "date", "month_name", "season", "arrivals")
    assert got == [
        ("a", f"{2000 + y}-{m:02d}", n, "monsoon", m + 100 * y) for y in (1, 2) for m, n in ((6, "Jun"), (7, "Jul"), (8, "Aug"))
    ]
    assert rows(answer.monthly_average, "month", "average_arrivals") == [(6, 156.0), (7, 157.0), (8, 158.0)]


def test_the_season_filter_leaves_season_averages_alone(panel):
    by_season = [rows(history(panel, 2001, 2002, s).season_average, "season", "average_arrivals") for s in ("all", "monsoon")]
    assert by_season[0] == by_season[1]
    assert [s for s, _ in by_season[0]] == ["autumn_trek", "monsoon", "shoulder", "spring_trek"]
    assert by_season[0][0] == ("autumn_trek", 160.0)
    assert by_season[0][2] == ("shoulder", 155.0)


def test_meta_keeps_the_whole_range(panel):
    meta = {r.series_id: r for r in history(panel, 2001, None, "shoulder").meta.collect()}
    assert (meta["a"].start_year, meta["a"].end_year, meta["a"].min_year, meta["a"].max_year) == (2001, 2002, 2000, 2002)
    assert meta["a"].records == 6
    assert meta["b"].records == 0


def test_no_bounds_mean_all_rows(panel):
    assert history(panel).records.count() == 48


def test_unordered_gives_the_same_rows(panel):
    both = [sorted(map(tuple, history(panel, ordered=o).records.collect())) for o in (True, False)]
    assert both[0] == both[1]


def test_empty_answer(panel):
    answer = history(panel, 1990, 1991)
    assert answer.records.count() == answer.monthly_average.count() == answer.season_average.count() == 0
    summary = history_summary(panel, 1990, 1991).collect()
    assert {(r.series_id, r.average_selected, r.latest_month, r.season) for r in summary} == {
        ("a", 0, None, None), ("b", 0, None, None),
    }


def test_summary(panel):
    got = [r for r in history_summary(panel, 2001, 2002, "monsoon").orderBy("season_rank").collect() if r.series_id == "a"]
    assert [r.season for r in got] == ["autumn_trek", "monsoon", "shoulder", "spring_trek"]
    assert {(r.average_selected, r.latest_month, r.latest_value) for r in got} == {(157, "2002-08", 208)}


def test_summary_counts_missing_values_as_zero_and_rounds_halves_up(make_panel):
    panel = make_panel({"a": [1, None, 2, 3]})
    assert history_summary(panel).first().average_selected == 2


def test_payload(panel):
    document = {r.series_id: json.loads(r.payload) for r in history(panel, 2000, 2000, "monsoon").payload().collect()}
    a = document["b"]
    assert a["meta"]["records"] == 3
    assert [r["date"] for r in a["records"]] == ["2000-06", "2000-07", "2000-08"]
    assert [r["month"] for r in a["monthly_average"]] == [6, 7, 8]
    assert [r["season"] for r in a["season_average"]] == ["autumn_trek", "monsoon", "shoulder", "spring_trek"]
    assert set(a["season_average"][0]) == {"season", "average_arrivals"}
    empty = {r.series_id: json.loads(r.payload) for r in history(panel, 2002, 2002).payload().collect()}
    assert empty["b"]["records"] == [] and empty["b"]["season_average"] == []


@pytest.mark.parametrize(
    "start, end, season", [("abc", None, "all"), (2020, 2019, "all"), (None, None, "winter"), (2019.5, 2020, "all"), (True, 2020, "all")]
)
def test_bad_filters(panel, start, end, season):
    with pytest.raises(ValueError):
        history(panel, start, end, season)


def test_horizon():
    assert [checked_horizon(h) for h in (1, "3", 6, 12)] == [1, 3, 6, 12]
    for bad in (None, "x", 2, 0, 3.9, True):
        with pytest.raises(ValueError):
            checked_horizon(bad)
