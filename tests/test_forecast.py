from __future__ import annotations

import random
from datetime import date, datetime

import pytest

from gridloom.operators import forecast as op
from gridloom.plans.bias import BiasAnalysis, realized_demand
from helpers import close, rows

HOURLY = "respondent_id_ferc714 int, datetime_utc timestamp_ntz, report_date date, d double"
FORECAST = (
    "respondent_id_ferc714 int, report_year int, forecast_year int,"
    " summer_peak_demand_forecast_mw double, winter_peak_demand_forecast_mw double"
)
RESPONDENTS = (
    "respondent_id_ferc714 int, respondent_name_ferc714 string, report_date date"
)
REALIZED = (
    "respondent_id_ferc714 int, year int, realized_peak double, realized_total_demand double"
)


@pytest.fixture
def make(spark):
    def build(schema, data):
        return spark.createDataFrame(data, schema)

    return build


def test_realized_keeps_matching_years_only(make):
    hourly = make(HOURLY, [
        (1, datetime(2010, 5, 1, 1), date(2010, 1, 1), 5.0),
        (1, datetime(2010, 5, 1, 2), date(2010, 1, 1), 7.0),
        (1, datetime(2011, 1, 1, 0), date(2010, 1, 1), 99.0),
        (2, datetime(2010, 5, 1, 1), date(2010, 1, 1), None),
        (None, datetime(2010, 5, 1, 1), date(2010, 1, 1), 3.0),
    ])
    assert rows(op.realized(hourly, "d")) == [(1, 2010, 7.0, 12.0), (2, 2010, None, 0.0)]


def errors_of(make, forecasts, realized, names=((1, "one"),), **options):
    respondents = make(RESPONDENTS, [(i, n, date(2010, 1, 1)) for i, n in names])
    return op.forecast_errors(
        make(FORECAST, forecasts), make(REALIZED, realized), respondents, **options
    )


def test_errors_are_zero_where_they_cannot_be_computed(make):
    forecasts = [
        (1, 2010, 2011, 12.0, 11.0), (1, 2010, 2012, 0.0, 0.0), (1, 2010, 2013, None, 9.0),
        (1, 2010, 2014, 9.0, 9.0), (1, 2010, 2015, 9.0, 9.0), (1, 2010, 2016, 9.0, 9.0),
        (1, 2005, 2011, 9.0, 9.0),
    ]
    realized = [(1, 2011, 10.0, 1.0), (1, 2012, 10.0, 1.0), (1, 2013, 10.0, 1.0),
                (1, 2014, 0.0, 0.0), (1, 2015, None, 0.0)]
    found = rows(errors_of(make, forecasts, realized), "lookahead", "forecast", "error")
    # 2016 has no realized demand and report year 2005 lies before the first year.
    assert found == [(1, 12.0, 0.2), (2, 0.0, 0.0), (3, None, 0.0), (4, 9.0, 0.0), (5, 9.0, 0.0)]


def test_unknown_names_stay_null_and_two_names_fail(make):
    forecasts, realized = [(1, 2010, 2011, 2.0, 1.0)], [(1, 2011, 2.0, 2.0)]
    unknown = errors_of(make, forecasts, realized, names=((2, "two"),))
    assert rows(unknown, "respondent_name_ferc714", "error") == [(None, 0.0)]
    with pytest.raises(Exception, match="two names"):
        errors_of(make, forecasts, realized, names=((1, "a"), (1, "b"))).collect()


def test_years_to_drop_are_forecast_years(make):
    forecasts = [(1, 2011, 2012, 2.0, 1.0), (1, 2010, 2011, 2.0, 1.0)]
    realized = [(1, 2011, 2.0, 2.0), (1, 2012, 2.0, 2.0)]
    found = errors_of(make, forecasts, realized, years_to_drop=[2011])
    assert rows(found, "report_year", "forecast_year") == [(2011, 2012)]


def test_threshold_is_on_the_mean_yearly_total(make):
    forecasts = [(i, 2010, 2011, 2.0, 1.0) for i in (1, 2)]
    realized = [(1, 2011, 2.0, 10.0), (1, 2012, 2.0, 0.0), (2, 2011, 2.0, 6.0)]
    options = {"names": ((1, "one"), (2, "two"))}
    for threshold, ids in ((0, [1, 2]), (5, [1, 2]), (5.5, [2]), (7, [])):
        found = errors_of(
            make, forecasts, realized, mean_annual_demand_threshold=threshold, **options
        )
        assert [r[0] for r in rows(found, "respondent_id_ferc714")] == ids


ERRORS = (
    "respondent_id_ferc714 int, respondent_name_ferc714 string, report_year int,"
    " lookahead int, error double"
)


def test_bias_drops_report_years_with_a_wild_first_year(make):
    data = [(1, "a", 2010, 1, 100.0), (1, "a", 2010, 2, 9.0), (1, "a", 2011, 1, 0.1),
            (1, "a", 2011, 2, 0.3), (1, "a", 2012, 2, 0.5)]
    found = rows(
        op.forecast_bias(make(ERRORS, data)), "lookahead_0", "lookahead_1", "lookahead_2"
    )
    assert found == [(0.0, 0.1, 0.4)]


def test_bias_limits_are_inclusive(make):
    data = []
    for i, (one, ten) in enumerate([(0.3, 1.0), (-0.3, -1.0), (0.31, 0.0), (0.0, 1.01)]):
        data += [(i, "n", 2010, 1, one), (i, "n", 2010, 10, ten)]
    found = rows(op.forecast_bias(make(ERRORS, data)), "respondent_id_ferc714")
    assert found == [(0,), (1,)]


def test_bias_counts_missing_over_every_lookahead_found(make):
    # Nine lookaheads are found: -1, 0 and 1 to 6, and 11. Zero always counts as present.
    full = [(1, "a", 2010, k, 0.0) for k in (-1, 0, 1, 2, 3, 4, 5, 6, 11)]
    three = [(2, "b", 2010, k, 0.0) for k in (1, 2, 3)]  # lacks -1, 4, 5, 6, 11: five
    two = [(3, "c", 2010, k, 0.0) for k in (1, 2)]  # lacks six
    found = rows(op.forecast_bias(make(ERRORS, full + three + two)), "respondent_id_ferc714")
    assert found == [(1,), (2,)]


def test_lookaheads_of_unnamed_respondents_and_wild_years_count_too(make):
    # Both the nameless respondent and the wild report year widen the set of lookaheads.
    data = [(1, "a", 2010, 1, 0.0)]
    data += [(2, None, 2010, k, 0.0) for k in (2, 3, 4)]
    data += [(3, "c", 2010, k, 100.0) for k in (1, 5, 6, 7)]
    assert rows(op.forecast_bias(make(ERRORS, data))) == []
    assert rows(op.forecast_bias(make(ERRORS, data[:-1])), "respondent_id_ferc714") == [(1,)]


def test_bias_overrides_lookahead_zero(make):
    found = op.forecast_bias(make(ERRORS, [(1, "a", 2010, 0, 0.7), (1, "a", 2010, 1, 0.1)]))
    assert rows(found, "lookahead_0", "lookahead_1", "lookahead_10") == [(0.0, 0.1, None)]


def test_bias_fails_on_a_repeated_lookahead(make):
    data = [(1, "a", 2010, 1, 0.1), (1, "a", 2010, 1, 0.1)]
    with pytest.raises(Exception, match="lookahead repeats"):
        op.forecast_bias(make(ERRORS, data)).collect()


def test_bias_long_keeps_nulls(make):
    bias = op.forecast_bias(make(ERRORS, [(1, "a", 2010, 1, 0.1)]))
    found = rows(op.bias_long(bias))
    assert found[:3] == [(1, 0, 0.0), (1, 1, 0.1), (1, 2, None)]
    assert len(found) == 11


def test_weighted_bias_keeps_the_full_divisor(make):
    data = [(1, "a", 2010, 1, 0.1), (1, "a", 2010, 2, 0.2), (2, "b", 2010, 1, 0.3),
            (3, "c", 2010, 1, 0.3), (4, "d", 2010, 1, 0.2)]
    bias = op.forecast_bias(make(ERRORS, data))
    # 3 has no row in the weight year, 4 has a null peak.
    realized = make(REALIZED, [(1, 2015, 1.0, 30.0), (2, 2015, 3.0, 10.0), (3, 2014, 1.0, 1.0),
                               (4, 2015, None, 0.0)])
    total = rows(op.weighted_bias(bias, realized))
    assert close(total[:4], [(0, 0.0, None), (1, 0.15, "15.0%"), (2, 0.15, "15.0%"),
                             (3, 0.0, "0.0%")])
    assert len(total) == 11
    peak = rows(op.weighted_bias(bias, realized, "peak"))
    assert close(peak[1:3], [(1, 0.25, "25.0%"), (2, 0.05, "5.0%")])
    with pytest.raises(ValueError, match="end_weighting"):
        op.weighted_bias(bias, realized, "mean")


def test_weighted_bias_without_weights_is_null(make):
    bias = op.forecast_bias(make(ERRORS, [(1, "a", 2010, 1, 0.1)]))
    found = rows(op.weighted_bias(bias, make(REALIZED, [(1, 2014, 1.0, 1.0)])))
    assert [r[1] for r in found] == [None] * 11


def test_coverage_counts_before_dropping_years(make):
    forecast = make(FORECAST, [(1, 2010, 2011, 1.0, 1.0), (2, 2010, 2011, 1.0, 1.0),
                               (9, 2010, 2011, 1.0, 1.0)])
    realized = make(REALIZED, [(1, 2011, 1.0, 6.0), (2, 2011, 1.0, 2.0), (3, 2011, 1.0, 12.0)])
    none = op.coverage(forecast, realized)
    assert rows(none) == [(2, 2, 100.0)]
    some = op.coverage(forecast, realized, mean_annual_demand_threshold=6)
    assert rows(some) == [(2, 1, 90.0)]
    text = "showing 1 / 2 respondents (90.00% of total demand)"
    assert rows(op.coverage_text(some)) == [(text,)]


def test_plan_runs_from_raw_tables(make):
    hourly = make(HOURLY, [
        (i, datetime(y, 7, 1), date(y, 1, 1), 100.0 * i + y - 2010)
        for i in (1, 2) for y in range(2010, 2017)
    ])
    forecast = make(FORECAST, [
        (i, 2010, y, 110.0 * i, 100.0) for i in (1, 2) for y in range(2011, 2017)
    ])
    respondents = make(RESPONDENTS, [(1, "ONE", date(2010, 1, 1)), (2, "Two", date(2010, 1, 1)),
                                     (2, "two", date(2011, 1, 1))])
    result = BiasAnalysis(forecast, realized_demand(hourly, "d"), respondents)
    assert result.errors.count() == 12
    assert rows(result.bias, "respondent_name_ferc714") == [("one",), ("two",)]
    curve = rows(result.curve)
    first = ((110 - 101) / 101 * 105 + (220 - 201) / 201 * 205) / 310
    assert close([curve[1][:2]], [(1, first)])
    assert rows(result.coverage) == [(2, 2, 100.0)]


def curves(make, forecasts, **options):
    realized = make(REALIZED, [(1, y, 10.0, 1.0) for y in range(2010, 2016)])
    respondents = make(RESPONDENTS, [(1, "\tNew ", date(2012, 1, 1)), (1, " Old", date(2010, 1, 1)),
                                     (1, "\tNew ", date(2009, 1, 1))])
    return op.respondent_curves(make(FORECAST, forecasts), realized, respondents, **options)


def test_curves_add_a_zero_point_per_report_year(make):
    forecasts = [
        (1, 2010, 2012, 12.0, 1.0), (1, 2010, 2011, 11.0, 1.0), (1, 2011, 2011, 15.0, 1.0),
        (1, 2012, 2013, 0.0, 0.0), (7, 2010, 2011, 1.0, 1.0),
    ]
    found = curves(make, forecasts, ids=[1])
    assert rows(found, "report_year", "lookahead", "error", "forecast", "gradient") == [
        (2010, 0, 0.0, 11.0, 0.0), (2010, 1, 0.1, 11.0, 0.0), (2010, 2, 0.2, 12.0, 0.0),
        (2011, 0, 0.0, 15.0, 0.5), (2011, 0, 0.5, 15.0, 0.5),
        (2012, 0, 0.0, 0.0, 1.0), (2012, 1, 0.0, 0.0, 1.0),
    ]
    # The name that went out of use first, without white space.
    assert {r[0] for r in rows(found, "name")} == {"Old"}


def test_curves_drop_years_and_spread_one_year_at_zero(make):
    found = curves(make, [(1, 2010, 2011, 11.0, 1.0), (1, 2011, 2012, 1.0, 1.0)],
                   years_to_drop=[2012])
    assert rows(found, "report_year", "gradient") == [(2010, 0.0), (2010, 0.0)]


def test_trajectory(make):
    forecast = make(FORECAST, [(1, 2024, 2026, 1.0, 2500.0), (1, 2024, 2025, 1.0, None),
                               (1, 2023, 2025, 1.0, 9.0), (2, 2024, 2025, 1.0, 9.0)])
    found = op.trajectory(forecast, ids=[1], report_year=2024).collect()
    assert [tuple(r)[2:] for r in found] == [(2025, None), (2026, 2.5)]


def brute_force_bias(data):
    """Mean errors per named respondent by plain loops over dictionaries."""
    reports = {}
    for i, name, year, lookahead, error in data:
        reports.setdefault((i, name, year), {})[lookahead] = error
    found = {k for r in reports.values() for k in r} | {0}
    gathered = {}
    for (i, name, _), report in reports.items():
        if name is None or report.get(1, 0.0) >= 100:
            continue
        for lookahead, error in report.items():
            gathered.setdefault((i, name), {}).setdefault(lookahead, []).append(error)
    result = {}
    for key, lists in gathered.items():
        means = {k: sum(v) / len(v) for k, v in lists.items()} | {0: 0.0}
        if len(found) - len(means) > 5:
            continue
        if abs(means.get(1, 0.0)) > 0.3 or abs(means.get(10, 0.0)) > 1.0:
            continue
        result[key] = [means.get(k) for k in range(11)]
    return result


@pytest.mark.parametrize("seed", range(4))
def test_bias_and_curve_agree_with_brute_force(make, seed):
    draw = random.Random(seed)
    data, weights = [], []
    for i in range(40):
        name = None if draw.random() < 0.1 else f"n{i}"
        width = draw.choice([2, 5, 8, 13])
        for year in range(2006, 2006 + draw.randint(1, 4)):
            for lookahead in range(-1, width):
                if draw.random() < 0.8:
                    wild = lookahead == 1 and draw.random() < 0.1
                    error = 120.0 if wild else draw.uniform(-0.5, 0.5) * (1 + lookahead / 5)
                    data.append((i, name, year, lookahead, error))
        if draw.random() < 0.8:
            weights.append((i, 2015, draw.uniform(1, 9), draw.uniform(1, 9)))
    expected = brute_force_bias(data)
    bias = op.forecast_bias(make(ERRORS, data))
    found = {(r[0], r[1]): list(r)[2:] for r in bias.collect()}
    assert found.keys() == expected.keys() and expected
    for key, values in expected.items():
        assert close([found[key]], [values])

    for weighting, column in (("peak", 2), ("total", 3)):
        weight = {w[0]: w[column] for w in weights}
        kept = {k: v for k, v in expected.items() if k[0] in weight}
        total = sum(weight[i] for i, _ in kept)
        curve = [
            sum((v[k] or 0.0) * weight[i] for (i, _), v in kept.items()) / total
            for k in range(11)
        ]
        shown = rows(op.weighted_bias(bias, make(REALIZED, weights), weighting))
        assert close([r[1:2] for r in shown], [(c,) for c in curve])
