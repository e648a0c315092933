"""The fold of an endpoint, whole and extended, against the operators that read the log each for itself."""

import pytest

from siftlane.operators import catalog as C
from siftlane.operators import fold as O
from siftlane.operators import openapi as A
from siftlane.session import stored

from events import frame, random_events


def rows_of(df, columns=None):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


@pytest.mark.parametrize("profile", ["v1", "v2"])
@pytest.mark.parametrize("cuts", [[], [60], [3, 40, 100]])
def test_fold_and_its_extensions(spark, profile, cuts):
    rows = random_events(23, 160)
    ends = [0, *cuts, 160]
    days = [frame(spark, rows[a:b]) for a, b in zip(ends, ends[1:])]
    folded = stored(O.fold(days[0], profile), "fold")
    for day in days[1:]:
        folded = stored(O.extend(folded, day, profile), "fold")
    events = frame(spark, rows)
    for got, want in ((O.catalog_of(folded, profile), C.endpoint_catalog(events, profile)), (O.openapi_requests_of(folded), A.openapi_requests(events, profile)),
                      (O.openapi_responses_of(folded, profile), A.openapi_responses(events, profile))):
        assert rows_of(got, want.columns) == rows_of(want)


def test_documents_read_the_fold_alone(spark, tmp_path):
    """No document reads the log again; what it scans is the stored fold."""
    from siftlane.operators.report import json_entries
    from siftlane.sinks.writers import endpoint_map_rows, openapi_lines
    folded = stored(O.fold(frame(spark, random_events(5, 50)), "v2"), "fold")
    for lines, most in ((json_entries(endpoint_map_rows(O.catalog_of(folded, "v1"))), 5), (C.client_spec(O.catalog_of(folded, "v2")), 2),
                        (openapi_lines(O.openapi_requests_of(folded), O.openapi_responses_of(folded), "T"), 6)):
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most and plan.count("FileScan") == plan.count("siftlane/fold-") and "LocalTableScan" not in plan and "Python" not in plan.replace("ArrowEvalPython", "")


def test_no_events(spark):
    none = frame(spark, [])
    base = O.fold(none, "v2")
    assert base.count() == 0 and O.extend(stored(base), none).count() == 0
    some = stored(O.fold(frame(spark, random_events(1, 40)), "v2"))
    assert rows_of(O.catalog_of(O.extend(some, none))) == rows_of(O.catalog_of(some))
