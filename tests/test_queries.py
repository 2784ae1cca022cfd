"""Named queries against their SQL; ALL_QUERIES=1 compares every one at the larger size."""

import os

import pytest
from tests.compare import connect, differences

from tidemark.plans import catalogue

QUICK = "returns_point_in_time returns_padded event_groups_transitive event_spacing_violations clock_alignment event_timing_sessions channel_scores scalar_functions event_dictionary_issues exposure_input_issues status_resolution exchange_by_suffix markdown_tables dated_references html_text discovery_score bootstrap_floor_curve design_limits first_publication".split()
FOLDER = "/root/testdata/sf0.01"
NAMES = sorted(catalogue.oracles()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, catalogue.queries()[name], catalogue.oracles()[name], FOLDER, con) == ""


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
