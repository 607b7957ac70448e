"""The ordered queries again, with chunks so small that every track spans many."""

import pytest

import __spark_entry__ as spark_entry
import tools_check
from cadenza.operators import joins, tracks
from cadenza.plans import folds, ordered

SF_DIR = "/root/testdata/sf0.001"
NAMES = """
monotone_reject monotone_sweep gap_interpolate overlap_trim gap_markers gap_markers_intro
proportional_layout prompt_window caption_order segment_interval_join nearest_onset snap_nearest
anchor_remap anchor_warp energy_flux onset_thin edit_ripple edit_roll edit_clamp caption_delete
caption_duplicate nudge_frames relyric suggestion_validate index_monotone_check repair_monotone
transcript_sanitize
""".split()


@pytest.fixture(autouse=True)
def tiny(monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 5)
    monkeypatch.setattr(folds, "FOLD_ROWS", 4)
    monkeypatch.setattr(joins, "CHUNK_US", 20_000_000)
    for operator in (tracks.overlap_trim, tracks.gap_markers, tracks.caption_order):
        at = operator.__code__.co_varnames.index("width_us") - operator.__code__.co_argcount
        defaults = list(operator.__defaults__)
        defaults[at] = 20_000_000
        monkeypatch.setattr(operator, "__defaults__", tuple(defaults))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = spark_entry.queries()[name](spark, SF_DIR).toPandas()
    want = tools_check.connect(SF_DIR).execute(spark_entry.oracle_sql()[name]).df()
    assert len(got) and tools_check.difference(got, want) == ""
