"""Ends of sentences against the protected runs of long texts."""

import time

from ctxloom.operators import segment_tables as G


def test_ends_in_many_protected_runs_are_found_by_search():
    """Whether an end lies inside a run does not take a look at each run of the text."""
    text = "MAX_VAL is v1.2.3. See 2024-01-02. " * 4000 + "End"
    own, tokens, safe = G._parts(text)
    assert len(own) == len(tokens) == len(safe) == 8001 and safe.all()
    at = time.process_time()
    G._parts(text)
    assert time.process_time() - at < 3
