"""Every training-data query and the pipeline run on whole small tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from panelforge.llm.queries import REGISTRY

from ..conftest import SF_SMOKE


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_gives_rows(spark, name):
    df = REGISTRY[name](spark, SF_SMOKE)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_pipeline_gives_gapless_sequences(spark):
    rows = corpus_pipeline.run(spark, SF_SMOKE).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert rows and max(ends.values()) <= 4096
