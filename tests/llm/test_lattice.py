"""Language-model scores where no word occurs exactly once."""

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from llm import lattice


def test_every_row_twice(spark):
    rows = [(1, "the old stone bridge", False), (2, "the quick brown fox", False), (3, "a zebra on the bridge", True)] * 2
    got = lattice.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()
    assert len(got) == 6 and all(math.isfinite(r.score) for r in got)
