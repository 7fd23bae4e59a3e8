"""What a pass of suffix_dedup holds at once: two of them run beside the JVM in an executor."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from bulletria.llm import suffix_dedup as D
from bulletria.llm.common import scatter


def peak(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_passes_hold_little_at_once():
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 1_500))) for _ in range(1_000)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    assert peak(lambda: [None for _ in D._anchors(D.THRESHOLD, D.DIGIT, 7)(iter([batch] * 2))]) < 60
    rec = np.zeros(D.RECORDS_A_TASK, D._ANCHOR)
    rec["key"], rec["doc"] = rng.integers(0, 2**62, len(rec)), np.arange(len(rec)) % 90_000
    sent = scatter(D.SCATTER, np.zeros(len(rec), np.int32), rec)
    assert peak(lambda: D._first_pass(7)(pa.Table.from_batches([sent]))) < 90
