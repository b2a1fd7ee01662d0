"""What a stage of the pipeline leaves in a worker."""

import numpy as np
import pyarrow as pa

from tidemark.llm import common, suffix_dedup


def test_a_stage_lets_go_of_what_another_kept():
    common.stored(("of an earlier stage",), lambda: np.zeros(1 << 20))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array(["x" * 60, None])], names=["doc", "hash", "text"])

    class NoCopies:
        def find(self, docs, hashes):
            return np.full(len(docs), -1)

    got = list(suffix_dedup.chunks(iter([batch]), 50, NoCopies()))
    assert [x[0].tolist() for x in got] == [[1]]
    assert not common._store
