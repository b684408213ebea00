"""What a task holds while it looks at a batch of texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from corpusgraph.llm import blocks, mixing
from tests.llm.conftest import prose


def test_temporaries_stay_small_for_a_large_batch():
    rng = random.Random(2)
    texts = [prose(rng, n=400) for _ in range(400)] * 4
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})

    class Shared:
        value = np.zeros((len(mixing.DOMAINS), mixing.SLOTS + 1))

    blocks.powers(2)  # made once for a worker
    tracemalloc.start()
    (out,) = mixing._posteriors(Shared)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("n_tokens").to_pylist() == [len(t.split()) for t in texts]
    assert peak < 24 << 20
