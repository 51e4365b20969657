"""What the text kernels hold at once."""

import random
import tracemalloc

import pyarrow as pa

from cragline.llm import chosen_path, common


def test_kernels_hold_little_memory(monkeypatch):
    rng = random.Random(2)
    texts = pa.array([" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(2500)])  # 4 MB
    monkeypatch.setattr(common, "_powers", {})
    tracemalloc.start()
    factors = common.seeds(8, 11)
    for _, _, data, offsets in common.text_slices(texts):
        h, first = common.distinct_by_text(*common.Words(data, offsets).shingles())
        chosen_path.minhash(h, first, factors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20, peak
