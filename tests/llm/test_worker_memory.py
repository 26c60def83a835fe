"""What operators leave in the memory of Python workers."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cellwise.llm import packing, quality, simhash
from cellwise.llm.queries import tokenizer_path


def batch(texts, **columns):
    return pa.RecordBatch.from_pydict(columns | {"text": texts})


def stages(texts):
    """The stages of the pipeline that run Python, in order: each as a task of one worker process, on the texts."""
    ids, keys = list(range(len(texts))), [b"k"] * len(texts)
    model = quality.fit(np.zeros((2, len(quality.COUNTS) + quality.BUCKETS), dtype="float16"), np.zeros(2))
    yield list(quality._feature_batches([batch(texts, labelled=ids, y=ids)]))
    yield list(quality._logit_batches([batch(texts, id=ids, k=keys, host=ids, path=ids)], model))
    yield list(simhash._print_batches([batch(texts, id=ids, k=keys)], 5))
    yield list(simhash._set_batches([batch(texts, node=ids, component=ids)], 5))
    yield list(packing._pieces([pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts})], tokenizer_path(), 2048, 0))


@pytest.fixture
def memories():
    """How many entries each operator remembers; empty before and after."""
    found = {"quality": quality._BUCKET_OF, "simhash": simhash._WORDS, "packing": packing._ENCODERS}
    for m in found.values():
        m.clear()
    yield found
    for m in found.values():
        m.clear()


def test_one_operator_is_remembered_at_a_time(memories):
    """Workers serve all stages, so that their memories would add up on an executor."""
    texts = [" ".join(f"word{i}x{j}" for j in range(50)) for i in range(20)]
    held = [{k for k, m in memories.items() if m} for _ in stages(texts)]
    assert held == [{"quality"}, {"quality"}, {"simhash"}, {"simhash"}, {"packing"}]
    first = next(stages(texts))
    assert {k for k, m in memories.items() if m} == {"quality"} and first[0].num_rows == 20


def test_no_long_chunk_is_remembered(memories):
    """A text without white space is one chunk, as long as it likes."""
    encode = packing.encoder(tokenizer_path())
    texts = ["short words " + "x" * 100_000, "y" * 63 + " " + "z" * 64, "short words " + "x" * 100_000]
    assert encode.encode(texts) == [encode.whole(t) for t in texts]
    assert encode.known and max(map(len, encode.known)) < 64


def test_search_of_a_large_group_holds_few_pairs():
    """A node that holds a large group of near copies is searched a few MB of pairs at a time."""
    random, n = np.random.default_rng(0), 3000
    fps = np.repeat(random.integers(0, 2**63, (1, 3)).astype(np.uint64), n, axis=0)
    fps ^= np.packbits(random.random((n, 192)) < 0.14, axis=1).view(np.uint64)
    index = simhash.GrayIndex(fps, np.zeros(n, dtype=np.int64))
    tracemalloc.start()
    found = sum(len(x) for x, _ in index.links(53))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum((np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(axis=1, dtype=np.int64) <= 53).sum() for i in range(n - 1)) and most < 40e6
