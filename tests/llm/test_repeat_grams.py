"""What op10 sends, and windows of other widths."""

import random

import numpy as np

from cellwise.llm.substring_dedup import remove_repeats, strips

from test_structure_operators import brute_repeats


def phrased(n, seed):
    """Texts of random letters with common phrases of 20 bytes between them."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    phrases = [letters(20) for _ in range(20)]
    return ["".join(letters(40) + rng.choice(phrases) for _ in range(20)) for _ in range(n)]


def test_common_phrases_send_no_strips():
    """Phrases too short to be removed bring no strips together, however often they stand in texts."""
    texts = [t.encode() for t in phrased(200, 1)]
    of, first, windows, value = strips(texts, 50)
    at = {}
    for t, v in zip(of.tolist(), value.tolist(), strict=True):
        at.setdefault(v, set()).add(t)
    assert not [v for v, own in at.items() if len(own) > 1]
    assert int(windows.sum()) == sum(len(t) - 49 for t in texts)
    assert np.all(first + windows + 49 <= np.array([len(t) for t in texts])[of])


def test_repeats_of_other_widths(spark):
    texts = [*enumerate(phrased(12, 2)), (12, None), (13, phrased(1, 2)[0][30:400])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for width in (16, 24, 47, 48):
        for per_task in (256, 8 << 20):
            assert sorted(map(tuple, remove_repeats(docs, width=width, bytes_per_task=per_task).collect()), key=repr) == brute_repeats(texts, width)
