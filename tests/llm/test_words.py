import random
import re

import numpy as np
import pyarrow as pa

from rasterlake.llm import words as W


def spans_of(texts, inside, **options):
    found = [[] for _ in texts]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})
    for rows, data, offsets in W.batches([batch], **options):
        starts, ends, owner = W.spans(data, offsets, inside)
        hashes = W.hash_spans(data, starts, ends)
        for a, b, r, h in zip(starts, ends, owner, hashes, strict=True):
            found[rows.column("i")[int(r)].as_py()].append((bytes(data[a:b]), int(h)))
    return found


def test_spans_equal_regular_expressions():
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choice("aB9 \t\n\x0b\x1f-_é中😀'`{") for _ in range(rng.randint(0, 60))) for _ in range(300))]
    for inside, pattern in ((W.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (W.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        for limit in (W.CHUNK_BYTES, 64):
            got = spans_of(texts, inside, limit=limit)
            assert [[w.decode() for w, _ in g] for g in got] == [re.findall(pattern, t or "") for t in texts]


def test_hashes_follow_lower_case_bytes_only():
    texts = ["The END the end", "x the", "y" * (W.CHUNK_BYTES + 5) + " the " + "Y" * (W.CHUNK_BYTES + 5)]
    flat = [w for own in spans_of(texts, W.NOT_SPACE) for w in own]
    by_word, by_hash = {}, {}
    for word, h in flat:
        assert by_word.setdefault(word.lower(), h) == h and by_hash.setdefault(h, word.lower()) == word.lower()


def test_grams_stay_within_rows():
    hashes, rows = np.arange(1, 8, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 2, 2])
    assert W.gram_hashes(hashes, rows, 2)[1].tolist() == [0, 1, 3, 5]
    assert len(W.gram_hashes(hashes, rows, 9)[0]) == 0
