"""Character offsets of tokens, against a walk through each text's bytes."""

import hashlib
import random

import numpy as np

from glyphshift.llm import bpe

from .conftest import ODD


def walked(codec, text):
    """Starts and ends, token by token: the characters that a token's bytes belong to."""
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    starts, ends, at = [], [], 0
    for token in codec.ids([text])[0]:
        size = len(codec.bytes_of[token])
        starts.append(owner[at])
        ends.append(owner[at + size - 1] + 1)
        at += size
    return starts, ends


def test_offsets_of_random_texts():
    rng = random.Random(9)
    codec = bpe.codec()
    texts = ["".join(rng.choice("  \n'abcstXY12.,éß中日😀ا́ 　") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert codec.offsets(texts) == [walked(codec, t) for t in texts]
    assert codec.offsets(["", "", "a"]) == [([], []), ([], []), ([0], [1])] and codec.offsets([]) == []


def test_the_query_returns_offsets_of_every_text(spark, odd):
    codec = bpe.codec()
    digest = lambda t: hashlib.sha256(b"".join(np.asarray(p, dtype="<i4").tobytes() for p in walked(codec, t))).hexdigest()
    got = sorted((str(r.doc_id), r.offsets_sha256) for r in bpe.round_trip_digests(odd).collect())
    assert got == sorted((str(i), digest(t or "")) for i, t in ODD)
    for r in bpe.encode(odd, decoded=True).collect():
        assert r.text in [t or "" for i, t in ODD if i == r.doc_id] and (r.starts, r.ends) == walked(codec, r.text)
