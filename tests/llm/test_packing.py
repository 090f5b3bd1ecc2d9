import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import packing, tokens
from tests.llm.common import awkward, documents

PATH = tokens.vocabulary("byte_bpe_50k.json")


def test_tightest_window():
    rng = random.Random(2)
    packer, room = packing.Packer(50), []
    for _ in range(40):
        lengths = np.array([rng.randrange(1, 50) for _ in range(20)])
        sequence, offset = packer.pack(lengths)
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[i]]
            if not fits:
                room.append(50)
                fits = [50]
            k = 50 - offset[i]
            assert k == min(fits)
            room[room.index(k)] = k - lengths[i]


def test_closed_windows():
    room = packing.Room(50)
    for k in range(1, 41):
        room.add(k, 100 + k)
    room.close(15)
    assert room.count[1] == 15 and room.take(1) == (26, 126) and room.take(40) == (40, 140) and room.take(41) is None


def check(spark, docs):
    """Every id in one piece, pieces gapless, digests right; gives padding and all tokens."""
    tk = tokens.tokenizer(PATH)
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    ids = [[*tk.encode(t, add_special_tokens=False).ids, 1] for _, _, t in texts]
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_doc[r.doc_id, r.doc_tokens, r.start].append(tuple(r.ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for (none, i, _), x in zip(texts, ids, strict=True):
        for a in range(0, len(x), 2048):
            want[None if none else i, len(x), a].append(tuple(x[a : a + 2048]))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return 1 - sum(map(len, ids)) / (2048 * len(by_sequence))


def test_pieces(spark):
    rng = random.Random(1)
    words = ["the", "Über", "don't", "<|endoftext|>", "  ", "\n", " ", "x" * 40, "42", "日本", "  a"]
    texts = [(i, "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(900)))) for i in range(60)]
    assert check(spark, documents(spark, texts)) < 0.1


@pytest.mark.parametrize("n", [100, 0])
def test_awkward_and_empty(spark, n):
    docs = awkward(spark).limit(n)
    if n:
        check(spark, docs)
    else:
        assert packing.pack(docs, PATH).count() == 0
