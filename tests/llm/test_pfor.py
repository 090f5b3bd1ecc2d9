import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import pfor, tokens
from tests.llm.common import awkward

PATH = tokens.vocabulary("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60000), st.integers(0, 2**32 - 1), st.just(7)), max_size=1200))
def test_round_trip(ids):
    ids = np.array(ids, np.uint32)
    payload, table = pfor.pack_blocks(ids, 8)
    assert (pfor.unpack_blocks(payload, table, 8)[: len(ids)] == ids).all()
    for i in range(len(table)):  # any block by itself
        assert (pfor.unpack_blocks(payload, table[i : i + 1], 8)[: len(ids) - i * 256] == ids[i * 256 : (i + 1) * 256]).all()


@pytest.mark.parametrize("n", [100, 0])
def test_files(spark, tmp_path, n):
    docs = awkward(spark).limit(n)
    manifest = pfor.write(docs, PATH, f"file://{tmp_path}/ids", partitions=4)
    rows = pfor.read(manifest, with_ids=True).collect()
    tk = tokens.tokenizer(PATH)
    key = lambda i: -1 if i is None else i
    want = sorted((key(r.doc_id), [*tk.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    rows.sort(key=lambda r: r.start)
    assert [(key(r.doc_id), r.ids) for r in rows] == want
    assert [r.start for r in rows] == [sum(len(x) for _, x in want[:k]) for k in range(len(want))]
    assert all(r.n_tokens == len(r.ids) for r in rows)
