import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.llm import counts, tokens
from tests.llm.common import awkward, documents

PATH = tokens.vocabulary("byte_bpe_50k.json")
TK = tokens.tokenizer(PATH)
COUNTER = counts.PrefixCounter(PATH)
PIECES = st.sampled_from(["the", "thing", "ation", "Über", "don't", "I'll", "we've", "'", "'r", "<|endoftext|>", "<|endof", "  ", "\n", "\t", " ", " ", " ", " ", "\x1c", "\u00a0", "\u2003", "\u2028", "\u0085", "\u0301", "\u00b2\u00bd", "\u3000", "x" * 9, "42", "3.14", "日本語", "été", "!!", "...", "🙂"]).filter(bool)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_every_prefix(text):
    assert COUNTER(text) == [len(TK.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def test_documents(spark):
    texts = [(i, (" the Ünder don't 42!  x\n" * (i * 7))[: i * 31]) for i in range(40)] + [(41, "a<|endoftext|>b <|endoftext|> c"), (42, "mot  mot  　 x")]
    docs = documents(spark, texts)
    for r in counts.prefix_table(docs, PATH).withColumn("fit", counts.longest_prefix("prefix_tokens", 20)).withColumn("ten", counts.tokens_of_prefix("prefix_tokens", F.lit(10))).collect():
        want = [len(TK.encode(r.text[: i + 1], add_special_tokens=False).ids) for i in range(len(r.text))]
        assert r.prefix_tokens == want
        assert r.fit == max([i + 1 for i, n in enumerate(want) if n <= 20], default=0) and r.ten == ([0, *want][min(10, len(want))])
    for r in counts.annotate(docs, PATH, 20).collect():
        want = [len(TK.encode(r.text[: i + 1], add_special_tokens=False).ids) for i in range(len(r.text))]
        assert r.tokens.n_tokens == (want or [0])[-1] and r.tokens.fit_chars == max([i + 1 for i, n in enumerate(want) if n <= 20], default=0)
        assert r.tokens.n_bytes == len(r.text.encode()) and r.tokens.over_limit == (r.tokens.n_tokens > 20)


@pytest.mark.parametrize("n", [100, 0])
def test_awkward_and_empty(spark, n):
    docs = awkward(spark).withColumn("tokens", F.lit(0)).limit(n)
    out = counts.annotate(docs, PATH)
    assert out.columns[:-1] == docs.columns
    for r in out.collect():
        assert r.tokens_.n_tokens == len(TK.encode(r.text or "", add_special_tokens=False).ids)
