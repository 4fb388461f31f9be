import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skarn.llm import tokens

SCHEMA = "doc_id bigint, text string, key string, ids string"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.compiled_automaton(tokens.DEFAULT))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.DEFAULT)
    t.encode_special_tokens = True
    return t


def ours(encoder, texts):
    out = []
    for i, j, ids, sizes in encoder.batches(texts):
        ends = np.cumsum(sizes)
        out += [ids[e - n : e].tolist() for e, n in zip(ends, sizes)]
    return out


ODD = ["", " ", "  ", "\n", "don't we'll I'VE 'tis ''s 's's 're'red\n's  's   'x' \t\t 'd '", "<|endoftext|> <|endoftext|>", "   a  ", "a" * 300, "x\x1cy\x85z w　v", "é😀‍ x²½Ⅷ  ", "aaaaaaa bbbbb ", "'", "x'", "ab 's", "'ll'", "́a", "漢字 かな", "'s", "a's", "x 'll y", "\r\n\r\n  z"]


def test_like_the_public_tokenizer(encoder, public):
    assert ours(encoder, ODD) == [x.ids for x in public.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n'stmdrevlaAzZ09.,-éß漢😀 　²")), st.characters(blacklist_categories=("Cs",)))), max_size=5))
def test_any_text(encoder, public, texts):
    assert ours(encoder, texts) == [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]


def test_long_text_in_parts(encoder, public, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 500)
    texts = [("word's and  more\n\n x " * 400), "y" * 3000, None, "", "short"]
    assert ours(encoder, texts) == [x.ids for x in public.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_round_trip_and_states(encoder):
    a = encoder.automaton
    text = "Größe 漢字 😀 naïve don't\n"
    ids = ours(encoder, [text])[0]
    assert a.decode(ids).decode() == text
    assert len(a.parent) <= a.now + 1


def test_column(spark):
    df = spark.createDataFrame([(1, "a b", "k", "i"), (2, None, "k", "i"), (3, "", "k", "i"), (1, "a b", "k", "i")], SCHEMA)
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_column(df, "doc_id", "text").collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0
    back = tokens.decode_column(tokens.encode_column(df, "doc_id", "text"), "ids", "t")
    assert {r.t for r in back.collect()} == {"a b", ""}
