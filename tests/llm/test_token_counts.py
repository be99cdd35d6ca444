import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import no_documents, odd_documents, odd_rows
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from starboard.llm.queries import tokenizer_file
from starboard.llm.token_counts import UnigramCounter, count_tokens, read_pieces

MODEL = tokenizer_file("piece_bpe_32k.model")
PIECES = read_pieces(MODEL)
BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]


def real(pieces):
    """The tokenizers library's own unigram model over the same pieces; byte pieces stand for unknown characters."""
    return Tokenizer(Unigram([("<unk>", 0.0), *BYTES, *pieces.items()], unk_id=0, byte_fallback=True))


def real_count(tokenizer, text):
    return len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids) if text else 0


def test_real_pieces_on_documents(spark):
    tokenizer, counter = real(PIECES), UnigramCounter(PIECES)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [r[1] for r in odd_rows() if r[1]] + ["a  b   c ", " x", "\n\n", "▁a ▁", "Straße 😀 ½"]
    for text in texts:
        assert counter.count(text)[0] == real_count(tokenizer, text)


TIES = {"▁": -2.0, "a": -2.0, "b": -2.0, "ab": -4.0, "ba": -4.0, "aba": -6.0, "▁a": -4.0, "bb": -3.0, "abab": -8.0, "▁▁": -4.0}


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab c"), max_size=14))
def test_ties_are_the_tokenizers(text):
    assert UnigramCounter(TIES).count(text)[0] == real_count(real(TIES), text)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(-6, 0).map(float), min_size=1), st.text(st.sampled_from("abcdé "), max_size=16))
def test_any_pieces(pieces, text):
    assert UnigramCounter(pieces).count(text)[0] == real_count(real(pieces), text)


def test_best_score_against_all_splits():
    dice = random.Random(0)
    counter = UnigramCounter(TIES)
    for _ in range(200):
        text = "".join(dice.choice("ab▁") for _ in range(10))
        best = [0.0]
        for end in range(1, len(text) + 1):
            ways = [best[s] + TIES[text[s:end]] for s in range(end) if text[s:end] in TIES]
            best.append(max(ways))
        assert counter.best(text)[0] == best[-1]


def test_a_piece_beyond_a_space_is_an_error():
    with pytest.raises(ValueError):
        UnigramCounter({"a▁b": 0.0})


def test_odd_and_no_documents(spark):
    tokenizer = real(PIECES)
    docs = odd_documents(spark).withColumnRenamed("Score", "N_TOKENS")
    found = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in count_tokens(docs, MODEL).collect())
    assert found == sorted((r[0] is None, r[0], real_count(tokenizer, r[1])) for r in odd_rows())
    assert count_tokens(no_documents(spark), MODEL).collect() == []
