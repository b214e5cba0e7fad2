import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from webweft.llm import pieces
from webweft.llm import sentencepiece_codec as C

PATH = public_tokenizers.path(C.MODEL)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = C.Codec(PATH)
BY_SCORES = C.Codec(PATH, merges=False)
SCORES = {MODEL.id_to_piece(i): (MODEL.get_score(i), i) for i in range(3, MODEL.get_piece_size()) if not MODEL.is_byte(i)}
ODD = ["", " ", "  two  blanks ", "a", "naïve café", "日本語 👩‍👩‍👧", "line\nline\ttab", "x" * 300, "\x00\x07", "The cat's, hat!",
       "ab-cd_ef", "2². x", "ąćę ͏", " ".join(["word"] * 200), "...!!!,,,", "mixed日本text"]


def slow_encode(text):
    """Every piece at every position of the whole text, without automaton, words or cache."""
    if not text:
        return []
    t = "▁" + text.replace(" ", "▁")
    best = [(0.0, [])]
    for end in range(1, len(t) + 1):
        ends = [(best[end - k][0] + SCORES[t[end - k:end]][0], k, SCORES[t[end - k:end]][1])
                for k in range(1, min(16, end) + 1) if t[end - k:end] in SCORES]
        if ends:
            score, k, i = max(ends)
            best.append((score, best[end - k][1] + [i]))
        else:
            spelt = [MODEL.piece_to_id(f"<0x{b:02X}>") for b in t[end - 1].encode()]
            best.append((best[end - 1][0] + BY_SCORES.floor, best[end - 1][1] + spelt))
    return best[-1][1]


@pytest.mark.parametrize("text", ODD)
def test_scores_equal_plain_viterbi_and_merges_the_library(text):
    assert BY_SCORES.encode(text).tolist() == slow_encode(text)
    ids = CODEC.encode(text).tolist()
    assert ids == MODEL.encode(text)
    assert CODEC.decode(ids) == text == BY_SCORES.decode(slow_encode(text)) == MODEL.decode(ids)


ANY = st.text(st.one_of(st.characters(max_codepoint=0x24f), st.sampled_from("   etaoin.,'-\n日")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ANY)
def test_any_text(text):
    assert BY_SCORES.encode(text).tolist() == slow_encode(text)
    ids = CODEC.encode(text).tolist()
    assert ids == MODEL.encode(text) and CODEC.decode(ids) == text


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "PAIRS", 3)
    monkeypatch.setattr(pieces, "KEPT", 3)
    own = C.Codec(PATH)
    text = "one two three four \x01\x02 one five. six, one"
    assert own.encode(text).tolist() == own.encode(text).tolist() == MODEL.encode(text)


def test_query_decodes_to_the_documents(spark):
    out = E.queries()["op3_sentencepiece"](spark, SF_CHECK)
    rows = {r.doc_id: r for r in out.collect()}
    for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect():
        got = rows.pop(r.doc_id)
        assert got.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and got.n_ids == len(got.ids)
        assert got.ids == MODEL.encode(r.text)
    assert not rows


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "same", 7), (3, "same", 8), (None, "x " * 40000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = C.decode(C.encode(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out if r.text is not None) == sorted((str(d), t) for d, t, _ in rows[1:])
    null = next(r for r in out if r.doc_id == 1)
    assert null.ids is None and null.text is None and next(r for r in out if r.doc_id == 2).ids == []
    assert C.encode(docs.limit(0)).collect() == []
