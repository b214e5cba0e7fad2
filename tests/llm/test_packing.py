import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as E
from tests.conftest import SF_CHECK
from webweft.llm import packing as P
from webweft.llm import pieces

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))


def true_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, size=P.SEQUENCE):
    """Every id lies in one piece, and every sequence is gapless and fits."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert docs.keys() == texts.keys()
    for d, own in docs.items():
        ids = true_ids(texts[d])
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = np.array(ids[r.start:r.start + r.length], dtype="<u4")
            assert r.start == at and r.length == len(part) > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    used = [sum(r.length for r in own) for own in sequences.values()]
    padded = [u if u & (u - 1) == 0 else size for u in used]
    return 1 - sum(used) / sum(padded)


def test_query_packs_every_id_with_little_padding(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    out = E.queries()["op2_packing"](spark, SF_CHECK)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check(out.collect(), texts) < 0.01


ODD = ["", " \n", "It's we're don'T !'s ''d", "İstanbul ΣΑΣ ß ǅ", "a\x1cb\x1dc d\x85e\xa0f g", "é é ñ",
       "1234 ½ ² x_y __ !!!???", "<|endoftext|> a<|startoftext|>b", "end <|endoftext|> next", "<|startoftext|>", "x<|EndOfText|>y <|ENDOFTEXT|>" + "z" * 60,
       "<|endoftext|>" * 50 + " It's", "日本語 テスト 👩‍👩‍👧 🏳️‍🌈", "x" * 5000, "ab " * 3000,
       "%%% ***word### |", "\x00\x07 \x7f", "naïve façade œuvre ŉ ſ"]


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text):
    assert [*P.word_ids(None).batch_ids([text, "a b", text])[2].tolist(), 1] == true_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), st.sampled_from("  \n'stdl.,%_é")), max_size=60))
def test_ids_equal_the_library_on_any_text(text):
    assert [*P.word_ids(None).batch_ids([text, "a b", text])[2].tolist(), 1] == true_ids(text)


def test_chunks_and_forgetting_change_nothing(monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 40)
    monkeypatch.setattr(pieces, "KEPT", 30)
    own = P.WordIds(public_tokenizers.path(P.VOCABULARY))
    plain = " ".join(f"word{i % 97} it's {i}" for i in range(500)) + "\nend"
    odd = plain.replace("it", "日本")
    for _ in range(2):
        assert [[*x.tolist(), 1] for x in own.batch_ids([plain, odd, ""])] == [true_ids(t) for t in (plain, odd, "")]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=20))
def test_plan_places_every_piece_once(histogram):
    found = P.patterns(histogram, 64)
    placed = Counter()
    for packs, content in found:
        assert sum(n * c for n, c in content) <= 64
        for length, copies in content:
            placed[length] += packs * copies
    assert placed == histogram
    assert len(found) <= 3 * len(histogram)
    for length in histogram:
        ranges = sorted((s.low, s.high) for s in P.slots(found) if s.length == length)
        assert [a for a, _ in ranges] == [0, *[b for _, b in ranges[:-1]]] and ranges[-1][1] == histogram[length]


def test_shortest_pack_takes_the_next_piece():
    assert sorted(P.patterns({7: 2, 3: 1, 2: 3}, 10)) == sorted([(1, [(7, 1), (3, 1)]), (1, [(7, 1), (2, 1)]), (1, [(2, 2)])])


def test_lengths_that_pack_badly_are_cut_shorter():
    cut, found = P.plan({1300: 5000})
    assert cut < 1300 and P.padding(found) <= 0.01
    assert P.plan({2048: 10, 1024: 4})[0] == 2048


def test_hot_length_ties_nulls_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 10)
    rows = [(i, "same text here", "x") for i in range(300)] + [(1000, None, "y"), (1001, "", "z"), (1002, "w " * 9000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    assert check(P.pack(docs).collect(), {d: t for d, t, _ in rows}) < 0.3
    odd = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    out = P.pack(odd).collect()
    assert sorted(str(r.doc_id) for r in out) == ["5", "5", "None"] and len({(r.sequence_id, r.offset) for r in out}) == 3


def test_empty_table_and_kept_ids(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert P.pack(docs.limit(0)).collect() == []
    r = P.pack(docs, payload=lambda p: p).first()
    assert np.frombuffer(r.ids, "<u4").tolist() == true_ids("some words")
