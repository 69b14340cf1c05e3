import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readtrail.llm import token_files as tf
from tests.llm.conftest import ODD_ROWS

MODEL = public_tokenizers.path("word_bpe_49k.json")
library = Tokenizer.from_file(MODEL)
coder = tf.WordCoder(MODEL)


def ids_of(text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x1c\x85 a'sTheΣéé.,!1<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encodes_like_the_library(text):
    assert coder.encode(text).tolist() == ids_of(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=80), max_size=12))
def test_files_round_trip_and_read_at_random(docs):
    tf.LEAST_COUNT, before = 2, tf.LEAST_COUNT
    try:
        names = [None if i % 5 == 4 else i * 3 for i in range(len(docs))]
        file = tf.TokenFile(tf.write_file(names, [np.array(d, np.uint32) for d in docs], 7))
    finally:
        tf.LEAST_COUNT = before
    assert file.doc_ids == names
    assert [d.tolist() for d in file.documents()] == docs
    assert [file.document(k).tolist() for k in range(len(docs))] == docs


def test_repeated_pairs_are_replaced():
    ids = np.tile(np.arange(10, dtype=np.uint32), 1000)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    seq, _, rules, rounds = tf.compress(ids, last, 10)
    assert len(seq) < len(ids) / 8 and sum(map(len, rules)) >= 5 and rounds[0] == 10
    file = tf.TokenFile(tf.write_file([1], [ids], 10))
    for rule, (a, b) in enumerate(zip(file.left, file.right)):  # expansion lengths add up
        size = lambda s: 1 if s < file.base else int(file.length[s - file.base])
        assert file.length[rule] == size(a) + size(b)


def test_odd_documents(spark, odd, tmp_path):
    path = str(tmp_path / "files")
    tf.write_token_files(odd.selectExpr("*", "1 AS part", "2 AS file"), path, MODEL)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tf.read_token_files(spark, path).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted((d is not None, d or 0) for d, _ in ODD_ROWS)
    start, want = 0, []
    for _, _, s, n, _ in got:
        assert s == start
        start += n
    for doc, text in ODD_ROWS:
        ids = ids_of(text or "") + [1]
        want.append((doc is not None, doc or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((a, b, n, c) for a, b, _, n, c in got) == sorted(want)


def test_empty_table(spark, odd, tmp_path):
    path = str(tmp_path / "none")
    tf.write_token_files(odd.where("false"), path, MODEL)
    assert tf.read_token_files(spark, path).collect() == []


def test_a_word_is_held_once_whatever_its_case_and_marks():
    own = tf.WordCoder(MODEL)
    text = "stones Stones, stones, stones"
    assert own.encode(text).tolist() == ids_of(text)
    assert sum(len(m) for m in vars(own).values() if isinstance(m, tf.Memo)) == 4  # the word, two with marks or capitals, a comma
