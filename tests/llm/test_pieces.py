import hashlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from readtrail.llm import pieces
from tests.llm.conftest import ODD_ROWS

MODEL = public_tokenizers.path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
coder = pieces.tokenizer(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabtheing.,!%é中\0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encodes_and_decodes_like_the_library(text):
    ids = library.encode(text)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 258), st.integers(0, 31_999)), max_size=8))
def test_decodes_any_ids_like_the_library(ids):
    assert coder.decode(ids) == library.decode(ids)


def test_long_runs_step_back_once_per_position():
    for text in ("a" * 20_000, "ab" * 10_000, "=" * 5_000 + "-" * 5_000):
        assert coder.encode(text) == library.encode(text)


def test_split_is_the_merge_definition():
    for word in ("▁thessatorening", "▁Übereinstimmung", "▁▁▁▁x", "▁interestingly,"):
        assert coder.split(word) == coder.merged(word)


def test_odd_documents(odd):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoding_digests(odd, MODEL).collect())
    want = []
    for doc, text in ODD_ROWS:
        ids = library.encode(text or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((str(doc), len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert got == sorted(want)


def test_tables_round_trip_and_clashing_columns(odd):
    clash = odd.selectExpr("*", "1 AS ids", "2 AS decoded")
    encoded = pieces.encode_documents(clash, MODEL, tuple(clash.columns))
    assert encoded.columns.count("ids") == 1 and encoded.columns.count("decoded") == 1
    back = pieces.decode_documents(encoded.select("doc_id", "ids"), MODEL)
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.selectExpr("doc_id", "replace(coalesce(text, ''), '▁', ' ') AS text").collect()))


def test_ids_wait_for_their_batch_in_four_bytes_each():
    for ids in ([], [7], list(range(32_000))):
        held, _ = pieces._ids_and_text(",".join(map(str, ids)), "")
        assert held.tolist() == ids and held.nbytes == 4 * len(ids)


def test_empty_table(odd):
    assert pieces.encoding_digests(odd.where("false"), MODEL).collect() == []


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    own, seen = pieces.PieceTokenizer(MODEL), []

    class Matcher:
        def iter(self, text):
            seen.append(text)
            return coder.matcher.iter(text)

    monkeypatch.setattr(own, "matcher", Matcher())
    text = "zorblatten zorblatten, zorblatten. zorblatten,"
    assert own.encode(text) == library.encode(text)
    assert [t for t in seen if "zorblatten" in t] == ["▁zorblatten"]
