import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docketry.llm import token_counts
from docketry.llm.queries import tokenizer_path

MODEL = tokenizer_path()
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library(docs, odd, none):
    for frame in (docs, odd):
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(SP.encode(r["text"] or ""))) for r in frame.collect())
        got = token_counts.token_counts(frame, MODEL, piece_bytes=300, batch_bytes=2000).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts.token_counts(none, MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é日\n\t  ▁.</s>"), max_size=80))
def test_cuts_are_safe(text):
    parts = token_counts.split_safely(text, 3)
    assert " ".join(parts) == text
    assert sum(len(SP.encode(p)) for p in parts) == len(SP.encode(text))


def test_other_library(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    some = docs.limit(20)
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) for r in some.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(some, path).collect()} == want
