import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "Hello world, it's 2024!", "a" * 5000, "x y  z\n\n\t q ", "日本語テキスト 😀", "déjà vu — l'été ½ ²", "\x00\x1c\x1f\x85\xa0", "ab" * 3000, "'s 'S 'll", "Ünïcödé'd " * 50]


@pytest.fixture(scope="module")
def both():
    tokens = bpe.load_ranks(PATH)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.Encoder(tokens, *bpe.PerfectHash.build(tokens), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(both):
    encoder, _ = both
    slots = [encoder.hash.slot(t) for t in encoder.tokens]
    assert sorted(slots) == list(range(len(encoder.tokens)))
    assert all(encoder.tokens[encoder.hash.slot_key[s]] == t for s, t in zip(slots, encoder.tokens, strict=True))


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200) | st.text(alphabet="ab' é\n12_²", max_size=60))
def test_equals_library(both, text):
    encoder, library = both
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_long_text_in_pieces(both, monkeypatch):
    encoder, library = both
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = "the quick brown fox, it's jumping  over\n\nlazy dogs " * 20
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_forgets_when_idle(both, monkeypatch):
    import time

    encoder, library = both
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.05)
    before = encoder.encode("some text to remember")
    encoder.rest()
    encoder.rest()
    time.sleep(0.5)
    assert not encoder and not encoder.older
    assert encoder.encode("some text to remember").tolist() == before.tolist()


def test_query_rows(spark, both):
    _, library = both
    df = spark.createDataFrame([(k, t, "other") for k, t in enumerate(TEXTS)] + [(0, "", "again")], "doc_id long, text string, ids string")
    rows = bpe.digest(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = library.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digest(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    kept = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert kept.columns == ["doc_id", "text", "ids", "decoded"]
