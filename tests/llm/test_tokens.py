import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lakespark.llm.tokens import Encoder, crc32, vocabulary_path

ODD = ["", " ", "  a", "a\n b", "a \n\nb", "x\t y", "foo<|endoftext|> bar", " a <|endoftext|>  ", "a\n\tb", "don't  stop", "a\nb\nc d\n", "\n", "İx İ. foo Σas. a!, b.. c..\nX\nY\n", "a \x1cb\x85c", "a\x00b c", "\x00 a", "1, 2. ½. x",
       "日本語。 你好. ٣٤ x", "ab\xa0\ncd e", "<|startoftext|> x<|endoftext|>. y", "<|STARTOFTEXT|> A", "Á b́. ́", "'s 't.foo. it's. o'reilly\nthe\r\nfoo", "İ, ı. x", "foo.\nBar, baz.\n\nqux. ", "a\x00. b", "\x00A", "x \x00A. y", "\x00 A"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def encoder(request):
    return Encoder(vocabulary_path(request.param), entries=400)


def same(encoder, texts):
    ids, counts = encoder.encode(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    want = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for k, w in enumerate(want):
        assert ids[at[k] : at[k + 1]].tolist() == w.ids, texts[k]


def test_odd_texts(encoder):
    for t in ODD:
        same(encoder, [t])
    same(encoder, [None, *ODD])


def test_documents(encoder, documents):
    same(encoder, [r.text for r in documents.collect()])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,!'|ab<>AZ09\x00é́İΣẞ中\xa0")), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_any_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        same(_shared(name), texts)


_kept = {}


def _shared(name):
    if name not in _kept:
        _kept[name] = Encoder(vocabulary_path(name), entries=2000)
    return _kept[name]


def test_blocks(encoder):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab. \n", k=rng.randint(0, 300))) for _ in range(50)]
    whole, counts = encoder.encode(texts)
    parts = list(encoder.encode_in_blocks(texts, characters=500))
    assert len(parts) > 5 and [p[:2] for p in parts][-1][1] == 50
    assert np.concatenate([p[2] for p in parts]).tolist() == whole.tolist() and np.concatenate([p[3] for p in parts]).tolist() == counts.tolist()
    assert crc32(np.array([1, 2], np.uint32)) == __import__("zlib").crc32(b"\x01\0\0\0\x02\0\0\0")


def test_other_tokenizers_are_encoded_whole(tmp_path, documents):
    """Chunks follow the cuts of known tokenizers only; any other gives the library's ids as well."""
    import json

    import public_tokenizers
    from lakespark.llm.tokens import Encoder
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        told = json.load(f)
    told["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    texts = [r.text for r in documents.limit(20).collect()] + [None, "", "a b", " a\n\nb "]
    ids, counts = Encoder(str(path)).encode(texts)
    want = [e.ids for e in Tokenizer.from_file(str(path)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
