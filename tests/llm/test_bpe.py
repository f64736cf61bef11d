import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlens.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, PATTERN, most=50)
TOKENS = [b""] * (max(RANKS.values()) + 1)
for _token, _i in RANKS.items():
    TOKENS[_i] = _token


def ids(text):
    return np.frombuffer(ENCODER.encode(text), "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text).tolist() == OTHER.encode_ordinary(text)
    assert bpe.decode_text(ids(text), TOKENS, block=3) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "é", "ß", "日本", "1", "'s", "!", "😀", "x" * 20, "\t", "er", " ", " "]), max_size=30))
def test_blanks_and_mixtures(parts):
    text = "".join(parts)
    assert ids(text).tolist() == OTHER.encode_ordinary(text)


def test_forgetting_changes_nothing():
    small = bpe.Transducer(RANKS, most_states=5)
    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 20))).encode()
        assert np.frombuffer(small.encode(word), "<u4").tolist() == OTHER.encode_ordinary(word.decode())


def test_tokens_come_after_bounded_lookahead():
    machine = bpe.Transducer(RANKS)
    state, longest = machine.start, max(map(len, RANKS))
    for byte in b"abcdefghij" * 200:
        state, _ = machine.step(state, byte)
        assert len(state.pending) <= 2 * longest


def test_utf8_machine_on_faulty_bytes():
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice([65, 0xC3, 0xA9, 0xE6, 0x97, 0xA5, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        machine, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            step = rng.randint(1, 4)
            out += machine.feed(data[at : at + step])
            at += step
        assert out + machine.finish() == data.decode("utf-8", "replace")


def test_documents(spark, hard, hard_rows, empty):
    out = {r.doc_id: r for r in bpe.digests(hard, RANKS, PATTERN).collect()}
    assert len(out) == len(hard_rows)
    for i, text in hard_rows:
        want = np.array(OTHER.encode_ordinary(text or ""), "<u4").tobytes()
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(empty, RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encoded(hard, {b"a": 0}, PATTERN)


@pytest.mark.parametrize("pattern", [r" ?\p{L}{1,5}|[^\p{L}]", r"\p{L}+|\s+|[^\p{L}\s]", r".{1,7}|\n", r" ?[a-z]+[.,]?|[\s\S]"])
def test_other_patterns(pattern):
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    encoder = bpe.Encoder(RANKS, pattern)
    for text in ("the international information", " a  b\nc. The,end", "éß日本 x" * 5, "abé ab.,!?;:%*&$#", ""):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_an_idle_worker_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.05)
    ranks = {bytes([b]): b for b in range(256)}
    encoder = bpe._encoder(ranks, PATTERN)
    bpe._task_over()
    assert bpe._encoder(ranks, PATTERN) is encoder  # the next task came in time
    bpe._task_over()
    bpe._rest[-1].join(5)
    assert not bpe._made and bpe._encoder(ranks, PATTERN).encode("ab") == encoder.encode("ab")


def test_letters_are_remembered_for_other_marks(monkeypatch):
    """As many pieces as words are kept, so letters that come again with another mark are not encoded again."""
    encoder = bpe.Encoder(RANKS, PATTERN, most=40)
    words = ["w" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10] * 3 for k in range(36)]
    encoder.encode("x " + " ".join(words))
    asked = []
    encode = encoder.pieces.transducer.encode
    monkeypatch.setattr(encoder.pieces.transducer, "encode", lambda piece: asked.append(piece) or encode(piece))
    text = "x " + " ".join(w + "." for w in words)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == OTHER.encode_ordinary(text)
    assert asked == [b"."]


def test_tasks_do_not_name_the_vocabulary(monkeypatch):
    monkeypatch.setattr(bpe, "_name", lambda ranks: pytest.fail("a task found the digest again"))
    ranks = {bytes([b]): b for b in range(256)}
    assert bpe._encoder(ranks, PATTERN, "own") is bpe._encoder(ranks, PATTERN, "own")
    bpe._made.clear()
