import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(text, codec=None):
    return np.frombuffer(b"".join((codec or bpe.codec(PATH)).encode(text)), "<u4").tolist()


def same(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", " ", "\n", "'re", "'", "é", "日", "12", "  ", "<|endoftext|>", "=", "ing", "\x85", "　"]), max_size=40).map("".join))
def test_any_text(library, text):
    same(library, text)


@pytest.mark.parametrize("text", ["", " ", "a" * 70_000, " " * 66_000 + "x", "\n" * 140_000, "=-" * 40_000, ("x" * 65_531) + "'re 're", "日本語" * 23_000, "1" * 66_000 + " a", "<|endoftext|>" * 3, "<|endo"])
def test_long_pieces(library, text):
    for pad in ("", "z", "zz"):
        same(library, pad + text)


def test_small_chunks(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 32)
    monkeypatch.setattr(bpe, "LONG", 8)
    c = bpe.Codec(PATH)
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab '\n\tré1-=") * r.choice((1, 1, 1, 40)) for _ in range(r.randint(0, 40)))
        assert ids(text, c) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a few words, that's all", "x" * 3000, " " * 2500 + "y", "=" * 4000 + " z", "日本" * 700, "1\n" * 900, "<|endoftext|> <|endof" * 40, "ab " * 900 + "\t" * 900])
def test_parts_of_one_byte(library, text):
    """Parts of any size give the same tokens, and what is held stays within its bound whatever the length."""
    c = bpe.codec(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    bound = 4 * c.lookahead + bpe.LONG + bpe.LOOKAHEAD + c.special_reach + 8
    for size in (1, 7, 1000):
        e, out, most, data = bpe.Encoder(c), [], 0, text.encode()
        for at in range(0, len(data), size):
            out.append(e.push(data[at : at + size]))
            most = max(most, e.holds())
        out.append(e.push(b"", last=True))
        assert np.frombuffer(b"".join(out), "<u4").tolist() == want and most <= bound + size and e.holds() == 0


def test_every_token_comes_from_the_transducer(monkeypatch):
    c = bpe.Codec(PATH)
    made, push, end = [], bpe.Transducer.push, bpe.Transducer.end
    monkeypatch.setattr(bpe.Transducer, "push", lambda self, part: made.append(push(self, part)) or made[-1])
    monkeypatch.setattr(bpe.Transducer, "end", lambda self: made.append(end(self)) or made[-1])
    text = "every word here is another " + "=" * 3000
    assert b"".join(c.encode(text)) == b"".join(made)


def test_ids(odd):
    out = bpe.encode_digest(odd, PATH, with_ids=True).collect()
    assert all(r.n_tokens == len(r.ids) and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in out)


def test_lookahead_suffices():
    """On a random small merge list: a token that the lookahead follows is the same whatever comes after it."""
    r = random.Random(3)
    for _ in range(30):
        parts, merges = [b"a", b"b", b"c"], []
        for _ in range(12):
            m = (r.choice(parts), r.choice(parts))
            if m not in merges and m[0] + m[1] not in parts:
                merges.append(m)
                parts.append(m[0] + m[1])
        far = bpe.sufficient_lookahead(merges)

        def encode(data, merges=merges):
            t = [data[i : i + 1] for i in range(len(data))]
            for a, b in merges:
                i, out = 0, []
                while i < len(t):
                    if t[i : i + 2] == [a, b]:
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(t[i])
                        i += 1
                t = out
            return t

        for _ in range(60):
            head = bytes(r.choice(b"abc") for _ in range(r.randint(0, 40)))
            tail = bytes(r.choice(b"abc") for _ in range(r.randint(0, 12)))
            n, fixed = 0, []
            for t in encode(head):
                n += len(t)
                if n > len(head) - far:
                    break
                fixed.append(t)
            assert encode(head + tail)[: len(fixed)] == fixed


def test_decode(library):
    c, r = bpe.codec(PATH), random.Random(2)
    for _ in range(300):
        own = [r.randrange(50_257) for _ in range(30)]
        assert "".join(c.decode(c.pack(own[i : i + 4]) for i in range(0, 30, 4))) == library.decode(own, skip_special_tokens=False)


def test_odd(odd, none, library):
    want = []
    for r in odd.collect():
        e = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(e, skip_special_tokens=False)
        want.append((r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_digest(odd, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode_digest(none, PATH).count() == 0
