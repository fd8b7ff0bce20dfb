import random
import sys
from hashlib import sha256

import numpy as np
import pytest

from maskwright.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def lib():
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def same(lib, texts):
    c = bpe.codec(bpe.vocabulary())
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = c.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text
        assert c.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_words(lib):
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "aé日σΣßİ", "01'!?.<|>", "ab 's't've\n"]
    same(lib, ["".join(rng.choice(a) for _ in range(rng.randint(0, 30))) for a in alphabets for _ in range(1500)])
    same(lib, ["a" * n for n in (1, 7, 300, 3001)] + ["the quick brown fox's", "", " \x1c\x1d\x85\xa0　x", "x<|endoftext|><|startoftext|>É <|EndOfText|>"])


def test_every_character(lib):
    some = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 37 == 0)]
    texts = ["".join(some[i : i + 1]) + "x" + c + "y 7" for i, c in enumerate(some)]
    c = bpe.codec(bpe.vocabulary())
    wrong = [t for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(c.encode(t), "<u4").tolist() != e.ids]
    assert not [hex(ord(t[0])) for t in wrong]


def merged(word, merges):
    """The tokens of a word by the definition: each merge in turn, from the left."""
    out = list(word)
    for u, v in merges:
        i, new = 0, []
        while i < len(out):
            both = out[i : i + 2] == [u, v]
            new.append(u + v if both else out[i])
            i += 1 + both
        out = new
    return out


def test_arcs_allow_one_sequence_for_each_word():
    """Small vocabularies: of all ways to cut a word into tokens, the table allows just the one that the merges make."""
    rng = random.Random(9)
    for _ in range(60):
        letters = "abc"[: rng.randint(1, 3)]
        tokens, merges = list(letters), []
        for _ in range(rng.randint(0, 12)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and merged(u + v, merges) == [u, v]:  # one that can apply, as in a trained vocabulary
                merges.append((u, v))
                tokens.append(u + v)
        vocab = {t: n for n, t in enumerate(tokens)}
        made = bpe.Automaton(vocab, [f"{u} {v}" for u, v in merges], "</w>")
        for word in ("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(40)):
            want = merged(word, merges)
            pairs = list(zip(want, want[1:]))
            assert all(made.has_arc(vocab[a], vocab[b]) for a, b in pairs), (merges, word)
            # no other sequence of tokens for the word is all arcs
            def ways(rest, last):
                if not rest:
                    yield []
                for t in tokens:
                    if rest.startswith(t) and (last is None or made.has_arc(vocab[last], vocab[t])):
                        yield from ([t, *more] for more in ways(rest[len(t) :], t))
            assert list(ways(word, None)) == [want], (merges, word)


def test_frames(spark, lib):
    path = bpe.vocabulary()
    rows = [(1, "Hello  World"), (None, None), (2, ""), (2, ""), (3, "lorem " * 5000)]
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, ids int")
    enc = bpe.encode(df, path)
    back = bpe.decode(enc, path)
    want = sorted(((i, lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == want
    got = sorted(((r.doc_id, r.decoded_sha256) for r in bpe.digests(df, path).collect()), key=str)
    assert got == sorted(((i, sha256(t.encode()).hexdigest()) for i, t in want), key=str)
    assert bpe.digests(df.limit(0), path).count() == 0
