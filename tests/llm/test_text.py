"""Word hashing, encoding and feature helpers against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from terrascope.llm.encode import encoder
from terrascope.llm.features import dense, mean_scores, sparse_rows
from terrascope.llm.textvec import Words, text_slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\u00a0", "\x1c", "\u2003", "a", "B", "'s", "'ll ", "9", "12", ".",
          "!!", "\u00e9", "\u00d7", "\u00f7", "\u00df", "\u65e5\u672c", "\U0001f600", "<|endoftext|>", "_", "\x00", "\u3000", "\x85",
          "x y", " z", "'", "a's", "'t", "\u2028", "\u0301", "\u0100"]


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def lowered(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def test_words_match_the_pattern():
    texts = random_texts(3000) + ["", "A b\x0bC"]
    seen = {}
    for a, b, data, offs in text_slices(pa.array(texts), limit=2000):
        w = Words(data, offs)
        for d in range(b - a):
            want = re.findall("[^\x20\x09-\x0d]+", lowered(texts[a + d]))
            got = w.hash[w.bound[d]:w.bound[d + 1]].tolist()
            assert len(got) == len(want)
            for word, h in zip(want, got):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles():
    texts = ["a b c d a b c d", "a b", "", "A B"]
    (_, _, data, offs), = text_slices(pa.array(texts))
    w = Words(data, offs)
    sizes = [len(w.shingles(d, 4)) for d in range(4)]
    assert sizes == [4, 1, 0, 1]
    assert w.shingles(1, 4).tolist() == w.shingles(3, 4).tolist()


def test_encoding_equals_the_tokenizer():
    tok = Tokenizer.from_file(PATH)
    texts = random_texts(20_000) + [None, "word " * 5000, "The quick, brown fox's.\nJumps!",
        "end<|endoftext|>next", "a.<|endoftext|>", "<|endoftext|>", "x <|endoftext|> y\n<|endoftext|><|endoftext|>z <|endoftext", "|>b"]
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = []
    for a, b, data, offs in text_slices(pa.array(texts), limit=5000):
        ids, bound = encoder(PATH).encode_slice(data, offs)
        got += [ids[bound[d]:bound[d + 1]].tolist() for d in range(b - a)]
    assert got == want


def test_encoder_table_is_bounded():
    from terrascope.llm.encode import Encoder
    small = Encoder(PATH, max_entries=50)
    for a, b, data, offs in text_slices(pa.array([f"w{i} x{i} y{i}" for i in range(200)]), limit=60):
        small.encode_slice(data, offs)
        assert len(small._hash) <= 50 + 20


def test_features_do_not_depend_on_slices():
    texts = ["", None, "one two two", "x" * 3000, "\u00e9a b"] * 50
    one = sparse_rows(pa.array(texts), 12, (2, 3))
    alone = [sparse_rows(pa.array([t], pa.string()), 12, (2, 3))[0] for t in texts]
    assert one == alone
    w = np.random.default_rng(0).normal(size=(1 << 12, 2)).astype(np.float32)
    assert np.allclose(mean_scores(pa.array(texts), w, 12, (2, 3)), dense(one, 12) @ w, atol=1e-4)
