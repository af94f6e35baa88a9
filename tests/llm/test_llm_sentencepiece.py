import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tracewarden.llm import queries, sentencepiece_bpe as P

MODEL = queries.model_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return P.Encoder(MODEL)


def same(coder, library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    packed, plain = coder.coded(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids, text[:80]
    assert plain == coder.decode(ids) == library.decode(ids), text[:80]


def test_random_texts(coder, library):
    rng = random.Random(5)
    signs = list("  \t\n\r\x00abcdefghijklmnopqrstuvwxyz012.,!?▁éüß世界日本😀𝒳​　<s>/unk")
    pieces = [p for p in coder.rank if len(p) > 1]
    for _ in range(3000):
        same(coder, library, "".join(rng.choice(signs) if rng.random() < 0.5 else rng.choice(pieces) for _ in range(rng.randint(0, 25))))


def test_backtracking_gives_what_merging_gives(coder):
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice("aeioutnrsh▁") for _ in range(rng.randint(1, 14)))
        assert coder.backtrack(text) == coder.merged(text)


def test_long_texts_without_spaces(coder, library):
    for text in ("abcdefgh" * 5000, "a" * 30_000, " " * 5000, "世界" * 5000, "▁x" * 3000):
        same(coder, library, text)


def test_decoding_any_ids(coder, library):
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids)


def test_rows(awkward, no_docs, library):
    want = []
    for d, t in ((r["doc_id"], r["text"] or "") for r in awkward.collect()):
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.digests(awkward, MODEL).collect()]
    assert sorted(got) == sorted(want)
    whole = P.encode(awkward, MODEL).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in whole) == sorted(w[:2] for w in want)
    assert P.digests(no_docs, MODEL).count() == 0 == P.encode(no_docs, MODEL).count()

