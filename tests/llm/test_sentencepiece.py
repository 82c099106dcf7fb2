import hashlib
import random

import numpy as np
import pytest

spm = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from strandline.llm import sentencepiece_codec as S  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a  b ", "line\nbreak\ttab", "é😀 x▁y", "a\x00b", "１２ ﬁ", "word " * 3000, "ünïcödé" * 50]


def test_ids_spans_and_decoding_equal_the_library():
    c = S.codec(MODEL)
    for t in TEXTS:
        ids, spans = c.encode(t)
        assert ids.tolist() == c.library.encode(t, add_bos=True, add_eos=True)
        assert c.decode(ids.tolist()) == c.library.decode(ids.tolist())
        assert (spans[1:, 0] == spans[:-1, 1]).all() and spans[-1].tolist() == [len(t.encode())] * 2
        pieces = c.library.encode(t, return_type="proto").pieces
        if not any(ord(ch) > 127 for ch in t):
            assert [(p.begin, p.end) for p in pieces] == [tuple(s) for s in spans[1:-1].tolist()]


def test_character_map_normaliser_equals_the_library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
        s = pb.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
        own = S.Normaliser(S.CharacterMap(s.precompiled_charsmap), s.add_dummy_prefix, s.remove_extra_whitespaces, s.escape_whitespaces)
        rng = random.Random(1)
        for _ in range(1500):
            t = "".join(rng.choice("abÀ  ①ﬁé　ｶﾞ㌔\t\n가각ſ") for _ in range(rng.randint(0, 15)))
            want, offsets = lib.normalize(t, with_offsets=True)
            got, source = own(t)
            assert got.decode() == want
            at = np.cumsum([0] + [len(ch.encode()) for ch in want])
            assert [len(t[:o].encode()) for o in offsets] == source[at].tolist()


def test_query_form(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, ""), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    lib = spm.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    got = S.encode_digests(df, MODEL)
    assert sorted(map(repr, (tuple(r[:4]) for r in got.collect()))) == sorted(map(repr, want))
    assert all(r.tiled for r in got.collect())
    long = S.encode_texts(df, MODEL).collect()
    assert {len(r.ids) * 2 == len(r.spans) for r in long} == {True}
    assert S.encode_digests(df.where("false"), MODEL).collect() == []
