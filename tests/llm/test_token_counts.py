import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("tiktoken")

from strandline.llm import token_counts as T  # noqa: E402
from strandline.llm.shared import fresh_path, open_uri  # noqa: E402


def write(spark, arrays):
    folder, uris = fresh_path(spark, "test"), []
    fs, path = open_uri(folder)
    fs.create_dir(path)
    for k, a in enumerate(arrays):
        with fs.open_output_stream(f"{path}/{k}.bin") as f:
            f.write(np.asarray(a, "<u2").tobytes())
        uris.append(f"{folder}/{k}.bin")
    return uris


@pytest.mark.parametrize("block", [1, 3, 4, 1000])
def test_documents_across_blocks(spark, block):
    arrays = [[5, 6, 0, 0, 7, 8, 9, 10, 11, 0], [1, 2], [], [0], [3] * 50 + [0, 4]]
    uris = write(spark, arrays)
    got = T.count_tokens(spark.createDataFrame([(u,) for u in uris] * 2, "path string"), 0, block_tokens=block).collect()
    want = []
    for u, a in zip(uris, arrays, strict=True):
        begin, k = 0, 0
        for i, x in enumerate(a):
            if x == 0:
                want.append((u, k, begin, i - begin, True))
                begin, k = i + 1, k + 1
        if begin < len(a):
            want.append((u, k, begin, len(a) - begin, False))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_counts_equal_the_tokenizer(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> é😀\n\n  x"), (5, "word " * 5000), (1, "hello world"), (None, "x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ordinal int").repartition(3)
    rank = P.path("byte_bpe_50k.tiktoken")
    enc = T.ranks_encoding(rank, P.PATTERN)
    got = T.token_counts(df, rank, P.PATTERN, 50256, block_tokens=64).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, len(enc.encode_ordinary(t or "")))) for i, t in rows)
    assert T.token_counts(df.where("false"), rank, P.PATTERN, 50256).collect() == []


def test_a_file_of_half_tokens_is_refused(spark):
    folder = fresh_path(spark, "test")
    fs, path = open_uri(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/x.bin") as f:
        f.write(b"abc")
    with pytest.raises(Exception, match="whole number"):
        T.count_tokens(spark.createDataFrame([(f"{folder}/x.bin",)], "path string"), 0).collect()
