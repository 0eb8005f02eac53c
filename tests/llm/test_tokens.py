import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordloom.llm import bpe_codec, token_count

COUNT, CODEC = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["'re", "'s", " ", "  ", "\n", "a", "B", "é", "É", "ΑΣ", "1", "²", "!", "?!", "İ", "Ⱥ", "日", "本", "é", "<|endoftext|>", "<|startoftext|>", "Ᲊ", "𐵐", "x" * 50, "!" * 40, "'", "l", "\x1c"]
ODD = ["", "<|endoftext|>", "x" * 20000, "'" * 9000, " " * 9000 + "a", "ab " * 9000, " ".join(map(chr, range(1, 0xD000)))]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 900))) for _ in range(300)]
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return ODD + made + real + real[:20]


def test_counts_are_the_librarys(texts):
    counter = token_count.WholeTokenCounter(COUNT)
    assert len(counter.whole) > 49000
    library = Tokenizer.from_file(COUNT)
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [counter.count(t) for t in texts] == expected


def test_ids_and_decoded_text_are_the_librarys(texts):
    codec, library = bpe_codec.ChunkCodec(CODEC), Tokenizer.from_file(CODEC)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        coded = codec.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids
        assert codec.decode(coded) == library.decode(ids, skip_special_tokens=False)


def test_equal_passages_share_chunks(texts):
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    one, two = (
        {t[a:b] for a, b in zip([0, *bpe_codec.boundaries(t)], bpe_codec.boundaries(t))} for t in ("some words " * 30 + passage, "quite other words, and more " * 20 + passage)
    )
    assert len(one & two) > 0.7 * len(one)


def test_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 9, "x"), (2, None, 9, "x"), (2, "", None, None), (None, "a b", 1, "x")], "doc_id long, text string, n_tokens long, ids string")
    assert [r["n_tokens"] for r in token_count.token_counts(rows, COUNT).collect()] == [2, 0, 0, 2]
    coded = bpe_codec.round_trip(rows, CODEC).collect()
    assert [len(r["ids"]) // 4 for r in coded] == [2, 0, 0, 2] and coded[1]["decoded"] == "" and coded[0]["n_tokens"] == 9
    assert bpe_codec.decode(bpe_codec.encode(rows, CODEC), CODEC).first()["decoded"] == coded[0]["decoded"]
    assert token_count.token_counts(rows.limit(0), COUNT).count() == 0 == bpe_codec.encode(rows.limit(0), CODEC).count()
