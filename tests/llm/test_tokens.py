import base64
import hashlib
import random
from sys import getsizeof

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from evidloom.llm import bpe_codec
from evidloom.llm.bpe_codec import encode_documents
from evidloom.llm.common import table
from evidloom.llm.token_counts import count_tokens
from tokenizers import Tokenizer

ODD = [None, "", " ", "  ", "a  b", "a   b", "x \n y", "\n\n a\n", "don't we'll I'VE 12 345", "<|endoftext|>", "end <|endoftext|> of<|endoftext|>", "a\x1cb\x85c　 d\xa0e", "日本語 テキスト", "🙂🙂 👩‍👩‍👧", "\x00\x01 \t x", "ends in space ", " starts", "a" * 5000, "!?" * 700, "tab\tand\r\nreturn   x", "Ġ ▁ ▁▁a", "é́ ñ ß ſ"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(ODD)] + [(None, "null id", "x", 0), (3, "same id", "x", 0), (3, "same id", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, pretoken string, freq long"), rows


def test_codec_equals_tiktoken(spark, sf_dir, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    for df, rows in ((odd[0], odd[1]), (table(spark, sf_dir, "documents"), whole)):
        want = []
        for d, text, *_ in rows:
            ids = t.encode_ordinary(text or "")
            want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), tuple(ids)))
        got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in encode_documents(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("head", [1 << 18, 7, 0])
def test_counts_equal_tokenizers(spark, sf_dir, odd, head):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    for df, rows in ((odd[0], odd[1]), (table(spark, sf_dir, "documents"), whole)):
        want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x, *_ in rows]
        assert sorted(map(tuple, count_tokens(df, head=head).collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(empty).collect() == [] and encode_documents(empty).collect() == []


def test_long_and_hot_pretokens(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rule, huge = "=" * 300, "x" * 1_000_000
    rows = [(i, f"{rule} word{i} \x01{rule} " + huge * (i in (3, 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((d, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for d, x in rows)
    for head in (4, 1 << 18):
        assert sorted(map(tuple, count_tokens(df, head=head).collect())) == want


def test_long_texts_and_many_long_chunks(monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    codec = bpe_codec.Codec(bpe_codec.sentencepiece_model(bpe_codec.read_ranks(P.path("byte_bpe_50k.tiktoken"))), P.PATTERN)
    monkeypatch.setattr(bpe_codec, "KNOWN_BYTES", 1 << 20)
    chunk = lambda n: "".join(rng.choices("abcdé1,.", k=n))
    texts = [" ".join(chunk(rng.randrange(1, 9)) for _ in range(60_000)), "  ".join(chunk(4) for _ in range(60_000)), "", " ", chunk(20_000)]
    texts += [" ".join(chunk(3_000) for _ in range(20)) for _ in range(40)]
    most = 0
    for lo in range(0, len(texts), 4):
        for text, ids in zip(texts[lo : lo + 4], codec.encode(texts[lo : lo + 4]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text)
            assert codec.decoded_sha256(ids) == hashlib.sha256(text.encode()).hexdigest()
        most = max(most, codec.held)
    held = sum(getsizeof(k) + getsizeof(v) for k, v in codec.known.items())
    assert held <= codec.held and most < 3 << 20
