"""Token counts and byte-level BPE equal the public libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from ledgerflow.llm.byte_bpe import ByteBpe, PerfectHash, decode, encode
from ledgerflow.llm.queries import QUERIES
from ledgerflow.llm.token_count import token_counts

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "\n", "\n\n a", "a  b   c", "<s> x </s> <unk> <|endoftext|>", "▁x ▁▁", "é漢🙂\x00\x1c\x85 z",
       "don't we'll I'M", "x" * 5000, "ab" * 3000 + "\n" + " " * 70 + "7", "tab\tend\r\n", "١٢٣ ٣", "of of of", "of of of"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    alphabet = "aeiounrst  \n\t'.,0189é漢🙂▁<>|_%"
    return ODD + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 200))) for _ in range(300)]


def frame(spark, texts):
    rows = [(i, t, i, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, id string")


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_sentencepiece(spark, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens)
           for r in token_counts(frame(spark, texts), P.path("piece_bpe_32k.model")).collect()}
    assert got == {i: (len((t or "").encode()), len(lib.encode(t or ""))) for i, t in enumerate(texts)}


def test_counts_equal_rank_file(spark, texts):
    lib = tik()
    got = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, texts), P.path("byte_bpe_50k.tiktoken")).collect()}
    assert got == {i: len(lib.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_encoding_round_trip(spark, texts):
    lib, ranks = tik(), P.path("byte_bpe_50k.tiktoken")
    rows = decode(encode(frame(spark, texts), ranks, P.PATTERN), ranks, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = texts[r.doc_id] or ""
        ids = lib.encode_ordinary(want)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r.decoded) == want.encode()


def test_one_pass_gives_what_two_give_also_for_long_texts_and_repeated_rows(spark):
    ranks, lib = P.path("byte_bpe_50k.tiktoken"), tik()
    long = "".join(random.Random(1).choices(["the ", "ünd ", "x", "\n", " 12", "zzkq "], k=2_500_000))
    df = frame(spark, ["the end", long, None]).unionAll(frame(spark, ["the end"]))
    once = encode(df, ranks, P.PATTERN, decoded=True)
    assert once.columns == ["doc_id", "ids", "decoded"]
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, decode(encode(df, ranks, P.PATTERN), ranks, P.PATTERN).collect())) and len(rows) == 4
    assert bytes(rows[2][2]) == long.encode()
    assert bytes(rows[2][1]) == b"".join(i.to_bytes(4, "little") for i in lib.encode_ordinary(long))


def test_perfect_hash_is_minimal_and_perfect():
    keys = [str(i).encode() for i in range(5000)]
    ph = PerfectHash(keys)
    assert [ph.position(k) for k in keys] == list(range(5000))
    assert 0 <= ph.position(b"no key") < 5000
    assert PerfectHash([b"one"]).position(b"one") == 0


def test_both_tiers_agree():
    vocab = ByteBpe(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    for raw in (b" the", b"ing", b" of"):
        assert vocab.merged(raw) == vocab.piece(raw)      # these entries are reached by merges too


def test_queries(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    enc = tik()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        n = len(lib.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    got = QUERIES["op4_byte_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    none = frame(spark, [])
    assert token_counts(none, P.path("piece_bpe_32k.model")).count() == 0
    assert encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
