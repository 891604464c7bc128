"""BPE encoding, token files: against the tokenizers library and by round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import bpe, queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "\n", "a ", "a\n", " a", "\na", "a  b", "a\n b", "a \nb", "a\n\nb ", "x\ty", "x \ty z\t", "\0a", "b\x01", "it's 'seen we'LL",
       "<|endoftext|>", "a<|endoftext|> b", "<|endoftext", "x" * 5000, "日本語 テキスト", "é  z", "😀 😀😀", "1234 5 67", "...'s 's", "a　\n"]


def encoded(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def many(texts):
    batch = pa.record_batch({"i": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    return [ids.tolist() for _, ids in bpe.encoded_rows([batch], PATH)]


def test_batch_encoding_matches_library():
    r = random.Random(3)
    alphabet = ["a", "b", "st", "the", "'s", " ", " ", " ", "\n", "\t", ".", "1", "é", "ß", "中", " ", " ", "😀", "<|endoftext|>"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(1500)]
    assert many(texts) == [encoded(t) for t in texts]
    assert [bpe.codec(PATH).decode(x) for x in many(texts)] == texts


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["abcdefghijklmnopqrstuvwxyz", "thean", "aé", "ab' st\n ", "01", " \n", ".'s", "中文a ", "中文字符的一是", "é'll", "!?'-", "0123456789", " \t", "ΩжאД", "a're've"]), st.integers(2, 300), st.integers(0, 10**6), st.integers(0, 10**6))
def test_joins_agree_with_the_whole(alphabet, size, cut, seed):
    r = random.Random(seed)
    text = "".join(r.choice(alphabet) for _ in range(size))
    cut %= size + 1
    c = bpe.codec(PATH)
    assert c.join(c.encode(text[:cut]), c.encode(text[cut:])).tolist() == encoded(text)


UNBROKEN = {"letters": "abcdefghijklmnopqrstuvwxyz", "capitals": "ABCdef", "chinese": "".join(map(chr, range(0x4E00, 0x5200))), "cyrillic": "абвгдежзийклмн",
            "digits": "0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "symbols": "!#$%&()*+-=", "blanks": " \t\n",
            "hex": "0123456789abcdef", "marked": "a!b?c'd"}


@pytest.mark.parametrize("kind", UNBROKEN)
def test_windows_stay_small(kind):
    r = random.Random(2)
    text = "".join(r.choices(UNBROKEN[kind], k=60_000))
    c = bpe.codec(PATH)
    for cut in (30_000, 41_234):
        left, right = c.encode(text[:cut]), c.encode(text[cut:])
        low, window, high = c.window(left, right)
        assert len(left) - low + high <= 260 and len(window) <= 260
        assert c.join(left, right).tolist() == encoded(text)


def test_an_encoding_that_shifts_as_a_whole():
    c = bpe.codec(PATH)
    for letter in "a-7é":
        text = letter * 20_000
        assert c.join(c.encode(text[:9_999]), c.encode(text[9_999:])).tolist() == encoded(text)


@pytest.mark.parametrize("segment", [5, 64])
def test_documents_by_the_tree(spark, segment):
    r = random.Random(5)
    texts = [None, *ODD, "".join(r.choice("abcdefgh") for _ in range(3000)), " ".join("".join(r.choice("thean.") for _ in range(r.randrange(9))) for _ in range(400))]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(5, texts[-1], "again"), (5, texts[-1], "again"), (None, texts[-2], "no id"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    out = bpe.encode_documents(docs, segment=segment, decode=True).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, bpe.decode_documents(bpe.encode_documents(docs, segment=segment)).collect()))
    assert sorted(map(repr, out)) == sorted(repr(type(out[0])(doc_id=i, ids=encoded(t or ""), decoded=t or "")) for i, t, _ in rows)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_registered_round_trip(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {(i, len(encoded(t)), sha(",".join(map(str, encoded(t)))), sha(t)) for i, t in docs.items()}
    assert {tuple(r) for r in queries.op4_bpe_round_trip(spark, FOLDER).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=400), st.booleans())
def test_words_round_trip(ids, zeros):
    ids = np.array([0] * 500 * zeros + ids, np.uint64)
    words, escapes = token_files.pack(ids)
    assert (token_files.unpack(words, escapes, len(ids)) == ids).all()
    assert len(words) <= 2 * len(ids)


def test_small_ids_share_words():
    assert len(token_files.pack(np.zeros(480, np.uint64))[0]) == 2
    assert len(token_files.pack(np.full(60, 1, np.uint64))[0]) == 1
    assert len(token_files.pack(np.full(8, 32767, np.uint64))[0]) == 2


def brute_files(rows):
    """Rows in ascending order of id, null first."""
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*encoded(text or ""), 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_of_odd_rows(spark, tmp_path):
    rows = [(None, "no id"), *((40 - k, t) for k, t in enumerate(ODD)), (-7, None), (77, "same"), (77, "same")]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id BIGINT, text STRING, block INT, part STRING")
    token_files.write_token_files(docs, f"file://{tmp_path}/a", block_ids=40)
    found = token_files.read_token_files(spark, f"file://{tmp_path}/a").selectExpr("*", "crc32(ids) AS c").drop("ids")
    out = token_files.with_starts(spark, f"file://{tmp_path}/a", found).orderBy("start")
    assert [tuple(r) for r in out.select("doc_id", "start", "n_tokens", "c").collect()] == brute_files(rows)
    token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/b")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_registered_files(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op8_token_files(spark, FOLDER).collect()) == sorted(brute_files(rows))
