import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayscope.llm import bitplane as b
from stayscope.llm.splitting import ChunkedEncoder, Recent, splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tools():
    with open(PATH, encoding="utf-8") as f:
        definition = f.read()
    return b.tokenizer_encoder(definition, public_tokenizers.PATTERN), Tokenizer.from_str(definition)


def test_encoder_equals_the_library(tools):
    encode, own = tools[0](), tools[1]
    rng = random.Random(4)
    blanks = [" ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "'s", "'", "1", "²", "é", "́", "_", "<|endoftext|>"]
    texts = ["".join(rng.choice(blanks) for _ in range(rng.randrange(30))) for _ in range(500)]
    every = b.every_character()
    texts += ["a".join(every[at : at + 5000]) for at in range(0, len(every), 5000)]
    for text, packed in zip(texts, encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("by", ["bit", "byte"])
def test_file_round_trip(by):
    rng = random.Random(1)
    documents = [[rng.choice([0, 1, 50_256, 2**32 - 1]) for _ in range(n)] for n in (0, 1, 7, 100, 0, 33, 256)]
    stream = io.BytesIO()
    out = b.PlaneWriter(stream, by, block_ids=16)
    for ids in documents:
        out.add(np.array(ids, "<u4").tobytes())
    table = pa.table({"key": pa.array(range(7)), "n": pa.array([len(d) for d in documents], pa.int64())})
    assert out.close(table) == len(stream.getvalue())
    reader = b.PlaneReader(pa.BufferReader(stream.getvalue()))
    assert [np.frombuffer(x, "<u4").tolist() for x in reader] == documents
    # The index finds a block without reading those before it.
    flat = [i for d in documents for i in d]
    assert reader.block(3).tolist() == flat[48:64] and len(reader.chunks) == -(-len(flat) // 16)
    with pytest.raises(ValueError):
        b.PlaneReader(pa.BufferReader(b"x" * 64))


def test_table(tools, texts, odd):
    encoder, own = tools
    rows = odd + [(i, f"text of {i}, " * (i % 9)) for i in range(10, 300)]
    df = texts(rows)
    files = b.write_ids(df.repartition(5), encoder, end_id=2, ids_per_file=500)
    assert files.count() > 3 and files.agg(F.sum("n_documents")).first()[0] == len(rows)
    got = b.read_ids(files, df.schema["doc_id"]).orderBy("start").collect()
    assert len(got) == len(rows)
    keys = [r["doc_id"] for r in got]
    assert keys == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at, want = 0, {}
    for key, text in rows:
        want.setdefault(key, []).append(own.encode(text or "", add_special_tokens=False).ids + [2])
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids)
        want[r["doc_id"]].remove(ids)
        at += len(ids)


def test_files_are_read_by_many_tasks(spark, tools, texts):
    df = texts([(i, f"text of {i}") for i in range(300)])
    files = b.write_ids(df.repartition(5), tools[0], ids_per_file=20)
    read = b.read_ids(files, df.schema["doc_id"]).select(F.spark_partition_id().alias("task"), "doc_id")
    n = files.count()
    assert n > 20 and read.select("task").distinct().count() > n // 2 and read.count() == 300


def test_folders_are_qualified(spark):
    from stayscope.llm import files

    assert files.qualified(spark, "/user/x").startswith("file:/")
    assert files.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
    with pytest.raises(ValueError, match="stores"):
        files.qualified(spark, "odd://host/x")


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_added_tokens_equal_the_library(tools, flags):
    from tokenizers import AddedToken

    own = Tokenizer.from_str(tools[1].to_str())
    own.add_special_tokens([AddedToken("<x>", **flags), AddedToken("<x>y", special=True)])
    encode = b.tokenizer_encoder(own.to_str(), public_tokenizers.PATTERN)()
    texts = ["<x>", "a <x> b", "a<x>b", "  <x>  y", "<x>y<x><|endoftext|>", " <|endoftext|> <x>\n", "a <x>. <x", "a<x> <x>b"]
    for text, packed in zip(texts, encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_empty_table(tools, texts):
    df = texts([])
    files = b.write_ids(df, tools[0])
    assert files.count() == 0 and b.read_ids(files, df.schema["doc_id"]).count() == 0


def test_words_before_marks_share_what_is_remembered(tools, monkeypatch):
    """A word followed by a mark is not encoded again; ids stay those of the library."""
    build, library = tools
    encode = build()
    made = []
    missing = Recent.__missing__
    monkeypatch.setattr(Recent, "__missing__", lambda self, key: made.append(key) or missing(self, key))
    text = "so zorblax zorblax, zorblax. zorblaxé zorblaxé\nzorblax"
    (ids,) = encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert " zorblax" not in made and made.count("zorblax") == 2 and " zorblaxé" in made


def test_only_texts_beyond_the_first_plane_pay_for_its_ranges():
    split = splitter("narrow", "wide")
    assert [split(f"narrow wide {c}") for c in ("", "é", "日", "\uffff", "𐀀", "🦊")] == [["narrow"]] * 4 + [["wide"]] * 2
    assert split("") == []


def test_marks_behind_words_are_encoded_once(tools, monkeypatch):
    """Marks after new words are remembered; ids stay those of the library."""
    build, library = tools
    encode = build()
    made = []
    missing = Recent.__missing__
    monkeypatch.setattr(Recent, "__missing__", lambda self, key: made.append(key) or missing(self, key))
    marks = [".", ",", "'", "'.", ".'", "...", "%%%", "_", "-", "\"'", "']"]
    text = " ".join(["so", *(f"qu{a}zl{m}" for a in ("ix", "ox") for m in marks), "don't.", "it's", "x's,", "é.", "1.", "a.b.", "a..\n"])
    (ids,) = encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(made.count(m) <= 2 for m in marks) and made.count("\"'") >= 1


def test_marks_that_stay_with_their_word():
    """Without ids of their own, marks are encoded together with the word before them."""
    whole = ChunkedEncoder(str.encode, 100, lambda w: b" " + w.encode(), lambda m: None if "!" in m else b"<" + m.encode() + b">")
    assert whole.encode("a b, c! d!, e1, f") == b"a b<,> c! d!, e1, f"
