import random

import public_tokenizers
import pytest
import tiktoken

from stayscope.llm import prefix_bpe as b

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tools():
    with open(PATH, "rb") as f:
        data = f.read()
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=b.read_ranks(data), special_tokens={})
    return b.Codec(data, b.written_out(PATTERN, b.class_members)), own


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def random_text(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(9, 14), rng.randrange(0xA0, 0x250)])) for _ in range(40))
    if kind == 1:
        points = (rng.randrange(0x110000) for _ in range(20))
        return "".join(chr(p) for p in points if not 0xD800 <= p <= 0xDFFF)
    if kind == 2:
        return "".join(rng.choice("abesthionr") for _ in range(rng.randrange(80)))
    if kind == 3:
        return "".join(rng.choice("aab ") for _ in range(rng.randrange(60)))
    blanks = [" ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "'s", "'", "1", "²", "é", "́", "_", "<|endoftext|>"]
    return "".join(rng.choice(blanks) for _ in range(rng.randrange(30)))


def test_equals_the_library(tools):
    codec, own = tools
    rng = random.Random(7)
    for _ in range(3000):
        text = random_text(rng)
        packed = codec.encode(text)
        assert ids(packed) == own.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_every_character(tools):
    codec, own = tools
    every = b.every_character()
    for at in range(0, len(every), 2000):
        text = "a".join(every[at : at + 2000])
        assert ids(codec.encode(text)) == own.encode_ordinary(text)


def test_caches_may_overflow():
    with open(PATH, "rb") as f:
        data = f.read()
    small = b.Codec(data, b.written_out(PATTERN, b.class_members), cached=3)
    small.vocabulary.max_known = 5
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=b.read_ranks(data), special_tokens={})
    text = "some words of some text, some of them twice; " * 3
    assert ids(small.encode(text)) == own.encode_ordinary(text)


def test_prefixes_appends_and_edits_of_bytes(tools):
    vocabulary = tools[0].vocabulary
    rng = random.Random(3)
    for _ in range(150):
        data = bytes(rng.choice(b"abesthion r") for _ in range(rng.randrange(1, 90)))
        made = b.PrefixEncoding(vocabulary, data)
        for end in range(1, len(data) + 1):
            whole = vocabulary.ranks.get(data[:end])
            want = [whole] if whole is not None else [vocabulary.ranks[t] for t in vocabulary.merge(data[:end])]
            assert made.tokens(end) == want
        more = bytes(rng.choice(b"abesth") for _ in range(5))
        made.append(more)
        assert made.last == b.PrefixEncoding(vocabulary, data + more).last
        start = rng.randrange(len(data))
        stop = rng.randrange(start, len(data) + 1)
        made.replace(start, stop, b"xy")
        assert made.last == b.PrefixEncoding(vocabulary, made.data).last
    long = b.PrefixEncoding(vocabulary, b"abesthion" * 200)
    assert long.replace(30, 33, b"zz") < 400


def test_appends_and_edits_of_text(tools):
    codec, own = tools
    rng = random.Random(11)
    pattern = b.written_out(PATTERN, b.class_members)
    for _ in range(300):
        text = random_text(rng) + random_text(rng)
        made = b.TextEncoding(codec.vocabulary, pattern, text)
        more = random_text(rng)[:6]
        made.append(more)
        text += more
        assert made.tokens() == own.encode_ordinary(text)
        if text:
            start = rng.randrange(len(text))
            stop = rng.randrange(start, min(len(text), start + 5) + 1)
            new = random_text(rng)[:4]
            made.replace(start, stop, new)
            text = text[:start] + new + text[stop:]
            assert made.tokens() == own.encode_ordinary(text)
    far = b.TextEncoding(codec.vocabulary, pattern, "some words here " * 500)
    assert far.replace(4000, 4003, "new") < 10


def test_table(tools, texts, odd):
    own = tools[1]
    df = texts(odd)
    rows = b.encode_texts(df, PATH, PATTERN, df.columns, decode=True).collect()
    got = sorted((str(r["kept"]["doc_id"]), r["kept"]["text"] or "", ids(r["ids"]), bytes(r["decoded"])) for r in rows)
    want = sorted((str(k), t or "", own.encode_ordinary(t or ""), (t or "").encode()) for k, t in odd)
    assert got == want
    again = b.decode_ids(b.encode_texts(df, PATH, PATTERN, ["doc_id"]), PATH, PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in again) == sorted((t or "").encode() for _, t in odd)
    assert b.encode_texts(texts([]), PATH, PATTERN, ["doc_id"]).count() == 0


def test_words_before_marks_are_encoded_once(monkeypatch):
    with open(PATH, "rb") as f:
        codec = b.Codec(f.read(), b.written_out(PATTERN, b.class_members))
    asked, encode = [], codec.vocabulary.encode
    monkeypatch.setattr(codec.vocabulary, "encode", lambda data: asked.append(data) or encode(data))
    text = "so zyxabw zyxabw. zyxabw, zyxabw! zyxabw"
    assert codec.decode(codec.encode(text)) == text.encode() and codec.decode(b"") == b""
    assert asked.count(b" zyxabw") == 1


def test_edges_at_the_same_time_decide(tools):
    """Going back through both merges finds what a search of all pairs of edges finds."""
    words, rng = tools[0].vocabulary, random.Random(3)
    made = sorted(words.made)
    for _ in range(3_000):
        left, right = rng.choice(made), rng.choice(made)
        ranked = [
            (words.ranks[x + y], since, until, start, stop)
            for x, since, until in words._edge(left, True)
            for y, start, stop in words._edge(right, False)
            if x + y in words.ranks
        ]
        meets = any(r < until and r <= stop and since < stop and start < until for r, since, until, start, stop in ranked)
        assert words.may_follow(left, right) is not meets
