import weakref
from types import SimpleNamespace

import public_tokenizers

from stayscope.llm import bitplane, jaccard_join, prefix_bpe
from stayscope.llm.splitting import written_out


def test_a_step_releases_what_the_one_before_remembered():
    """A worker that encoded texts doesn't hold their ids while it compares shingles."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        shared = SimpleNamespace(value=("ranks", f.read(), written_out(public_tokenizers.PATTERN, prefix_bpe.class_members)))
    codec = prefix_bpe._codec(shared)
    ids = codec.encode("some words, remembered")
    assert prefix_bpe._codec(shared) is codec
    held = weakref.ref(codec)
    del codec
    assert len(jaccard_join.shingle_set(b"one two three four", 3)) == 2
    assert held() is None
    assert prefix_bpe._codec(shared).encode("some words, remembered") == ids


def test_the_encoder_of_id_files_is_released_too():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        build = bitplane.tokenizer_encoder(f.read(), public_tokenizers.PATTERN)
    (ids,) = build()(["some words"])
    first = weakref.ref(build().__closure__[0].cell_contents)
    assert first() is not None
    jaccard_join.shingle_set(b"one two three four", 3)
    assert first() is None and build()(["some words"]) == [ids]
