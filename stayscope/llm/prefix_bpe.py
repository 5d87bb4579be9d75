"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix has one encoding, so it has one last token: the token t that ends there and that
may follow the last token of the prefix before it. Two tokens may stand side by side when merging
their joined bytes gives just these two again. The table of last tokens is filled from left to
right and read backwards. It holds the encoding of every prefix, so text can be appended exactly,
and after an edit only the places near it are filled anew.

Vocabularies are rank files (base64 token and rank a line). A piece that is a token by itself is that
token; text is cut into pieces by the pattern first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .remembered import remembered
from .splitting import ChunkedEncoder, Recent, every_character, keeps_words, written_out
from .text import few_rows


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file's content."""
    pairs = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


#: Prefixes of up to so many bytes are shared between pieces.
_SHARED = 24


class Vocabulary:
    """Ranks of byte tokens, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int], max_known: int = 600_000):
        self.ranks = ranks
        #: Last tokens of short prefixes (places in ``tokens``), shared by all pieces; emptied when it is full.
        self.known: dict[bytes, int] = {}
        self.max_known = max_known
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._pairs: dict[int, bool] = {}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        if len([t for t in ranks if len(t) == 1]) < 256:
            raise ValueError("the vocabulary lacks single bytes")

    def merge(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """Plain merging, lowest rank first, leftmost of equal ones; for short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [
                (rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None
            ]
            rank, i = min(ranked, default=(below, 0))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge made the token; None for bytes and for tokens merges never make."""
        if token not in self._halves:
            parts = self.merge(token, self.ranks[token]) if len(token) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    @cached_property
    def made(self) -> frozenset[bytes]:
        """Tokens that merging can end in."""
        return frozenset(t for t in self.ranks if len(t) == 1 or self.halves(t) is not None)

    def _edge(self, token: bytes, right: bool) -> list[tuple[bytes, float, float]]:
        """Tokens at one edge while the token is made: token, from when, until when (by rank)."""
        out = self._edges[right].get(token)
        if out is None:
            out, until, part = [], float("inf"), token
            while True:
                since = self.ranks[part] if len(part) > 1 else -1
                out.append((part, since, until))
                halves = self.halves(part) if len(part) > 1 else None
                if halves is None:
                    break
                part, until = halves[1 if right else 0], since
            self._edges[right][token] = out
        return out

    @cached_property
    def places(self) -> dict[bytes, int]:
        """Made tokens and their places among them."""
        return {token: place for place, token in enumerate(self.made)}

    @cached_property
    def tokens(self) -> list[bytes]:
        return list(self.places)

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether merging ``left + right`` ends in these two tokens: no merge across comes first."""
        return self._may_follow(self.places[left], self.places[right])

    def _may_follow(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= 200_000:
                self._pairs.clear()
            known = self._pairs[pair] = self._stand_apart(self.tokens[left], self.tokens[right])
        return known

    def _stand_apart(self, left: bytes, right: bytes) -> bool:
        """Goes back through the merges of both; only edges that exist at the same time can merge."""
        rank_of, lefts, rights = self.ranks.get, self._edge(left, True), self._edge(right, False)
        i = j = 0
        while i < len(lefts) and j < len(rights):
            a, a_since, a_until = lefts[i]
            b, b_since, b_until = rights[j]
            rank = rank_of(a + b)
            # At equal ranks the leftmost merge comes first.
            if rank is not None and rank < a_until and rank <= b_until and a_since < b_until and b_since < a_until:
                return False
            if a_since >= b_since:
                i += 1
            else:
                j += 1
        return True

    def last_token(self, data: bytes, end: int, last_of) -> bytes:
        """Last token of ``data[:end]``; ``last_of(start)`` tells that of a shorter prefix."""
        made = self.made
        for start in range(max(0, end - self.longest), end):
            token = data[start:end]
            if token in made and (start == 0 or self.may_follow(last_of(start), token)):
                return token
        raise ValueError("no token ends here")

    def encode(self, data: bytes) -> bytes:
        """Ids of one piece, 32 bits each, from the table of prefixes that all pieces share."""
        known, packed = self.known, self.packed
        if data in packed:
            return packed[data]
        if len(data) > _SHARED:
            return b"".join(packed[t] for t in PrefixEncoding(self, data).last_tokens())
        if len(known) > self.max_known:
            known.clear()
        end = len(data)
        while end and data[:end] not in known:
            end -= 1
        place_of, pairs, longest = self.places.get, self._pairs.get, self.longest
        for stop in range(end + 1, len(data) + 1):
            # As ``last_token``, written out: this is where encoding spends its time.
            for start in range(stop - longest if stop > longest else 0, stop):
                token = place_of(data[start:stop])
                if token is not None:
                    if not start:
                        break
                    left = known[data[:start]]
                    apart = pairs(left << 32 | token)
                    if apart or (apart is None and self._may_follow(left, token)):
                        break
            else:
                raise ValueError("no token ends here")
            known[data[:stop]] = token
        out, end, tokens = [], len(data), self.tokens
        while end:
            token = tokens[known[data[:end]]]
            out.append(packed[token])
            end -= len(token)
        return b"".join(reversed(out))


class PrefixEncoding:
    """Last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[bytes] = [b""]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes; what is filled stays, as prefixes don't depend on what follows."""
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.vocabulary.last_token(self.data, end, self.last.__getitem__))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of [start, stop); returns how many places were filled anew.

        Filling stops once as many places as the longest token has bytes agree with the old ones.
        """
        old, shift = self.last, start + len(new) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        same, filled = 0, 0
        for end in range(start + 1, len(self.data) + 1):
            token = self.vocabulary.last_token(self.data, end, self.last.__getitem__)
            self.last.append(token)
            filled += 1
            same = same + 1 if end - shift > stop and old[end - shift] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                break
        return filled

    def tokens(self, end: int | None = None) -> list[int]:
        """Ids of the prefix of ``end`` bytes (default: all)."""
        end = len(self.data) if end is None else end
        whole = self.vocabulary.ranks.get(self.data[:end])
        if whole is not None:
            return [whole]
        return [self.vocabulary.ranks[t] for t in self.last_tokens(end)]

    def last_tokens(self, end: int | None = None) -> list[bytes]:
        """The tokens of a prefix, read backwards from its end."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.last[end])
        return out[::-1]


def class_members(name: str) -> str:
    """Characters of a regex class such as ``\\p{L}`` in tiktoken's edition of Unicode."""
    single = {bytes([b]): b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
    return bytes(probe.encode_ordinary(every_character())).decode()


class TextEncoding:
    """Encoding of a text by pieces, open to appends and edits at any place.

    ``pattern`` is written out, as for ``Codec``.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, re.compile(pattern)
        self.pieces: list[str] = []
        self.encoded: list[PrefixEncoding] = []
        self.append(text)

    def append(self, more: str) -> None:
        """Add text; only the last piece is cut and encoded anew, or just extended."""
        rest = (self.pieces[-1] if self.pieces else "") + more
        cut = self.pattern.findall(rest)
        if self.pieces and cut and cut[0].startswith(self.pieces[-1]):
            self.encoded[-1].append(cut[0][len(self.pieces[-1]) :].encode())
            self.pieces[-1] = cut.pop(0)
        elif self.pieces:
            self.pieces.pop()
            self.encoded.pop()
        self.pieces += cut
        self.encoded += [PrefixEncoding(self.vocabulary, piece.encode()) for piece in cut]

    def replace(self, start: int, stop: int, new: str) -> int:
        """Put ``new`` in place of the characters [start, stop); returns how many pieces were cut anew.

        Cutting starts at the piece before the edit, since a piece's end may depend on the next
        character, and stops where an old cut is met again behind the edit.
        """
        bounds = np.cumsum([0, *map(len, self.pieces)]).tolist()
        first = max(0, int(np.searchsorted(bounds, start, "right")) - 2)
        text = "".join(self.pieces)
        shift = start + len(new) - stop
        text = text[:start] + new + text[stop:]
        old_cuts = {b: k for k, b in enumerate(bounds) if b >= stop}
        fresh: list[str] = []
        at, resume = bounds[first], len(self.pieces)
        while at < len(text):
            if at - shift in old_cuts and at >= start + len(new):
                resume = old_cuts[at - shift]
                break
            match = self.pattern.match(text, at)
            fresh.append(match.group())
            at = match.end()
        self.pieces[first:resume] = fresh
        self.encoded[first:resume] = [PrefixEncoding(self.vocabulary, p.encode()) for p in fresh]
        return len(fresh)

    def tokens(self) -> list[int]:
        return [t for piece in self.encoded for t in piece.tokens()]


class Codec:
    """Encoder and decoder of texts for one vocabulary and (written-out) pattern."""

    def __init__(self, rank_file: bytes, pattern: str, cached: int = 300_000):
        self.vocabulary = Vocabulary(read_ranks(rank_file))
        self._split = re.compile(pattern).findall
        self._keeps = keeps_words(self._split)
        word = (lambda letters: self.vocabulary.encode(b" " + letters.encode())) if self._keeps else None
        whole = ChunkedEncoder(self._pieces, cached, word)
        self.encode, self._after_space = whole.encode, whole.after_space
        self._piece = Recent(self._alone, cached // 8).__getitem__
        places = pa.array(range(len(self.vocabulary.ranks)), pa.int32())
        ranks = pa.array(list(self.vocabulary.ranks.values()), pa.int64())
        self._places = np.zeros(max(self.vocabulary.bytes_of) + 1, np.int32)
        self._places[ranks.to_numpy()] = places.to_numpy()
        self._tokens = pa.array(list(self.vocabulary.ranks), pa.large_binary())

    def _alone(self, piece: str) -> bytes:
        return self.vocabulary.encode(piece.encode())

    def _pieces(self, text: str) -> bytes:
        """Ids of a text; a lone piece and a word in front are remembered elsewhere."""
        found = self._split(text)
        if len(found) == 1:
            return self._alone(found[0])
        first = found[0][1:] if self._keeps and found and found[0][0] == " " else ""
        if first.isascii() and first.isalpha():
            return self._after_space(first) + b"".join(map(self._piece, found[1:]))
        return b"".join(map(self._piece, found))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that little-endian 32-bit ids stand for."""
        tokens = self._tokens.take(pa.array(self._places[np.frombuffer(ids, "<u4")]))
        _, offsets, content = tokens.buffers()
        start, end = np.frombuffer(offsets, "<i8", len(tokens) + 1)[[0, -1]] if len(tokens) else (0, 0)
        return content[start:end].to_pybytes() if end > start else b""


def _codec(shared) -> Codec:
    """One codec per Python worker, kept between its tasks until a step of another kind begins."""
    name, data, pattern = shared.value
    return remembered(name, lambda: Codec(data, pattern))


def _share(df: DataFrame, rank_file: str, pattern: str):
    """Rank file and written-out pattern for the tasks; their size doesn't depend on the data."""
    with open(rank_file, "rb") as f:
        data = f.read()
    name = hashlib.sha256(data + pattern.encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((name, data, written_out(pattern, class_members)))


def encode_texts(
    docs: DataFrame, rank_file: str, pattern: str, keep: list[str], text: str = "text", decode: bool = False
) -> DataFrame:
    """Per row: kept (a struct of the ``keep`` columns), ids (binary, little-endian 32 bits each).

    With ``decode`` also decoded: the bytes that the ids stand for. The rank file is read on the
    driver and sent to the tasks.

    Null texts count as empty and have no ids. Rows are encoded each by itself: repeated rows, ties
    and null keys keep their own results, and clashing column names are safe inside ``kept``. No
    special tokens are known: their strings are text.
    """
    shared = _share(docs, rank_file, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in few_rows(batches):
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            columns = {"kept": batch.column("kept"), "ids": pa.array(ids, pa.binary())}
            if decode:
                columns["decoded"] = pa.array(map(codec.decode, ids), pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    rows = docs.select(kept, F.col(text).cast("string").alias("text"))
    made = ["ids", "decoded"] if decode else ["ids"]
    return rows.mapInArrow(encode, StructType([rows.schema["kept"], *(StructField(c, BinaryType()) for c in made)]))


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with their ids and a column decoded: the bytes that the ids stand for."""
    shared = _share(encoded, rank_file, pattern)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in few_rows(batches):
            decoded = pa.array([codec.decode(i or b"") for i in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
