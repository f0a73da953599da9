"""Byte-pair encoding with an existing vocabulary, and decoding.

Encoding is exact and linear in the text: an Aho-Corasick automaton gives the longest token at every
position of a word, and a token is accepted only if it may stand after its predecessor, which a table of
compatible pairs tells. When no token fits, the last one is given back and a shorter one is tried; every
position given up is marked, so that no position is tried twice with the same outcome.

Decoding looks tokens up in a table of offsets into one string of bytes.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weekcast.llm.common import arrow_map, text_blocks, text_or_empty

# Fixed value: the word pattern of byte-level vocabularies (white space spelled out, as libraries differ).
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHED_WORDS = 900_000
CACHED_LENGTH = 48
VOCABULARY_LIMIT = 64 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class _WordCache(dict):
    """Ids of words seen so far, as bytes; emptied when full, so memory is bounded."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self._encode(word.encode("utf-8"))).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Tokenizer:
    """Encoder and decoder of one byte-level vocabulary (its JSON file as text)."""

    def __init__(self, source: str):
        data = json.loads(source)
        model, letters = data["model"], byte_letters()
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        pieces = {name: bytes(letters[c] for c in name) for name in model["vocab"] if name not in added}
        size = 1 + max([*model["vocab"].values(), *added.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for name, piece in pieces.items():
            self.token_bytes[model["vocab"][name]] = piece
        for name, number in added.items():
            self.token_bytes[number] = name.encode("utf-8")
        self.special = added
        self._special = (
            regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        )
        self._words = regex.compile(WORD_PATTERN)
        self._merges(model)
        self._shorter_tokens(pieces, model["vocab"])
        self._offsets()
        self._fits: dict[int, bool] = {}
        self.cache = _WordCache(self.encode_word)

    def _merges(self, model) -> None:
        """``_made``: pair -> (rank, token). ``_rank`` and ``_parts``: how a token is made."""
        vocab = model["vocab"]
        self._made: dict[int, tuple[int, int]] = {}
        self._rank, self._parts = [-1] * len(self.token_bytes), [None] * len(self.token_bytes)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if self._parts[whole] is not None:
                raise ValueError(f"token {a + b!r} is made by two merges")
            self._made[left << 32 | right] = (rank, whole)
            self._rank[whole], self._parts[whole] = rank, (left, right)

    def _shorter_tokens(self, pieces, vocab) -> None:
        """Automaton over all tokens; for every token the next shorter one that it begins with."""
        self._by_bytes = {piece: vocab[name] for name, piece in pieces.items()}
        # A token that no merge makes is never an outcome of merging.
        usable = {p: t for p, t in self._by_bytes.items() if len(p) == 1 or self._parts[t] is not None}
        automaton = ahocorasick.Automaton()
        for piece, token in usable.items():
            automaton.add_word(piece.decode("latin-1"), (len(piece), token))
        automaton.make_automaton()
        self._automaton = automaton
        self._shorter = [-1] * len(self.token_bytes)
        for piece, token in usable.items():
            for n in range(len(piece) - 1, 0, -1):
                if (found := usable.get(piece[:n])) is not None:
                    self._shorter[token] = found
                    break

    def _offsets(self) -> None:
        self._lengths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)[:-1]])
        self._blob = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)

    # -- encoding ----------------------------------------------------------------------------

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side, remembered per pair."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, latest first, and look for one across the border that would
        have come before the merge just undone (the left one of two equal merges comes first)."""
        rank, made, parts = self._rank, self._made, self._parts
        bound, strict = len(made), True
        while True:
            crossing = made.get(left << 32 | right)
            if crossing is not None and (crossing[0] < bound or (crossing[0] == bound and not strict)):
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                bound, strict = rank[left], True
                left = parts[left][1]
            else:
                bound, strict = rank[right], False
                right = parts[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        whole = self._by_bytes.get(word)
        if whole is not None and (len(word) == 1 or self._parts[whole] is not None):
            return [whole]
        longest = [-1] * len(word)
        for end, (length, token) in self._automaton.iter(word.decode("latin-1")):
            longest[end - length + 1] = token  # later matches of a position are longer
        size, open_to = len(word), bytearray(b"\1") * (len(word) + 1)
        lengths, shorter = self.token_bytes, self._shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + len(lengths[token])
            if open_to[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_to[at] = 0
                token = out.pop()
                at -= len(lengths[token])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self._special is None or self._special.search(text) is None:
            return b"".join(map(self.cache.__getitem__, self._words.findall(text)))
        out, at = [], 0
        for hit in self._special.finditer(text):
            out += map(self.cache.__getitem__, self._words.findall(text[at : hit.start()]))
            out.append(array("I", [self.special[hit.group()]]).tobytes())
            at = hit.end()
        out += map(self.cache.__getitem__, self._words.findall(text[at:]))
        return b"".join(out)

    # -- decoding ----------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        tokens = np.frombuffer(ids, dtype="<u4")
        lengths = self._lengths[tokens]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self._starts[tokens] - (ends - lengths), lengths) + np.arange(total)
        return self._blob[where].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(source: str) -> Tokenizer:
    return Tokenizer(source)


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read once by the driver; its size is checked as it is sent to every worker."""
    with open(path, encoding="utf-8") as file:
        source = file.read(VOCABULARY_LIMIT + 1)
    if len(source) > VOCABULARY_LIMIT:
        raise ValueError(f"vocabulary {path} is larger than {VOCABULARY_LIMIT} characters")
    return source


def encode_texts(df: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: (id, n_tokens, ids, decoded).

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` is what they stand for. A null text
    counts as empty: no tokens. Null ids and repeated rows stay as they are; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        coder = tokenizer(shared.value)
        for batch, texts in text_blocks(batches, "text"):
            ids = [coder.encode(t) for t in texts]
            yield [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([coder.decode(i) for i in ids], pa.string()),
            ]

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), text_or_empty(text).alias("text"))
    out = arrow_map(rows, run, f"id {kind}, n_tokens bigint, ids binary, decoded string")
    return out.withColumnRenamed("id", id_column)


def token_digests(df: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The same with SHA-256 digests in place of ids and text, taken where they are made, so that only
    digests leave the Python worker."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        coder = tokenizer(shared.value)
        for batch, texts in text_blocks(batches, "text"):
            ids = [coder.encode(t) for t in texts]
            yield [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([digest(i) for i in ids], pa.string()),
                pa.array([digest(coder.decode(i).encode("utf-8")) for i in ids], pa.string()),
            ]

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), text_or_empty(text).alias("text"))
    out = arrow_map(rows, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)
