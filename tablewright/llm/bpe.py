"""Byte-level BPE encoding with offsets, and decoding, over Arrow batches.

A rank file is turned into a ``tokenizers`` model: every byte is written as one printable character
(the usual byte-to-character table), every token as a string of such characters, and the merge that
makes a token follows from the ranks below its own.

Defined cases: null counts as the empty text and has no tokens. Special tokens are never produced.
Ids that no rank has raise ``KeyError`` when decoded. A character whose bytes fall into two tokens
gets the same offsets in both; decoding works on bytes, so it needs no care there. Each match of the
pattern is encoded by itself, so a worker encodes each distinct match once and keeps its ids in a
bounded table; so it does with the chunks between single spaces, where every match ends. Extra columns
are kept; clashing result columns are replaced.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from tablewright.llm.common import slices

#: Distinct matches, and chunks between spaces, that a worker remembers as recent; as many older ones
#: are at hand besides.
KNOWN_MATCHES = 60_000
#: White space beside a space: there a space need not begin a match.
_BESIDE = re.compile(r" \s|\s |\A | \Z")


def byte_characters() -> list[str]:
    """Printable character of each byte: itself where printable in Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merges ranked below ``token`` leave of it."""
    limit = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(pairs)
        if rank >= limit:
            raise ValueError(f"no merge makes {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class _Recent:
    """Values by key in two generations, so that memory stays bounded."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """Values of all keys; those of new keys are made together."""
        found = {k: v for k in keys if (v := self.young.get(k)) is not None}
        aged = {k: v for k in keys if k not in found and (v := self.old.get(k)) is not None}
        new = [k for k in keys if k not in found and k not in aged]
        made = dict(zip(new, make(new))) if new else {}
        if len(self.young) + len(aged) + len(made) > KNOWN_MATCHES:
            self.old, self.young = self.young, {}
        self.young.update(aged)
        self.young.update(made)
        return {**found, **aged, **made}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        characters = byte_characters()
        spelled = {token: "".join(characters[b] for b in token) for token in ranks}
        merges = [
            tuple("".join(characters[b] for b in part) for part in merge_of(token, ranks))
            for token in sorted(ranks, key=ranks.__getitem__)
            if len(token) > 1
        ]
        self.tokenizer = Tokenizer(models.BPE({spelled[t]: r for t, r in ranks.items()}, merges, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.known, self.chunks = _Recent(), _Recent()

    def _encode_new(self, matches: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(matches, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_matches(self, texts: list[str]) -> list[bytes]:
        parts = [self.pattern.findall(text) for text in texts]
        ids = self.known.find({match for part in parts for match in part}, self._encode_new)
        return [b"".join([ids[match] for match in part]) for part in parts]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return self._encode_matches([" " + chunk for chunk in chunks])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers.

        A space with other characters on both sides always begins a match of the pattern. Texts in
        which all spaces are such are looked up chunk by chunk, each with the space before it.
        """
        plain = [not _BESIDE.search(text) for text in texts]
        split = [text.split(" ") if cut else [text] for text, cut in zip(texts, plain)]
        first = self._encode_matches([parts[0] for parts in split])
        ids = self.chunks.find({chunk for parts in split for chunk in parts[1:]}, self._encode_chunks)
        return [head + b"".join([ids[chunk] for chunk in parts[1:]]) for head, parts in zip(first, split)]

    def offsets(self, text: str) -> bytes:
        """For each token the first and last-plus-one character that it touches, in the same form."""
        found = list(self.pattern.finditer(text))
        encoded = self.tokenizer.encode_batch([m.group() for m in found], add_special_tokens=False)
        parts = [np.array(e.offsets, "<u4").reshape(-1, 2) + np.uint32(m.start()) for e, m in zip(encoded, found)]
        return b"".join(part.astype("<u4").tobytes() for part in parts)

    def forget(self) -> None:
        """Gives the remembered ids back, since a worker outlives its tasks."""
        self.known, self.chunks = _Recent(), _Recent()


class Decoder:
    """Bytes of the tokens of one rank file."""

    def __init__(self, path: str) -> None:
        self.tokens = {rank: token for token, rank in read_ranks(path).items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
    return Codec(SparkFiles.get(name), pattern)


@lru_cache(maxsize=2)
def _decoder(name: str) -> Decoder:
    return Decoder(SparkFiles.get(name))


def _mapped(
    df: DataFrame, column: str, added: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]], end: Callable[[], None]
) -> DataFrame:
    """Runs ``work`` on the values of a column over bounded parts of the Arrow batches, then ``end``."""
    new = [f.name for f in added]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                values = work(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, *values], names=[*part.schema.names, *new])
        end()

    return df.select(*kept).mapInArrow(run, schema)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit numbers), ``n_tokens`` and ``offsets``.

    ``offsets`` is binary too: start and end character of each token as two such numbers.
    The rank file is distributed with the job, so executors need no copy of their own.
    """
    df.sparkSession.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if offsets:
        added.append(T.StructField("offsets", T.BinaryType()))

    def work(values: pa.Array) -> list[pa.Array]:
        codec = _codec(name, pattern)
        texts = [value or "" for value in values.to_pylist()]
        ids = codec.encode(texts)
        out = [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
        return out + ([pa.array(map(codec.offsets, texts), pa.binary())] if offsets else [])

    return _mapped(df, text, added, work, lambda: _codec(name, pattern).forget())


def decode(df: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids in column ``ids``; null ids give no bytes."""
    df.sparkSession.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]

    def work(values: pa.Array) -> list[pa.Array]:
        decoder = _decoder(name)
        return [pa.array([decoder.decode(value or b"") for value in values.to_pylist()], pa.binary())]

    return _mapped(df, ids, [T.StructField("decoded", T.BinaryType())], work, lambda: None)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``decoded``: ``encode`` without offsets and ``decode`` in one worker.

    Two steps after each other keep two workers per task, each with tables of its own.
    """
    df.sparkSession.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.BinaryType())]

    def work(values: pa.Array) -> list[pa.Array]:
        ids = _codec(name, pattern).encode([value or "" for value in values.to_pylist()])
        decoder = _decoder(name)
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(decoder.decode, ids), pa.binary())]

    return _mapped(df, text, added, work, lambda: _codec(name, pattern).forget())
