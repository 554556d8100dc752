"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training text. A text goes to the
language whose dictionary compresses it to the fewest bytes, and is rejected where the two smallest
sizes lie too close together.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is rejected; ties of
size go to the language whose name sorts first; rows without a language are never learned from; with
no learnable row every text is ``und``. Texts are compressed whole, in blocks, after case and ASCII
characters other than letters are folded. Columns of the input are kept; a clashing ``lang_pred``,
``score`` or ``rejected`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import sample_by_class, slices

#: Bound of the training sample: pieces of text per language, characters of each, dictionary bytes.
SAMPLE_PIECES = 400
PIECE_CHARS = 2000
DICTIONARY_BYTES = 1 << 17
LEVEL = 3
BLOCK_BYTES = 1 << 13
#: A second look at narrow results: higher level, small pieces (so that repetition inside a text counts
#: less than the dictionary), each padded so that a tiny piece is not stored uncompressed.
SECOND_BELOW = 0.04
SECOND_LEVEL = 6
SECOND_BYTES = 256
PAD = bytes(64)
#: Smallest share of the best size by which the second best must be larger.
MARGIN = 0.01

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def fold(text: str) -> bytes:
    """Lower case, and a space for every ASCII character that is no letter."""
    return text.lower().encode().translate(_FOLD)


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary bytes per language; at most ``SAMPLE_PIECES * PIECE_CHARS`` characters each."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def learn(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    pieces: int = SAMPLE_PIECES,
    piece_chars: int = PIECE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """Dictionaries from a bounded sample: ``pieces`` rows per language, picked by a hash of the key.

    The piece of a row begins at a place anywhere in its text, by another hash of the key; all pieces
    of a language have an equal share of its dictionary.
    """
    room = F.greatest(F.char_length(F.col(text)) - piece_chars + 1, F.lit(1))
    place = (F.pmod(F.xxhash64(F.lit("place"), key), room) + 1).cast("int")
    rows = df.select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.substring(F.col(text), place, F.lit(piece_chars)).alias("piece"))
    sample = sample_by_class(rows.filter("length(piece) > 0"), "lang", "key", pieces).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r.lang, r.pick, r.piece)):
        found.setdefault(row.lang, []).append(row.piece)
    names = tuple(sorted(found))
    return LanguageModel(names, tuple(_dictionary(found[n], dictionary_bytes) for n in names))


def _dictionary(pieces: list[str], limit: int) -> bytes:
    """The pieces folded, each cut to its share of the limit; what short ones leave goes to the others."""
    parts = sorted(map(fold, pieces), key=len)
    out: list[bytes] = []
    for i, part in enumerate(parts):
        share = (limit - sum(len(x) + 1 for x in out)) // (len(parts) - i) - 1
        out.append(part[: max(0, share)])
    return b"\n".join(out)


class _Sizes:
    """Compressed sizes of a text under each dictionary, in blocks so that each block sees them."""

    def __init__(self, model: LanguageModel, level: int, block: int, pad: bytes = b"") -> None:
        self.block, self.pad, self.compressors = block, pad, []
        for content in model.dictionaries:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    dict_data=known, level=level, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def of(self, data: bytes) -> np.ndarray:
        sizes = np.zeros(len(self.compressors), np.int64)
        for start in range(0, len(data), self.block):
            block = data[start : start + self.block] + self.pad
            sizes += [len(c.compress(block)) for c in self.compressors]
        return sizes


def _margins(sizes: np.ndarray) -> tuple[int, np.ndarray]:
    """Best language, and by what share of its size each other one is larger."""
    best = int(np.argmin(sizes))
    return best, sizes / max(1, int(sizes[best])) - 1.0


class Classifier:
    """Decides one text: language, score (a softmax over relative sizes) and whether it is rejected."""

    def __init__(self, model: LanguageModel, margin: float = MARGIN) -> None:
        self.languages, self.margin = model.languages, margin
        self.first = _Sizes(model, LEVEL, BLOCK_BYTES)
        self.second = _Sizes(model, SECOND_LEVEL, SECOND_BYTES, PAD)

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        data = fold(text)
        best, larger = _margins(self.first.of(data))
        if np.partition(larger, 1)[1] < SECOND_BELOW:
            best, larger = _margins(self.second.of(data))
        score = 1.0 / float(np.exp(-40.0 * larger).sum())
        return self.languages[best], score, bool(np.partition(larger, 1)[1] < self.margin)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``rejected`` to every row of ``df``."""
    spark = df.sparkSession
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in df.columns if c not in added]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value, margin)
        for batch in batches:
            for part in slices(batch, text):
                values = part.column(part.schema.get_field_index(text)).to_pylist()
                langs, scores, rejected = zip(*map(classifier.decide, values))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*part.schema.names, *added],
                )

    return df.select(*kept).mapInArrow(predict, schema)
