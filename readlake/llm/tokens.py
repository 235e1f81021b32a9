"""Token counts by a SentencePiece model, without keeping any token.

Texts are cut where no piece of the vocabulary can reach across: before a run of spaces
that follows something else. The tokens of a part do not depend on its neighbours there,
so a part is encoded once and its length is remembered. Should a vocabulary have pieces
that cross such a border, or a model that rewrites text first, texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from .text import slices

SPACE = "▁"  # how the library writes a space
LIMIT = 4096
ENCODE_BYTES = 1 << 18
REMEMBERED = 400_000  # parts whose lengths a worker keeps; then it starts afresh
LONGEST_REMEMBERED = 64
_PART = re.compile(" +[^ ]*")


class Counter:
    """Lengths in tokens; one per worker and model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model_format.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        crossing = any(SPACE in piece.piece.lstrip(SPACE) for piece in spec.pieces)
        normalizer = spec.normalizer_spec
        self.cuts = (
            not crossing
            and spec.trainer_spec.model_type == spec.trainer_spec.BPE
            and normalizer.name == "identity"
            and normalizer.add_dummy_prefix
            and normalizer.escape_whitespaces
            and not normalizer.remove_extra_whitespaces
        )
        self.known: dict[str, int] = {"": 1}

    def encoded(self, texts: list[str]) -> list[int]:
        """Lengths by the library, in calls of about as many bytes each."""
        out: list[int] = []
        start = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= ENCODE_BYTES or end == len(texts):
                out += map(len, self.model.encode(texts[start:end], num_threads=1))
                start, size = end, 0
        return out

    def parts(self, text: str) -> list[str]:
        """The text's parts, each without the first of its leading spaces: the library
        adds that one to whatever it encodes. A lone space at the end is the part ''."""
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [part[1:] for part in _PART.findall(" " + text)]
        return text.split(" ")

    def count(self, texts: list[str | None]) -> list[int]:
        if not self.cuts:
            return self.encoded([text or "" for text in texts])
        split = [self.parts(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": 1}
        new = list(set().union(*split) - self.known.keys())
        fresh = dict(zip(new, self.encoded(new)))
        self.known |= {part: n for part, n in fresh.items() if len(part) <= LONGEST_REMEMBERED}
        known = _Either(self.known, fresh) if fresh else self.known
        return [sum(map(known.__getitem__, parts)) for parts in split]


class _Either(dict):
    def __init__(self, first: dict, second: dict):
        super().__init__(second)
        self.first = first

    def __missing__(self, key):
        return self.first[key]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    documents: DataFrame, model_path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: its id as ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens), over whole texts, without added special tokens.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids stay as they
    are; other columns are not read. ``model_path`` must exist on every executor.
    """
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, n_bytes bigint"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                sizes = [len(text.encode()) if text else 0 for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.count(texts), pa.int64()), pa.array(sizes, pa.int64())],
                    ["doc_id", "n_tokens", "n_bytes"],
                )

    counted = source.mapInArrow(lengths, schema)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
