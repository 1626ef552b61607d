"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Characters of a piece that is encoded in one call.
PIECE = 100_000
#: Whitespace runs from here on would overflow the library's pattern matcher.
LONG_BLANK = 20_000
#: Before a space or line feed that follows one of these, a match always ends and another begins.
SAFE = re.compile(r"[0-9A-Za-z.,;:!?](?=[ \n])")
_blank = re.compile(r"\s{%d,}" % LONG_BLANK)
_loaded: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """A rank file and a pre-splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = {i: str(i) for i in ranks.values()}

    @classmethod
    def load(cls, path: str, pattern: str) -> "Codec":
        """From a local file of ``base64-token rank`` lines; kept for the life of the process."""
        if (path, pattern) not in _loaded:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
            _loaded[path, pattern] = cls(ranks, pattern)
        return _loaded[path, pattern]

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        """The text in pieces whose matches are, together, those of the whole."""
        start = 0
        while len(text) - start > PIECE:
            cut = SAFE.search(text, start + PIECE)
            if not cut:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_BLANK:
            return self.split.encode_ordinary(text)
        ids: list[int] = []
        for piece in self.pieces(text):
            if _blank.search(piece):
                for match in self.pattern.finditer(piece):
                    ids += self.whole.encode_ordinary(match[0])
            else:
                ids += self.split.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.split.decode_bytes(ids)


def real_outputs(codec: Codec, ids: list[int]) -> dict:
    """The ids themselves and the bytes that they stand for."""
    return {"ids": ids, "decoded": codec.decode(ids)}


REAL = ("ids array<int>, decoded binary", [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def byte_bpe(
    docs: DataFrame,
    rank_file: str | None = None,
    pattern: str | None = None,
    finish: Callable[[Codec, list[int]], dict] = real_outputs,
    returns: tuple[str, list[tuple[str, pa.DataType]]] = REAL,
) -> DataFrame:
    """Token ids of every text, and the bytes decoded from them.

    ``rank_file`` is a path on every executor; by default that of the 50k
    byte-level vocabulary of the installed ``public_tokenizers``, whose pattern
    is the default too. Texts are encoded without special tokens; long ones are
    pre-split where a match must end. ``finish`` makes a row's columns from its
    ids, so that a query may derive digests where the ids are.

    One pass without shuffles. A null text counts as empty and has no tokens;
    invalid UTF-8 is replaced by U+FFFD as Spark's own decoding would; repeated
    rows give repeated results; a null id stays null; columns beside ``doc_id``
    and ``text`` are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    ddl, fields = returns
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        codec = Codec.load(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            out["doc_id"] = batch.column(0).to_pylist()
            for text in batch.column(1).to_pylist():
                for name, value in finish(codec, codec.encode((text or b"").decode("utf-8", "replace"))).items():
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id long, {ddl}")
