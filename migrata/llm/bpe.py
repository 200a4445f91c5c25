"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode`` gives every row its token ids, ``decode`` the exact bytes of a row of ids.  Nothing is
trained and no file is fetched: the rank file (one base64 token and its rank per line) and the
split pattern are parameters.  Texts are encoded without special tokens.

Long texts are cut before they reach the library, and only where a token must end anyway: the
pattern never matches a non-space character followed by white space, so the place before a blank or
a line feed that follows a non-space character is a token boundary in every text, and the ids of
the pieces joined are the ids of the whole.  Decoding joins raw token bytes, so a token that holds
part of a character does no harm.

Defined results: a null text is encoded as the empty text (no ids, empty bytes); null ids decode to
empty bytes; equal texts get equal ids; an empty table gives an empty table; other columns are
neither read nor returned unless they are named in ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migrata.llm.common import col, map_texts

# texts longer than this are cut at safe boundaries, in pieces of about this many characters
PIECE_CHARS = 1 << 16
# text a worker encodes before it hands the ids on
SLICE_BYTES = 1 << 20
_SAFE = re.compile(r"(?<=\S)[ \n]")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of at least ``size`` characters (but the last)."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


class Codec:
    """One rank file loaded; ids are little-endian unsigned 32-bit integers in a byte string."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        ids = [np.asarray(self.encoding.encode_ordinary(p), dtype="<u4") for p in pieces(text)]
        return b"".join(x.tobytes() for x in ids)

    def decode(self, packed: bytes | None) -> bytes:
        if not packed:
            return b""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file, loaded once per Python worker."""
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
           keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``ids``: the packed ids of each row's text (see ``Codec``)."""
    def make():
        c = codec(rank_file, pattern)
        return lambda texts: ([c.encode(t) for t in texts],)

    return map_texts(docs, [col(k) for k in keep], [col(text_col)], [T.StructField("ids", T.BinaryType())], make)


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids",
           keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded``: the bytes that the packed ids stand for."""
    def make():
        c = codec(rank_file, pattern)
        return lambda ids: ([c.decode(x) for x in ids],)

    return map_texts(encoded, [col(k) for k in keep], [col(ids_col)], [T.StructField("decoded", T.BinaryType())], make)


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Round trip of every text: token count and digests of the ids and of the decoded bytes; ``ids`` adds the packed ids."""
    # both ways in one worker: a rank file is held once a task, and little text at a time
    def make():
        c = codec(rank_file, pattern)

        def work(texts):
            coded = [c.encode(t) for t in texts]
            return coded, [c.decode(x) for x in coded]
        return work

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    both = map_texts(docs, [col(id_col).alias("id")], [col(text_col)], fields, make, slice_bytes=SLICE_BYTES)
    return both.select(
        F.col("id").alias(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *([F.col("ids")] if ids else []),
    )


def unpacked(ids: bytes) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(ids, dtype="<u4").tolist()
