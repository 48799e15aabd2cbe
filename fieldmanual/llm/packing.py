"""Vector best-fit packing of tokenised documents into sequences.

Every open sequence has a residual vector: tokens, documents, and attention cost (sum of squared lengths).
Pieces are placed by falling length; a piece goes into the sequence that fits under every constraint and, by
weighted shares of capacity, leaves the smallest residual norm (``rule='norm'``) or aligns best with the piece's
needs (``rule='dot'``).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.json"
# A cut before one blank and a non-blank never falls inside a token of this vocabulary's pre-tokenizer.
CUT = re.compile(r" (?=\S)")
UNSAFE = re.compile(r" (?!\S)")
LATIN = re.compile("[!-~\u00a1-\u02ff]+(?:\n[!-~\u00a1-\u02ff]+)*").fullmatch


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary on this machine (it is installed on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Token ids of texts as little-endian bytes; chunks between safe cuts are encoded once and remembered.

    New chunks of Latin letters and single line feeds are encoded together from the same vocabulary as ranks, which is
    several times faster; all others (other scripts, white space, the special token's name) by the tokenizer file itself.
    """

    def __init__(self, path: str, most_remembered: int = 700_000):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.first, self.most = Tokenizer.from_file(path), {}, {}, most_remembered
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]

    def _encode(self, chunks: list[str], lead: str, known: dict[str, bytes]) -> None:
        plain, other = [], []
        for c in chunks:
            (plain if LATIN(c) and "<|" not in c else other).append(c)
        if plain:
            ids = np.array(self.ranks.encode_ordinary(lead + ("\n" + lead).join(plain)), "<u4")
            breaks = np.append(np.flatnonzero(ids == self.newline), len(ids)) * 4
            ends = breaks[np.cumsum([c.count("\n") + 1 for c in plain]) - 1]
            raw, begin = ids.tobytes(), 0
            for c, end in zip(plain, ends.tolist()):
                known[c] = raw[begin:end]
                begin = end + 4
        if other:
            for c, e in zip(other, self.tokenizer.encode_batch([lead + c for c in other], add_special_tokens=False)):
                known[c] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        cut = [t.split(" ") if not UNSAFE.search(t) else CUT.split(t) for t in texts]
        heads = [parts.pop(0) for parts in cut]
        if len(self.known) > self.most:
            self.known = {}
        self.first = {}
        self._encode(list(set(heads)), "", self.first)
        self._encode(list(set().union(*cut).difference(self.known)), " ", self.known)
        look = self.known.__getitem__
        return [self.first[head] + b"".join(map(look, parts)) for head, parts in zip(heads, cut)]


def token_pieces(documents: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", path: str | None = None,
                 end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids``.

    A document is its token ids and then ``end_id``; a null text has only that.  A document longer than
    ``capacity`` is cut into pieces of exactly that length, except the first, which takes the rest.
    """
    path = path or tokenizer_path()
    key_type = documents.schema[key].dataType
    fields = [T.StructField("doc_id", key_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = ChunkEncoder(path)
        for batch in batches:
            for low in range(0, len(batch), 256):
                rows = batch.iloc[low:low + 256]
                out = []
                for doc, ids in zip(rows["doc_id"], encode([t or "" for t in rows["text"]])):
                    ids += end
                    size = len(ids) // 4
                    begin, first = 0, (size - 1) % capacity + 1
                    for piece in range(-(-size // capacity)):
                        stop = first + piece * capacity
                        part = ids[4 * begin:4 * stop]
                        out.append((doc, piece, begin, stop - begin, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
                        begin = stop
                made = pd.DataFrame(out, columns=[f.name for f in fields])
                if isinstance(key_type, (T.IntegerType, T.LongType)):
                    made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

    return documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(cut, T.StructType(fields))


def best_fit(lengths, capacity: int, most_pieces: int, most_attention: int, rule: str = "norm", weights: Sequence[float] = (1.0, 1.0, 1.0)):
    """Sequence number and offset of each piece, in the given order.  Pieces that no capacity admits get a sequence of their own."""
    room = np.array([capacity, most_pieces, most_attention], float)
    share = np.array(weights, float) / room
    size = max(16, len(lengths))
    left = np.zeros((size, 3))
    number = np.zeros(size, np.int64)
    filled = np.zeros(size, np.int64)
    open_bins = made = 0
    least = min(lengths) if len(lengths) else 0
    into, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        need = np.array([n, 1, n * n], float)
        at = -1
        if open_bins:
            free = left[:open_bins]
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                rest = free[fits]
                score = ((rest - need) * share) ** 2 @ np.ones(3) if rule == "norm" else -((rest * share) @ (need * share))
                at = int(fits[np.argmin(score)])
        if at < 0:
            at = open_bins
            left[at], number[at], filled[at] = room, made, 0
            open_bins, made = open_bins + 1, made + 1
        into[i], offset[i] = number[at], filled[at]
        left[at] -= need
        filled[at] += n
        if (left[at] < (least, 1, least * least)).any():  # nothing fits any more: close it
            open_bins -= 1
            left[at], number[at], filled[at] = left[open_bins], number[open_bins], filled[open_bins]
    return into, offset


def pack_pieces(pieces: DataFrame, capacity: int = 2048, most_pieces: int = 2048, most_attention: int = 2048 * 2048, rule: str = "norm",
                weights: Sequence[float] = (1.0, 1.0, 1.0), documents: int | None = None, bucket: int = 8192) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    Pieces of full length make a sequence each.  The others are dealt evenly over tasks of about ``bucket`` pieces
    and packed there, so one task never holds more; the loss is about one sequence per task.  ``documents`` is the
    number of documents, if known (each has at most one piece shorter than the capacity).
    """
    count = pieces.where(F.col("length") < capacity).count() if documents is None else documents
    tasks = max(1, -(-count // bucket))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        rows = pd.concat(rows) if rows else None
        if rows is None or rows.empty:
            return
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        into, offset = best_fit(rows["length"].tolist(), capacity, most_pieces, most_attention, rule, weights)
        yield rows.assign(sequence_id=into + (TaskContext.get().partitionId() + 1 << 40), offset=offset)

    full = pieces.where(F.col("length") >= capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = full.withColumn("sequence_id", -F.col("sequence_id") - 1)
    return full.unionByName(pieces.where(F.col("length") < capacity).repartition(tasks).mapInPandas(pack, schema))


def pack_documents(documents: DataFrame, capacity: int = 2048, most_pieces: int = 2048, most_attention: int = 2048 * 2048, key: str = "doc_id",
                   text: str = "text", path: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece, with its ids if wanted.

    Null and empty texts are one piece of one token.  Repeated rows and null keys are documents of their own.
    Ties in length go by checksum, then key.  An empty table gives no rows.
    """
    from fieldmanual.llm.common import stored

    pieces = stored(token_pieces(documents, capacity, key, text, path, with_ids=with_ids))
    return pack_pieces(pieces, capacity, most_pieces, most_attention, documents=documents.count(), **options)
