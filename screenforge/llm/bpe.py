"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

Short texts are encoded piece by piece: a cut between a character that is no white space and white
space is always a cut of the tokenizer too. A text beyond ``LEAF`` characters is halved until its
parts are short enough; the parts are rows of their own, encoded by many tasks. Neighbours are then
joined level by level: the text of a growing window of tokens around the join is encoded anew until
its edges agree with both sides.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.text import slices
from screenforge.session import checkpointed

#: Characters of a part that is encoded at once; pieces that a worker remembers, and their length.
LEAF, CACHE, CACHED_CHARS = 49_152, 100_000, 40
PIECE = re.compile(r"\s*\S+|\s+")
#: White space to Python alone; a text with one is not cut beside it.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def load(tokenizer_json: str):  # noqa: ANN201
    """The library's tokenizer with truncation and padding off, on one thread: a task has one core."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_str(tokenizer_json)
    t.no_truncation()
    t.no_padding()
    return t


def token_bytes(tokenizer_json: str) -> list[bytes]:
    """Bytes of every token id, by the byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    spec = json.loads(tokenizer_json)
    table = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def _ids(tokenizer, text: str) -> list[int]:  # noqa: ANN001
    return tokenizer.encode(text, add_special_tokens=False).ids


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode_short(tokenizer, text: str, cache: dict[str, bytes]) -> bytes:  # noqa: ANN001
    """Packed ids of a text, piece by piece with a bounded memory of pieces."""
    if ODD_SPACE.search(text):
        return _packed(_ids(tokenizer, text))
    pieces = PIECE.findall(text)
    new = {p for p in pieces if p not in cache}
    if new:
        if len(cache) > CACHE:
            cache.clear()
            new = set(pieces)
        names = list(new)
        fresh = {n: _packed(e.ids) for n, e in zip(names, tokenizer.encode_batch_fast(names, add_special_tokens=False), strict=True)}
        cache.update((n, v) for n, v in fresh.items() if len(n) <= CACHED_CHARS)
        get = cache.get
        return b"".join([fresh[p] if (v := get(p)) is None else v for p in pieces])
    return b"".join(map(cache.__getitem__, pieces))


def _hard(left: str, right: str) -> bool:
    """Is there always a cut between these neighbouring characters?"""
    return not left.isspace() and right.isspace() and not ODD_SPACE.match(right) and not ODD_SPACE.match(left)


def join(tokenizer, table: list[bytes], left: list[int], right: list[int], start: int = 8) -> list[int]:  # noqa: ANN001
    """Ids of the joined text from the ids of its two halves.

    The window takes ``start`` tokens of either side, then twice as many, until each edge is one
    where both sides surely agree: the end of the text, a cut before white space, or - inside a run
    of letters - neighbours that stay the same two tokens when their joint text is encoded.
    """

    def text_of(ids: list[int]) -> str | None:
        try:
            return b"".join(table[i] for i in ids).decode()
        except UnicodeDecodeError:
            return None

    def agrees(a: int, b: int) -> bool:
        x, y = text_of([a]), text_of([b])
        if x is None or y is None:
            return False
        if _hard(x[-1], y[0]):
            return True
        return y.isalpha() and x.strip(" ").isalpha() and len(x) - len(x.lstrip(" ")) <= 1 and _ids(tokenizer, x + y) == [a, b]

    n = start
    while True:
        lo, hi = max(0, len(left) - n), min(len(right), n)
        window = text_of(left[lo:] + right[:hi])
        if window is not None:
            middle = _ids(tokenizer, window)
            if (lo == 0 or (middle and agrees(left[lo - 1], middle[0]))) and (hi == len(right) or (middle and agrees(middle[-1], right[hi]))):
                return left[:lo] + middle + right[hi:]
        elif lo == 0 and hi == len(right):
            raise ValueError("the halves are not the ids of texts")
        n *= 2


def halves(text: str, leaf: int = LEAF) -> list[str]:
    """Parts of at most ``leaf`` characters by repeated halving, in order."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def concatenate(tokenizer, table: list[bytes], parts: list[list[int]]) -> list[int]:  # noqa: ANN001
    """Ids of the whole text from the ids of its parts, joined in pairs level by level."""
    while len(parts) > 1:
        parts = [join(tokenizer, table, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


_STATE: dict[str, tuple] = {}
_TABLE: dict[str, list[bytes]] = {}


def _table(token: str, tokenizer_json: str) -> list[bytes]:
    if token not in _TABLE:
        _TABLE.clear()
        _TABLE[token] = token_bytes(tokenizer_json)
    return _TABLE[token]


def _state(token: str, tokenizer_json: str) -> tuple:
    if token not in _STATE:
        _STATE.clear()
        _STATE[token] = (load(tokenizer_json), _table(token, tokenizer_json), {})
    return _STATE[token]


def encode(docs: DataFrame, tokenizer_json: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids): packed little-endian 32-bit ids of every whole text, as the library encodes it.

    Null texts are empty and have no ids. Repeated rows are encoded each; a null doc_id is kept;
    only doc_id and text are read. A text with an unpaired surrogate cannot come from a Spark string.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    token = uuid.uuid4().hex
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _, cache = _state(token, shared.value)
        for b in slices(batches):
            ids = [encode_short(tokenizer, t, cache) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            for doc, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                parts = halves(text, leaf)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(parts), pa.int64()), "row": pa.array([row] * len(parts), pa.int64()), "part": pa.array(range(len(parts)), pa.int32()), "text": parts})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _, _ = _state(token, shared.value)
        for b in slices(batches, 16):
            ids = [_packed(_ids(tokenizer, t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("part"), pa.array(ids, pa.binary())], names=["doc_id", "row", "part", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, table, _ = _state(token, shared.value)
        for b in slices(batches, 16):
            ids = [_packed(concatenate(tokenizer, table, [np.frombuffer(p["ids"], "<u4").tolist() for p in x])) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    long = F.length("text") > leaf
    brief = rows.where(~long).mapInArrow(short, "doc_id long, n_tokens long, ids binary")
    # the parts get their row numbers where they are made and are written before they are dealt out
    leaves = checkpointed(rows.where(long).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text").mapInArrow(split, "doc_id long, row long, part int, text string"))
    n = leaves.count()
    if n == 0:
        return brief
    dealt = leaves.repartition(max(2, n // 64), F.xxhash64("row", "part")).mapInArrow(parts, "doc_id long, row long, part int, ids binary")
    tree = dealt.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return brief.unionByName(tree.select("doc_id", "parts").mapInArrow(joined, "doc_id long, n_tokens long, ids binary"))


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the text of the ids, special tokens included; broken UTF-8 is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(token, shared.value)
        for b in slices(batches):
            text = [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())).decode(errors="replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded texts."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
