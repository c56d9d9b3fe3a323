"""Cost-balanced packing of documents into training sequences.

A piece of l tokens costs LINEAR * l + QUADRATIC * l * l: matrix products grow with the tokens,
attention with their square. Whole sequences are cut off long documents first. What is left of
the documents is packed in blocks: by descending length, each goes to the sequence of lowest cost
that has room for it; where none has, it is cut over the sequences with the most room. A block
opens as few sequences as its tokens need, so at most one sequence a block is lost to padding.

A block is a run of rows of one input partition, up to BLOCK_TOKENS tokens. So there is no
shuffle, memory is bounded, and a lost task is repeated from its input alone.

Token ids are those of `byte_bpe_50k.json` with the `tokenizers` defaults, so a special token's
string in a text is that token. The rank file of the same vocabulary gives the same ids about five
times as fast and serves all texts but those with a run of LONG_RUN white-space characters, on
which its matcher's stack could overflow; these go through the JSON file. The tests compare both.

Edge cases: a null or empty text has the end token only; very long texts are encoded whole; repeated rows are packed as documents of
their own; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import sliced, table

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BLOCK_TOKENS = 4_000_000
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LONG_RUN = re.compile(r"(?<!\s)\s{10000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"


def load_encoder(vocabulary_path: str, ranks_path: str, pattern: str):
    """text -> ids of the vocabulary's JSON file."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    whole = []

    def encode(text: str) -> list[int]:
        if not LONG_RUN.search(text):
            return fast.encode(text, allowed_special="all")
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(vocabulary_path))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def public_encoder():
    """The encoder of the public vocabulary, read on the machine that calls this."""
    import public_tokenizers as public

    return load_encoder(public.path(VOCABULARY), public.path(RANKS), public.PATTERN)


def cost(length, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * length + quadratic * length * length


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a block; sequences count from 0."""
    pieces, rests, sequences = [], [], 0
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            pieces.append((d, start, capacity, sequences, 0))
            sequences += 1
        if n > whole:
            rests.append((n - whole, d, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rests)
    room = np.full(-(-total // capacity), capacity)
    load = np.zeros(len(room))

    def put(d: int, start: int, n: int, k: int) -> None:
        pieces.append((d, start, n, sequences + k, int(capacity - room[k])))
        room[k] -= n
        load[k] += cost(n)

    for n, d, start in rests:
        k = int(np.argmin(np.where(room >= n, load, np.inf)))
        if room[k] >= n:
            put(d, start, n, k)
            continue
        while n:
            k = int(np.argmax(room))
            part = min(n, int(room[k]))
            put(d, start, part, k)
            start, n = start + part, n - part
    return pieces


def pack_rows(doc_ids: list, ids: list[np.ndarray], first_sequence: int, capacity: int) -> tuple[dict, int]:
    """Columns of a packed block and the number of its sequences."""
    pieces = pack_block([len(x) for x in ids], capacity)
    filled: dict[int, int] = {}
    for _, _, n, k, _ in pieces:
        filled[k] = filled.get(k, 0) + n
    columns = {
        "doc_id": [doc_ids[d] for d, *_ in pieces],
        "start": [s for _, s, *_ in pieces],
        "length": [n for _, _, n, *_ in pieces],
        "ids_crc32": [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, *_ in pieces],
        "doc_tokens": [len(ids[d]) for d, *_ in pieces],
        "sequence_id": [first_sequence + k for *_, k, _ in pieces],
        "offset": [o for *_, o in pieces],
        "sequence_tokens": [filled[k] for *_, k, _ in pieces],
        "padded_to": [n if (n := filled[k]) & (n - 1) == 0 else capacity for *_, k, _ in pieces],
    }
    return columns, len(filled)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, encoder=public_encoder) -> DataFrame:
    """One row per piece. `encoder` is called in each task and returns text -> list of ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        base, made = TaskContext.get().partitionId() << 40, 0
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
        doc_ids, ids, held = [], [], 0
        for batch in sliced(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                doc_ids.append(doc_id)
                ids.append(np.array([*encode(text or ""), END_ID], "<u4"))
                held += len(ids[-1])
                if held >= block_tokens:
                    columns, n = pack_rows(doc_ids, ids, base + made, capacity)
                    made += n
                    doc_ids, ids, held = [], [], 0
                    yield pa.RecordBatch.from_pydict(columns, schema)
        if ids:
            yield pa.RecordBatch.from_pydict(pack_rows(doc_ids, ids, base + made, capacity)[0], schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(pack, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
