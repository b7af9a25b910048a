"""Hierarchical multi-length packing of tokenized documents.

A task packs windows of about `window_tokens` tokens of its own partition: no shuffle, no state beyond a window. Within a
window
1. every document gives full windows of the longest tier; what is left is routed to the shortest tier that holds it;
2. tiers are packed from long to short; a gap is filled with the longest pieces of shorter tiers that fit, and at last with
   a cut of the shortest piece that doesn't;
3. when nothing is left to fill the last gap, the content is laid out in tiers of powers of two, so nothing is padded;
4. sequences are dealt into step groups, each of one tier and of exactly STEP_TOKENS tokens; a group that a window leaves open
   is filled by the next one, so a task leaves one shorter group a tier at most.

Defined results
* null text is empty; a document is its token ids followed by the end id, so an empty one has a single token;
* a document may be cut anywhere; its pieces are contiguous, do not overlap and cover it;
* rows with a null doc_id or repeated doc_ids are packed as rows of their own; the order of input decides ties;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Context sizes that documents are routed to.
TIERS = (1024, 512, 256, 128)
WINDOW_TOKENS = 1 << 20
STEP_TOKENS = 16 * 1024
END_ID = 0
SPECIAL = "<|endoftext|>"

_tokenizers: dict = {}


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str = "byte_bpe_50k"):
    """text -> ids as the tokenizer file gives them, without special tokens added.

    The same vocabulary read as ranks gives equal ids at a quarter of the time; texts that hold the special token's own
    string go through the tokenizer file, as only that knows it.
    """
    if name not in _tokenizers:
        import base64

        import public_tokenizers
        import tiktoken

        with open(_vocabulary(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full: list = []

        def encode(text: str) -> np.ndarray:
            if SPECIAL not in text:
                return fast.encode_to_numpy(text)
            if not full:
                from tokenizers import Tokenizer

                full.append(Tokenizer.from_file(_vocabulary(f"{name}.json")))
            return np.array(full[0].encode(text, add_special_tokens=False).ids, np.uint32)

        _tokenizers[name] = encode
    return _tokenizers[name]


class Shelf:
    """Pieces by length, with a bit for each length that is there."""

    def __init__(self, longest: int):
        self.of = [[] for _ in range(longest + 1)]
        self.mask = 0

    def add(self, length: int, piece: tuple) -> None:
        self.of[length].append(piece)
        self.mask |= 1 << length

    def take(self, length: int) -> tuple:
        pieces = self.of[length]
        piece = pieces.pop()
        if not pieces:
            self.mask ^= 1 << length
        return piece

    def longest_upto(self, limit: int) -> int:
        return (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def shortest_over(self, limit: int) -> int:
        above = self.mask >> (limit + 1)
        return limit + (above & -above).bit_length() if above else 0


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length), ...]) holding each token of documents of these lengths once."""
    top, out, shelf = tiers[0], [], Shelf(tiers[0])
    for d, n in enumerate(lengths):
        whole = n - n % top
        out.extend((top, [(d, s, top)]) for s in range(0, whole, top))
        if n > whole:
            shelf.add(n - whole, (d, whole))
    while shelf.mask:
        first = shelf.mask.bit_length() - 1
        tier = next(t for t in reversed(tiers) if t >= first)
        d, s = shelf.take(first)
        row, gap = [(d, s, first)], tier - first
        while gap and shelf.mask:
            fits = shelf.longest_upto(gap)
            if fits > 0:
                row.append((*shelf.take(fits), fits))
                gap -= fits
            else:
                n = shelf.shortest_over(gap)
                d, s = shelf.take(n)
                row.append((d, s, gap))
                shelf.add(n - gap, (d, s + gap))
                gap = 0
        if not gap:
            out.append((tier, row))
        else:
            out.extend(_laid_out(row))
    return out


def _laid_out(row: list[tuple[int, int, int]]) -> list:
    """The pieces of a window that stays short, cut into full sequences of powers of two."""
    out, left, queue = [], sum(n for _, _, n in row), list(row)
    for tier in (1 << i for i in reversed(range(left.bit_length()))):
        while left >= tier:
            need, seq = tier, []
            while need:
                d, s, n = queue.pop(0)
                take = min(n, need)
                seq.append((d, s, take))
                if n > take:
                    queue.insert(0, (d, s + take, n - take))
                need -= take
            out.append((tier, seq))
            left -= tier
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _packer(name: str, tiers: tuple[int, ...], window_tokens: int, step_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(name)
        # ids are unique over tasks: 23 bits of partition, 40 of a counter
        base = TaskContext.get().partitionId() << 40
        made, groups, held, ids, tokens = 0, 0, [], [], 0
        steps: dict[int, tuple[int, int]] = {}

        def flush():
            nonlocal made, groups, held, ids, tokens
            rows = []
            for tier, seq in sorted(pack([len(x) for x in held], tiers), key=lambda x: -x[0]):
                if steps.get(tier, (0, 0))[1] + tier > step_tokens or tier not in steps:
                    steps[tier] = (groups, 0)
                    groups += 1
                group, filled = steps[tier]
                steps[tier] = (group, filled + tier)
                at = 0
                for d, s, n in seq:
                    rows.append((ids[d], s, n, zlib.crc32(held[d][s : s + n].tobytes()), len(held[d]), base + made, at, tier, base + group))
                    at += n
                made += 1
            held, ids, tokens = [], [], 0
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                row = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                held.append(row)
                ids.append(doc_id)
                tokens += len(row)
                if tokens >= window_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k", tiers: tuple[int, ...] = TIERS, window_tokens: int = WINDOW_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """documents (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(tokenizer, tiers, window_tokens, step_tokens), SCHEMA)
