"""Best-fit packing of tokenised documents by swap-based local search.

Documents become pieces of at most 4096 tokens. Pieces are dealt by hash to blocks of bounded size. A block starts
from best-fit decreasing and then improves its underfull bins: it moves a document, exchanges one for one or two
for one between two bins whenever that raises the sum of squared fills, until bins empty. Full bins are done; the
pieces of underfull bins go to fewer blocks of the next round, until one block holds them or a round no longer helps.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, small_batches

CAPACITY = 4096
END_ID = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Chunks whose ids a task keeps at most; past that it starts anew.
MEMO_CHUNKS = 100_000
BLOCK_ROWS = 20_000
#: A bin with no more free tokens than this is full.
SLACK = CAPACITY // 512


#: Chunks of printable ASCII and precomposed Latin letters: normal form and lower case are per character there.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The words that the tokenizer cuts a lower-case Latin chunk into.
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


class ChunkEncoder:
    """Token ids of texts, from the ids of their chunks between white space.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids in a row. Chunks of
    Latin letters are cut into words here and only new words go to the tokenizer's model; others go through
    the whole tokenizer. Control characters that Python, but not the tokenizer, takes for white space make a
    text go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.byte_chars = {chr(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in [*range(0x21, 0x7F), *range(0xC0, 0x180)]}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelled = word if word.isascii() else "".join(map(self.byte_chars.__getitem__, word))
            found = self.words[word] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole([text])[0]
        chunks = text.split()
        known = self.chunks
        new = [c for c in set(chunks) if c not in known]
        if new:
            if len(known) + len(new) > MEMO_CHUNKS:
                self.words, self.chunks = {}, (known := {})
                new = list(set(chunks))
            other = []
            for c in new:
                if LATIN.fullmatch(c):
                    known[c] = b"".join(map(self.word, LATIN_WORDS.findall(c.lower())))
                else:
                    other.append(c)
            if other:
                known.update(zip(other, self.whole(other)))
        return b"".join(map(known.__getitem__, chunks))


def tokenize_pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): one row per piece.

    A document is its ids and then id 1, cut into pieces of capacity tokens, the last one shorter; so null and
    empty texts are one piece of one token. Repeated rows give repeated pieces. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkEncoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows, out, parts, held = [], [], [], 0

            def done() -> pa.RecordBatch:
                columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]]
                return pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.list_(pa.int64()))] * with_ids, names)

            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                ids = (encoder.encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        parts.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
                        held += len(part)
                if held > MEMO_CHUNKS:
                    yield done()
                    rows, out, parts, held = [], [], [], 0
            if rows:
                yield done()

    small_batches(docs)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers. A bit per free size that some bin has finds the tightest fit."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    sizes = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = sizes >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                sizes &= ~(1 << free)
        else:
            free, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        by_free.setdefault(free - n, []).append(k)
        sizes |= 1 << (free - n)
    return bins


def best_trade(giver: list[int], taker: list[int], free: int, gap: int, lengths: np.ndarray) -> tuple[int, list[int], list[int]] | None:
    """The trade that brings the taker the most tokens within its free ones: (gain, rows to the taker, rows back).

    Squared fill rises when the gain exceeds gap, the giver's fill less the taker's.
    """
    best = None

    def offer(gain: int, to: list[int], back: list[int]) -> None:
        nonlocal best
        if max(gap, 0) < gain <= free and (best is None or gain > best[0]):
            best = (gain, to, back)

    small = sorted(giver, key=lambda i: lengths[i])
    sizes = lengths[small]
    at = int(np.searchsorted(sizes, free, side="right")) - 1
    if at >= 0:
        offer(int(sizes[at]), [small[at]], [])
    for back in taker:
        room = free + int(lengths[back])
        at = int(np.searchsorted(sizes, room, side="right")) - 1
        if at >= 0:
            offer(int(sizes[at] - lengths[back]), [small[at]], [back])
        i, j, pair = 0, len(small) - 1, None
        while i < j:  # two for one: the heaviest pair within the room
            two = int(sizes[i] + sizes[j])
            if two > room:
                j -= 1
            else:
                if pair is None or two > pair[0]:
                    pair = (two, [small[i], small[j]])
                i += 1
        if pair:
            offer(pair[0] - int(lengths[back]), pair[1], [back])
    return best


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, partners: int = 8, max_passes: int = 20) -> list[list[int]]:
    """Raise the sum of squared fills by trades between underfull bins until none helps or the bins are as few as can be."""
    fill = [int(lengths[b].sum()) for b in bins]
    least = -(-sum(fill) // capacity)
    for _ in range(max_passes):
        order = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: (-fill[k], k))
        if sum(1 for b in bins if b) <= least or len(order) < 2:
            break
        changed = False
        givers = order[::-1][:partners]
        for taker in order:
            for giver in givers:
                if giver == taker or not bins[giver] or not bins[taker] or fill[giver] > fill[taker]:
                    continue
                trade = best_trade(bins[giver], bins[taker], capacity - fill[taker], fill[giver] - fill[taker], lengths)
                if trade is None:
                    continue
                gain, to, back = trade
                bins[giver] = [i for i in bins[giver] if i not in to] + back
                bins[taker] = [i for i in bins[taker] if i not in back] + to
                fill[giver] -= gain
                fill[taker] += gain
                changed = True
                if fill[taker] == capacity:
                    break
        if not changed:
            break
    return [b for b in bins if b]


def pack_block(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return improve(best_fit_decreasing(lengths, capacity), lengths, capacity)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, seed: int = 3) -> DataFrame:
    """Adds sequence_id and offset to pieces: no sequence exceeds capacity, offsets are gapless from 0.

    Pieces of full length are sequences of their own. Ties of length fall by the order of doc_id (as text) and piece.
    Bins with SLACK tokens or fewer left are done, and the rest packed anew in fewer blocks. Where that no longer helps, bins
    more than half full are done; what is left then comes down to one block, so that no two bins could be one.
    An empty table gives no rows.
    """
    keys = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    id_kind = pieces.schema["doc_id"].dataType.simpleString()
    pieces = pieces.withColumn("doc_id", F.col("doc_id").cast("string"))  # whole in pandas, beside nulls too
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", sequence_id long, offset long, filled boolean"
    done = []
    left, before, round_no, slack = cut_lineage(pieces), None, 0, SLACK
    while True:
        n = left.count()
        n_blocks = max(1, -(-n // block_rows))
        last = n_blocks == 1
        if before is not None and n > 0.7 * before:
            slack = capacity // 2 - 1
        # the low bits of sequence_id number a block's bins, the next ones the block, the top ones the round
        base = round_no << 56

        def solve(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
            lengths = block["length"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
            filled = np.zeros(len(block), bool)
            start = base + (int(block["block"].iloc[0]) << 24)
            for k, rows in enumerate(pack_block(lengths, capacity)):
                sizes = lengths[rows]
                sequence[rows], offset[rows] = start + k, np.cumsum(sizes) - sizes
                filled[rows] = capacity - int(sizes.sum()) <= slack
            return block[keys].assign(sequence_id=sequence, offset=offset, filled=filled)

        block = F.pmod(F.xxhash64(F.lit(seed + round_no), "doc_id", "piece", "ids_crc32"), F.lit(n_blocks))
        packed = left.withColumn("block", block).groupBy("block").applyInPandas(solve, schema)
        if last:
            done.append(packed.drop("filled"))
            break
        packed = cut_lineage(packed)
        done.append(packed.where("filled").drop("filled"))
        left, before, round_no = packed.where("not filled").select(*keys), n, round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_kind))


def pack_documents(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    return pack_pieces(tokenize_pieces(docs, path, capacity), capacity)
