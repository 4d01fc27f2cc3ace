"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

The vocabulary is a piece model: a text gets a leading mark, spaces become marks, and the adjacent pair
whose joined piece ranks lowest is merged until none is left, leftmost first among equals. The count is the
number of initial symbols minus the number of merges; a symbol that is no piece counts its UTF-8 bytes.

No piece has a mark after another character, and some characters are in no longer piece, so a text falls
into chunks that merge apart from each other. Each task remembers the counts of recent chunks (bounded).

Defined cases: NULL and empty texts have 0 tokens; repeated rows are counted each; NULL ids stay; texts of
any length are counted whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rowassay.llm.common import as_bytes, sliced

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def load_ranks(model_file: str) -> dict[str, float]:
    """Rank by piece (lower merges first), without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kept = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    ranks = {model.id_to_piece(i): -model.get_score(i) for i in kept}
    if any(MARK in piece.lstrip(MARK) for piece in ranks):
        raise ValueError("pieces with an inner mark would merge across words")
    return ranks


class ChunkCounts(dict):
    """Token count by chunk; a missing chunk is merged, and the memory is emptied when full."""

    def __init__(self, ranks: dict[str, float], limit: int = 400_000):
        super().__init__()
        self.ranks, self.limit = ranks, limit
        inside = {c for piece in ranks if len(piece) > 1 for c in piece}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in inside))
        self.chunks = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = n = self.merge(chunk)
        return n

    def merge(self, chunk: str) -> int:
        ranks, last = self.ranks, len(chunk)
        if last > 1 and chunk in ranks and last == 2:
            return 1
        piece = list(chunk)
        left, right = list(range(-1, last - 1)), list(range(1, last + 1))
        heap = [(ranks[pair], i, pair) for i, pair in enumerate(map(str.__add__, piece, piece[1:])) if pair in ranks]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if not piece[i] or j >= last or piece[i] + piece[j] != joined:
                continue  # one of the two was merged with another neighbour since
            piece[i], piece[j] = joined, ""
            right[i] = after = right[j]
            merges += 1
            if after < last:
                left[after] = i
                pair = joined + piece[after]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], i, pair))
            before = left[i]
            if before >= 0:
                pair = piece[before] + joined
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], before, pair))
        unknown = sum(len(c.encode()) - 1 for c in piece if len(c) == 1 and c not in ranks)
        return last - merges + unknown

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, self.chunks(MARK + text.replace(" ", MARK)))) if text else 0


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text). The vocabulary is read by the driver."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(model_file))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = ChunkCounts(ranks.value)
        for batch in sliced(batches, "text"):
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([counts.of(t.decode()) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
