"""Token counts by heap-and-linked-list byte-pair merging.

The text is cut into units that no piece of the vocabulary can span (a run of word marks with what follows it).
Within a unit the characters are symbols in a linked list; a heap gives the adjacent pair of lowest rank again and
again, the leftmost of equal ranks first. No identifiers are made: the count is the initial symbols less the merges.

Null text counts as empty (0 tokens), a null doc_id is carried along, repeated rows give repeated results and an empty
table gives an empty one. A text of any length is processed whole; a word of any length takes O(n log n).
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame

from tersely.llm.common import column_bytes, id_text, per_batch

MARK = "▁"
#: Entries of the memo of units that each Python worker keeps; it is emptied when full, so its memory is bounded.
MEMO_ENTRIES = 1_000_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Counts the tokens of a sentencepiece byte-pair model with identity normalisation."""

    def __init__(self, model_path: str, memo_entries: int = MEMO_ENTRIES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation are supported")
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.vocab_size())
        if any(model.is_unused(i) for i in ids) or any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with unused or user-defined pieces are not supported")
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
        self.fallback = proto.trainer_spec.byte_fallback
        self.prefix = spec.add_dummy_prefix
        if any(MARK in piece.lstrip(MARK) or (piece[:2] == MARK * 2 and piece.strip(MARK)) for piece in self.rank):
            raise ValueError("a piece spans words")
        #: Two characters that no piece holds side by side never merge, so units end between them too.
        self.beside = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.costs = {c: 1 for c in self.rank if len(c) == 1}
        self.memo: dict[str, int] = {}
        self.memo_entries = memo_entries

    def cost(self, char: str) -> int:
        """Symbols that a character stands for before any merge: its bytes where the vocabulary lacks it."""
        return self.costs.get(char) or (len(char.encode()) if self.fallback else 1)

    def merged(self, unit: str) -> int:
        """Tokens of a unit by merging."""
        n, rank, known, pop, push = len(unit), self.rank, self.costs, heapq.heappop, heapq.heappush
        symbols: list[str] = list(unit)
        costs = [known.get(c) or self.cost(c) for c in symbols]
        count = sum(costs)
        heap = [(rank[pair], i, pair) for i in range(n - 1) if (pair := unit[i : i + 2]) in rank]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, pair = pop(heap)
            if not (left := symbols[i]) or (j := after[i]) >= n or left + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            count -= costs[i] + costs[j] - 1
            symbols[i], symbols[j], costs[i] = pair, "", 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in rank:
                    push(heap, (rank[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in rank:
                push(heap, (rank[new], h, new))
        return count

    def unit(self, unit: str) -> int:
        """Tokens of a unit: the sum over its parts, each from the memo if it is there."""
        n, at, size, memo, beside = 0, 0, len(unit), self.memo, self.beside
        for i in range(1, size + 1):
            if i == size or unit[i - 1 : i + 1] not in beside:
                part = unit[at:i]
                if (known := memo.get(part)) is None:
                    known = self.merged(part)
                    if len(part) <= 64:
                        if len(memo) >= self.memo_entries:
                            memo.clear()
                        memo[part] = known
                n += known
                at = i
        return n

    def count(self, text: str) -> int:
        """Tokens of a text, without begin, end or added special tokens."""
        if not text:
            return 0
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        words = text.split(MARK)
        memo, unit = self.memo, self.unit
        total = unit(words[0]) if words[0] else 0
        run = 1
        for word in words[1:]:
            if word:
                key = MARK * run + word
                n = memo.get(key)
                total += unit(key) if n is None else n
                run = 1
            else:
                run += 1
        return total + (unit(MARK * (run - 1)) if run > 1 else 0)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id, n_bytes, n_tokens, over_limit` (more tokens than `limit`). No shuffle."""

    def make():
        counter = PieceCounter(model_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = column_bytes(batch, "text")
            tokens = [counter.count(t.decode()) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    return id_text(docs, id_col, text_col).mapInArrow(per_batch(make), SCHEMA)
