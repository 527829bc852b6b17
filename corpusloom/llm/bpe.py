"""Token counts of a piece vocabulary, by merging with a heap and a linked list.

The adjacent pair of the best rank is popped and merged, again and again; a count is the initial symbols
less the merges. No identifiers are made. Characters that are no piece fall back to their bytes.

Nulls: a null text is empty and has no tokens. Repeated rows give repeated results. Texts of any length
are taken whole; other columns aren't carried.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Entries of a worker's memory of counts; beyond, it starts anew, which changes no count.
MEMORY = 1_500_000


def read_pieces(path: str) -> tuple[dict[str, float], bool, bool]:
    """The mergeable pieces with their scores, whether a space is put first, and whether unknown characters become bytes."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or model.trainer_spec.model_type != 2:
        raise ValueError("only byte-pair models with identity normalisation are supported")
    normal = {p.piece: p.score for p in model.pieces if p.type == 1}
    return normal, model.normalizer_spec.add_dummy_prefix, model.trainer_spec.byte_fallback


class PieceCounter:
    """Counts tokens; texts are cut where no piece of the vocabulary spans the cut, and counts of parts are remembered."""

    def __init__(self, path: str):
        self.score, self.prefix, self.fallback = read_pieces(path)
        self.kept: dict[str, int] = {}
        joint = {a + b for p in self.score for a, b in zip(p, p[1:], strict=False)}
        # cuts that no piece spans: around characters of no longer piece, before a space's mark, and after a run of letters
        alone = re.escape("".join(c for c in "\n\t\r" if not any(c in x for x in joint)))
        letter = re.compile(f"[{LETTERS}]")
        if any(x[1] == SPACE != x[0] for x in joint):
            self.cut = None
        elif any(letter.match(x[0]) and not letter.match(x[1]) for x in joint):
            self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        else:
            self.cut = re.compile(f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}{alone}{LETTERS}]+[{LETTERS}]*|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def merged(self, part: str) -> int:
        """The tokens of a part, merged pair by pair."""
        score = self.score
        n = len(part)
        if n == 1:
            return 1 if part in score or not self.fallback else len(part.encode())
        symbol: list[str] = list(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, symbol[i] + symbol[i + 1]) for i in range(n - 1) if (s := score.get(symbol[i] + symbol[i + 1])) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not symbol[i] or j >= n or symbol[i] + symbol[j] != pair:
                continue
            symbol[i], symbol[j] = pair, ""
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (s := score.get(pair + symbol[k])) is not None:
                    heapq.heappush(heap, (-s, i, pair + symbol[k]))
            if (h := before[i]) >= 0 and (s := score.get(symbol[h] + pair)) is not None:
                heapq.heappush(heap, (-s, h, symbol[h] + pair))
        if self.fallback:
            count += sum(len(c.encode()) - 1 for c in symbol if len(c) == 1 and c not in score)
        return count

    def count(self, text: str) -> int:
        """The tokens of a text."""
        if not text:
            return 0
        text = ((" " + text) if self.prefix else text).replace(" ", SPACE)
        parts = self.cut.findall(text) if self.cut else [text]
        kept = self.kept
        try:
            return sum(map(kept.__getitem__, parts))
        except KeyError:
            if len(kept) > MEMORY:
                kept.clear()
            total = 0
            for part in parts:
                n = kept.get(part)
                if n is None:
                    n = self.merged(part)
                    if len(part) <= 64:
                        kept[part] = n
                total += n
            return total


_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; one narrow pass, bounded memory."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, PieceCounter(path))
        for part in parts:
            texts = [x or "" for x in part.column(1).to_pylist()]
            tokens = [counter.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
