"""Documents cut and packed into sequences, first fit decreasing, in randomised groups.

Texts are tokenised, an end id is added, whole sequences are cut off, and the rests go by decreasing
length into the first bin with room, which a tournament tree over the bins' capacities finds. Then the
emptiest bins are dissolved into the gaps of the fullest; what is left of a group is cut into sequences
whose lengths are powers of two, which need no padding.

Groups are drawn by a hash of the row and of the partition that holds it, and have a bounded number of bytes
on average: a row that is repeated ever so often is spread as its partitions are, and a task that runs again
deals its rows as before, in whatever order they come. Nulls and empty texts have the end id alone. Repeated rows are packed
each by itself. A text longer than a sequence spans several; one of more bytes than a group has on average is whole in one.
Other columns aren't carried. An empty table gives no piece.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trim

#: Bytes of text in a group, on average.
GROUP_BYTES = 8 << 20
#: Groups that a task has, on average.
TASK_GROUPS = 4
#: Parts that a worker remembers, and that it keeps from group to group; beyond, it starts anew, which changes no id.
MEMORY, KEPT = 600_000, 100_000
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = tuple(x.split()[0] for x in SCHEMA.split(", "))


class Tournament:
    """Capacities of bins in a tree of maxima: the first bin with room for a size is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for a size, whose capacity then falls."""
        best, i = self.best, 1
        if best[1] < size:
            return -1
        while i < self.leaves:
            i *= 2
            if best[i] < size:
                i += 1
        place = i - self.leaves
        best[i] -= size
        while i > 1:
            i //= 2
            best[i] = max(best[2 * i], best[2 * i + 1])
        return place


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices, each with at most the capacity; sizes are at most the capacity."""
    tree, bins = Tournament(max(1, len(sizes)), capacity), {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins.setdefault(tree.place(sizes[i]), []).append(i)
    return [bins[b] for b in sorted(bins)]


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (index, start, length) that hold each position of each length once."""
    done: list[list[tuple[int, int, int]]] = []
    rest = []
    for i, n in enumerate(lengths):
        whole = n // capacity * capacity
        done += [[(i, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((i, whole, n - whole))
    open_bins = []
    for b in first_fit_decreasing([r[2] for r in rest], capacity):
        pieces = [rest[k] for k in b]
        (done if sum(p[2] for p in pieces) == capacity else open_bins).append(pieces)
    open_bins.sort(key=lambda b: sum(p[2] for p in b))
    spare = [p for b in open_bins for p in reversed(b)][::-1]  # the emptiest bins' pieces at the end
    total = sum(p[2] for p in spare)
    full, left = divmod(total, capacity)
    # the fullest bins stay as they are as long as they are needed; their gaps take pieces of the emptiest
    kept = open_bins[len(open_bins) - full :] if full else []
    loose = [p for b in open_bins[: len(open_bins) - full] for p in b]
    targets = [(b, capacity) for b in reversed(kept)]
    size = capacity
    while left:
        while size > left:
            size //= 2
        targets.append(([], size))
        left -= size
    for pieces, goal in targets:
        gap = goal - sum(p[2] for p in pieces)
        while gap:
            i, s, n = loose.pop()
            if n > gap:
                loose.append((i, s + gap, n - gap))
                n = gap
            pieces.append((i, s, n))
            gap -= n
        done.append(pieces)
    return done


class Ids:
    """Ids of texts by a tokenizer that never joins characters across white space; ids of parts are remembered.

    Plain parts are a word and a run of signs, each a unit of its own with one id that ends it. New units go through
    the vocabulary's merges in one call, without the steps that change nothing on them; a probe of the vocabulary
    shows that. Other parts, and units that don't come back one by one, take the tokenizer's plain way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.plain = re.compile(r"([a-zß-öø-ÿ]*)([.,;:!?#$%&*|()-]*)")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = " ".join(sorted(w for t in vocabulary if (w := t.removesuffix("</w>")) and (m := self.plain.fullmatch(w)) and not (m[1] and m[2])))
        if self._encoded(self.merges, probe) != self._encoded(self.tokenizer, probe):
            self.merges = self.tokenizer

    @staticmethod
    def _encoded(tokenizer: object, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each text's ids begin and the last one's end.

        Texts are cut at ASCII white space, and each distinct part is looked up once. A-Z are lower-cased before,
        as the tokenizer does, but for texts that may have a special token.
        """
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        data = list(map(self.kept.get, distinct))
        missing = [k for k, x in enumerate(data) if x is None]
        if missing:
            found = self.learn([distinct[k] for k in missing])
            for k in missing:
                data[k] = found[distinct[k]]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        known = np.frombuffer(b"".join(data), "<u4")
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = known[np.repeat(begins[which] - done[:-1], n) + np.arange(done[-1])]
        lists = parts.offsets.to_numpy()
        bounds = done[lists - lists[0]]
        ids = np.insert(ids, bounds[1:], end)
        return ids, bounds + np.arange(len(bounds))

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of new parts, which are remembered."""
        if len(self.kept) > MEMORY:
            self.kept.clear()
        kept, match, split, odd, new = self.kept, self.plain.fullmatch, [], [], {}
        for p in parts:
            m = match(p) or match(p.lower() if p.isascii() or p.istitle() else p)
            if not m:
                odd.append(p)
                continue
            word, signs = m.groups()
            if word and word not in kept:
                new[word] = None
            if signs:
                if signs not in kept:
                    new[signs] = None
                split.append((p, word, signs))
            elif p != word:
                split.append((p, word, signs))
        if new:
            ids = np.asarray(self._encoded(self.merges, " ".join(new)), "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(new):
                data = ids.tobytes()
                kept.update(zip(new, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
            else:
                odd, split = parts, []
        kept[""] = b""
        for p, word, signs in split:
            kept[p] = kept[word] + kept[signs]
        if odd:
            for p, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                kept[p] = np.asarray(e.ids, "<u4").tobytes()
        return kept


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's own. A function that is sent to tasks must not name _ids itself, or each task gets a copy of it, empty."""
    return _ids.get(path) or _ids.setdefault(path, Ids(path))


def packed(docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, seed: int = 17, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row for each piece: doc_id and the columns of SCHEMA."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    groups = max(1, -(-(size["n"] or 0) // group_bytes), -(-size["rows"] // 100_000))

    def rows(_: tuple, part: pa.Table) -> pa.Table:
        ids = ids_of(path)
        group = part.column("_group")[0].as_py()
        known = [ids.encode(x, end) for x in part.column("text").chunks]
        tokens = [x[a:b] for x, bounds in known for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out: dict[str, list[int]] = {k: [] for k in _FIELDS}
        doc = []
        for number, pieces in enumerate(pack([len(x) for x in tokens], capacity)):
            offset = 0
            for i, s, n in pieces:
                doc.append(i)
                for k, v in zip(_FIELDS, (s, n, zlib.crc32(tokens[i][s : s + n]), len(tokens[i]), (group << 32) + number, offset), strict=True):
                    out[k].append(v)
                offset += n
        if len(ids.kept) > KEPT:  # workers live on, some of them idle
            ids.kept.clear()
        del known, tokens
        trim()
        return pa.Table.from_arrays([part.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(out[k], pa.int64()) for k in _FIELDS)], names=["doc_id", *_FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"), F.spark_partition_id()), F.lit(groups)).alias("_group")
    tasks = -(-groups // TASK_GROUPS)
    return docs.select("doc_id", "text", drawn).repartition(tasks, "_group").groupBy("_group").applyInArrow(rows, f"doc_id {kind}, {SCHEMA}")
