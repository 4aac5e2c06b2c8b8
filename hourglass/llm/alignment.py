"""Cross-tokenizer alignment: ends of A and B tokens merged along merge paths, groups cut where both end together.

A text is encoded twice, by a byte-level BPE file (A) and by a sentencepiece model with byte fallback (B).  Each task
lays the token ends of its texts end to end on one byte axis and merges the two sorted lists.  The merge is divided by
diagonals: a binary search on each diagonal finds how many A and B ends lie before it, so that every piece holds the
same number of ends whatever the texts.  A piece looks for the ends that A and B share; a shared end of which the two
halves fall on both sides of a diagonal is stitched from the boundary pieces.  Shared ends cut the tokens into groups,
and each links the last A and the last B token of its group.

How often an id pair is linked in the whole corpus is counted from blocks: the task that encodes a text also sums the
pairs of its block, so a pair that stands in a third of all texts is one row a block.  The totals come back as one row
for each pair and block, and a block's texts are scored against its own pairs.  Nothing that grows with the number of
texts is broadcast; the highest count of each B id is one row per id of the vocabulary.

Tokens of a text: none if it is null or empty, or if the bytes of its A or B tokens don't add up to a space and the
text (a literal U+2581 does that).  Such a text has zeros and no groups.  Repeated rows count and are returned one by
one; a null id is carried along; other columns aren't read; an empty table gives an empty result.  A text may be of any
length, its tokens are held by one task; a block ends with the text that fills it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import Encoder, byte_symbols

SPACE = "▁"  # sentencepiece's sign for a space
PIECE = 1 << 15  # ends in a piece of the merge
BLOCK = 1 << 20  # A tokens in a block
LONG = 64  # characters: longer chunks are encoded anew each time


class Pieces(dict):
    """Chunk between single spaces -> little-endian uint32 ids of a sentencepiece model, which adds the leading space."""

    def __init__(self, path: str, most: int = 250_000):
        super().__init__()
        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # chunks are independent where no piece goes on after a space that follows something else
        self.by_chunk = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
                      for i, p in enumerate(pieces)]

    def plain(self, text: str) -> bytes:
        return np.array(self.model.encode(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.plain(chunk)
        if len(chunk) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or "  " in text or text[0] == " " or text[-1] == " ":
            return self.plain(text)
        return b"".join(map(self.__getitem__, text.split(" ")))


def token_bytes(path: str) -> list[bytes]:
    """Bytes of every entry of a byte-level BPE file, by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    vocabulary, symbols = spec["model"]["vocab"], byte_symbols()
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = entry.encode() if entry in special else bytes(symbols[c] for c in entry)
    return out


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Number of elements of ``a`` among the first ``piece``, 2 ``piece``, ... of the merge (``a`` first among equals)."""
    k = np.arange(piece, len(a) + len(b), piece)
    low, high = np.maximum(0, k - len(b)), np.minimum(k, len(a))
    while (busy := low < high).any():
        mid = (low[busy] + high[busy]) // 2
        before = a[mid] <= b[k[busy] - mid - 1]
        low[busy] = np.where(before, mid + 1, low[busy])
        high[busy] = np.where(before, high[busy], mid)
    return low


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and in ``b`` (both strictly increasing) of their common elements, found piece by piece."""
    i = np.concatenate(([0], diagonals(a, b, piece), [len(a)]))
    j = np.concatenate(([0], np.arange(piece, len(a) + len(b), piece) - i[1:-1], [len(b)]))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:  # a common end cut by the diagonal: stitched
            found.append((np.array([i0 - 1]), np.array([j0])))
        if i0 == i1 or j0 == j1:
            continue
        at = np.minimum(np.searchsorted(b[j0:j1], a[i0:i1]), j1 - j0 - 1)
        same = np.flatnonzero(b[j0:j1][at] == a[i0:i1])
        found.append((same + i0, at[same] + j0))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


class Aligner:
    """Both tokenizers, and the alignment of a run of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a, most=250_000, plain_special=True), Pieces(path_b)
        self.bytes_a, self.bytes_b = token_bytes(path_a), self.b.bytes
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.width = len(self.bytes_b)
        # a token as it is written into the groups, with the mark that follows it
        self.ids = max(len(self.bytes_a), self.width)
        self.code = "<u4" if len(self.bytes_a) * self.width <= 1 << 32 else "<i8"  # holds every pair
        self.written = [b"%d%c" % (i, mark) for mark in b",|;" for i in range(self.ids)]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        if not text or SPACE in text:
            return none, none
        whole = " " + text
        ids_a, ids_b = np.frombuffer(self.a.after_space(text), "<u4"), np.frombuffer(self.b.encode(text), "<u4")
        want = whole.encode("utf-8", "surrogatepass")
        if (b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != want
                or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != want):
            return none, none
        return ids_a.astype(np.int64), ids_b.astype(np.int64)

    def align(self, texts: list[tuple[np.ndarray, np.ndarray]], piece: int = PIECE) -> tuple[list[int], list[bytes], np.ndarray]:
        """Of the tokens of some texts: number of groups and written groups of each, and the pair codes of all links."""
        a, b = (np.concatenate([t[k] for t in texts]) if texts else np.empty(0, np.int64) for k in (0, 1))
        last_a, last_b = shared_ends(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), piece)
        cut_a, cut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        cut_a[last_a] = cut_b[last_b] = 1
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = a + self.ids * cut_a
        line[np.arange(len(b)) + last_a[group_b] + 1] = b + 2 * self.ids * cut_b
        groups, written = [], []
        at = at_a = 0
        for x, y in texts:
            n = len(x) + len(y)
            written.append(b"".join(map(self.written.__getitem__, line[at:at + n].tolist()))[:-1])
            groups.append(int(cut_a[at_a:at_a + len(x)].sum()))
            at, at_a = at + n, at_a + len(x)
        return groups, written, a[last_a] * self.width + b[last_b]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, so that its remembered chunks serve all tasks that the worker runs."""
    return Aligner(path_a, path_b)


def align(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False,
          block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``df``.

    ``groups`` is the alignment itself, ``a1,a2|b1;a3|b2,b3`` in ids; with ``digest`` its SHA-256 takes its place before
    it is written anywhere, for runs that only compare alignments.  ``count_sum`` adds up, over the links of a text, how
    often the pair is linked in all texts; ``n_best`` counts the links to the A id that the B id is linked to most.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, made, size = aligner(path_a, path_b), TaskContext.get().partitionId(), 0, 0
        ids, found = [], []
        id_type = None

        def batch() -> pa.RecordBatch:
            nonlocal made, size
            groups, written, codes = both.align(found)
            cuts = np.cumsum([0, *groups])
            if digest:
                written = [hashlib.sha256(w).hexdigest() if w else "" for w in written]
            n = len(ids)
            distinct, times = np.unique(codes, return_counts=True)
            columns = [
                pa.array([*ids, None], id_type), pa.array([*[len(x) for x, _ in found], None], pa.int64()),
                pa.array([*[len(y) for _, y in found], None], pa.int64()), pa.array([*groups, None], pa.int64()),
                pa.array([*[w if digest else w.decode() for w in written], None], pa.string()),
                pa.array([*[codes[cuts[k]:cuts[k + 1]].astype(both.code).tobytes() for k in range(n)], None], pa.binary()),
                pa.array([None] * n + [distinct], pa.list_(pa.int64())), pa.array([None] * n + [times], pa.list_(pa.int64())),
                pa.array([(task << 32) + made] * (n + 1), pa.int64())]
            ids.clear()
            found.clear()
            made, size = made + 1, 0
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups", "links", "codes", "times",
                                                        "block"])

        for b in batches:
            id_type = b.column(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(d)
                found.append(both.tokens(t.as_py()))
                size += len(found[-1][0]) + 1
                if size >= block:
                    yield batch()
        if ids:
            yield batch()

    # one row for each text, and one that sums the pairs of a block
    rows = stage(docs.mapInArrow(aligned, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups string, links binary, "
                                          "codes array<bigint>, times array<bigint>, block bigint"), "aligned")
    pairs = (rows.where("codes IS NOT NULL").select("block", F.explode(F.arrays_zip("codes", "times")).alias("p"))
             .select("block", F.col("p.codes").alias("code"), F.col("p.times").alias("times")))
    # a pair has one row a block, so its window is as long as there are blocks
    totals = stage(pairs.select("block", "code", F.sum("times").over(Window.partitionBy("code")).alias("total")), "pairs")
    both = aligner(path_a, path_b)
    width, code_type = both.width, both.code
    highest = totals.groupBy((F.col("code") % width).alias("b")).agg(F.max("total").alias("most"))  # one row for each B id
    judged = (totals.withColumn("b", F.col("code") % width).join(F.broadcast(highest), "b")
              .select("block", "code", "total", (F.col("total") == F.col("most")).alias("best")))

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        code, total, best = (known[c].to_numpy() for c in ("code", "total", "best"))
        order = np.argsort(code)
        code, total, best = code[order], total[order], best[order]
        sums, bests = [], []
        for links in texts["links"]:
            at = np.searchsorted(code, np.frombuffer(links.as_py(), code_type))
            sums.append(int(total[at].sum()))
            bests.append(int(best[at].sum()))
        return pa.Table.from_arrays([*(texts[c] for c in ("doc_id", "n_a", "n_b", "n_groups")), texts["n_groups"],
                                     pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), texts["groups"]],
                                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    texts = rows.where("codes IS NULL").drop("codes", "times")
    return (texts.groupBy("block").cogroup(judged.groupBy("block"))
            .applyInArrow(score, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                                 "count_sum bigint, groups string"))
