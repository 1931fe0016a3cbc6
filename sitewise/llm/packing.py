"""Operator 9: best-fit packing of documents into fixed-length sequences.

Only lengths decide where a piece goes, and there are at most ``capacity``
different lengths. So the plan is made on the histogram of lengths: items above
one third of the capacity are matched greedily, at most two to a bin, and
smaller items then best-fit into the gaps, whole runs of equal bins at a time.
The plan's size depends on the capacity and not on the corpus. Pieces then look
up their place by their length and their rank among pieces of that length;
ranks come from per-partition counts, so no length gathers in one task.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed value: the pre-token pattern of byte-level BPE files.
_PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CAPACITY = 2048


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            table[chr(extra)] = b
            extra += 1
    return table


class ByteLevelEncoder:
    """Ids of whole texts as a byte-level BPE file's library gives them.

    Where each merge's result has a larger id than the one before, the merge
    order is the id order and the rank-based encoder gives the same ids several
    times faster; any other file goes through its own library, as do texts that
    the encoder refuses, such as a million blanks.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab["".join(p)] for p in pairs]
        byte = _byte_of_symbol()
        ordered = all(a < b for a, b in zip(made, made[1:])) and min(made, default=0) >= 256 and sorted(vocab[c] for c in byte) == list(range(256))
        if ordered and not spec["normalizer"] and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            import tiktoken

            specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in specials}
            encoding = tiktoken.Encoding("byte-level", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens=specials)
            self._ranked = lambda text: encoding.encode_to_numpy(text, allowed_special="all").tobytes()
        else:
            self._ranked = None
        self._path, self._library = path, None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        if self._ranked:
            try:
                return self._ranked(text)
            except ValueError:  # a run of blanks too long for its pattern's stack
                pass
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placement runs (length, first rank, count, first bin, offset) and the number of bins.

    ``histogram`` maps a length (1 to ``capacity``) to how many items have it.
    Within a length, items of ranks first..first+count-1 go to the bins
    first_bin..first_bin+count-1, each at ``offset``. Large items (above a third
    of the capacity) are taken in falling order; each takes the largest other
    large item that fits beside it. Small items in falling order go to the
    fullest bins that take them, and open new bins when none does.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    n_bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: runs of bins (first, count)
    rooms: list[int] = []

    def place(length: int, count: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], count, first_bin, offset))
        used[length] += count
        left[length] -= count

    def leave(room: int, first_bin: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first_bin, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a] > 0:
            i = bisect_left(large, capacity - a + 1) - 1
            while i >= 0 and (left[large[i]] == 0 or large[i] > a):
                i -= 1
            b = large[i] if i >= 0 else 0
            if b == a and left[a] < 2:
                i -= 1
                while i >= 0 and left[large[i]] == 0:
                    i -= 1
                b = large[i] if i >= 0 else 0
            if not b:
                count = left[a]
                place(a, count, n_bins, 0)
                leave(capacity - a, n_bins, count)
            else:
                count = left[a] // 2 if b == a else min(left[a], left[b])
                place(a, count, n_bins, 0)
                place(b, count, n_bins, a)
                leave(capacity - a - b, n_bins, count)
            n_bins += count

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s] > 0:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                # No gap takes it: open as many bins as its own class fills.
                opened = -(-left[s] // (capacity // s))
                leave(capacity, n_bins, opened)
                n_bins += opened
                continue
            room = rooms[i]
            first_bin, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(i)
            each = room // s
            full, rest = divmod(left[s], each)
            take = min(count, full)
            if take:
                for k in range(each):
                    place(s, take, first_bin, capacity - room + k * s)
                leave(room - each * s, first_bin, take)
            elif rest:
                for k in range(rest):
                    place(s, 1, first_bin, capacity - room + k * s)
                leave(room - rest * s, first_bin, 1)
                take = 1
            leave(room, first_bin + take, count - take)
    return runs, n_bins


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Cut every document into pieces of at most ``capacity`` tokens.

    Per piece: id, piece, start, length, ids_crc32 (and ids as bytes if
    ``keep_ids``), with part and local: the task that cut it and its rank there
    among pieces of its length. A document longer than the capacity is cut from
    its end, so its first piece is the one that may be shorter.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder, part, seen = ByteLevelEncoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows, piece, start, length, crc, local, raw = [], [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                cut, k = n % capacity or capacity, 0
                at = 0
                while at < n:
                    own = ids[4 * at : 4 * cut]
                    rows.append(i), piece.append(k), start.append(at), length.append(cut - at), crc.append(zlib.crc32(own)), local.append(int(seen[cut - at]))
                    if keep_ids:
                        raw.append(own)
                    seen[cut - at] += 1
                    at, cut, k = cut, cut + capacity, k + 1
            cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(local, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "local"]
            if keep_ids:
                cols.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    One row per piece: the id, piece (from 0), start, length, ids_crc32,
    sequence_id, offset (gapless from 0 in each sequence) and, with
    ``keep_ids``, ids: little-endian unsigned 32-bit. A null or empty text is
    the end token alone. Rows with null or repeated ids are packed as rows of
    their own. An empty table gives no rows. Other columns play no part. A text
    of any length is encoded whole.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, keep_ids))

    # How many pieces of each length each task cut: small whatever the texts.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most

    runs, _ = plan_bins(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, first_rank, count, first_bin, offset in runs:
        by_length.setdefault(length, []).append((first_rank, first_bin, offset))
    lookup = {}
    for length, found in by_length.items():
        found.sort()
        lookup[length] = tuple(np.array(x, np.int64) for x in zip(*found))
    shipped = spark.sparkContext.broadcast(lookup)  # bounded by the capacity

    keep = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    at = {c: i for i, c in enumerate([*keep, "rank"])}

    def seat(batches):
        plan = shipped.value
        for b in batches:
            length = b.column(at["length"]).to_numpy(zero_copy_only=False)
            rank = b.column(at["rank"]).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first_rank, first_bin, offset = plan[int(n)]
                k = np.searchsorted(first_rank, rank[own], "right") - 1
                seq[own] = first_bin[k] + rank[own] - first_rank[k]
                off[own] = offset[k]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    ranked = pieces.join(offsets.select("part", "length", "base"), ["part", "length"]).select(*keep, (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(seat, schema).withColumnRenamed("id", id_col)
