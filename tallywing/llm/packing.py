"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to tiers by length: each gives whole windows of the longest tier, and its rest
goes to the tier of the smallest power of two that holds it. Each tier is packed longest first into
windows of its size; the gaps are filled from shorter tiers, cutting the last piece to fit. What is
left at the end becomes windows of ever smaller powers of two, so that only full windows remain.
Windows are dealt to step groups of about equal token counts.

A task packs one chunk of documents after another; chunks are bounded, so is the memory of a task,
and no rows are moved between tasks. Every chunk's waste is nil, so that smaller chunks cost cuts,
not padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices
from .tokens import default_path, encoder

WINDOW, SMALLEST, STEP_TOKENS = 4096, 256, 1 << 16
END = 2
CHUNK_BYTES = 2 << 20


def pack(lengths: np.ndarray, window: int = WINDOW, smallest: int = SMALLEST) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (tier, pieces), a piece being (document, start, length); every id lies in exactly one piece.

    Each window is filled to its last place and is a power of two of ids long.
    """
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests: dict[int, list[tuple[int, int, int]]] = {}  # tier: (length, document, start), ascending
    for doc, n in enumerate(lengths.tolist()):
        at = 0
        while n - at >= window:
            windows.append((window, [(doc, at, window)]))
            at += window
        if n > at:
            tier = max(smallest, 1 << (n - at - 1).bit_length())
            rests.setdefault(tier, []).append((n - at, doc, at))
    for rest in rests.values():
        rest.sort()
    tiers = sorted(rests, reverse=True)
    for tier in tiers:
        own = rests[tier]
        while own:
            length, doc, at = own.pop()
            pieces, gap = [(doc, at, length)], tier - length
            while gap:
                found = _fitting(rests, tiers, tier, gap)
                if found is None:
                    break
                length, doc, at = found
                used = min(length, gap)
                pieces.append((doc, at, used))
                gap -= used
                if length > used:
                    left = (length - used, doc, at + used)
                    smaller = max(smallest, 1 << (length - used - 1).bit_length())
                    if smaller not in rests:
                        rests[smaller] = []
                        insort(tiers, smaller, key=lambda t: -t)
                    insort(rests[smaller], left)
            if not gap:
                windows.append((tier, pieces))
                continue
            # nothing is left to fill with: windows of smaller powers of two
            size = tier
            while pieces:
                total = sum(p[2] for p in pieces)
                size = 1 << (total.bit_length() - 1)
                head, need = [], size
                while need:
                    doc, at, n = pieces.pop(0)
                    used = min(n, need)
                    head.append((doc, at, used))
                    need -= used
                    if n > used:
                        pieces.insert(0, (doc, at + used, n - used))
                windows.append((size, head))
    return windows


def _fitting(rests: dict, tiers: list[int], tier: int, gap: int):
    """The longest rest that fits the gap whole, else the shortest one of the tier itself or below, to be cut."""
    best = None
    for t in tiers:
        if t > tier or not rests[t]:
            continue
        at = bisect_right(rests[t], (gap, float("inf"), 0)) - 1
        if at >= 0 and (best is None or rests[t][at][0] > best[0][at_][0]):
            best, at_ = (rests[t], t), at
            if rests[t][at][0] == gap:
                break
    if best is not None:
        return best[0].pop(at_)
    for t in reversed(tiers):
        if t <= tier and rests[t]:
            return rests[t].pop(0)
    return None


def _step_groups(sizes: list[int], step: int = STEP_TOKENS) -> list[int]:
    """A group for each window: longest first, always to the group with the fewest ids so far."""
    import heapq

    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def _packer(path: str, key_type: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 34
        windows_before = groups_before = 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                ids, off = encoder(path).encode(part.column("text"), END)
                lengths = np.diff(off)
                windows = pack(lengths)
                groups = _step_groups([w[0] for w in windows])
                doc, start, length, window, at, tier, group = [], [], [], [], [], [], []
                for n, (size, pieces) in enumerate(windows):
                    place = 0
                    for d, s, k in pieces:
                        doc.append(d), start.append(s), length.append(k), window.append(n), at.append(place), tier.append(size), group.append(groups[n])
                        place += k
                flat = ids.astype("<u4")
                begin = off[doc] + np.array(start)
                crc = [zlib.crc32(flat[b : b + k]) for b, k in zip(begin.tolist(), length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                        pa.array(lengths[doc], pa.int64()), pa.array(np.array(window, np.int64) + first + windows_before), pa.array(at, pa.int64()), pa.array(tier, pa.int32()),
                        pa.array(np.array(group, np.int64) + first + groups_before),
                    ],
                    ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"],
                )
                windows_before, groups_before = windows_before + len(windows), groups_before + max(groups, default=-1) + 1

    return run


def pack_documents(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null or empty text is a document of its end id only. Repeated rows are packed each, a null key
    stays null, and a very long text is cut into as many pieces as it needs. An empty table gives no
    pieces. Other columns, whatever their names, are not read. sequence_id is the task's number and
    a count in it.
    """
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = documents.schema[key].dataType.simpleString()
    out = bounded_batches(rows).mapInArrow(
        _packer(path or default_path(), None),
        f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long",
    )
    return out.withColumnRenamed("key", key)
