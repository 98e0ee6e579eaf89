"""Problem 9: documents into containers of fixed capacity.

Hierarchical packing by length: documents are routed to tiers of context sizes (the capacity, its half, its quarter, ...),
each to the shortest window that holds it. Tier by tier, longest first, windows of the tier's size are packed with the
tier's documents and their gaps filled from shorter tiers; the windows are then packed into containers. Containers are
dealt to step groups of even token numbers over the whole spec. Documents are packed in blocks of bounded size, so that
packing is one shuffle whatever the corpus.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm import arrowtext as at
from promptloom.llm import bpe
from promptloom.operators.position import with_running
from promptloom.storage import written

#: Documents that one task packs together; each block leaves at most one container less than half full.
BLOCK_DOCS = 20_000
#: Containers of a step group.
STEP_CONTAINERS = 64
#: Context sizes: the capacity, its half, ...
TIERS = 4


def tier_of(size: np.ndarray, capacity: int, tiers: int = TIERS) -> np.ndarray:
    """The tier of the shortest window that holds each document: windows of tier k have ``capacity >> k``, at least 1."""
    windows = np.maximum(1, capacity >> np.arange(1, tiers))
    return (size[:, None] <= windows[None, :]).sum(axis=1)


class _Stock:
    """Items by size, of which the longest that fits can be taken."""

    def __init__(self, items: list[int], sizes: list[int]):
        self.stacks: dict[int, list[int]] = {}
        for item, size in zip(items, sizes):
            self.stacks.setdefault(size, []).append(item)
        self.keys = sorted(self.stacks)

    def take(self, room: int) -> tuple[int, int] | None:
        k = bisect_right(self.keys, room) - 1
        if k < 0:
            return None
        size = self.keys[k]
        stack = self.stacks[size]
        item = stack.pop()
        if not stack:
            del self.keys[k]
        return item, size


def _fill(stocks: list[_Stock], room: int) -> tuple[list[int], int]:
    """Items for a window, from the first stock as long as one fits, then from the next; and the room left."""
    taken = []
    for stock in stocks:
        while (found := stock.take(room)) is not None:
            taken.append(found[0])
            room -= found[1]
    return taken, room


def pack(sizes: np.ndarray, capacity: int, tiers: int = TIERS) -> np.ndarray:
    """Container of each item; no item is larger than the capacity.

    Each tier's windows take the tier's longest item left, what else of the tier fits, and then what fits of shorter tiers.
    Windows go into containers in the same way: longest first, then the longest that fits. Items of no size go into the first container.
    """
    where = np.zeros(len(sizes), np.int64)
    real = np.flatnonzero(sizes > 0)
    order = real[np.argsort(sizes[real], kind="stable")]
    tier = tier_of(sizes[order], capacity, tiers)
    stocks = [_Stock(order[tier == k].tolist(), sizes[order[tier == k]].tolist()) for k in range(tiers)]
    windows: list[list[int]] = []
    used: list[int] = []
    for k in range(tiers):
        size = max(1, capacity >> k)
        while stocks[k].keys:
            items, room = _fill(stocks[k:], size)
            windows.append(items)
            used.append(size - room)
    whole = _Stock(list(range(len(windows)))[::-1], used[::-1])
    container = 0
    while whole.keys:
        for window in _fill([whole], capacity)[0]:
            where[windows[window]] = container
        container += 1
    return where


def _sizes(tokenizers: list[str], folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [bpe.load(name, folder) for name in tokenizers]
        for batch in batches:
            for a, b in at.slices(batch.column(1)):
                cps, offs = at.to_codepoints(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(t.count(cps, offs)) for t in loaded)], ["doc", *(f"n{k}" for k in range(len(loaded)))])

    return run


_PLACED = T.StructType(
    [T.StructField("spec_id", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField("tier", T.IntegerType())]
    + [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def _pack_block(table: pa.Table) -> pa.Table:
    spec, block, capacity = (table.column(c)[0].as_py() for c in ("spec_id", "block", "capacity"))
    doc, size = table.column("doc").to_numpy(), table.column("size").to_numpy()
    order = np.argsort(doc, kind="stable")  # the result does not depend on the order of arrival
    doc, size = doc[order], size[order]
    pieces = np.maximum(1, -(-size // capacity))
    item = np.repeat(np.arange(len(doc)), pieces)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = piece * capacity
    n = np.minimum(capacity, size[item] - first)
    where = pack(n, capacity)
    wide = np.int64(block) << np.int64(32)
    columns = [np.full(len(item), spec, np.int32), wide + where, tier_of(n, capacity).astype(np.int32), doc[item], piece.astype(np.int32), first, n]
    return pa.table([pa.array(c) for c in columns], names=_PLACED.names)


def pack_documents(df: DataFrame, key: str, text: str, specs: list[tuple[int, str, int]], folder: str = bpe.TOKENIZER_DIR, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Each document, by each of the specs (id, tokenizer, capacity), in containers: ``spec_id, container_id, step_group, tier, doc_id,
    piece, first_token, n_tokens``.

    A text of more tokens than the capacity, and no other, is cut into full pieces and a rest. Null and empty texts
    have no tokens and lie in the first container of their block. Repeated rows are packed each for itself. Containers never hold
    more than their capacity. A row with a null key is left out. ``step_group`` numbers groups of at most STEP_CONTAINERS containers,
    which differ in their tokens by no more than a container or two.
    """
    if any(capacity < 1 for _, _, capacity in specs):
        raise ValueError("a container needs a capacity of at least one token")
    names = sorted({name for _, name, _ in specs})
    docs = df.select(df[key].cast("bigint").alias("doc"), df[text].alias("text")).filter("doc is not null")
    counted = docs.mapInArrow(_sizes(names, folder), T.StructType([T.StructField("doc", T.LongType()), *(T.StructField(f"n{k}", T.LongType()) for k in range(len(names)))]))
    blocks = max(1, -(-df.count() // block_docs))
    each = F.array(*(F.struct(F.lit(i).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity"), F.col(f"n{names.index(t)}").alias("size")) for i, t, c in specs))
    items = counted.select("doc", F.inline(each)).withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)))
    placed = written(items.groupBy("spec_id", "block").applyInArrow(_pack_block, _PLACED), "placed")
    # a container's rows are those of one block
    return placed.join(step_groups(placed), ["spec_id", "container_id"]).select("spec_id", "container_id", "step_group", *_PLACED.names[2:])


def step_groups(placed: DataFrame, most: int = STEP_CONTAINERS) -> DataFrame:
    """``spec_id, container_id, step_group``: containers, fullest first, are dealt to and fro over their spec's groups: like numbers of
    containers and of tokens."""
    containers = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"))
    ranked = with_running(containers, [F.col("spec_id"), F.col("t").desc(), F.col("container_id")], {}, "pos")
    specs = ranked.groupBy("spec_id").agg(F.min("pos").alias("first"), F.ceil(F.count(F.lit(1)) / most).alias("groups"))
    rank = F.col("pos") - F.col("first")
    place = rank % F.col("groups")
    group = F.when(F.floor(rank / F.col("groups")) % 2 == 1, F.col("groups") - 1 - place).otherwise(place)
    return ranked.join(specs, "spec_id").select("spec_id", "container_id", group.cast("bigint").alias("step_group"))


def summary(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """For each spec: documents, pieces of documents that were cut, containers, tokens, the share of the room that is used, and the
    fewest containers that the tokens could fill."""
    full = placed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.sum((F.col("piece") == 0).cast("bigint")).alias("docs"), F.sum((F.col("piece") > 0).cast("bigint")).alias("cuts"))
    by_spec = full.groupBy("spec_id").agg(F.sum("docs").alias("n_docs"), F.sum("cuts").alias("n_cuts"), F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"))
    met = by_spec.join(F.broadcast(specs.select("spec_id", "tokenizer", F.col("capacity_tokens").cast("bigint").alias("capacity"))), "spec_id")
    return met.select(
        "spec_id", "tokenizer", "capacity", "n_docs", "n_cuts", "n_containers", "n_tokens",
        F.round(F.try_divide("n_tokens", F.col("n_containers") * F.col("capacity")), 6).alias("fill"),
        F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"),
    )
