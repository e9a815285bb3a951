"""Filling containers of fixed capacity with items, never splitting one that fits.

Minimum bin slack over lengths. What remains of a group of items is a multiset
of lengths, at most ``capacity`` different ones, so it stays small however many
items there are. A container takes the longest remaining item; a subset-sum
dynamic programme on bitsets (bounded counts split in powers of two) finds the
multiset of remaining lengths that fills the rest closest to capacity, and
counts are read off backwards. That multiset is used as often as the remaining
counts allow, so the number of steps is bounded by lengths too.

Each task packs what it reads, in groups of up to GROUP_ITEMS items, so nothing
is shuffled or collected; the only loss is the last container of a group. An
item longer than the capacity fills whole containers; its rest is an item like
others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .tokens import TOKENIZER_DIR, encode_text, words

#: Lengths the dynamic programme adds, longest first, before it settles for less than a full container.
WINDOW = 64
#: Items a task packs together.
GROUP_ITEMS = 200_000
#: Containers of this capacity at most; larger ones are refused, since the tables would not stay small.
MAX_CAPACITY = 1 << 20


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` with total closest to, and at most, ``room``.

    Lengths are added in the order given, in windows of WINDOW; the search ends
    with the first window that reaches ``room`` exactly or with the last one.
    """
    if room <= 0:
        return {}
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for k, x in enumerate(lengths):
        if x <= room:
            left, part = min(counts[x], room // x), 1
            while left:
                take = min(part, left)
                steps.append((x, take, reach))
                reach |= (reach << (x * take)) & mask
                left, part = left - take, part * 2
        if k % WINDOW == WINDOW - 1 and reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for x, take, before in reversed(steps):
        if not before >> total & 1:  # reachable only with this step
            out[x] = out.get(x, 0) + take
            total -= x * take
    return out


def fill_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(multiset of lengths, number of containers filled with it)], using up all of ``counts``."""
    left = {x: n for x, n in counts.items() if n > 0 and 0 < x <= capacity}
    order = sorted(left, reverse=True)
    out = []
    while order:
        x = order[0]
        left[x] -= 1  # the longest item is in
        used = best_fill(left, [y for y in order if left[y]], capacity - x)
        left[x] += 1
        used[x] = used.get(x, 0) + 1
        times = min(left[y] // n for y, n in used.items())
        for y, n in used.items():
            left[y] -= n * times
        order = [y for y in order if left[y]]
        out.append((used, times))
    return out


def assign(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item index, container, start, tokens) of the pieces of a group; containers count from 0, -1 is none."""
    full = np.where(sizes > capacity, (sizes - 1) // capacity, 0)
    rest = sizes - full * capacity
    # Whole containers of over-long items.
    long = np.flatnonzero(full)
    item = np.repeat(long, full[long])
    piece = np.arange(len(item)) - np.repeat(np.cumsum(full[long]) - full[long], full[long])
    box = np.arange(len(item))
    # The rests: items of one length in order, dealt to the containers that want that length.
    lengths, counts = np.unique(rest[rest > 0], return_counts=True)
    order = np.argsort(rest, kind="stable")
    begin = np.searchsorted(rest[order], lengths)
    free = {int(x): int(k) for x, k in zip(lengths, begin)}
    at, own = len(item), np.full(len(sizes), -1, np.int64)
    for used, times in fill_patterns({int(x): int(n) for x, n in zip(lengths, counts)}, capacity):
        for x, n in used.items():
            k = free[x]
            own[order[k : k + n * times]] = at + np.repeat(np.arange(times), n)
            free[x] = k + n * times
        at += times
    every = np.arange(len(sizes))
    return np.concatenate([item, every]), np.concatenate([box, own]), np.concatenate([piece * capacity, full * capacity]), np.concatenate([np.full(len(item), capacity), rest])


def pack(df: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(container_kind, container_no, id, start_token, n_tokens) for every kind of container.

    Every item is in each kind's result, whole unless it alone exceeds the
    capacity; then its pieces start at multiples of the capacity. Null, empty
    and token-less texts need no room: they have one row with n_tokens 0 and
    container_no null. Kinds with a null or non-positive capacity are left out,
    a repeated kind has its smallest capacity; repeated items are packed each.
    """
    spark = df.sparkSession
    ship(spark)
    kinds = {r.container_kind: int(r.capacity_tokens) for r in containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens")).collect()}
    if any(c > MAX_CAPACITY for c in kinds.values()):
        raise ValueError(f"capacities over {MAX_CAPACITY} tokens are not supported")
    rows = df.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words(tokenizer, folder)
        task = TaskContext.get().partitionId() << 40
        used = dict.fromkeys(kinds, 0)
        ids: list[pa.Array] = []
        sizes: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            names, n = pa.concat_arrays(ids), np.array(sizes, np.int64)
            for kind, cap in sorted(kinds.items()):
                item, box, start, tokens = assign(n, cap)
                number = pa.array(task + used[kind] + box, pa.int64(), mask=box < 0)
                used[kind] += int(box.max(initial=-1)) + 1
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(item), pa.string()), number, names.take(pa.array(item)), pa.array(start, pa.int64()), pa.array(tokens, pa.int64())], names=["container_kind", "container_no", "item", "start_token", "n_tokens"])
            ids.clear(), sizes.clear()

        for b in batches:
            ids.append(b.column(0))
            sizes += [len(encode_text(t, memo)) // 4 for t in b.column(1).to_pylist()]
            if len(sizes) >= GROUP_ITEMS:
                yield from flush()
        if sizes:
            yield from flush()

    return rows.mapInArrow(run, f"container_kind string, container_no bigint, item {id_type}, start_token bigint, n_tokens bigint").withColumnRenamed("item", id_col)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_containers, tokens, slack_share): how much room the containers leave."""
    one = packed.where("container_no is not null").groupBy("container_kind", "container_no").agg(F.sum("n_tokens").alias("t")).groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("t").alias("tokens"))
    caps = containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("c"))
    return one.join(caps, "container_kind").select("container_kind", "n_containers", "tokens", F.round(1 - F.col("tokens") / (F.col("n_containers") * F.col("c")), 6).alias("slack_share"))
