"""Problem 8: fill containers of fixed capacity by first-fit decreasing.

Items are spread over groups by a hash of their id and a seed; every group is packed by itself, so no task holds more
than about ``group_size`` items (an id and a number each). Inside a group a tournament tree over the remaining room of
the containers finds the first container with room in logarithmic time.

Results for the special cases: an item of size 0 or null size takes no room and goes into the first container of its
group; an item above the capacity is cut into full pieces and a rest, the only case in which an item is split;
equal sizes are placed by id; repeated rows are items of their own; an empty table gives no containers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_SIZE = 20_000


class TournamentTree:
    """Room of up to ``n`` containers; ``place`` puts a size into the first container that has room for it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, n):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> int:
        room, at = self.room, 1
        if size > room[1]:
            raise ValueError("no container has room")
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_no = at - self.leaves
        room[at] -= size
        at //= 2
        while at:
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        self.used = max(self.used, bin_no + 1)
        return bin_no


def pack(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(id, size) to (container, id, piece, start, piece size), first-fit decreasing."""
    pieces = []
    for key, size in items:
        size = size or 0
        full, rest = divmod(size, capacity)
        for k in range(full):
            pieces.append((capacity, key, k, k * capacity))
        if rest or not full:
            pieces.append((rest, key, full, full * capacity))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    tree, out = TournamentTree(len(pieces), capacity), []
    for size, key, piece, start in pieces:
        out.append((tree.place(size), key, piece, start, size))
    return out


def fill_containers(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", n_items: int | None = None, group_size: int = GROUP_SIZE, seed: int = 17) -> DataFrame:
    """Assign every row of ``sizes`` to containers: container_id, ``id_col``, piece_no, start_token, n_tokens.

    ``n_items`` is the number of rows, if known; else the table is counted.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    if n_items is None:
        n_items = sizes.count()
    groups = max(1, -(-n_items // group_size))

    def run(part: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("container_id", pa.int64()), (id_col, pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()))})
        group = part.column(0)[0].as_py()
        rows = pack(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())), capacity)
        bins, ids, piece, start, size = zip(*rows)
        return pa.table({"container_id": pa.array([(group << 32) | b for b in bins], pa.int64()), id_col: pa.array(ids, pa.int64()), "piece_no": pa.array(piece, pa.int32()), "start_token": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int64())})

    keyed = sizes.select(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(groups)).alias("_group"), F.col(id_col).cast("bigint").alias(id_col), F.col(size_col).cast("bigint").alias("_size"))
    return keyed.groupBy("_group").applyInArrow(run, f"container_id bigint, `{id_col}` bigint, piece_no int, start_token bigint, n_tokens bigint")
