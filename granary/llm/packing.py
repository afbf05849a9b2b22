"""Problem 9: filling containers of fixed capacity with texts measured in tokens.

All texts are reduced to a histogram of sizes, which has at most ``capacity`` entries
however many texts there are. Bin completion with branch and bound runs on that histogram:
the undominated fillings around the largest size that is left are the branches, each repeated
as often as the histogram allows or once, and the search goes back over containers already
closed as long as a bound leaves room for a better plan. The best-fit plan is the incumbent.
Each text then gets its container from its rank among the texts of its size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.arrow import map_columns

Plan = list[tuple[int, list[int]]]


def _counts(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Number of items of each size from 0 to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    return counts


def _bound(counts: np.ndarray) -> int:
    """The waste bound L2: for each threshold, items above capacity - threshold are alone, and items above half the capacity share with no other
    such item; what small items from the threshold on do not fit in the room beside those needs containers of its own."""
    capacity = len(counts) - 1
    half = capacity // 2
    n, w = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    top = capacity - np.arange(half + 1)  # for the thresholds 0 to half
    big, mid = n[-1] - n[top], n[top] - n[half]
    small = w[half] - np.concatenate(([0], w[:half]))
    free = mid * capacity - (w[top] - w[half])
    return int((big + mid + np.maximum(0, -((free - small) // capacity))).max())


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs."""
    return _bound(_counts(histogram, capacity))


def dominated(chosen: tuple[int, ...], room: int, counts: dict[int, int]) -> bool:
    """Whether an item left over may replace some of the chosen ones of no more size, or stand in the room, so that as much is filled by no more items."""
    singles = several = 0  # sums of one chosen item, and of two and more, as bits
    for s in chosen:
        several |= several << s | singles << s
        singles |= 1 << s
    mask = (1 << room + 1) - 1
    for x, n in counts.items():
        if n > chosen.count(x) and (x <= room or several >> x - room & mask or singles >> x - room & mask >> 1):
            return True
    return False


def fillings(left: int, sizes: list[int], counts: dict[int, int], steps: int) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``left`` from the sizes on hand, large sizes first, until ``steps`` branches are used up; -1 sets no limit.

    A branch is left when it must end with room for a size that it passed over: with that size the same filling is fuller.
    """
    most = np.cumsum([s * counts[s] for s in sizes]).tolist()  # what sizes up to each place can fill at most
    stack: list[tuple[int, int, int, tuple[int, ...]]] = [(left, len(sizes) - 1, left + 1, ())]
    while stack and steps:
        free, top, passed, chosen = stack.pop()
        steps -= 1
        top = min(top, bisect.bisect_right(sizes, free) - 1)
        if top < 0:
            if free < passed and not dominated(chosen, free, counts):
                yield chosen
            continue
        if free - most[top] >= passed:
            continue
        size = sizes[top]
        on_hand = counts[size] > chosen.count(size)
        stack.append((free, top - 1, min(passed, size) if on_hand else passed, chosen))
        if on_hand:
            stack.append((free - size, top, passed, (*chosen, size)))


def complete(left: int, sizes: list[int], counts: dict[int, int], nodes: int) -> list[int]:
    """The fullest undominated filling of ``left`` from the sizes on hand.

    Depth-first from large to small sizes, so the best-fit filling is met first and is the incumbent. A branch is pruned by its waste bound:
    when all that is left of smaller sizes cannot bring the waste below the incumbent's. It is pruned as dominated when it must end with
    room for a size that it passed over: with that size added the same filling wastes less. Ends at the first filling without waste, or
    after ``nodes`` branches with the incumbent.
    """
    most = np.cumsum([s * counts[s] for s in sizes]).tolist()  # what sizes up to each place can fill at most
    best: list[int] = []
    best_waste = left
    stack: list[tuple[int, int, int, tuple[int, ...]]] = [(left, len(sizes) - 1, left + 1, ())]
    while stack and nodes:
        free, top, passed, chosen = stack.pop()
        nodes -= 1
        if free < best_waste:
            best_waste, best = free, list(chosen)
            if not free:
                break
        top = min(top, bisect.bisect_right(sizes, free) - 1)
        if top < 0 or free - most[top] >= min(best_waste, passed):
            continue
        size = sizes[top]
        on_hand = counts[size] > chosen.count(size)
        if top:
            stack.append((free, top - 1, min(passed, size) if on_hand else passed, chosen))
        if on_hand:
            stack.append((free - size, top, passed, (*chosen, size)))
    return best


class Completion:
    """Branch and bound over containers.

    A branch closes one container, or as many equal ones as the histogram allows, around the largest size that is left. It is given up when the
    containers closed so far and the waste bound of what is left reach the incumbent, or when what is left was met before with no more
    containers closed. The search ends when the incumbent meets the bound of the whole, when no branch is left (then the plan is optimal), or
    after ``budget`` branches. With a budget, the fillings tried at one place are those met within ``per_filling`` steps; None sets neither limit.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, incumbent: Plan, budget: int | None, per_filling: int = 4000):
        self.capacity, self.per_filling = capacity, per_filling
        self.left = _counts(histogram, capacity)
        self.best, self.number = incumbent, sum(times for times, _ in incumbent) + 1  # an equally good plan replaces it
        self.goal = _bound(self.left)
        self.steps = -1 if budget is None else budget
        self.met: dict[bytes, int] = {}

    def options(self) -> Iterator[tuple[int, list[int]]]:
        """Fillings for the largest size left with their repetitions: the fullest one first, then all undominated ones by waste."""
        sizes = np.flatnonzero(self.left).tolist()
        counts = dict(zip(sizes, self.left[sizes].tolist()))
        first = sizes[-1]
        counts[first] -= 1
        rest = sizes if counts[first] else sizes[:-1]
        room = self.capacity - first
        fullest = tuple(complete(room, rest, counts, self.per_filling))
        yield from self.repeated(first, fullest)
        others = fillings(room, rest, counts, -1 if self.steps < 0 else self.per_filling)
        for chosen in sorted((c for c in others if c != fullest), key=lambda c: (-sum(c), len(c), [-s for s in c])):
            yield from self.repeated(first, chosen)

    def repeated(self, first: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, list[int]]]:
        filling = [first, *chosen]
        times = min(int(self.left[s]) // filling.count(s) for s in set(filling))
        yield times, filling
        if times > 1:
            yield 1, filling

    def put(self, times: int, filling: list[int], sign: int) -> None:
        for s in filling:
            self.left[s] -= sign * times

    def run(self) -> Plan:
        path: list[tuple[int, list[int]]] = []
        closed = 0
        stack = [self.options()] if self.left.any() else []
        while stack and self.number > self.goal:
            option = next(stack[-1], None) if self.steps else None
            if option is None:
                stack.pop()
                if path:
                    times, filling = path.pop()
                    self.put(times, filling, -1)
                    closed -= times
                continue
            self.steps -= 1
            times, filling = option
            self.put(times, filling, 1)
            path.append(option)
            closed += times
            state = self.left.tobytes() if self.capacity < 64 else hash(self.left.tobytes()).to_bytes(8, "big", signed=True)
            if not self.left.any():
                if closed < self.number:
                    self.best, self.number = list(path), closed
            elif closed + _bound(self.left) < self.number and self.met.get(state, closed + 1) > closed:
                self.met[state] = closed
                stack.append(self.options())
                continue
            path.pop()
            self.put(times, filling, -1)
            closed -= times
        return self.best


def plan_by_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit decreasing over the histogram: containers of equal room and content are one entry with a count."""
    rooms: list[int] = []  # ascending
    groups: dict[int, list[tuple[int, list[int]]]] = {}

    def put(room: int, times: int, filling: list[int]) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((times, filling))

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n > 0:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                # No room anywhere: as many new containers as these items fill, all alike but for the last.
                each = capacity // size
                full, over = divmod(n, each)
                if full:
                    put(capacity - each * size, full, [size] * each)
                if over:
                    put(capacity - over * size, 1, [size] * over)
                break
            room = rooms[at]
            times, filling = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            used = min(times, n)
            if times > used:
                put(room, times - used, filling)
            put(room - size, used, [*filling, size])
            n -= used
    return [entry for entries in groups.values() for entry in entries]


def plan_fillings(histogram: dict[int, int], capacity: int, budget: int | None = 3_000) -> Plan:
    """[(repetitions, sizes of one container)] that use up the whole histogram, by bin completion with the best-fit plan as incumbent.

    With ``budget`` None the plan is optimal, whatever time that takes; else the search ends after so many branches with the best plan met.
    Where the plan meets ``lower_bound`` it is optimal in any case.
    """
    incumbent = plan_by_best_fit(histogram, capacity)
    return Completion(histogram, capacity, incumbent, budget).run()


def fill_containers(sized: DataFrame, capacity: int, key: str = "doc_id", tokens: str = "tokens", per_lane: int = 200_000) -> DataFrame:
    """(key, piece_no, piece_tokens, container_no) for items of at least one token.

    ``sized`` has one row per item: its key, which may repeat, and its size. An item larger
    than the capacity is cut into full pieces and a rest; no other is split. Items of size 0 or null need
    no container and come out with piece_no 1, size 0 and a null container. Ties between
    equal sizes fall by a hash of the key, so the outcome does not depend on partitions.

    The histogram has at most ``capacity`` rows, which bounds what is collected and what is
    broadcast. Ranks within a size follow the hash; they are counted in lanes, ranges of the hash of about ``per_lane`` pieces, so that a size that a
    third of all items have does not land in one task. The offsets of the lanes are one number each, and the lanes change no rank.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = sized.sparkSession
    items = sized.select(F.col(key).alias("k"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n"))
    full = F.expr(f"(n - 1) div {capacity}")
    pieces = items.where("n > 0").select(
        "k", F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.array(F.col("n") - full * capacity))).alias("p", "size")
    )
    pieces = pieces.select("k", (F.col("p") + 1).alias("p"), F.col("size").cast("int").alias("size"), F.xxhash64("k", F.col("p") + 1).alias("h"))
    histogram: dict[int, int] = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most ``capacity`` rows
    # Lanes are powers of two; the leading bits of the hash are the lane.
    bits = {s: (-(-n // per_lane) - 1).bit_length() for s, n in histogram.items() if n > per_lane}
    lane = F.lit(0)
    if bits:
        of_size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in bits.items() for x in kv]), F.col("size")), F.lit(0))
        pieces = pieces.withColumn("bits", of_size)
        lane = F.when(F.col("bits") > 0, F.expr("shiftright(h, 64 - bits)").cast("int")).otherwise(0)
    pieces = pieces.select("k", "p", "size", "h", lane.alias("lane"))
    before: dict[tuple[int, int], int] = {}
    if bits:
        counts = pieces.where(F.col("size").isin(list(bits))).groupBy("size", "lane").count().collect()  # a row per ``per_lane`` pieces
        taken_by: dict[int, int] = {}
        for row in sorted(counts, key=lambda r: (r["size"], r["lane"])):
            before[row["size"], row["lane"]] = taken_by.get(row["size"], 0)
            taken_by[row["size"]] = taken_by.get(row["size"], 0) + row["count"]
    plan = plan_fillings(histogram, capacity)

    # Slots of each size in the order of its ranks: from which rank on, and which container that is.
    slots: list[tuple[int, int, int]] = []
    taken = dict.fromkeys(histogram, 0)
    container = 1
    for times, filling in plan:
        for size in filling:
            slots.append((size, taken[size], container))
            taken[size] += times
        container += times
    ordered = np.array(sorted(slots), np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((ordered, before))
    kind = sized.schema[key].dataType.simpleString()

    def make():
        by_slot, offsets = shared.value
        places = (by_slot[:, 0] << 44) + by_slot[:, 1]  # a size is below 2 ** 19, a rank below 2 ** 44

        def work(keys, numbers, sizes, lanes, ranks):
            at = np.array(ranks, np.int64) - 1
            if offsets:
                at += np.array([offsets.get(x, 0) for x in zip(sizes, lanes)], np.int64)
            i = np.searchsorted(places, (np.array(sizes, np.int64) << 44) + at, "right") - 1
            return [keys, numbers, sizes, (by_slot[i, 2] + at - by_slot[i, 1]).tolist()]

        return work

    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("size", "lane").orderBy("h", "k", "p")))
    filled = map_columns(ranked.select("k", "p", "size", "lane", "r"), make, f"k {kind}, piece_no int, piece_tokens int, container_no long")
    empty = items.where("n <= 0").select("k", F.lit(1).alias("piece_no"), F.lit(0).alias("piece_tokens"), F.lit(None).cast("long").alias("container_no"))
    return filled.unionByName(empty).withColumnRenamed("k", key)
