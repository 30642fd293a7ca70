"""Best-fit packing of tokenized documents into fixed-length sequences.

The lengths of all pieces form a histogram of at most ``capacity`` rows, whatever the corpus. Over it stands the
configuration linear program of cutting-stock: choose how often to use each multiset of lengths that fits one
sequence, covering every length's count, with as few sequences as possible. Multiplicative weights solve it: each
length carries a price, in each round a knapsack dynamic program finds the dearest configurations for all pieces, and
prices of lengths that stood beside empty room are multiplied up, so that the next round places them while there is
choice. The average of the rounds is the program's fractional solution. It is rounded down to whole configurations
whose items all exist; what is left is covered at the last prices or best fit. A round's own cover is whole already;
the fewest sequences of all are taken, and rounds end where they reach the total length, which none can beat.
Every step works on counts, so its cost depends on the capacity alone. Documents then find their place from their
length and their rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import bpe, scratch

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


# --- the program over the histogram -------------------------------------------------------------------------------


Configuration = tuple[tuple[int, int], ...]  # (length, copies), ascending


def dearest(room: int, order: list[int], left: list[int]) -> dict[int, int]:
    """Knapsack by dynamic programming over whole tokens: the fullest filling of ``room`` from ``left`` copies of each length, of equally full ones that of the lengths first in ``order``.

    ``reach`` has bit r set where some filling comes to r tokens; copies are added by doubling.
    """
    reach, whole, stages = 1, (1 << room + 1) - 1, []
    for length in order:
        todo = min(left[length], room // length)
        if todo <= 0:
            continue
        stages.append((length, reach))
        some = 1
        while todo > 0:
            reach |= (reach << length * min(some, todo)) & whole
            todo -= some
            some *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        copies = 0
        while not before >> at - copies * length & 1:
            copies += 1
        if copies:
            out[length] = copies
            at -= copies * length
    return out


def cover(counts: np.ndarray, price: np.ndarray, capacity: int) -> Counter[Configuration]:
    """Whole configurations that hold exactly the pieces counted: the dearest length left with the dearest filling beside it, as often as its items last."""
    left, out = counts.tolist(), Counter()
    order = sorted(np.flatnonzero(counts).tolist(), key=lambda n: (-price[n], -n))
    while order := [n for n in order if left[n]]:
        first = order[0]
        left[first] -= 1
        config = dearest(capacity - first, order, left)
        left[first] += 1
        config[first] = config.get(first, 0) + 1
        uses = min(left[n] // k for n, k in config.items())
        for n, k in config.items():
            left[n] -= k * uses
        out[tuple(sorted(config.items()))] += uses
    return out


def raised(price: np.ndarray, uses: Counter[Configuration], counts: np.ndarray, capacity: int, rate: float) -> np.ndarray:
    """Prices after a round: up by the share of empty room that a length's pieces stood beside, by ``exp(rate)`` at most."""
    loss = np.zeros(capacity + 1)
    for config, n in uses.items():
        empty = capacity - sum(length * k for length, k in config)
        if empty:
            for length, k in config:
                loss[length] += n * k * empty / capacity
    return price * np.exp(rate * np.minimum(4 * loss / np.maximum(counts, 1), 1))


def round_down(uses: Counter[Configuration], rounds: int, counts: np.ndarray, capacity: int) -> Counter[Configuration]:
    """Whole uses of the full configurations of ``uses`` / ``rounds``; takes their items out of ``counts``."""
    out, carried = Counter(), 0.0
    for config, n in sorted(uses.items(), key=lambda u: u[0][::-1], reverse=True):  # longest items first, so that carried shares stay among like configurations
        if sum(length * k for length, k in config) < capacity:
            continue
        carried += n / rounds
        whole = min([int(carried + 1e-9), *(int(counts[length]) // k for length, k in config)])
        carried = min(carried - whole, 1.0)
        if whole > 0:
            out[config] += whole
            for length, k in config:
                counts[length] -= k * whole
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on counts: sequences with the same content are placed together."""
    rooms: dict[int, Counter[tuple]] = {}  # room left: contents (sorted lengths) of how many sequences
    for length in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[length])
        while todo:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                # No open sequence takes it: new ones, each filled with as many as fit.
                full = capacity // length
                new, rest = divmod(todo, full)
                for n, k in ((new, full), (1 if rest else 0, rest)):
                    if n:
                        rooms.setdefault(capacity - k * length, Counter())[((length, k),)] += n
                todo = 0
                continue
            contents, n = rooms[room].popitem()
            fit = min(room // length, todo)
            use = min(n, todo // fit) or 1
            if n > use:
                rooms[room][contents] = n - use
            if not rooms[room]:
                del rooms[room]
            new_contents = tuple(sorted(Counter(dict(contents) | {length: dict(contents).get(length, 0) + fit}).items()))
            rooms.setdefault(room - fit * length, Counter())[new_contents] += use
            todo -= use * fit
    return [(dict(c), n) for r in rooms.values() for c, n in r.items()]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 24, rate: float = 0.5) -> list[tuple[dict[int, int], int]]:
    """Whole configurations and their multiplicities that hold exactly the pieces of ``histogram``."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        counts[length] = n
    bound = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    price, total = np.arange(capacity + 1) / capacity, Counter()
    best: list[tuple[dict[int, int], int]] | None = None

    def offer(plan: list[tuple[dict[int, int], int]]) -> bool:
        """Keep the plan if it is the shortest; whether none can be shorter."""
        nonlocal best
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        return sum(n for _, n in best) <= bound

    for t in range(1, rounds + 1):
        uses = cover(counts, price, capacity)
        total.update(uses)
        if offer([(dict(c), n) for c, n in uses.items()]):
            break
        rest = counts.copy()
        whole = [(dict(c), n) for c, n in round_down(total, t, rest, capacity).items()]
        if offer(whole + [(dict(c), n) for c, n in cover(rest, price, capacity).items()]) or offer(whole + best_fit(rest, capacity)):
            break
        price = raised(price, uses, counts, capacity, rate)
    return best or []


def placement(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go: sequence = base + (rank - first) // copies, and the offset of copy c is offset + c * length."""
    rows, base, seen = [], 0, Counter()
    for config, n in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            copies = config[length]
            rows.append((length, seen[length], base, copies, offset))
            seen[length] += n * copies
            offset += copies * length
        base += n
    names = ("length", "first", "base", "copies", "offset")
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(names, columns, strict=True))


# --- documents ----------------------------------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's pieces, with the task that cut them and their rank among that task's pieces of the same length.

    A null text counts as empty and yields the end id alone; a null doc_id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ranks, tok = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), bpe.tokenizer(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for at, texts in bpe.slices(batch.column(1)):
                owner, number, starts, lengths, sums = [], [], [], [], []
                for i, raw in enumerate(tok.encode(texts), at):
                    wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes() + end
                    n = len(wide) // 4
                    a, b, k = 0, (n - 1) % capacity + 1, 0
                    while a < n:
                        owner.append(i)
                        number.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(wide[4 * a : 4 * b]))
                        a, b, k = b, b + capacity, k + 1
                length = np.array(lengths, np.int64)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty_like(length)
                rank[order] = ranks[length[order]] + np.arange(len(length)) - first
                ranks += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(length), task, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidy(cut), PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty, repeated rows are
    packed once for each row, an empty table gives no rows, and columns other than doc_id and text are ignored.
    """
    scratch.prepare(docs)
    pieces = scratch.materialize(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    # A row for each task and length: at most `capacity` for a task, however many documents it read.
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = scratch.materialize(before.select("length", "task", "n", F.coalesce("before", F.lit(0)).alias("before")), "ranks")
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    place = placement(plan_sequences(histogram, capacity))
    span = int(max(histogram.values(), default=0)) + 1

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = place["length"] * span + place["first"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            copy = rank - place["first"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(place["base"][at] + copy // place["copies"][at]), pa.array(place["offset"][at] + copy % place["copies"][at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before.select("length", "task", "before").hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(scratch.tidy(put), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
