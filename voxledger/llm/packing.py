"""Best-fit packing of tokenised documents into sequences, by bin completion with branch and bound.

Documents longer than a sequence are cut into full pieces and a rest. What has to be packed is then
the histogram of piece lengths, which has at most ``size`` entries whatever the corpus: Spark counts it,
the search for fillings runs on it, and Spark deals the pieces out to the places that were planned.
A plan is a list of fillings with the number of times that each is used, so the search is as long for
a billion pieces as for a thousand.

The incumbent is the whole best-fit-decreasing plan. The search then takes the largest length left, branches
over the undominated fillings of the room beside it, best first, uses each as often as its lengths last, and goes on
with what is left; it comes back to the next filling of a bin when a branch is done. A branch is cut when its
sequences so far and the lower bound of what is left reach the incumbent. The search ends when the incumbent
meets the lower bound, or when a budget of nodes is spent: ``Plan.gap`` then says by how many sequences the plan
may be longer than the best one.

Edge cases: null text is the empty text, which still has its end token; repeated rows and ties are
pieces like others (each row keeps its own place); an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import logging
import zlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.common import cut

CACHE_ENTRIES = 700_000
#: Parts that a length's pieces are numbered in, at least, and pieces of one length in a part, about.
SALTS, SALTED = 64, 200_000
#: Nodes that the search for one filling may visit before it settles for its incumbent.
NODES = 4000
#: Nodes that the search over whole plans may visit, in all.
BUDGET = 200_000


class WordCache:
    """Ids of whole texts from the ids of their stretches between blanks.

    White space never belongs to a token of the vocabularies this is for, so a text's ids are those of
    its stretches, one after the other; stretches not met before go to the tokenizer in one batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.seen: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        import numpy as np

        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        seen = self.seen
        new = list({w for words in split for w in words if w not in seen})
        fresh = {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))} if new else {}
        out = [b"".join([seen[w] if w in seen else fresh[w] for w in words]) for words in split]
        for w, ids in fresh.items():
            if len(seen) >= CACHE_ENTRIES:
                break
            if len(w) <= 40:
                seen[w] = ids
        return out


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, end each document with ``end_id`` and cut at ``size``: one row per piece with its place in
    the document, its length and the CRC-32 of its ids. A narrow map without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = word_cache(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(part.column(0).to_pylist(), cache.encode_batch(part.column(1).to_pylist())):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * size)):
                        one = ids[start : start + 4 * size]
                        for column, x in zip(rows, (doc, k, start // 4, len(one) // 4, zlib.crc32(one))):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], part.column(0).type), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


class Plan(NamedTuple):
    """Fillings ``(lengths, times)`` that use up a histogram, and how many sequences more than the best plan they may
    take: 0 where the search came to its end or met the lower bound."""

    fillings: list[tuple[list[int], int]]
    gap: int


def fillings(left: list[int], count: dict[int, int], room: int, nodes: int = NODES) -> tuple[list[list[int]], int, bool]:
    """Undominated fillings of ``room`` from ``left`` (decreasing) with at most ``count`` of each, least waste first;
    the nodes visited, and whether all fillings were seen. A filling beside which a length left over would fit is
    dominated by the one with it."""
    rising, falling = left[::-1], [-x for x in left]
    found: list[tuple[int, list[int]]] = []
    visited = 0

    def branch(at: int, room: int, chosen: list[int]) -> bool:
        nonlocal visited
        if visited >= nodes:
            return False
        visited += 1
        if all(chosen.count(x) >= count[x] for x in itertools.takewhile(lambda x: x <= room, rising)):
            found.append((room, chosen))
        for k in range(max(at, bisect.bisect_left(falling, -room)), len(left)):
            x = left[k]
            for n in range(min(room // x, count[x]), 0, -1):
                if not branch(k + 1, room - n * x, chosen + [x] * n):
                    return False
        return True

    whole = branch(0, room, [])
    found.sort(key=lambda f: (f[0], [-x for x in f[1]]))
    return [f for _, f in found], visited, whole


def lower_bound(count: dict[int, int], size: int) -> int:
    """Sequences that any plan needs: for each least length k, pieces above size / 2 have one each, and pieces from k
    on must fit beside those that leave k or more, or in sequences of their own (Martello and Toth)."""
    xs = sorted(count)
    n, total = [0], [0]
    for x in xs:
        n.append(n[-1] + count[x])
        total.append(total[-1] + x * count[x])
    half = bisect.bisect_right(xs, size // 2)
    best = max(-(-total[-1] // size), n[-1] - n[half])
    for at in range(half):
        large = bisect.bisect_right(xs, size - xs[at])
        beside = (n[large] - n[half]) * size - (total[large] - total[half])
        best = max(best, n[-1] - n[half] + max(0, -(-(total[half] - total[at] - beside) // size)))
    return best


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """The best-fit-decreasing plan: each piece, largest first, to the fullest sequence that has room for it. Alike
    sequences are kept as one, so it takes as long for a billion pieces as for a thousand."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[list[int], int]]] = {}

    def put(room: int, chosen: list[int], times: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
        open_.setdefault(room, []).append((chosen, times))

    for x in sorted(histogram, reverse=True):
        left = histogram[x]
        while left:
            if (at := bisect.bisect_left(rooms, x)) < len(rooms):
                room = rooms[at]
                chosen, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, chosen, times = size, [], -(-left // (size // x))
            each = min(room // x, left)
            used = min(times, left // each)
            put(room - each * x, chosen + [x] * each, used)
            if chosen and times > used:
                put(room, chosen, times - used)
            left -= each * used
    return [group for room in rooms for group in open_[room]]


def best_filling(left: list[int], count: dict[int, int], room: int, nodes: int = NODES) -> list[int]:
    """Lengths that fill ``room`` best, from ``left`` (decreasing) with at most ``count`` of each."""
    rising = left[::-1]

    def fitting(x: int, below: int) -> int:
        """Largest length of at most ``x`` and ``below``, or 0."""
        i = bisect.bisect_right(rising, min(x, below))
        return rising[i - 1] if i else 0

    def greedy(room: int, below: int) -> list[int]:
        out = []
        while (x := fitting(room, below)) > 0:
            take = min(room // x, count[x])
            out += [x] * take
            room -= take * x
            below = x - 1
        return out

    best = greedy(room, room)  # the best-fit filling is the first incumbent
    waste, visited = room - sum(best), 0
    smallest = rising[0] if rising else 0

    def branch(room: int, below: int, chosen: list[int]) -> None:
        """Lengths of at most ``below``, each as often as it may; as deep as a filling has different lengths."""
        nonlocal best, waste, visited
        if room < waste:
            best, waste = chosen, room
        if waste == 0 or room < smallest:
            return
        x = fitting(room, below)
        while x > 0 and waste > 0 and visited < nodes:
            visited += 1
            rest = room - x
            # one exact partner ends the search at once: no other filling dominates it
            if rest == 0 or rest <= x and rest in count and count[rest] > (rest == x):
                best, waste = [*chosen, x, *[rest] * (rest > 0)], 0
                return
            for n in range(min(room // x, count[x]), 0, -1):
                branch(room - n * x, x - 1, chosen + [x] * n)
            x = fitting(room, x - 1)

    branch(room, room, [])
    return best


def fill_in_turn(histogram: dict[int, int], size: int, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """The plan that fills the largest length's sequence best, as often as its lengths last, and so on."""
    count = {k: v for k, v in histogram.items() if v > 0 and k > 0}
    rising, out = sorted(count), []
    while rising:
        top = rising[-1]
        count[top] -= 1
        spare = {k: v for k, v in count.items() if v > 0 and k <= size - top} if size > top else {}
        chosen = [top, *(best_filling(sorted(spare, reverse=True), spare, size - top, nodes) if spare else [])]
        count[top] += 1
        need: dict[int, int] = {}
        for x in chosen:
            need[x] = need.get(x, 0) + 1
        times = min(count[x] // n for x, n in need.items())
        out.append((chosen, times))
        for x, n in need.items():
            count[x] -= n * times
            if not count[x]:
                del count[x]
                rising.pop(bisect.bisect_left(rising, x))
    return out


def plan(histogram: dict[int, int], size: int, nodes: int = NODES, budget: int = BUDGET) -> Plan:
    """The best plan that branch and bound over whole plans finds within its budget."""
    count = {k: v for k, v in histogram.items() if v > 0 and k > 0}
    length = lambda p: sum(times for _, times in p)
    # pieces above a third of a sequence are two to a sequence at most, and then best fit has as few as there can be
    bound = max(lower_bound(count, size), length(best_fit({k: v for k, v in count.items() if 3 * k > size}, size)))
    best = best_fit(count, size)
    if length(best) > bound:
        best = min(best, fill_in_turn(count, size, nodes), key=length)
    fewest, whole = length(best), True

    def choices(count: dict[int, int]):
        """Fillings with the largest length, each with its numbers of times, and what each leaves."""
        nonlocal budget, whole
        top = max(count)
        spare = {k: v - (k == top) for k, v in count.items() if k <= size - top and v > (k == top)}
        found, visited, all_seen = fillings(sorted(spare, reverse=True), spare, size - top, min(nodes, budget))
        budget -= visited
        whole = whole and all_seen
        for chosen in found:
            need: dict[int, int] = {}
            for x in [top, *chosen]:
                need[x] = need.get(x, 0) + 1
            for times in range(min(count[x] // n for x, n in need.items()), 0, -1):
                after = count | {x: count[x] - n * times for x, n in need.items()}
                yield [top, *chosen], times, {x: n for x, n in after.items() if n}

    # the way to the node looked at: the choices left at each bin, and sequences so far
    way = [(choices(count), 0)] if fewest > bound else []
    taken: list[tuple[list[int], int]] = []
    while way:
        if budget <= 0:
            whole = False
            break
        todo, used = way[-1]
        del taken[len(way) - 1 :]
        if (choice := next(todo, None)) is None:
            way.pop()
            continue
        chosen, times, left = choice
        budget -= 1
        if used + times + lower_bound(left, size) >= fewest:
            continue
        taken.append((chosen, times))
        if left:
            way.append((choices(left), used + times))
            continue
        best, fewest = list(taken), used + times
        if fewest == bound:
            break
    return Plan(best, 0 if whole else fewest - bound)


def pack(parts: DataFrame, size: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece"), nodes: int = NODES) -> DataFrame:
    """Give each piece of ``parts`` (with a ``length``) its ``sequence_id`` and ``offset``, and the plan's ``gap``: by how many
    sequences it may be longer than the best one.

    ``parts`` is read three times: cut its lineage before. Pieces of one length are numbered in parts
    whose counts give each part its first number, and the numbers of a length are looked up in
    the plan's ranges by an equi-join on the length.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(SALTS, -(-max(histogram.values(), default=0) // SALTED))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    ranges, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    best = plan(histogram, size, nodes)
    if best.gap:
        logging.getLogger(__name__).warning("packing: at most %d of the planned sequences are more than needed", best.gap)
    for chosen, times in best.fillings:
        at, place = 0, {}
        for x in chosen:
            place.setdefault(x, []).append(at)
            at += x
        for x, offsets in place.items():  # numbers used[x]... of this length go to these offsets in turn
            ranges.append((x, used[x], used[x] + times * len(offsets), sequence, offsets))
            used[x] += times * len(offsets)
        sequence += times
    firsts = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    numbered = salted.withColumn("_number", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1).join(firsts.select("length", "_salt", "_first"), ["length", "_salt"])
    numbered = numbered.withColumn("_number", F.col("_number") + F.col("_first"))
    schema = "length long, _from long, _to long, _sequence long, _offsets array<long>"
    # at most a few ranges for each of the lengths 1..size, however many pieces there are: each
    # planned filling uses up a length
    planned = spark.createDataFrame(ranges, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_sequence", "_offsets"))).alias("_ranges"))
    k = F.col("_number") - F.col("_r._from")
    return (
        numbered.join(planned, "length")
        .withColumn("_r", F.element_at(F.filter("_ranges", lambda r: (F.col("_number") >= r["_from"]) & (F.col("_number") < r["_to"])), 1))
        .withColumn("sequence_id", F.col("_r._sequence") + F.floor(k / F.size("_r._offsets")))
        .withColumn("offset", F.element_at("_r._offsets", (k % F.size("_r._offsets") + 1).cast("int")))
        .withColumn("gap", F.lit(best.gap).cast("long"))
        .drop("_salt", "_number", "_first", "_ranges", "_r")
    )


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise and pack whole documents; see ``pieces`` and ``pack`` for the columns."""
    return pack(cut(pieces(docs, vocabulary, size, end_id)), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")
