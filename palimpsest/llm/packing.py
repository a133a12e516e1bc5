"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized where they lie; longer ones are cut. What is packed afterwards are narrow rows
(no ids), dealt at random into blocks of bounded size. Each block is packed by best fit decreasing and
improved by local search over its underfull bins: of all moves of a document and all exchanges of one for one or
two for one between any two of them, the one is taken that raises the sum of squared fills most, until
bins empty and no such step is left, or the bins are as few as a lower bound allows. Bins that still have much
room go on, whole, to a next level of fewer blocks, as long as a level lowers their number. No level
sees more than a bounded number of rows in a task.

Defined results: a null or empty text has the end id alone; repeated rows are packed each by itself;
an empty table gives no rows; ids of documents (null as well) and other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, id_encoder, materialize, table

CAPACITY = 4096
BLOCK_ROWS = 2048
#: Bins with at least this share of room go to the next level.
LOOSE = 1 / 128


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, spaces: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()

    def run(b):
        import numpy as np

        tail, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        counts, piece, length, crc = [], [], [], []
        for ids in id_encoder(path, spaces)(b["text"].to_pylist()):
            ids += tail
            parts = [ids[i : i + width] for i in range(0, len(ids), width)]
            counts.append(len(parts))
            piece += range(len(parts))
            length += [len(p) // 4 for p in parts]
            crc += [zlib.crc32(p) for p in parts]
        return {"doc_id": b["doc_id"].take(np.repeat(np.arange(len(counts)), counts)), "piece": np.array(piece, np.int32), "start": np.array(piece, np.int64) * capacity, "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)}

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_block(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions in ``lengths``) of one block: best fit decreasing, then local search."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for i in order:
        n = lengths[i]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        if left := room - n:
            by_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return improve(bins, lengths, capacity, lower_bound(lengths, capacity))


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs. For each size k up to half a bin: documents above capacity - k leave no room
    for one of k or more, others above a half don't share a bin, and those from k to a half fill the rest."""
    import numpy as np

    x = np.sort(np.asarray(lengths, np.int64))
    if not len(x):
        return 0
    sums = np.concatenate([[0], np.cumsum(x)])
    k = np.unique(np.concatenate([[0], x[2 * x <= capacity]]))
    low, half, high = np.searchsorted(x, k), np.searchsorted(x, capacity // 2, side="right"), np.searchsorted(x, capacity - k, side="right")
    high = np.maximum(high, half)
    room = (high - half) * capacity - (sums[high] - sums[half])
    over = np.maximum(0, sums[half] - sums[np.minimum(low, half)] - room)
    return int((len(x) - half + -(-over // capacity)).max())


class _Bin:
    """Documents of a bin by length; the lengths, and the sums of two, as sets of bits."""

    def __init__(self, docs: list[int], lengths: list[int]):
        self.docs, self.lengths = docs, lengths
        self.update()

    def update(self) -> None:
        self.by_length: dict[int, list[int]] = {}
        for i in self.docs:
            self.by_length.setdefault(self.lengths[i], []).append(i)
        self.fill = sum(self.lengths[i] for i in self.docs)
        self.one = self.two = 0
        for n in self.by_length:
            self.one |= 1 << n
        for n, docs in self.by_length.items():
            self.two |= (self.one & ~(1 << n)) << n | (len(docs) > 1) << 2 * n

    def pick(self, n: int) -> list[int]:
        """Documents that sum up to ``n``: none, one or two."""
        if not n:
            return []
        if n in self.by_length:
            return self.by_length[n][:1]
        for m, docs in self.by_length.items():
            other = self.by_length.get(n - m)
            if other and (n != 2 * m or len(docs) > 1):
                return [docs[0], other[n == 2 * m]]
        raise ValueError(f"no two documents of {n}")


def best_step(donor: _Bin, target: _Bin, more_than: int, room: int) -> tuple[int, int, int] | None:
    """(tokens gained, length that leaves the donor, length that comes back) of the step that fills the target's
    ``room`` best: a move of one or two, an exchange of one for one, of two for one, or of one for two."""
    best, found, mask = more_than, None, (1 << room + 1) - 1
    both = donor.one | donor.two
    g = (both & mask).bit_length() - 1
    if g > best:
        best, found = g, (g, g, 0)
    for back in target.by_length:
        if best == room:
            return found
        g = (both >> back & mask).bit_length() - 1
        if g > best:
            best, found = g, (g, g + back, back)
    for out in donor.by_length:
        if best == room:
            return found
        least = max(0, out - room)
        fit = target.two >> least
        if fit and (g := out - least - (fit & -fit).bit_length() + 1) > best:
            best, found = g, (g, out, out - g)
    return found


def improve(bins: list[list[int]], lengths: list[int], capacity: int, least: int = 0, watch: Callable[[int], None] | None = None) -> list[list[int]]:
    """Local search: the best step between any two underfull bins, until none raises the sum of squared fills or there
    are no more bins than ``least``. A step that moves g tokens from a bin of a to one of b changes that sum by
    2 g (b - a + g). Steps are computed in the order of what they could bring at best, so most never are.
    ``watch`` is told the change of each step taken."""
    import numpy as np

    left = len(bins)
    if left <= least:
        return bins
    loose = [_Bin(b, lengths) for b in bins if sum(lengths[i] for i in b) < capacity]
    full = [b for b in bins if sum(lengths[i] for i in b) >= capacity]
    fill = np.array([b.fill for b in loose], np.int64)
    count = np.array([len(b.docs) for b in loose], np.int64)

    def bounds(a, b):
        """What a step from bins ``a`` to bins ``b`` brings at best. Two single documents only change places."""
        room = np.minimum(capacity - fill[b], fill[a])
        g = np.where((count[a] == 1) & (count[b] == 1) & (fill[a] > capacity - fill[b]), 0, room)
        return np.where((count[a] > 0) & (count[b] > 0) & (a != b), np.maximum(0, 2 * g * (fill[b] - fill[a] + g)), 0)

    everyone = np.arange(len(loose))
    gain = bounds(everyone[:, None], everyone[None])
    steps: dict[tuple[int, int], tuple[int, int, int]] = {}
    best = gain.max(axis=1, initial=0)
    while left > least and len(best) and best[a := int(best.argmax())] > 0:
        b = int(gain[a].argmax())
        donor, target = loose[a], loose[b]
        if (a, b) not in steps:
            step = best_step(donor, target, max(0, donor.fill - target.fill), capacity - target.fill)
            gain[a, b] = 2 * step[0] * (target.fill - donor.fill + step[0]) if step else 0
            best[a] = gain[a].max()
            if step:
                steps[a, b] = step
            continue
        _, out, back = steps[a, b]
        leave, come = donor.pick(out), target.pick(back)
        donor.docs = [i for i in donor.docs if i not in leave] + come
        target.docs = [i for i in target.docs if i not in come] + leave
        if watch:
            watch(int(gain[a, b]))
        for k in (a, b):
            loose[k].update()
            fill[k], count[k] = loose[k].fill, len(loose[k].docs)
        left -= not donor.docs
        steps = {k: v for k, v in steps.items() if a not in k and b not in k}
        for k in (a, b):
            gain[k], gain[:, k] = bounds(k, everyone), bounds(everyone, k)
        best = gain.max(axis=1)
    return full + [b.docs for b in loose if b.docs]


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean"


def _level(rows: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    """Packs each block; the bins it had before stay if they are as few."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = pack_block(lengths, capacity)
        if level and pdf["sequence_id"].nunique() <= len(bins):
            bins = list(pdf.groupby("sequence_id", sort=True).indices.values())
        n = len(lengths)
        seq, off, loose = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = k, at
                at += lengths[i]
            loose[list(b)] = capacity - at >= LOOSE * capacity
        base = (level * 2**30 + int(pdf["block"].iloc[0])) * BLOCK_ROWS * 8
        out = pdf.assign(sequence_id=base + seq, offset=off, loose=loose)
        return out[["row", *[c.split()[0] for c in _PLACED.split(", ")]]]

    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(blocks)).cast("int")).drop("key").groupBy("block").applyInPandas(run, f"row long, {_PLACED}")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs pieces (as from ``pieces``): adds sequence_id and offset."""
    spark = parts.sparkSession
    rows = materialize(spark, parts.withColumn("row", F.monotonically_increasing_id()), "pieces").withColumn("sequence_id", F.lit(-1).cast("long")).withColumn("key", F.col("row"))
    blocks, bins, level, out = -(-rows.count() // BLOCK_ROWS), None, 0, None
    while True:
        placed = materialize(spark, _level(rows, max(1, blocks), level, capacity), f"packed-{level}")
        loose = placed.filter("loose")
        now = placed.agg(F.count_distinct("sequence_id").alias("bins"), F.count_if("loose").alias("loose"), F.count_distinct(F.when(F.col("loose"), F.col("sequence_id"))).alias("loose_bins")).first()
        last = blocks <= 1 or not now.loose or bins is not None and now.bins >= bins
        kept = placed if last else placed.filter("not loose")
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        # bins stay whole on their way to the next level
        rows = loose.drop("offset", "loose").withColumn("key", F.col("sequence_id"))
        blocks, bins, level = min(blocks - 1, -(-now.loose // BLOCK_ROWS)), now.loose_bins, level + 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs))
