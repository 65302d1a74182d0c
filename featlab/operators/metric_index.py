"""Exact nearest rows by a metric index, so that blocks of rows that can't hold a near one are never compared.

Pivots are rows drawn by a hash. Each row belongs to the cell of its nearest pivot, and of each cell the least
and greatest distance to its pivot are kept by label. Cells are cut into blocks of a bounded size. First each
block is searched for its own rows, which bounds how far their k nearest can be; by the triangle inequality a
row at distance d of a pivot is at least d - hi and lo - d away from all rows of that cell. Only blocks
that some row's bound reaches are compared, for those rows. The driver and each task hold PIVOTS rows and
two numbers a pivot and label; a task holds a share of the rows with the best found so far, and a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots at most; beyond PIVOTS * cell_rows rows cells grow and have several blocks.
PIVOTS = 1024
_BLOCK = "cell int, piece int, ids binary, labels binary, x binary"
_NEAR = "src long, src_label long, dst long, dst_label long, d double"


def points(features, metric: str) -> np.ndarray:
    """Rows as points whose Euclidean distance ranks as the metric does: for cosine, rows of length one (zero rows stay)."""
    return scaled(np.array([np.asarray(v, float) for v in features]), metric)


def scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(1e-12, np.sqrt((x * x).sum(1, keepdims=True))) if metric == "cosine" else x


def narrow(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, in single precision where that holds all of these rows exactly, as it does for features that were stored so."""
    single = x.astype("<f4")
    return [v.tobytes() for v in (single if (single == x).all() else x)]


def wide_again(rows: list[bytes], width: int) -> np.ndarray:
    """What narrow packed, of several calls."""
    if all(len(v) == 4 * width for v in rows):
        return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), width).astype(float)
    return np.array([np.frombuffer(v, "<f4" if len(v) == 4 * width else float) for v in rows], float)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    @staticmethod
    def read(ids: bytes, labels: bytes, x: bytes) -> Block:
        i = np.frombuffer(ids, np.int64)
        return Block(i, np.frombuffer(labels, np.int64), np.frombuffer(x, float).reshape(len(i), -1))

    def only(self, at: np.ndarray) -> Block:
        return Block(self.ids[at], self.labels[at], self.x[at])


@dataclass
class Question:
    """What is looked for: the k nearest by metric, within "any", "same" or "each" label; own: both sides are the same rows."""

    k: int
    metric: str
    within: str
    own: bool

    def values(self, a: Block, b: Block) -> np.ndarray:
        """What ranks, smallest first: squared distances, or cosines with the sign turned; 9 decimals."""
        if self.metric == "cosine":
            return np.round(-(a.x @ b.x.T), 9)
        d = squared(a.x, b.x)
        if self.own:
            d[a.ids[:, None] == b.ids[None, :]] = 0
        return np.round(d, 9)

    def groups(self, a: Block, b: Block, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(label, rows of a, rows of b, values) of each label of b that neighbours are looked for in; label -1 and all rows for "any"."""
        if self.within == "any":
            yield -1, np.arange(len(a.ids)), np.arange(len(b.ids)), values
            return
        for c in np.unique(b.labels):
            at = np.flatnonzero(b.labels == c)
            rows = np.flatnonzero(a.labels == c) if self.within == "same" else np.arange(len(a.ids))
            if len(rows):
                v = values[np.ix_(rows, at)]
                if self.within == "each" and self.own:
                    v = np.where(a.ids[rows][:, None] == b.ids[at][None, :], np.inf, v)
                yield int(c), rows, at, v

    def nearest(self, a: Block, b: Block) -> Iterator[pd.DataFrame]:
        """The k nearest in b of each row of a, and of each label for "each"; ties by the order of b."""
        for _, rows, at, v in self.groups(a, b, self.values(a, b)):
            best = np.argsort(v, axis=1, kind="stable")[:, : self.k]
            value = np.take_along_axis(v, best, 1)
            ok = np.isfinite(value).ravel()
            src, dst = np.repeat(rows, best.shape[1])[ok], at[best].ravel()[ok]
            d = value.ravel()[ok]
            yield pd.DataFrame({"src": a.ids[src], "src_label": a.labels[src], "dst": b.ids[dst], "dst_label": b.labels[dst], "d": (-d if self.metric == "cosine" else d) + 0.0})

    def reach(self, a: Block, b: Block, labels: np.ndarray) -> np.ndarray:
        """(rows of a, labels): the distance beyond which no row of that label can be among the k nearest, as b tells; inf where b has fewer than k, -1 where none is looked for."""
        out = np.full((len(a.ids), len(labels)), np.inf)
        if self.within == "same":
            out[a.labels[:, None] != labels[None, :]] = -1
        for c, rows, _, v in self.groups(a, b, self.values(a, b)):
            if v.shape[1] >= self.k:
                kth = np.partition(v, self.k - 1, axis=1)[:, self.k - 1]
                out[rows, np.searchsorted(labels, c)] = np.sqrt(np.maximum(0, 2 + 2 * kth if self.metric == "cosine" else kth) + 1e-8)
        return out


@dataclass
class Cells:
    """pivots; by label (in order, -1 alone for "any") and cell the range of distances to the pivot; blocks of each cell on both sides; the length of the longest row."""

    pivots: np.ndarray
    labels: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    longest: float

    def reached(self, a: Block, reach: np.ndarray) -> np.ndarray:
        """(rows of a, cells): whether the cell may hold one of the row's nearest. Distances come from differences of squares, so they count as exact to 1e-5 of the longest row."""
        d, out = np.sqrt(squared(a.x, self.pivots)), np.zeros((len(a.ids), len(self.pivots)), bool)
        for g in range(len(self.labels)):
            bound = np.maximum(d - self.hi[g], self.lo[g] - d) - 1e-5 * self.longest
            out |= (bound <= reach[:, g][:, None]) & (self.lo[g] <= self.hi[g]) & (reach[:, g] >= 0)[:, None]
        return out


def _pivots(rows: DataFrame, metric: str, m: int) -> np.ndarray:
    drawn = rows.select(F.xxhash64("id", F.lit(7)).alias("h"), "features").orderBy("h").limit(m).toPandas()
    return points(drawn["features"], metric)


def _ranges(rows: DataFrame, pivots: np.ndarray, q: Question) -> pd.DataFrame:
    """(label, cell, n, lo, hi, longest) of one side; at most pivots x labels rows, summed in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = points(part["features"], q.metric)
                d = squared(x, pivots)
                cell = d.argmin(1)
                yield pd.DataFrame({"label": part["label"] if q.within != "any" else -1, "cell": cell.astype(np.int32), "r": np.sqrt(d[np.arange(len(x)), cell]), "s": np.sqrt((x * x).sum(1))})

    told = rows.select(F.col("label").cast("long").alias("label"), "features").mapInPandas(run, "label long, cell int, r double, s double")
    return told.groupBy("label", "cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("s").alias("longest")).toPandas()


def _dealt(rows: DataFrame, pivots: np.ndarray | None, pieces: np.ndarray, metric: str, more: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(id, label, x, cell, piece): a cell's rows are dealt to its pieces by a hash of the id. more: further columns by the number of the block, cells in turn.

    x is the features as they came, narrow, if there are further columns: such rows are shipped many times. Else it is the point.
    """
    start, more = np.concatenate(([0], np.cumsum(pieces))), more or {}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                raw = points(part["features"], "euclidean")
                x = scaled(raw, metric)
                cell = np.zeros(len(x), int) if pivots is None else squared(x, pivots).argmin(1)
                h = (part["id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                piece = (h % pieces[cell].astype(np.uint64)).astype(np.int32)
                own = {c: v[start[cell] + piece] for c, v in more.items()}
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "x": narrow(raw) if more else [v.tobytes() for v in x], "cell": cell.astype(np.int32), "piece": piece, **own})

    told = rows.select("id", F.col("label").cast("long").alias("label"), "features")
    return told.mapInPandas(deal, "id long, label long, x binary, cell int, piece int" + "".join(f", {c} int" for c in more))


def _blocks(rows: DataFrame, pivots: np.ndarray | None, pieces: np.ndarray, metric: str) -> DataFrame:
    """A row for each block: its rows in order of id, packed."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        return pd.DataFrame({"cell": part["cell"].iloc[:1].to_numpy(), "piece": part["piece"].iloc[:1].to_numpy(), "ids": [part["id"].to_numpy(np.int64).tobytes()], "labels": [part["label"].to_numpy(np.int64).tobytes()], "x": [b"".join(part["x"])]})

    return _dealt(rows, pivots, pieces, metric).groupBy("cell", "piece").applyInPandas(pack, _BLOCK)


def _named(blocks: DataFrame, prefix: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(prefix + c) for c in blocks.columns])


def _wanted(left: DataFrame, right: DataFrame, cells: Cells, q: Question) -> DataFrame:
    """(l_cell, l_piece, r_cell, r_piece, rows): the pairs of blocks to compare, and for which rows of the left one. A left block is first searched in one right block of its cell."""
    first = _named(left, "l_").withColumn("at", F.col("l_piece") % F.get(F.array(*[F.lit(int(n)) for n in cells.right]), F.col("l_cell")))
    met = first.join(_named(right, "r_"), (F.col("l_cell") == F.col("r_cell")) & (F.col("at") == F.col("r_piece")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples(index=False):
                a, b = Block.read(r.l_ids, r.l_labels, r.l_x), Block.read(r.r_ids, r.r_labels, r.r_x)
                reached = cells.reached(a, q.reach(a, b, cells.labels))
                to = [(c, p) for c in np.flatnonzero(reached.any(0)) for p in range(cells.right[c])]
                yield pd.DataFrame({"l_cell": r.l_cell, "l_piece": r.l_piece, "r_cell": np.array([c for c, _ in to], np.int32), "r_piece": np.array([p for _, p in to], np.int32), "rows": [np.flatnonzero(reached[:, c]).astype(np.int32).tobytes() for c, _ in to]})

    return met.mapInPandas(run, "l_cell int, l_piece int, r_cell int, r_piece int, rows binary")


def _cells(rows: DataFrame, against: DataFrame | None, pivots: np.ndarray, q: Question, block_rows: int) -> tuple[Cells, np.ndarray, np.ndarray]:
    """The cells, the number of blocks of each on the right, and of rows on the left."""

    def sizes(told: pd.DataFrame) -> np.ndarray:
        return np.bincount(told["cell"], told["n"], len(pivots)).astype(np.int64)

    def pieces(n: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-n // block_rows))

    right = _ranges(rows if against is None else against, pivots, q)
    left = right if against is None else _ranges(rows, pivots, q)
    labels = np.unique(right["label"].to_numpy(np.int64))
    lo, hi = np.full((len(labels), len(pivots)), np.inf), np.full((len(labels), len(pivots)), -np.inf)
    at = np.searchsorted(labels, right["label"]), right["cell"].to_numpy()
    lo[at], hi[at] = right["lo"], right["hi"]
    cells = Cells(pivots, labels, lo, hi, pieces(sizes(left)), pieces(sizes(right)), float(max(left["longest"].max(), right["longest"].max())) if len(left) else 0.0)
    return cells, cells.right, sizes(left)


def _indexed(rows: DataFrame, against: DataFrame | None, q: Question, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left blocks, right blocks, and the pairs to compare. Where one block holds all that is searched there is nothing to leave out."""
    other = rows if against is None else against
    n = other.count()
    if n <= block_rows:
        b = _blocks(other, None, np.ones(1, int), q.metric)
        a = b if against is None else _blocks(rows, None, np.array([max(1, -(-rows.count() // block_rows))]), q.metric)
        every = F.udf(lambda ids: np.arange(len(ids) // 8, dtype=np.int32).tobytes(), "binary")  # a call a block
        return a, b, a.select(F.col("cell").alias("l_cell"), F.col("piece").alias("l_piece"), F.lit(0).alias("r_cell"), F.lit(0).alias("r_piece"), every("ids").alias("rows"))
    pivots = _pivots(other, q.metric, min(PIVOTS, -(-n // max(1, block_rows // 4))))
    cells = _cells(rows, against, pivots, q, block_rows)[0]
    b = _blocks(other, pivots, cells.right, q.metric)
    a = b if against is None else _blocks(rows, pivots, cells.left, q.metric)
    return a, b, _wanted(a, b, cells, q)


class Nearest:
    """The k nearest found so far of each row of a block, and of each label for "each", and the distance beyond which none of a label can follow."""

    def __init__(self, a: Block, q: Question, labels: np.ndarray, pivots: np.ndarray | None):
        order = np.argsort(a.labels, kind="stable") if q.within == "same" else np.arange(len(a.ids))
        self.a, self.q, self.labels = a.only(order), q, labels
        self.to_pivots = None if pivots is None else np.sqrt(squared(self.a.x, pivots)).astype(np.float32)
        shape = (len(a.ids), len(labels) if q.within == "each" else 1)
        self.worst, self.have = np.full(shape, np.inf), np.zeros(shape, np.int64)
        self.place, self.ids, self.of, self.value = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float))

    def _wanted(self, cells: Cells, cell: int, g: int, slot: int) -> np.ndarray:
        """Rows for which a cell may hold a near one of the label at place g."""
        if self.to_pivots is None:
            return np.ones(len(self.a.ids), bool)
        worst = self.worst[:, slot]
        reach = np.sqrt(np.maximum(0, 2 + 2 * worst if self.q.metric == "cosine" else worst) + 1e-8)
        d = self.to_pivots[:, cell]
        return np.maximum(d - cells.hi[g, cell], cells.lo[g, cell] - d) - 1e-5 * cells.longest <= reach

    def meet(self, b: Block, cell: int, cells: Cells | None) -> None:
        q, a = self.q, self.a
        again = q.own and bool(len(np.intersect1d(a.ids, b.ids)))
        for c in [-1] if q.within == "any" else np.unique(b.labels).tolist():
            cols = np.arange(len(b.ids)) if q.within == "any" else np.flatnonzero(b.labels == c)
            g = int(np.searchsorted(self.labels, c))
            slot = g if q.within == "each" else 0
            rows = self._wanted(cells, cell, g, slot)
            if q.within == "same":
                rows &= a.labels == c
            rows = np.flatnonzero(rows)
            if not len(rows):
                continue
            v = -(a.x[rows] @ b.x[cols].T) if q.metric == "cosine" else squared(a.x[rows], b.x[cols])
            if again:
                same = a.ids[rows][:, None] == b.ids[cols][None, :]
                v[same] = np.inf if q.within == "each" else v[same] if q.metric == "cosine" else 0
            limit = self.worst[rows, slot]
            few = self.have[rows, slot] < q.k
            if few.any():
                kth = min(q.k, v.shape[1]) - 1
                limit[few] = np.partition(v[few], kth, axis=1)[:, kth]
            i, j = np.nonzero(v <= limit[:, None] + 2e-9)
            value = np.round(v[i, j], 9)
            ok = np.isfinite(value)
            self._take(rows[i[ok]], slot, b.ids[cols[j[ok]]], b.labels[cols[j[ok]]], value[ok])

    def _take(self, rows: np.ndarray, slot: int, ids: np.ndarray, of: np.ndarray, value: np.ndarray) -> None:
        """Merges what was found; of equal values the least id stays."""
        slots, k = self.have.shape[1], self.q.k
        place = rows * slots + slot
        touched = np.zeros(self.have.size, bool)
        touched[place] = True
        old = touched[self.place]
        place, ids, of, value = (np.concatenate((x[old], y)) for x, y in ((self.place, place), (self.ids, ids), (self.of, of), (self.value, value)))
        order = np.lexsort((ids, value, place))
        place, ids, of, value = place[order], ids[order], of[order], value[order]
        first = np.searchsorted(place, place)
        best = np.arange(len(place)) - first < k
        place, ids, of, value = place[best], ids[best], of[best], value[best]
        count = np.bincount(place, minlength=self.have.size)
        self.have.ravel()[touched] = count[touched]
        last = np.append(place[1:] != place[:-1], True) if len(place) else np.zeros(0, bool)
        full = place[last][count[place[last]] == k]
        self.worst.ravel()[full] = value[last][count[place[last]] == k]
        self.place, self.ids, self.of, self.value = (np.concatenate((x[~old], y)) for x, y in ((self.place, place), (self.ids, ids), (self.of, of), (self.value, value)))

    def found(self) -> pd.DataFrame:
        src = self.place // self.have.shape[1]
        d = -self.value if self.q.metric == "cosine" else self.value
        order = np.lexsort((self.ids, self.value, self.place))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order)) - np.searchsorted(self.place[order], self.place[order]) + 1
        return pd.DataFrame({"src": self.a.ids[src], "src_label": self.a.labels[src], "dst": self.ids, "dst_label": self.of, "d": d + 0.0, "rank": rank})


#: Numbers of the rows that a task looks up together, and rows at least that a task should have; each such share of the rows meets all blocks.
SHARE, LEAST = 1 << 23, 512


def nearest(rows: DataFrame, against: DataFrame | None, k: int, metric: str, within: str, block_rows: int) -> DataFrame:
    """(src, src_label, dst, dst_label, d, rank): the k nearest rows of each row, of each label for "each"; of equal distances the least id.

    The rows are dealt to shares by their cells, and both sides are put in order of their blocks once, narrow. A share's task then reads its
    own rows and after them all blocks of the other side from where Spark keeps these, so nothing is shuffled once a share; its own blocks
    meet each other first, and only the k best are kept. There are no more shares than cores unless memory asks for them.
    """
    q, spark = Question(k, metric, within, against is None), rows.sparkSession
    other = rows if against is None else against
    n = other.count()
    m = n if against is None else rows.count()
    small = n <= block_rows
    if small:
        cells, pivots = None, None
        labels = np.array([-1]) if within == "any" else np.array(sorted(r["label"] for r in other.select("label").distinct().collect() if r["label"] is not None), np.int64)
        right_pieces, left_cells = np.ones(1, int), np.array([m])
    else:
        pivots = _pivots(other, metric, min(PIVOTS, -(-n // max(1, block_rows // 4))))
        cells, right_pieces, left_cells = _cells(rows, against, pivots, q, block_rows)
        labels = cells.labels
    width = max(1, len(np.asarray(other.select("features").first()["features"]))) if n else 1
    share_rows = max(block_rows, SHARE // width)
    shares = max(1, -(-m // share_rows), min(spark.sparkContext.defaultParallelism, -(-m // LEAST)))
    per = max(1, -(-m // shares))
    # cells in turn, cut where a share is full: a large cell has pieces in several shares
    left_pieces = np.maximum(1, -(-left_cells // min(per, block_rows))).astype(np.int64)
    load = np.cumsum(np.repeat(left_cells / left_pieces, left_pieces))
    share = np.minimum(shares - 1, np.maximum(load - 1, 0) // per).astype(np.int32)

    def kept(side: DataFrame, pieces: np.ndarray, share: np.ndarray) -> DataFrame:
        dealt = _dealt(side, pivots, pieces, metric, {"share": share})
        return dealt.repartition(max(shares, spark.sparkContext.defaultParallelism), "cell", "piece").sortWithinPartitions("cell", "piece", "id").localCheckpoint()

    left = kept(rows, left_pieces, share)
    right = left if against is None else kept(other, right_pieces, np.zeros(int(right_pieces.sum()), np.int32))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], Nearest] = {}
        met = False
        for (side, cell, piece), block in in_blocks(batches, ["side", "cell", "piece"], lambda x: scaled(wide_again(x, width), metric)):
            if side == 0:
                if met:
                    raise RuntimeError("a share's own rows came after others")
                held[cell, piece] = Nearest(block, q, labels, pivots)
                continue
            if not met and q.own:
                for at, h in held.items():
                    h.meet(h.a, at[0], cells)
                for at, h in held.items():
                    for (c, piece_), b in held.items():
                        if (c, piece_) != at:
                            h.meet(b.a, c, cells)
            met = True
            if not q.own or (cell, piece) not in held:
                for h in held.values():
                    h.meet(block, cell, cells)
        yield from (h.found() for h in held.values())

    def read(s: int) -> DataFrame:
        own, all_ = (side.coalesce(1).withColumn("side", F.lit(k)) for k, side in enumerate((left.where(F.col("share") == s), right)))
        one = own.unionByName(all_).coalesce(1).select(F.lit(s).alias("share"), "side", "cell", "piece", "id", "label", "x")
        return one.coalesce(2)  # still one, but a union of frames of which Spark knows that would put all shares in one task

    return reduce(DataFrame.unionByName, [read(s) for s in range(shares)]).mapInPandas(run, _NEAR + ", rank int")


def in_blocks(batches: Iterator[pd.DataFrame], keys: list[str], read: Callable[[list[bytes]], np.ndarray]) -> Iterator[tuple[tuple, Block]]:
    """Rows (keys, id, label, x) that follow each other with the same keys, as blocks. read: a matrix of what is in x."""
    now, held = None, []

    def block() -> Block:
        rows = held[0] if len(held) == 1 else pd.concat(held)
        return Block(rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), read(rows["x"].tolist()))

    for part in batches:
        if not len(part):
            continue
        key = part[keys].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(key[a].tolist())
            if held and own != now:
                yield now, block()
                held = []
            now = own
            held.append(part.iloc[a:b])
    if held:
        yield now, block()


def visited(rows: DataFrame, k: int, metric: str = "euclidean", within: str = "any", block_rows: int = 2048) -> DataFrame:
    """One row: (pairs, all_pairs, cells_read, all_cells): pairs of blocks compared and possible, and numbers of distances computed in them and possible."""
    left, right, wanted = _indexed(rows, None, Question(k, metric, within, True), block_rows)
    size = right.select(F.col("cell").alias("r_cell"), F.col("piece").alias("r_piece"), (F.length("ids") / 8).alias("m"))
    n = size.agg(F.count("*").alias("b"), F.sum("m").alias("n"))
    seen = wanted.join(size, ["r_cell", "r_piece"]).agg(F.count("*").alias("pairs"), F.sum(F.length("rows") / 4 * F.col("m")).alias("cells_read"))
    return seen.crossJoin(n).select("pairs", (F.col("b") * F.col("b")).alias("all_pairs"), F.col("cells_read").cast("long"), (F.col("n") * F.col("n")).cast("long").alias("all_cells"))
