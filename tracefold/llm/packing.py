"""Documents into windows of fixed token capacity: bin completion over bounded lots.

An item longer than the window is cut into full windows and one rest; full windows are bins of their own and
need no search. All other items are spread by hash over lots of about LOT_ITEMS items, which leaves at most a
partly filled bin per lot, so a lot is a bounded group of (id, piece, size) triples at any corpus size. Within
a lot the search enumerates undominated fillings around the largest item left, best first, prunes branches
whose wasted room can no longer beat the incumbent, and keeps the best packing, which starts as best-fit
decreasing. It ends at the lower bound or after `budget` bins were filled; then the incumbent holds.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.tokens import RANK_FILE, TOKENIZER_DIR, token_counts
from tracefold.session import written

LOT_ITEMS = 4_000
#: Bins filled by the search of one lot, as a multiple of the lot's incumbent.
BUDGET = 3
#: Windows are settings; a table beyond this bound isn't one of settings.
MAX_WINDOWS = 1_000
PACKED_SCHEMA = "window_name string, capacity_tokens int, lot long, bin int, doc_id long, piece int, first_token long, n_tokens int"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest of the continuous bound and the bounds that set items above a threshold apart (Martello and Toth)."""
    if not len(sizes):
        return 0
    s = np.sort(sizes)
    best = -(-int(s.sum()) // capacity)
    below = np.concatenate([[0], np.cumsum(s)])
    for k in np.unique(s[s <= capacity // 2]):
        big = len(s) - np.searchsorted(s, capacity - k, "right")
        lo, hi = np.searchsorted(s, capacity // 2, "right"), np.searchsorted(s, capacity - k, "right")
        mid_n, mid_sum = hi - lo, below[hi] - below[lo]
        small_sum = below[lo] - below[np.searchsorted(s, k, "left")]
        extra = max(0, -(-int(small_sum - (mid_n * capacity - mid_sum)) // capacity))
        best = max(best, int(big + mid_n + extra))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of sizes."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in np.sort(sizes)[::-1].tolist():
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([s])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            left, b = room.pop(at)
            bins[b].append(s)
            insort(room, (left - s, b))
    return bins


def _top_up(present: np.ndarray, count: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill `room` with at most three of the sizes present (ascending): the best one, pair and
    triple, each only if it wastes less than the shorter ones."""
    out: list[tuple[int, ...]] = [()]
    fits = present[: np.searchsorted(present, room, "right")]
    if not len(fits):
        return out
    best = int(fits[-1])
    out.append((best,))
    if best == room:
        return out

    def pair(left: int, used: int = -1) -> tuple[int, int] | None:
        """Best x >= y with x + y <= left; `used` is a size of which one is taken."""
        x = fits[: np.searchsorted(fits, left, "right")]
        if not len(x):
            return None
        at = np.searchsorted(x, np.minimum(left - x, x), "right") - 1
        ok = at >= 0
        # A size twice needs two of it; else the next smaller one stands in.
        n = count[x] - (x == used)
        ok &= n > 0
        y = x[np.maximum(at, 0)]
        twice = (y == x) & (n < 2) | (y == used) & (count[y] < 2 + (y == x))
        at = at - twice
        ok &= at >= 0
        if not ok.any():
            return None
        y = x[np.maximum(at, 0)]
        total = np.where(ok, x + y, -1)
        i = int(total.argmax())
        return (int(x[i]), int(y[i])) if total[i] > 0 else None

    p = pair(room)
    if p and sum(p) > best:
        best = sum(p)
        out.append(p)
        if best == room:
            return out
    for z in fits[::-1].tolist():
        if z * 3 <= best:  # no triple whose largest item is z can be better
            break
        p = pair(room - z, z)
        if p and z >= p[0] and z + sum(p) > best:
            best = z + sum(p)
            out.append((z, *p))
            if best == room:
                break
    return out


def _fillings(count: np.ndarray, present: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(waste, filling) around the largest size left, least waste first, until one wastes nothing. A filling is a stem of
    largest items that fit, of any length, and up to three more that are searched for."""
    room, chosen, taken, stems = capacity - int(present[-1]), [int(present[-1])], {int(present[-1]): 1}, []
    while True:
        stems.append((room, list(chosen)))
        at = int(np.searchsorted(present, room, "right")) - 1
        while at >= 0 and count[present[at]] - taken.get(int(present[at]), 0) <= 0:
            at -= 1
        if at < 0:
            break
        s = int(present[at])
        chosen.append(s)
        taken[s] = taken.get(s, 0) + 1
        room -= s
    found: dict[tuple[int, ...], int] = {}
    # The shorter a stem, the more room is left to do better than greed.
    for room, stem in stems[::-1]:
        for s in stem:
            count[s] -= 1
        left = present[count[present] > 0]
        for more in _top_up(left, count, room):
            filling = tuple(sorted([*stem, *more], reverse=True))
            found[filling] = capacity - sum(filling)
        for s in stem:
            count[s] += 1
        if min(found.values()) == 0:
            break
    ranked = sorted((w, list(f)) for f, w in found.items())
    kept: list[tuple[int, list[int]]] = []
    for w, f in ranked:
        if not any(len(g) == len(f) and all(a >= b for a, b in zip(g, f)) for _, g in kept):
            kept.append((w, f))
    return kept


def bin_completion(sizes: np.ndarray, capacity: int, budget: int = BUDGET) -> list[list[int]]:
    """Packs sizes (each from 1 to capacity); returns bins as lists of sizes."""
    best = best_fit_decreasing(sizes, capacity)
    low = lower_bound(sizes, capacity)
    if len(best) <= low:
        return best
    count = np.bincount(sizes, minlength=capacity + 1)
    total, left = int(sizes.sum()), len(sizes)
    path: list[list[int]] = []
    branches: list[list[tuple[int, list[int]]]] = []
    waste, steps, limit = 0, 0, budget * len(best)
    while len(best) > low and steps < limit:
        if left == 0:
            if len(path) < len(best):
                best = [list(f) for f in path]
            options: list[tuple[int, list[int]]] = []
        else:
            allowed = (len(best) - 1) * capacity - total
            options = [o for o in _fillings(count, np.flatnonzero(count), capacity) if waste + o[0] <= allowed][::-1]
        branches.append(options)
        while branches and not branches[-1]:
            branches.pop()
            if path and len(path) > len(branches) - 1 and branches:
                undone = path.pop()
                np.add.at(count, undone, 1)
                left += len(undone)
                waste -= capacity - sum(undone)
        if not branches:
            break
        w, filling = branches[-1].pop()
        np.subtract.at(count, filling, 1)
        left -= len(filling)
        waste += w
        path.append(filling)
        steps += 1
    return best


def _pack_lot(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf.capacity_tokens.iloc[0])
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ignore_index=True)
    sizes = pdf.n_tokens.to_numpy(np.int64)
    bins = bin_completion(sizes[sizes > 0], capacity)
    at = {int(s): list(g) for s, g in pdf.groupby("n_tokens").groups.items()}
    where = np.zeros(len(pdf), np.int32)  # items without a token go to the first bin
    for b, filling in enumerate(bins):
        for s in filling:
            where[at[s].pop()] = b
    return pdf.assign(bin=where)[["window_name", "capacity_tokens", "lot", "bin", "doc_id", "piece", "first_token", "n_tokens"]]


def pack(sizes: DataFrame, windows: DataFrame, lot_items: int = LOT_ITEMS) -> DataFrame:
    """(window_name, capacity_tokens, lot, bin, doc_id, piece, first_token, n_tokens): every document of `sizes`
    (doc_id, n_tokens) once per window, in as many pieces as its length needs.

    (lot, bin) names a container; pieces that fill a window by themselves have one each, under a negative lot. Null and zero lengths take no room and go to their lot's first bin. Windows without a positive
    capacity take nothing. Repeated doc_ids are packed as often as they occur.
    """
    sizes = written(sizes.select("doc_id", "n_tokens"), "sizes")
    n = sizes.count()
    wide = windows.filter(F.col("capacity_tokens") > 0).select("window_name", "capacity_tokens").limit(MAX_WINDOWS + 1).collect()
    if len(wide) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows")
    if not wide:
        return sizes.sparkSession.createDataFrame([], PACKED_SCHEMA)
    each = F.array(*(F.struct(F.lit(w.window_name).alias("window_name"), F.lit(int(w.capacity_tokens)).alias("capacity_tokens")) for w in wide))
    c, t = F.col("capacity_tokens"), F.coalesce(F.col("n_tokens"), F.lit(0))
    items = (
        sizes.select(F.col("doc_id").cast("long").alias("doc_id"), t.cast("long").alias("total"), F.monotonically_increasing_id().alias("row"))
        .withColumn("window", F.explode(each))
        .select("doc_id", "total", "row", "window.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / c) - 1).cast("int"))))
        .withColumn("first_token", F.col("piece") * c.cast("long"))
        .withColumn("n_tokens", F.least(c.cast("long"), F.col("total") - F.col("first_token")).cast("int"))
        .drop("total")
    )
    lots = max(1, -(-n // lot_items))
    full = items.filter(F.col("n_tokens") == c).select(
        "window_name", "capacity_tokens", (-1 - F.col("row")).alias("lot"), F.col("piece").alias("bin"), "doc_id", "piece", "first_token", "n_tokens"
    )
    rest = (
        items.filter(F.col("n_tokens") < c)
        .withColumn("lot", F.pmod(F.xxhash64("row", "piece"), F.lit(lots)))  # the stored table keeps its row numbers
        .drop("row")
        .groupBy("window_name", "capacity_tokens", "lot")
        .applyInPandas(_pack_lot, PACKED_SCHEMA)
    )
    return full.unionByName(rest)


def pack_documents(docs: DataFrame, windows: DataFrame, folder: str = TOKENIZER_DIR, file: str = RANK_FILE, lot_items: int = LOT_ITEMS) -> DataFrame:
    """Sizes each passage once, then packs it into every window."""
    return pack(token_counts(docs, folder=folder, file=file), windows, lot_items)


def packing_report(packed: DataFrame) -> DataFrame:
    """Containers, pieces and used share per window."""
    bins = packed.filter(F.col("lot") >= 0).groupBy("window_name", "capacity_tokens", "lot", "bin").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").cast("long").alias("used")
    )
    full = packed.filter(F.col("lot") < 0).select("window_name", "capacity_tokens", "lot", "bin", F.lit(1).cast("long").alias("pieces"), F.col("n_tokens").cast("long").alias("used"))
    return (
        bins.unionByName(full)
        .groupBy("window_name", "capacity_tokens")
        .agg(
            F.count(F.lit(1)).alias("containers"),
            F.sum("pieces").alias("pieces"),
            F.sum("used").alias("tokens"),
            (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("used_share"),
        )
    )
