"""N-gram Jaccard join with a count-vector R-tree (operator 1).

A text is the set of its distinct 5-word shingles (of its whole word sequence where it has fewer
words); two texts link when 4 * intersection >= 3 * union. The join is exact up to hash collisions
(52 bits of each shingle; the final check compares 40 of them).

1. Equal sets are one class; everything below works on classes, so copies cost nothing.
2. Blocks: ordered by rarity, two linked sets share a shingle among the first n - ceil(3n/4) + 1 of
   each. Frequent shingles are ranked last (a bounded table of the most frequent ones; the order
   decides the cost, never the result).
   Two linked sets meet in the block of the first shingle they share, and its places in both bound their
   overlap, so members whose sizes that rules out are never compared: late places, where frequent shingles
   are, reach hardly any size.
3. Families: pairs in small blocks whose count vectors allow a link, and in large blocks the joins that
   the tree finds, hold classes together in families; no link leads out of a family. Shingles are hashed
   into groups, group counts are points, and the sum of coordinate minima bounds the overlap of two
   classes, or of a class and all below a node of an R-tree, whose coordinates are maxima.
4. A family's sets meet once, in tiles of bounded size. Some classes are verified against all others
   first, those that none reaches along a spanning forest of the highest bounds, and contracted; then the tree gives all pairs of different components whose
   bound reaches 3/7 of both sizes, and they are verified too. Pairs inside a component need no look
   for the components: they can't change them.
5. For the number of links, all pairs of classes of a tile are verified instead: their intersections are
   counted over an index from shingles to classes. A tile returns each class's number of linked documents
   and a spanning set of links, not the pairs, so rows don't grow with the square of a family.

Large blocks and families are tiled. Links and components stay in tables in the shared folder.

Nulls, empty and wordless texts are empty sets and link with nothing (component: their own id).
Repeated rows are members of the same class; a null id takes the smallest id of its component, if any.
An id with several texts names several rows: each is a member of its own text's class, and a component is
named by the smallest id in it, so ids can share a name by one of their texts only. At exactly 3/4 two
texts link. Texts are read whole, however long. An empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import tokens as tk
from quillmesh.llm.components import components
from quillmesh.llm.util import cut, forget, mapped, parts, table

K = 5
GROUPS = 512
COARSE = 64  # groups of sets of up to 800 shingles; larger ones have 128, 256, then GROUPS
SMALL = 12  # classes of a small block
FREQUENT = 500_000  # most frequent shingles that are ranked; 12 bytes each
TILE = 4096
TILE_SHINGLES = 1 << 23  # 40 MB of sets
LEAF = 32
PIVOTS = 16  # classes of a tile that are verified against all others first
ROWS = 1 << 21  # bytes of text handled at a time
COUNTED = 1 << 22  # shingles counted at a time
NEEDED = 1 << 24  # bits of the filter of documents whose sets are read again
PREFIX = [("h", "<u8"), ("c", "<i8"), ("n", "<i4"), ("u", "<i4")]


def _sets(batch: pa.RecordBatch, text: str):
    """Slices of a batch: (rows from, to, shingle hashes ascending by text, their offsets)."""
    at = 0
    while at < batch.num_rows:
        data, offs = tk.buffer(batch.column(text).slice(at))
        n = min(max(1, int(np.searchsorted(offs, ROWS, "right")) - 1), tk.SET_DOCS)
        data, offs = data[: offs[n]], offs[: n + 1]
        folded, s, e, doc = tk.words(data, offs)
        h, own = tk.shingles(tk.hashes(folded, s, e), doc, n, K)
        h, first = tk.distinct_sets(h, own, n)
        yield at, at + n, h, first
        at += n


def _class_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; with its size it names a class."""
    with np.errstate(over="ignore"):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(tk.mixed(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, out=c[1:])
        return tk.mixed(c[first[1:]] - c[first[:-1]]).view(np.int64)


def _points(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Count vectors, a byte a group; empty where a count is over 255 (then nothing is known of the set)."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    out: list[bytes] = []
    for a in range(0, n, 512):
        b = min(n, a + 512)
        lo, hi = first[a], first[b]
        p = np.bincount((doc[lo:hi] - a) * GROUPS + (h[lo:hi] >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=(b - a) * GROUPS).reshape(-1, GROUPS)
        for row, size in zip(p, np.diff(first[a : b + 1])):
            g = COARSE
            while g < GROUPS and size > 12.5 * g:
                g *= 2
            row = row.reshape(-1, g).sum(0)
            out.append(b"" if row.max() > 255 else row.astype(np.uint8).tobytes())
    return out


def _matrix(blobs: list, sizes: np.ndarray, groups: int) -> np.ndarray:
    """Points of many sets, folded to `groups`; unknown ones are as large as any overlap could be."""
    out = np.empty((len(blobs), groups), np.int32)
    for i, b in enumerate(blobs):
        out[i] = np.frombuffer(b, np.uint8).reshape(-1, groups).sum(0, dtype=np.int32) if b else sizes[i]
    return out


def _describe(text: str, ident: str):
    """Rows (kind 0) of each document: id, class, size, point; (kind 1) locally frequent shingles and counts."""

    def often(held, docs):
        u, c = np.unique(np.concatenate(held), return_counts=True)
        at = np.flatnonzero(c >= max(4, docs // 1500))
        m = len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(u[at].view(np.int64)), pa.array(c[at].astype(np.int32)), pa.nulls(m, pa.binary())], ["kind", "doc_id", "cid", "n", "point"])

    def run(batches):
        held, size, docs = [], 0, 0
        for batch in batches:
            for a, b, h, first in _sets(batch, text):
                cid, n = _class_ids(h, first), np.diff(first)
                blob = pa.array(_points(h, first), pa.binary())
                ids = batch.column(ident).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), ids.cast(pa.int64()), pa.array(cid), pa.array(n.astype(np.int32)), blob], ["kind", "doc_id", "cid", "n", "point"])
                _, one = np.unique(cid, return_index=True)  # copies count once
                keep = np.zeros(b - a, bool)
                keep[one] = True
                held.append(h[np.repeat(keep, n)])
                size, docs = size + len(held[-1]), docs + len(one)
                if size > COUNTED:
                    yield often(held, docs)
                    held, size, docs = [], 0, 0
        if held:
            yield often(held, docs)

    return run


def _prefixes(text: str, buckets: int, frequent: np.ndarray, rank: np.ndarray):
    """Packed (shingle, class, size, reach) of each class's prefix, by bucket of the shingle.

    Reach: the largest set that the class can link with if this shingle, at place i of n, is the first one
    both have. At most n - i are common then, so 7 (n - i) >= 3 (n + other).
    """
    bits = np.zeros(1 << 20, bool)
    bits[(frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            for a, b, h, first in _sets(batch, text):
                cid, n = _class_ids(h, first), np.diff(first)
                _, one = np.unique(cid, return_index=True)
                keep = np.zeros(b - a, bool)
                keep[one] = True
                doc = np.repeat(np.arange(b - a), n)
                sel = keep[doc]
                h2, d2 = h[sel], doc[sel]
                want = n - -(-3 * n // 4) + 1
                r = np.full(len(h2), -1, np.int64)
                maybe = np.flatnonzero(bits[(h2 & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if len(maybe) and len(frequent):
                    i = np.searchsorted(frequent, h2[maybe])
                    i[i == len(frequent)] = 0
                    ok = frequent[i] == h2[maybe]
                    r[maybe[ok]] = rank[i[ok]]
                # rare shingles first, by hash; then the frequent ones, the most frequent last
                rare = np.flatnonzero(r < 0)
                start = np.searchsorted(d2[rare], np.arange(b - a + 1))
                place = np.arange(len(rare)) - start[d2[rare]]
                fit = place < want[d2[rare]]
                pre, place = rare[fit], place[fit]
                rares = np.diff(start)
                short = want - rares
                hot = np.flatnonzero((r >= 0) & (short[d2] > 0))
                hot = hot[np.lexsort((r[hot], d2[hot]))]
                start = np.searchsorted(d2[hot], np.arange(b - a))
                after = np.arange(len(hot)) - start[d2[hot]]
                fit = after < short[d2[hot]]
                hot, after = hot[fit], after[fit]
                pre, place = np.concatenate([pre, hot]), np.concatenate([place, rares[d2[hot]] + after])
                h2, d2 = h2[pre], d2[pre]
                rec = np.empty(len(h2), PREFIX)
                rec["h"], rec["c"], rec["n"], rec["u"] = h2, cid[d2], n[d2], (4 * n[d2] - 7 * place) // 3
                bk = (h2 >> np.uint64(12)).astype(np.int64) % buckets
                order = np.argsort(bk, kind="stable")
                rec, bk = rec[order], bk[order]
                ub, lo = np.unique(bk, return_index=True)
                hi = np.append(lo[1:], len(bk))
                yield pa.RecordBatch.from_arrays([pa.array(ub.astype(np.int32)), pa.array([rec[x:y].tobytes() for x, y in zip(lo, hi)], pa.binary())], ["bucket", "blob"])

    return run


def _paired(n: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Places of a block's members that are in reach of another member that is within their own reach."""
    order = np.argsort(n, kind="stable")
    n, u = n[order], u[order]
    best = np.maximum.accumulate(u)
    second = np.maximum.accumulate(np.append(-1, np.minimum(u[1:], best[:-1])))
    k = np.searchsorted(n, u, "right")  # members small enough for each
    self_best = (np.arange(len(n)) < k) & (u >= best[k - 1])
    return np.sort(order[(k > 0) & (np.where(self_best, second[k - 1], best[k - 1]) >= n)])


def _blocks(batches):
    """Pairs of small blocks whose sizes are within each other's reach, once a bucket; with h: members of large blocks and their reach (as nb)."""
    got: dict[int, list] = {}
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got.setdefault(k, []).append(v)
    for k in list(got):
        rec = np.unique(np.frombuffer(b"".join(got.pop(k)), PREFIX))
        h, c, n, u = (np.ascontiguousarray(rec[x]) for x in ("h", "c", "n", "u"))
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(h)))
        pairs = []
        own = np.repeat(size, size)
        left = np.arange(len(h)) - np.repeat(at, size)
        for d in range(1, SMALL):  # partners d places on in the block
            i = np.flatnonzero((own <= SMALL) & (left + d < own))
            if not len(i):
                break
            j = i + d
            near = (n[j] <= u[i]) & (n[i] <= u[j])
            i, j = i[near], j[near]
            swap = (c[i] > c[j]) | ((c[i] == c[j]) & (n[i] > n[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            p = np.empty(len(i), [("a", "<i8"), ("na", "<i4"), ("b", "<i8"), ("nb", "<i4")])
            p["a"], p["na"], p["b"], p["nb"] = c[i], n[i], c[j], n[j]
            pairs.append(np.unique(p))
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, [("a", "<i8"), ("na", "<i4"), ("b", "<i8"), ("nb", "<i4")])
        big = np.flatnonzero(own > SMALL)
        big = np.concatenate([big[:0], *(lo + _paired(n[lo : lo + m], u[lo : lo + m]) for lo, m in zip(at[size > SMALL], size[size > SMALL]))])
        for s in range(0, len(pairs), 100_000):
            p = pairs[s : s + 100_000]
            m = len(p)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), *[pa.array(np.ascontiguousarray(p[x])) for x in ("a", "na", "b", "nb")]], ["h", "a", "na", "b", "nb"])
        for s in range(0, len(big), 100_000):
            i = big[s : s + 100_000]
            m = len(i)
            yield pa.RecordBatch.from_arrays([pa.array(h[i].view(np.int64)), pa.array(c[i]), pa.array(n[i]), pa.nulls(m, pa.int64()), pa.array(u[i])], ["h", "a", "na", "b", "nb"])


def _bounded(batches):
    """Pairs whose points, folded to the coarser of the two, allow a link."""
    for batch in batches:
        a, na, b, nb = (batch.column(i).to_numpy() for i in range(4))
        pa_, pb_ = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        groups = np.array([min(len(x) or GROUPS, len(y) or GROUPS) for x, y in zip(pa_, pb_)])
        ok = np.zeros(len(a), bool)
        for g in np.unique(groups).tolist():
            i = np.flatnonzero(groups == g)
            bound = np.minimum(_matrix([pa_[k] for k in i], na[i], g), _matrix([pb_[k] for k in i], nb[i], g)).sum(1)
            ok[i] = 7 * bound >= 3 * (na[i].astype(np.int64) + nb[i])
        ok = np.flatnonzero(ok)
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, na, b, nb)], ["a", "na", "b", "nb"])


def _packed(text: str, ident: str, needed: np.ndarray):
    """(class, size, set) of documents the filter lets through: 40 bits of each shingle, five bytes each."""

    def run(batches):
        for batch in batches:
            ids = batch.column(ident)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            at = _bit(ids.fill_null(0).to_numpy().astype(np.uint64))
            hit = (needed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) | ~known
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            for a, b, h, first in _sets(batch, text):
                cid, n = _class_ids(h, first), np.diff(first)
                _, one = np.unique(cid, return_index=True)
                one = one[n[one] > 0]
                raw = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]
                sets = [np.ascontiguousarray(raw[first[i] : first[i + 1]]).tobytes() for i in one]
                yield pa.RecordBatch.from_arrays([pa.array(cid[one]), pa.array(n[one].astype(np.int32)), pa.array(sets, pa.binary())], ["c", "n", "s"])

    return run


def _bit(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tk.mixed(ids * tk.BASE) % np.uint64(NEEDED)).astype(np.int64)


def _bits(batches):
    """Positions of ids in the filter, as words of 32 bits: one row for each word a partition sets."""
    word, bit = [], []
    for batch in batches:
        at = _bit(batch.column(0).to_numpy().astype(np.uint64))
        word.append(at >> 5)
        bit.append(np.left_shift(1, at & 31))
    if word:
        w, i = np.unique(np.concatenate(word), return_inverse=True)
        v = np.zeros(len(w), np.int64)
        np.bitwise_or.at(v, i, np.concatenate(bit))
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(v)], ["w", "v"])


def _unpacked(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return raw.view(np.uint64).ravel()


def _link(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 4 * both >= 3 * (len(a) + len(b) - both)


class CountTree:
    """An R-tree over count vectors: each node has the coordinate maxima and the smallest size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.order = np.lexsort((points[:, 0], points.argmax(1), sizes))
        self.points, self.sizes, self.levels = points[self.order], sizes[self.order], []
        top, low = self.points, self.sizes
        while len(top) > leaf:
            cuts = np.arange(0, len(top), leaf)
            top, low = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(low, cuts)
            self.levels.append((top, low))
        self.leaf = leaf

    def search(self, query: np.ndarray, size: int, among: np.ndarray | None = None) -> np.ndarray:
        """Places (in the given order) of points whose bound reaches 3/7 of both sizes.

        among: which points (in the tree's order) are asked for; nodes above none of them are not entered.
        """
        fan, wanted = None, []
        for top, _ in self.levels if among is not None else ():
            below = wanted[-1] if wanted else among
            wanted.append(np.logical_or.reduceat(below, np.arange(0, len(below), self.leaf)))
        for top, low in reversed(self.levels):
            look = np.arange(len(top)) if fan is None else fan[fan < len(top)]
            look = look[wanted.pop()[look]] if among is not None else look
            bound = np.minimum(top[look], query).sum(1)
            look = look[7 * bound >= 3 * (size + low[look])]
            fan = (look[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        look = np.arange(len(self.points)) if fan is None else fan[fan < len(self.points)]
        look = look[among[look]] if among is not None else look
        if not len(look):
            return look
        n = self.sizes[look]
        fit = 4 * np.minimum(n, size) >= 3 * np.maximum(n, size)
        look, n = look[fit], n[fit]
        return self.order[look[7 * np.minimum(self.points[look], query).sum(1) >= 3 * (size + n)]]


def _forest(pts: np.ndarray, n: np.ndarray, slot: np.ndarray, across: bool):
    """Pairs along a maximum spanning forest of the bounds (between tiles: each class's best partner)."""
    m = len(n)
    if across:
        a, b = np.flatnonzero(slot == slot.min()), np.flatnonzero(slot != slot.min())
        for i in a if len(b) else ():
            s = _gain(pts, n, i, b)
            if s.max() > 0:
                yield int(i), int(b[s.argmax()])
        return
    best, near, out = np.zeros(m), np.full(m, -1), np.ones(m, bool)
    for _ in range(m):
        i = int(np.where(out, best, -1).argmax())
        out[i] = False
        if best[i] > 0:
            yield i, int(near[i])
        rest = np.flatnonzero(out)
        if not len(rest):
            break
        s = _gain(pts, n, i, rest)
        up = s > best[rest]
        best[rest[up]], near[rest[up]] = s[up], i


def _gain(pts, n, i, rest):
    """Bound of the likeness of i and each of rest; 0 where they can't link."""
    over = np.minimum(pts[rest], pts[i]).sum(1)
    ok = (4 * np.minimum(n[rest], n[i]) >= 3 * np.maximum(n[rest], n[i])) & (7 * over >= 3 * (n[rest] + n[i]))
    return np.where(ok, over / np.maximum(n[rest] + n[i] - over, 1), 0.0)


class _Roots:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        r = self.root
        while r[i] != i:
            r[i] = r[r[i]]
            i = r[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(i), self.find(j)
        self.root[a] = b
        return a != b


def _joined(x: dict, n, slot, across: bool):
    """Pairs that join what the tree's hits hold together, so many only as there are joins.

    Each class asks for larger ones that are within its reach, that it is within reach of, and that no join has led to yet.
    """
    data = x["data"]
    pts = _matrix(data, n, COARSE)
    tree = CountTree(pts, n)
    order, size, reach = tree.order, tree.sizes, x["m"][tree.order]
    own, comp = slot[order], np.arange(len(n))
    members = [[i] for i in range(len(n))]
    at = np.empty(len(n), np.int64)
    at[order] = np.arange(len(n))
    ends = np.searchsorted(size, reach, "right")
    for q in range(len(n)):
        lo, hi = q + 1, int(ends[q])
        if hi <= lo:
            continue
        among = np.zeros(len(n), bool)
        among[lo:hi] = (reach[lo:hi] >= size[q]) & (comp[lo:hi] != comp[q])
        if across:
            among[lo:hi] &= own[lo:hi] != own[q]
        if not among.any():
            continue
        i = int(order[q])
        for j in tree.search(pts[i], int(n[i]), among).tolist():
            a, b = comp[q], comp[at[j]]
            if a == b:
                continue
            g = min(len(data[i]) or GROUPS, len(data[j]) or GROUPS)
            if g > COARSE and data[i] and data[j]:  # a finer look at larger sets
                fine = _matrix([data[i], data[j]], n, g)
                if 7 * int(np.minimum(fine[0], fine[1]).sum()) < 3 * int(n[i] + n[j]):
                    continue
            a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
            comp[members[b]] = a
            members[a] += members[b]
            members[b] = []
            yield i, j


def _pivots(sets: list, pts, n, slot, across: bool, roots: _Roots, left: list):
    """Verified links of some classes of middle size with all that no such class has reached; `left` gets the rest.

    Copies with few edits are all near a few of them, so large families need no look at all their pairs.
    """
    rest = np.arange(len(n))
    for _ in range(PIVOTS):
        if len(rest) < LEAF:
            break
        i = int(rest[np.argsort(n[rest], kind="stable")[len(rest) // 2]])
        for _ in range(2 if across else 1):  # between tiles: from one to the other, and back
            look = rest[(rest != i) & (slot[rest] != slot[i])] if across else rest[rest != i]
            got = [j for j in look[_gain(pts, n, i, look) > 0].tolist() if _link(sets[i], sets[j])]
            for j in got:
                if roots.join(i, j):
                    yield i, j
            rest = np.setdiff1d(rest, [i, *got])
            if not got:
                break
            i = got[len(got) // 2]
    left.extend(rest.tolist())


def _settled(x: dict, n, slot, across: bool):
    """Verified links that hold the tile's components together."""
    sets = [_unpacked(b) for b in x["data"]]
    pts = np.stack([np.bincount((s >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32) for s in sets])
    roots, left = _Roots(len(n)), []
    yield from _pivots(sets, pts, n, slot, across, roots, left)
    left = np.array(left, np.int64)
    for i, j in _forest(pts[left], n[left], slot[left], across) if len(left) else ():
        i, j = int(left[i]), int(left[j])
        if _link(sets[i], sets[j]) and roots.join(i, j):
            yield i, j
    comp = np.array([roots.find(i) for i in range(len(n))])
    vals, counts = np.unique(comp, return_counts=True)
    if len(vals) < 2:
        return
    major = vals[counts.argmax()]
    tree = CountTree(pts, n)
    by, own = comp[tree.order], slot[tree.order]
    for q in np.flatnonzero(comp != major).tolist():
        among = (by != comp[q]) & ((by == major) | (tree.order > q))
        if across:
            among &= own != slot[q]
        if not among.any():
            continue
        for j in tree.search(pts[q], int(n[q]), among).tolist():
            if roots.find(q) != roots.find(j) and _link(sets[q], sets[j]):
                roots.join(q, j)
                yield q, j


class _Linked:
    """All verified links: a spanning set of them, and each class's number of documents linked to."""

    def __init__(self):
        self.links = np.zeros(0, np.int64)

    def __call__(self, x: dict, n, slot, across: bool):
        sets = [_unpacked(b) for b in x["data"]]
        m, size = len(sets), np.array([len(s) for s in sets])
        own = np.repeat(np.arange(m), size)
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        by = own[np.argsort(at, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(at))])
        of = np.concatenate([[0], np.cumsum(size)])
        self.links, roots = np.zeros(m, np.int64), _Roots(m)
        for q in range(m):
            both = np.zeros(m, np.int64)
            mine = at[of[q] : of[q + 1]]
            for s in range(0, len(mine), 1024):
                lo, hi = first[mine[s : s + 1024]], first[mine[s : s + 1024] + 1]
                n_ = hi - lo
                both += np.bincount(by[np.repeat(lo - np.cumsum(n_) + n_, n_) + np.arange(n_.sum())], minlength=m)
            hit = 4 * both >= 3 * (size[q] + size - both)
            hit[q] = False
            if across:
                hit &= slot != slot[q]
            hit = np.flatnonzero(hit)
            self.links[q] = x["m"][hit].sum()
            for j in hit[hit > q].tolist():
                if roots.join(q, j):
                    yield q, j


def _tiles(pick):
    """Pairs that `pick` takes in each tile; rows come sorted by (g, t1, t2)."""

    def run(batches):
        names = ["g", "t1", "t2", "slot", "c", "n", "m", "data"]
        held, key, out = [], None, []

        def close():
            if not held:
                return
            x = {k: (sum((p[k] for p in held), []) if k == "data" else np.concatenate([p[k] for p in held])) for k in names}
            if len(x["c"]) < 2:
                return
            for i, j in pick(x, x["n"].astype(np.int64), x["slot"], x["t1"][0] != x["t2"][0]):
                a, b = sorted([(int(x["c"][i]), int(x["n"][i])), (int(x["c"][j]), int(x["n"][j]))])
                out.append((*a, *b, 0))
            if isinstance(pick, _Linked):
                out.extend((c, k, None, None, v) for c, k, v in zip(x["c"].tolist(), x["n"].tolist(), pick.links.tolist()) if v)

        def flush():
            cols = list(zip(*out)) if out else [[], [], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["a", "na", "b", "nb", "links"])

        for batch in batches:
            cols = {k: (batch.column(k).to_pylist() if k == "data" else batch.column(k).to_numpy()) for k in names}
            ids = np.stack([cols["g"], cols["t1"], cols["t2"]])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), ids.shape[1]]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                this = tuple(ids[:, lo].tolist())
                if this != key:
                    close()
                    held, key = [], this
                held.append({k: v[lo:hi] for k, v in cols.items()})
            if len(out) > 50_000:
                yield flush()
        close()
        yield flush()

    return run


def _tiled(members: DataFrame, pick, spent: list) -> DataFrame:
    """members (g, c, n, m documents, data) to the pairs (a, na, b, nb) that `pick` takes in their groups (b null: links of a), cut into tiles of TILE classes and TILE_SHINGLES shingles at most.

    The sizes of groups are a table of their own (it goes to `spent`), so the join with it has nothing to
    aggregate in its tasks and a group that holds much of all rows can be parted there (skew join).
    """
    size = cut(members.groupBy("g").agg(F.count("*").alias("size"), F.sum(F.col("n").cast("long")).alias("all")).filter("size > 1"))
    spent.append(size)
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("all") / TILE_SHINGLES)).cast("int")
    m = members.join(size, "g").withColumn("tiles", tiles).withColumn("slot", F.pmod(F.xxhash64("c", "n"), F.col("tiles").cast("long")).cast("int"))
    m = m.withColumn("t", F.explode(F.expr("transform(sequence(0, tiles - 1), t -> struct(least(t, slot) AS t1, greatest(t, slot) AS t2))")))
    m = m.select("g", "t.t1", "t.t2", "slot", "c", "n", "m", "data").repartition(parts(members.sparkSession), "g", "t1", "t2").sortWithinPartitions("g", "t1", "t2", "c", "n")
    return mapped(m, _tiles(pick), "a long, na int, b long, nb int, links long").groupBy("a", "na", "b", "nb").agg(F.sum("links").alias("links"))


def _needed_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, n, data): sets of the classes (doc), read again from the first document of each.

    Which they are is known from a filter of NEEDED bits (2 MB, whatever the input); what it lets
    through in error joins with nothing.
    """
    words = mapped(classes.filter("doc IS NOT NULL").select("doc"), _bits, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    needed = np.zeros(NEEDED // 32, np.uint32)
    needed[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    sets = mapped(docs, _packed("text", "doc_id", needed.view(np.uint8)), "c long, n int, s binary")
    return sets.groupBy("c", "n").agg(F.min("s").alias("data"))


def near_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; with links, n_links too: the other rows it links with."""
    spark = docs.sparkSession
    docs = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = cut(mapped(docs, _describe("text", "doc_id"), "kind int, doc_id long, cid long, n int, point binary"))
    rows = described.filter("kind = 0")
    top = described.filter("kind = 1").groupBy("cid").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "cid").limit(FREQUENT).select("cid").toArrow()
    frequent = top.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    rank = len(frequent) - order  # the more frequent, the later
    frequent = frequent[order]
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(parts(spark), int(total * 0.27 * 20 / 16e6) + 1)
    packed = mapped(docs.select("text"), _prefixes("text", buckets, frequent, rank), "bucket int, blob binary")
    found = cut(mapped(packed.repartition(buckets, "bucket"), _blocks, "h long, a long, na int, b long, nb int"))
    # classes are named by one number from here on: their smallest document, or the class id without one
    classes = cut(rows.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("doc"), F.count("*").alias("m"), F.any_value("point").alias("point")).withColumn("node", F.coalesce("doc", "cid")))
    point = classes.select(F.col("cid").alias("c"), "n", "node", "point")

    small = found.filter("h IS NULL").select("a", "na", "b", "nb").distinct()
    small = small.join(point.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa")), ["a", "na"])
    small = small.join(point.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), ["b", "nb"])
    small = mapped(small.select("a", "na", "b", "nb", "pa", "pb"), _bounded, "a long, na int, b long, nb int")
    large = found.filter("h IS NOT NULL").select(F.col("h").alias("g"), F.col("a").alias("c"), F.col("na").alias("n"), F.col("nb").cast("long").alias("m"))
    large = large.join(point.select("c", "n", F.col("point").alias("data")), ["c", "n"]).select("g", "c", "n", "m", "data")
    spent: list[DataFrame] = []
    families = components(_named(small.union(_tiled(large, _joined, spent).drop("links")), classes))
    forget(found, *spent)

    members = cut(classes.select("cid", "n", "m", "node", "doc").join(families, "node").select(F.col("label").alias("g"), F.col("cid").alias("c"), "n", "m", "doc"))
    sets = _needed_sets(docs, members)
    found = _tiled(members.select("g", "c", "n", "m").join(sets, ["c", "n"]), _Linked() if links else _settled, spent)
    found = cut(found) if links else found
    comp = components(_named(found.filter("b IS NOT NULL").drop("links"), classes))
    forget(members, *spent)

    out = classes.select("cid", "n", "m", "node", "doc").join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = out.groupBy("label").agg(F.min("doc").alias("component_id"))
    out = out.join(low, "label").select("cid", "n", "m", "component_id")
    if links:
        linked = found.filter("b IS NULL").select(F.col("a").alias("cid"), F.col("na").alias("n"), "links")
        out = out.join(linked, ["cid", "n"], "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("m") - 1)
        out = out.drop("links")
    got = rows.select("doc_id", "cid", "n").join(out, ["cid", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return got.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component, *more)


def _named(e: DataFrame, classes: DataFrame) -> DataFrame:
    c = classes.select("cid", "n", "node")
    e = e.join(c.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("node").alias("u")), ["a", "na"])
    e = e.join(c.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("node").alias("v")), ["b", "nb"])
    return e.select("u", "v")


def op1(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), links=True)
