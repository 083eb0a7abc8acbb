"""Language-model scoring with Brown classes (operator 4).

P(w | previous) = P(class of w | class of previous) * P(w | class of w), additively smoothed. Documents
whose crc32(id) mod 5 is not 1 are the training text.

1. Words: every training word is counted, in a distributed table. Those of the highest counts, FREQUENT at
   most, go to all tasks (17 bytes each); every other word stays in the table, at every input size.
2. Coding: the text is read once more and written as slices of word codes: a frequent word's place, or a
   place in the slice's own list of other words. What the table knows of these comes by a join on the
   word; being rare in the training text, they are no hot keys.
3. Classes: the start puts the UNITS most frequent words each, and all others by their last two bytes (64
   hashed groups), with the text's end and start, in CLASSES classes by exchange over their bigram counts.
   Then one distributed pass exchanges every single training word: a word's counts of preceding and
   following classes meet in its bucket, which moves its words one block after another against its own
   copy of the class bigram table. The pass stays if the bigram likelihood of the whole training text
   rose. Words that only held-out texts have take the class of their unit.
4. Scores: the slices, joined with their other words' counts and classes, are counted (class bigrams) and
   scored where they stand, a row a document. Counts are neither cut off nor sampled, nothing that grows
   with the input is gathered on the driver, and the classes don't depend on how rows are dealt.

Null texts are empty: they have one token, the end. A null id counts as training. Repeated rows are
scored each and train each. Texts of any length are read whole (a slice has one text at least). Words of
equal counts go to the same side of the frequent table; moves of equal gain take the first class. An
empty table gives no rows; without training text all counts are zero. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import tokens as tk
from quillmesh.llm.util import cut, forget, mapped, table

UNITS, TAILS, CLASSES = 500, 64, 32
FREQUENT = 1 << 18  # words that go to all tasks
SWEEPS = 8
WORDS = 1 << 14  # words a bucket of the exchange has, about
BLOCK = 64  # words moved at a time, after the first ones of a bucket
HELD = 1 << 21  # words or context keys counted at a time
SLICE = 1 << 18  # bytes of text a coded slice has, about
ROW_GROUP = 16 << 20  # bytes of slices that are read at a time
ADD = 0.5


def held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids], bool)


def word_ids(folded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A word's 64-bit name: 58 bits of its hash above its ending's group of TAILS."""
    if not len(s):
        return np.zeros(0, np.int64)
    tail = (folded[e - 1].astype(np.int64) * 31 + folded[np.maximum(e - 2, s)] * 7) % TAILS
    return (tk.hashes(folded, s, e) & ~np.uint64(TAILS - 1) | tail.astype(np.uint64)).view(np.int64)


def _read(batch, text: str, ident: str, budget: int):
    """Slices: (from, to, names of words, document of each word, held out)."""
    at = 0
    while at < batch.num_rows:
        data, offs = tk.buffer(batch.column(text).slice(at))
        n = max(1, int(np.searchsorted(offs, budget, "right")) - 1)
        folded, s, e, doc = tk.words(data[: offs[n]], offs[: n + 1])
        yield at, at + n, word_ids(folded, s, e), doc, held_out(batch.column(ident).slice(at, n).to_pylist())
        at += n


def _vocabulary(text: str, ident: str):
    """Training words and their counts; a word may come several times."""

    def counted(held):
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c)], ["w", "c"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a, b, w, doc, out in _read(batch, text, ident, 1 << 20):
                if len(w):
                    held.append(w[~out[doc]])
                    size += len(held[-1])
                if size > HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


class Frequent:
    """The words that go to all tasks, the most frequent first, with their counts, and a table of slots to look them up."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.lexsort((words, -counts))
        self.words, self.counts = words[order], counts[order]
        self.n = len(words)
        self.by_name = np.argsort(self.words)
        self.names = self.words[self.by_name]
        self.slots = np.full(1 << 20, -1, np.int32)
        self.slots[self._slot(self.words)[::-1]] = np.arange(self.n)[::-1]  # of several words in a slot one

    def _slot(self, w: np.ndarray) -> np.ndarray:
        return w.view(np.uint64) >> np.uint64(44)

    def codes(self, w: np.ndarray) -> np.ndarray:
        """Places of words; -1 for others."""
        i = self.slots[self._slot(w)].astype(np.int64)
        if not self.n:
            return i
        odd = np.flatnonzero((i >= 0) & (self.words[i] != w))
        j = np.searchsorted(self.names, w[odd])
        j[j == self.n] = 0
        i[odd] = np.where(self.names[j] == w[odd], self.by_name[j], -1)
        return i


def _coded(text: str, ident: str, freq: Frequent):
    """Slices of coded text: ids, held out, words of each text, codes; other words are coded by their place in `rest`.

    A code takes two bytes; those from LARGE on are LARGE there, and stand in `large` with four.
    """

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, w, doc, out in _read(batch, text, ident, SLICE):
                code = freq.codes(w)
                new = np.flatnonzero(code < 0)
                rest, at = np.unique(w[new], return_inverse=True)
                code[new] = freq.n + at
                count = np.bincount(doc, minlength=b - a).astype("<u4")
                ids = batch.column(ident).slice(a, b - a).cast(pa.int64())
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (out.astype(np.uint8), count, np.minimum(code, LARGE).astype("<u2"), code[code >= LARGE].astype("<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array([serial]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *blobs, pa.array([rest], pa.list_(pa.int64()))], CODED)
                serial += 1

    return run


LARGE = (1 << 16) - 1
CODED = ["slice", "ids", "out", "count", "codes", "large", "rest"]
CODED_TYPE = "slice long, ids array<long>, out binary, count binary, codes binary, large binary, rest array<long>"


class Slice:
    """A coded slice as a sequence of tokens, ends included: previous and current codes, and each one's text.

    Codes below n are frequent words, then come the rest, then end and start.
    """

    def __init__(self, batch, i: int, n: int):
        col = lambda c: batch.column(batch.schema.get_field_index(c))[i]
        self.ids = col("ids").values
        self.out = np.frombuffer(col("out").as_buffer(), np.uint8).astype(bool)
        self.rest = col("rest").values.to_numpy()
        count = np.frombuffer(col("count").as_buffer(), "<u4").astype(np.int64)
        code = np.frombuffer(col("codes").as_buffer(), "<u2").astype(np.int64)
        code[code == LARGE] = np.frombuffer(col("large").as_buffer(), "<u4")
        self.docs, self.end = len(count), n + len(self.rest)
        last = np.cumsum(count)
        self.cur = np.insert(code, last, self.end)
        self.own = np.repeat(np.arange(self.docs), count + 1)
        self.prev = np.empty_like(self.cur)
        self.prev[1:] = self.cur[:-1]
        self.prev[np.cumsum(count + 1) - count - 1] = self.end + 1


def _slices(batches, n: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, Slice(batch, i, n)


class Units:
    """The unit of each word: its own, or its ending's group; then end and start."""

    def __init__(self, freq: Frequent, n_units: int):
        top = np.lexsort((freq.words, -freq.counts))[:n_units]
        self.n = len(top) + TAILS + 2
        self.own = len(top)
        self.of_frequent = len(top) + (freq.words & (TAILS - 1))
        self.of_frequent[top] = np.arange(len(top))

    def of(self, rest: np.ndarray) -> np.ndarray:
        """Units by code, of a slice with these other words."""
        return np.concatenate([self.of_frequent, self.own + (rest & (TAILS - 1)), [self.n - 2, self.n - 1]])


def _bigrams(freq: Frequent, units: Units):
    def run(batches):
        count = np.zeros(units.n * units.n, np.int64)
        for _, _, s in _slices(batches, freq.n):
            of, keep = units.of(s.rest), ~s.out[s.own]
            count += np.bincount(of[s.prev[keep]] * units.n + of[s.cur[keep]], minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["pair", "c"])

    return run


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, fixed: int = 2) -> np.ndarray:
    """Classes of units by exchange: move each unit where the class-bigram likelihood is highest.

    The last `fixed` units (end and start) keep classes of their own.
    """
    n = len(counts)
    free = n - fixed
    k = min(classes, max(1, free)) + fixed
    weight = counts.sum(0) + counts.sum(1)
    order = np.argsort(-weight[:free], kind="stable")
    cls = np.empty(n, np.int64)
    cls[order] = np.arange(free) % (k - fixed)
    cls[free:] = np.arange(k - fixed, k)
    c = counts.astype(float)
    xlx = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0.0)
    one = np.eye(k)[cls]
    rows, cols = c @ one, c.T @ one  # unit to class, class to unit (transposed)
    big = one.T @ rows
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old = cls[u]
            self_c = c[u, u]
            r, l_ = rows[u].copy(), cols[u].copy()
            r[old] -= self_c
            l_[old] -= self_c
            big[old] -= r
            big[:, old] -= l_
            big[old, old] -= self_c
            # likelihood change of joining each class: its rows, columns, corner and margins
            base, right, left = big, big.sum(1), big.sum(0)
            corner = np.diag(base)
            gain = (xlx(base + r[None, :]) - xlx(base)).sum(1) + (xlx(base + l_[:, None]) - xlx(base)).sum(0)
            d = corner
            gain += xlx(d + r + l_ + self_c) - xlx(d + r) - xlx(d + l_) + xlx(d)
            gain -= xlx(right + r.sum() + self_c) - xlx(right) + xlx(left + l_.sum() + self_c) - xlx(left)
            # the other classes' margins grow by what the unit brings them, wherever it goes
            gain[k - fixed :] = -np.inf
            new = int(gain.argmax())
            big[new] += r
            big[:, new] += l_
            big[new, new] += self_c
            if new != old:
                moved += 1
                cls[u] = new
                rows[:, old] -= c[:, u]
                rows[:, new] += c[:, u]
                cols[:, old] -= c[u]
                cols[:, new] += c[u]
        if not moved:
            break
    return cls


def _contexts(freq: Frequent, cls: np.ndarray, unit_cls: np.ndarray, units: Units, buckets: int):
    """Class bigram counts of training text (pair in bucket, blob null), and by bucket of words the packed counts
    of (word, slot): slots are preceding classes, following classes, the word itself."""
    k = int(unit_cls.max()) + 1
    slots = 2 * k + 1

    def packed(w, slot, c):
        """Counts by word (ascending) and slot, as a blob a bucket: words, their numbers of slots, slots, counts."""
        new = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        size = np.diff(np.append(new, len(w)))
        words = w[new]
        of = _bucket(words, buckets)
        order = np.argsort(of, kind="stable")
        ub, lo = np.unique(of[order], return_index=True)
        blobs = []
        for part in np.split(order, lo[1:]):
            rows = np.repeat(new[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())
            blobs.append(np.int64(len(part)).tobytes() + words[part].tobytes() + size[part].astype("u1").tobytes() + c[rows].astype("<u4").tobytes() + slot[rows].astype("u1").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ub), pa.array(blobs, pa.binary()), pa.nulls(len(ub), pa.int64())], ["bucket", "blob", "c"])

    def run(batches):
        big, often = np.zeros(k * k, np.int64), np.zeros(freq.n * slots, np.uint32)
        held, size, rest, rest_size = [], 0, [], 0
        for _, _, s in _slices(batches, freq.n):
            of = np.concatenate([cls, unit_cls[units.of(s.rest)[freq.n :]]]).astype(np.int64)
            train = ~s.out[s.own]
            prev, cur = s.prev[train], s.cur[train]
            before, after = of[prev], of[cur]
            big += np.bincount(before * k + after, minlength=k * k)
            p, c = prev < s.end, cur < s.end
            keys = np.concatenate([prev[p] * slots + k + after[p], cur[c] * slots + before[c], prev[p & (prev == cur)] * slots + 2 * k])
            rare = keys >= freq.n * slots
            held.append(keys[~rare])
            size += len(held[-1])
            if rare.any():
                keys, c = np.unique(keys[rare], return_counts=True)
                rest.append((s.rest[keys // slots - freq.n], keys % slots, c))
                rest_size += len(keys)
            if size > HELD:
                keys, c = np.unique(np.concatenate(held), return_counts=True)
                often[keys] += c.astype(np.uint32)
                held, size = [], 0
            if rest_size > HELD // 4:
                yield packed(*_summed(rest, slots))
                rest, rest_size = [], 0
        if held:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            often[keys] += c.astype(np.uint32)
        if rest:
            yield packed(*_summed(rest, slots))
        at = np.flatnonzero(often)
        if len(at):
            yield packed(freq.words[at // slots], at % slots, often[at])
        at = np.flatnonzero(big)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.binary()), pa.array(big[at])], ["bucket", "blob", "c"])

    return run


def _summed(rest: list, slots: int):
    """Counts of several slices by (word, slot): words ascending."""
    w, slot, c = (np.concatenate(x) for x in zip(*rest))
    order = np.lexsort((slot, w))
    w, slot, c = w[order], slot[order], c[order]
    new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (slot[1:] != slot[:-1])))
    return w[new], slot[new], np.add.reduceat(c, new)


def _bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return ((w.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _xlx(v):
    return np.where(v > 0, v * np.log(np.maximum(v, 1)), 0.0)


def likelihood(big: np.ndarray) -> float:
    """The part of the bigram log likelihood that classes decide."""
    return float(_xlx(big).sum() - _xlx(big.sum(0)).sum() - _xlx(big.sum(1)).sum())


def move(big: np.ndarray, old: np.ndarray, ctx: np.ndarray, fixed: int = 2) -> np.ndarray:
    """New classes of words (frequent ones first) by exchange on their context counts; big is brought up to date."""
    k, every = len(big), np.arange(len(big))
    out = old.copy()
    at = 0
    while at < len(old):
        rows = slice(at, at + (1 if at < BLOCK else BLOCK if at < 64 * BLOCK else 8 * BLOCK))
        at = rows.stop
        o, m = old[rows], np.arange(len(old[rows]))
        r, l_, own = ctx[rows, :k].astype(float), ctx[rows, k : 2 * k].astype(float), ctx[rows, 2 * k].astype(float)
        r[m, o] -= own
        l_[m, o] -= own
        w, mine = own[:, None], every == o[:, None]
        rs, ls = r.sum(1, keepdims=True), l_.sum(1, keepdims=True)
        # the table without the word: its diagonal, and below the cells that the word's counts touch; the margins
        # keep what the word's neighbours have by it, which is theirs wherever the word goes
        d = big[every, every] - mine * (r + l_ + w)
        right, left = big.sum(1) - mine * (rs + w), big.sum(0) - mine * (ls + w)
        gain = _xlx(d + r + l_ + w) - _xlx(d + r) - _xlx(d + l_) + _xlx(d)
        gain -= _xlx(right + rs + w) - _xlx(right) + _xlx(left + ls + w) - _xlx(left)
        for table, x, other in ((big, r, l_), (big.T, l_, r)):
            i, c = np.nonzero(x)
            if len(i):
                v = x[i, c][:, None]
                cell = table[:, c].T - mine[i] * v - (c == o[i])[:, None] * (other[i] + mine[i] * w[i])
                first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                gain[i[first]] += np.add.reduceat(_xlx(cell + v) - _xlx(cell), first)
        gain[:, k - fixed :] = -np.inf
        new = np.where(gain.max(1) > gain[m, o] + 1e-9, gain.argmax(1), o)
        go = np.flatnonzero(new != o)
        for c, sign in ((o[go], -1), (new[go], 1)):
            np.add.at(big, c, sign * r[go])
            np.add.at(big.T, c, sign * l_[go])
            np.add.at(big, (c, c), sign * own[go])
        out[rows] = new
    return out


def _moves(big: np.ndarray, freq: Frequent, cls: np.ndarray, unit_cls: np.ndarray, units: Units):
    """Buckets of packed contexts to all training words with their counts, and classes before and after a pass."""
    k = len(big)
    slots = 2 * k + 1

    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = int(np.frombuffer(blob, "<i8", 1)[0])
                words, size = np.frombuffer(blob, "<i8", m, 8), np.frombuffer(blob, "u1", m, 8 + 8 * m).astype(np.int64)
                at = 8 + 9 * m
                e = (len(blob) - at) // 5
                got.setdefault(b, []).append((words, size, np.frombuffer(blob, "<u4", e, at), np.frombuffer(blob, "u1", e, at + 4 * e)))
        for b in list(got):
            words, size, c, slot = (np.concatenate(x) for x in zip(*got.pop(b)))
            u, at = np.unique(words, return_inverse=True)
            ctx = np.bincount(np.repeat(at, size) * slots + slot, weights=c, minlength=len(u) * slots).astype(np.int64).reshape(-1, slots)
            place = freq.codes(u)
            old = np.where(place >= 0, cls[place] if freq.n else 0, unit_cls[units.own + (u & (TAILS - 1))]).astype(np.int64)
            order = np.argsort(-ctx.sum(1), kind="stable")
            new = old.copy()
            new[order] = move(big.astype(float), old[order], np.concatenate([ctx[order, k : 2 * k], ctx[order, :k], ctx[order, 2 * k :]], 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(ctx[:, :k].sum(1)), pa.array(old.astype(np.int32)), pa.array(new.astype(np.int32))], ["w", "c", "old", "new"])

    return run


def _counted(freq: Frequent, cls: np.ndarray, unit_cls: np.ndarray, units: Units, column: str):
    """Class bigram counts of the training text."""
    k = int(unit_cls.max()) + 1

    def run(batches):
        big = np.zeros(k * k, np.int64)
        for batch, i, s in _slices(batches, freq.n):
            of = _classes(batch, i, s, freq, cls, unit_cls, units, column)
            train = ~s.out[s.own]
            big += np.bincount(of[s.prev[train]] * k + of[s.cur[train]], minlength=k * k)
        at = np.flatnonzero(big)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(big[at])], ["pair", "c"])

    return run


CLASS = 256


def _known(batch, i: int) -> np.ndarray:
    """Counts and classes of a slice's other words, in their order; -1 for those that training text hasn't."""
    known = batch.column(batch.schema.get_field_index("known"))[i].values
    return known.field("x").fill_null(-1).to_numpy() if known is not None and len(known) else np.zeros(0, np.int64)


def _classes(batch, i, s: Slice, freq, cls, unit_cls, units, column: str) -> np.ndarray:
    """Classes by code: of training words as learned, of others (and of all but frequent ones before) by their unit."""
    of = np.concatenate([cls, unit_cls[units.of(s.rest)[freq.n :]]]).astype(np.int64)
    if column == "new" and len(s.rest):
        found = _known(batch, i)
        of[freq.n : s.end] = np.where(found >= 0, found % CLASS, of[freq.n : s.end])
    return of


def _scored(freq: Frequent, cls, unit_cls, units: Units, column: str, log_t: np.ndarray, low: np.ndarray, end_count: int):
    """A row per document: tokens, known tokens, log10 of counts, of transitions and of classes' denominators."""

    def run(batches):
        for batch, i, s in _slices(batches, freq.n):
            of = _classes(batch, i, s, freq, cls, unit_cls, units, column)
            c = np.concatenate([freq.counts, np.maximum(_known(batch, i), 0) // CLASS, [end_count, 0]])
            logs = np.log10(c + ADD)
            sums = lambda x: np.bincount(s.own, weights=x, minlength=s.docs)
            cur = of[s.cur]
            emit = sums(logs[s.cur])
            score = emit + sums(log_t[of[s.prev], cur] - low[cur])
            known = sums(c[s.cur] > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(s.out), pa.array(np.bincount(s.own, minlength=s.docs)), pa.array(known), pa.array(emit), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "emit", "score"])

    return run


class Model:
    """Brown classes and counts: frequent words here, all others in the table `words` (w, c, old, new)."""

    def __init__(self, freq, cls, unit_cls, units, words, column):
        self.freq, self.cls, self.unit_cls, self.units, self.words, self.column = freq, cls, unit_cls, units, words, column


def _frequent(vocab: DataFrame):
    """The words of the highest counts, FREQUENT at most, equal counts together; and the condition they meet."""
    level = F.floor(F.log2("c") * 16)
    least, size = 1 << 30, 0
    for r in sorted(vocab.groupBy(level.alias("level")).count().collect(), reverse=True):  # about a thousand levels
        size += r["count"]
        if size > FREQUENT:
            break
        least = r.level
    top = vocab.filter(level >= least).toArrow()
    return Frequent(top.column(0).to_numpy(), top.column(1).to_numpy()), level >= least


def _big(found, k: int) -> np.ndarray:
    big = np.zeros(k * k, np.int64)
    for r in found.groupBy("pair").agg(F.sum("c").alias("c")).collect():  # at most k squared
        big[r.pair] = r.c
    return big.reshape(k, k)


def _joined(coded: DataFrame, words: DataFrame) -> DataFrame:
    """Slices with `known`: each of their other words, and its count and class as one number (CLASS of a class)."""
    known = words.select("w", (F.col("c") * CLASS + F.col("new")).alias("x"))
    pairs = coded.select("slice", F.explode("rest").alias("w")).join(known, "w", "left")
    known = pairs.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("w", "x"))).alias("known"))
    return coded.join(known, "slice", "left")


def fit(d: DataFrame, n_units: int = UNITS, classes: int = CLASSES) -> tuple[Model, DataFrame, np.ndarray, int]:
    """From (doc_id, text): the model, the slices with what it knows of their words, the class bigram counts, and the number of training texts."""
    vocab = cut(mapped(d, _vocabulary("text", "doc_id"), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    freq, often = _frequent(vocab)
    units = Units(freq, n_units)
    coded = cut(mapped(d, _coded("text", "doc_id", freq), CODED_TYPE), ROW_GROUP)
    unit_cls = exchange(_big(mapped(coded, _bigrams(freq, units), "pair long, c long"), units.n), classes).astype(np.uint8)
    k = int(unit_cls.max()) + 1
    cls = unit_cls[units.of_frequent]
    buckets = vocab.count() // WORDS + 1
    found = cut(mapped(coded, _contexts(freq, cls, unit_cls, units, buckets), "bucket long, blob binary, c long"))
    before = _big(found.filter("blob IS NULL").select(F.col("bucket").alias("pair"), "c"), k)
    moved = found.filter("blob IS NOT NULL").select("bucket", "blob").repartition(buckets, "bucket")
    words = cut(mapped(moved, _moves(before, freq, cls, unit_cls, units), "w long, c long, old int, new int"))
    forget(found, vocab)
    top = words.filter(often).toArrow()  # the frequent words
    new = cls.copy()
    new[freq.codes(top.column(0).to_numpy())] = top.column(3).to_numpy().astype(np.uint8)
    ready = cut(_joined(coded, words.filter(~often)), ROW_GROUP)
    forget(coded)
    model = Model(freq, new, unit_cls, units, words, "new")
    after = _big(mapped(ready, _counted(freq, new, unit_cls, units, "new"), "pair long, c long"), k)
    if likelihood(after) <= likelihood(before):
        model, after = Model(freq, cls, unit_cls, units, words, "old"), before
    return model, ready, after


def score(docs: DataFrame, ident: str = "doc_id", text: str = "text", n_units: int = UNITS, classes: int = CLASSES) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    d = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    m, ready, big = fit(d, n_units, classes)
    k, end, start = len(big), int(m.unit_cls[-2]), int(m.unit_cls[-1])
    log_t = np.log10((big + ADD) / (big.sum(1, keepdims=True) + ADD * (k - 1)))  # no class follows into start
    log_t[:, start] = 0.0
    tokens, types = np.zeros(k), np.zeros(k)
    for r in m.words.groupBy(F.col(m.column).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row a class
        tokens[r.k], types[r.k] = r.c, r.n
    texts = int(big[:, end].sum())  # an end for each training text
    tokens[end], types[end] = texts, texts > 0
    low = np.log10(tokens + ADD * (types + 1))
    big_n, big_v = int(tokens.sum()), int(types.sum())
    x = mapped(ready, _scored(m.freq, m.cls, m.unit_cls, m.units, m.column, log_t, low, texts), "doc_id long, held_out boolean, n_tokens long, n_known long, emit double, score double")
    return x.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(big_n).cast("long").alias("train_tokens"),
        (F.col("emit") - F.col("n_tokens") * F.lit(float(np.log10(max(big_n + ADD * (big_v + 1), ADD))))).alias("base_score"),
        "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op4(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
