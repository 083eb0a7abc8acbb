"""Benchmark decontamination by winnowing (operator 9).

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A window is 10 consecutive
words of an item (all of them where it has fewer). From every 6 consecutive 5-gram hashes the smallest
is kept as a fingerprint, in items and documents alike, so a shared span of 10 words always shares a
fingerprint. Documents that share one are extended: their windows are held against the items' windows,
and every document word inside an occurring window is hit. Items under 10 words, which winnowing can't
promise, are looked up as whole runs of their length.

The benchmark is read in blocks of at most `BLOCK_WORDS` words; each block is a bounded index that goes
to all tasks, and the documents pass block after block. Documents are never grouped or shuffled.

Null or wordless texts have no words, no hits and no items; a wordless item has no window; repeated
documents get a row each, items of equal id count once; ids of items are sorted as strings; a null
item id is skipped in the list (its hits count). Texts are read whole, however long. Equal windows of
several items count for each. Without documents there are no rows, without items no hits. Columns of docs
stay, but for those named like an output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import tokens as tk
from quillmesh.llm.util import cut, mapped, table

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
BLOCK_WORDS = 2_000_000


def runs(wh: np.ndarray, doc: np.ndarray, k: int):
    """Hashes of k-word runs that stay inside a text, and where they start."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + wh[j : j + n]
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return tk.mixed(acc[at]), at


def winnow(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Whether each gram is the smallest of some `span` consecutive grams of its text."""
    n = len(h) - span + 1
    if n <= 0:
        return np.ones(len(h), bool)
    low = h[:n].copy()
    for j in range(1, span):
        np.minimum(low, h[j : j + n], out=low)
    low[at[:n] + span - 1 != at[span - 1 :]] = 0  # a span that leaves the text
    picked = np.zeros(len(h), bool)
    for j in range(span):
        picked[j : j + n] |= h[j : j + n] == low
    return picked


def member(x: np.ndarray, table_: np.ndarray) -> np.ndarray:
    if not len(table_) or not len(x):
        return np.zeros(len(x), bool)
    i = np.searchsorted(table_, x)
    i[i == len(table_)] = 0
    return table_[i] == x


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, ids: list, texts: list):
        data, offs = tk.buffer(pa.array(texts, pa.string()))
        folded, s, e, doc = tk.words(data, offs, tk.ALNUM)
        wh = tk.hashes(folded, s, e)
        count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
        self.ids, self.windows, prints = ids, {}, []
        g, at = runs(wh, doc, GRAM)
        self.prints = np.unique(g[winnow(g, at, SPAN)])
        for k in sorted({min(int(c), WINDOW) for c in count if c}):
            h, at = runs(wh, doc, k)
            own = doc[at]
            fit = (count[own] >= WINDOW) if k == WINDOW else (count[own] == k)
            h, own = h[fit], own[fit]
            order = np.argsort(h, kind="stable")
            self.windows[k] = (h[order], own[order])
        # a quick first look: bit of the low 20 bits of each fingerprint
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.prints & np.uint64((1 << 20) - 1)] = True


def hit_words(wh: np.ndarray, doc: np.ndarray, n_docs: int, index: Index, hit: np.ndarray, found: dict) -> None:
    """Mark the words of occurring windows in `hit`; add the items found to `found` by text."""
    look = np.zeros(n_docs, bool)
    g, at = runs(wh, doc, GRAM)
    near = index.bits[g & np.uint64((1 << 20) - 1)]
    if near.any():
        pick = winnow(g, at, SPAN) & near
        pick[pick] = member(g[pick], index.prints)
        look[doc[at[pick]]] = True
    for k, (keys, own) in index.windows.items():
        words = np.flatnonzero(look[doc]) if k == WINDOW else None
        if words is not None and not len(words):
            continue
        h, at = runs(wh[words], doc[words], k) if words is not None else runs(wh, doc, k)
        m = np.flatnonzero(member(h, keys))
        if not len(m):
            continue
        at = words[at[m]] if words is not None else at[m]
        for j in range(k):
            hit[at + j] = True
        lo, hi = np.searchsorted(keys, h[m], "left"), np.searchsorted(keys, h[m], "right")
        for d, a, b in set(zip(doc[at].tolist(), lo.tolist(), hi.tolist())):
            found.setdefault(d, set()).update(index.ids[i] for i in own[a:b])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, hits (word numbers [start, end) of hit runs) and items (ids found)."""
    cols = [f for f in docs.schema.fields if f.name not in ("n_words", "hits", "items")]
    df = docs.select(*[F.col(f"`{f.name}`") for f in cols], F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items"))
    out = df.schema
    blocks = _blocks(items, item_id, item_text, block_words)
    for k, (ids, texts) in enumerate(blocks):
        index = Index(ids, texts)
        df = cut(df) if k else df
        df = mapped(df, _marker(index, text), out)
    return df


def _blocks(items: DataFrame, item_id: str, item_text: str, block_words: int):
    ids, texts, words, any_ = [], [], 0, False
    for r in items.select(F.col(item_id).cast("string"), F.coalesce(F.col(item_text), F.lit(""))).toLocalIterator():
        n = len(r[1].split()) + 1
        if ids and words + n > block_words:
            yield ids, texts
            ids, texts, words, any_ = [], [], 0, True
        ids.append(r[0])
        texts.append(r[1])
        words += n
    if ids or not any_:
        yield ids, texts


def _marker(index: Index, text: str):
    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # so many rows at a time that the word arrays stay small
                data, offs = tk.buffer(batch.column(text).slice(at))
                n = max(1, int(np.searchsorted(offs, 1 << 21, "right")) - 1)
                part = batch.slice(at, n)
                data, offs = data[: offs[n]], offs[: n + 1]
                at += n
                folded, s, e, doc = tk.words(data, offs, tk.ALNUM)
                wh = tk.hashes(folded, s, e)
                hit = np.zeros(len(wh) + 1, bool)
                found: dict = {}
                hit_words(wh, doc, n, index, hit, found)
                first = np.searchsorted(doc, np.arange(n + 1))
                old_hits, old_items = part.column("hits").to_pylist(), part.column("items").to_pylist()
                hits, items = [], []
                hot = set(doc[np.flatnonzero(hit[:-1])].tolist())
                for d in range(n):
                    if d not in hot and not old_hits[d]:
                        hits.append([])
                        items.append(old_items[d])
                        continue
                    own = np.zeros(first[d + 1] - first[d] + 2, np.int8)
                    own[1:-1] = hit[first[d] : first[d + 1]]
                    for a, b in zip(old_hits[d][::2], old_hits[d][1::2]):
                        own[1 + a : 1 + b] = 1
                    hits.append(np.flatnonzero(np.diff(own)).tolist())
                    items.append(sorted(set(old_items[d]) | {x for x in found.get(d, ()) if x is not None}))
                new = {"n_words": pa.array(np.diff(first), pa.int64()), "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
                names = part.schema.names
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for i, c in enumerate(names)], names)

    return run


def op9(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(d, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.k, dw.i, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
