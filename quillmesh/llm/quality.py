"""Quality classifier by co-training of a content view and a metadata view (operator 2).

The content view sees the text: word evidence (log odds of a word's presence in rejected against
accepted documents, learned from the labels) and the make-up of its characters, words and lines. The
metadata view sees lang, source and length. Each view is a logistic regression. In each round a view's
most confident judgements of unlabelled documents become labels of the other. At the end each view is
calibrated on scores of labelled documents by fits that left their third of the sample out (word evidence
and weights both), and the views' log odds are combined with weights fitted on these scores too.

Fitted on a bounded sample: at most LABELLED labelled and POOL unlabelled documents, those of smallest
md5(id) that the table has. All documents are scored, whole. A label of quality 0 or of toxic 1 means reject.

Null texts are empty texts; null lang, source or id are values of their own; a document is scored on
its own columns, so repeated rows score alike; contradicting labels of an id count as reject; with no
labels, or labels of one kind only, every document scores 0.5 and is kept. A score of exactly the threshold
is kept. An empty table gives no rows. Columns of docs stay, but for those named like an output.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import tokens as tk
from quillmesh.llm.util import mapped, table

LABELLED = 4000
POOL = 2000
ROUNDS = 3
CONFIDENT = 0.05  # share of the pool that a view labels a round, on either side
KEEP_AT = 0.5
BUCKETS = 1 << 18
N_META = 64
FLOOR = 4  # documents a word must be in to be evidence
Z_LEAST = (3.0, 5.0)  # standard errors a word must stand out by, with 200 labels and with 4000


def _runs(batch_text, budget: int = 1 << 21):
    at = 0
    while at < len(batch_text):
        data, offs = tk.buffer(batch_text.slice(at))
        n = max(1, int(np.searchsorted(offs, budget, "right")) - 1)
        yield at, at + n, data[: offs[n]], offs[: n + 1]
        at += n


def presence(data, offs):
    """(bucket, document) once for each distinct word, and word start of four bytes, of each text."""
    folded, s, e, doc = tk.words(data, offs, tk.ALNUM)
    w = (tk.hashes(folded, s, e) & np.uint64(BUCKETS - 1)).astype(np.int64)
    long = np.flatnonzero(e - s > 4)
    starts = (tk.hashes(folded, s[long], s[long] + 4) >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int64)
    pair = np.unique(np.concatenate([doc * BUCKETS + w, doc[long] * BUCKETS + starts]))
    return pair % BUCKETS, pair // BUCKETS, np.bincount(doc, minlength=len(offs) - 1)


def shape(data, offs):
    """Character, word and line make-up of each text: a dense matrix."""
    n = len(offs) - 1
    size = np.diff(offs)
    own = np.repeat(np.arange(n), size)
    share = lambda mask: np.bincount(own, weights=mask, minlength=n) / np.maximum(size, 1)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    space = ~tk.NOT_SPACE[data]
    odd = ~(tk.ALNUM[tk.FOLD[data]] | space)
    plain = (data == 44) | (data == 46)
    lines = np.bincount(own, weights=data == 10, minlength=n) + 1
    folded, s, e, doc = tk.words(data, offs)
    wh = tk.hashes(folded, s, e)
    words = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, int)
    if len(doc):
        order = np.lexsort((wh, doc))
        d2, w2 = doc[order], wh[order]
        new = np.ones(len(d2), bool)
        new[1:] = (d2[1:] != d2[:-1]) | (w2[1:] != w2[:-1])
        distinct = np.bincount(d2[new], minlength=n)
        long = np.bincount(doc, weights=(e - s) > 20, minlength=n) / np.maximum(words, 1)
        same = np.zeros(len(wh), bool)
        same[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
        repeat = np.bincount(doc, weights=same, minlength=n) / np.maximum(words, 1)
    else:
        distinct, long, repeat = np.zeros(n), np.zeros(n), np.zeros(n)
    dense = np.stack(
        [share(upper), share(digit), share(odd & ~plain), share(plain), share(space), lines / np.maximum(words, 1), distinct / np.maximum(words, 1) * (words > 0), np.log1p(words) / 10, np.minimum(words, 5) / 5, long, repeat,
         share(data == 33), share(data == 124), share((data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42)), size / np.maximum(words, 1) / 10], axis=1)
    return np.hstack([dense, np.minimum(dense[:, [0, 2, 3, 6, 10, 11, 12, 13]] * 20, 1)])


def meta(langs, sources, sizes):
    """Hashed one-hots of lang and source, and the length's scale."""
    import zlib

    out = np.zeros((len(langs), N_META + 3))
    for i, (a, b, c) in enumerate(zip(langs, sources, sizes)):
        out[i, zlib.crc32(f"l{a}".encode()) % N_META] += 1
        out[i, zlib.crc32(f"s{b}".encode()) % N_META] += 1
        x = np.log1p(max(c or 0, 0))
        out[i, N_META:] = x / 10, (x / 10) ** 2, float((c or 0) < 60)
    return out


def evidence(w, doc, n, odds):
    """The strongest and summed word evidence for rejection of each text."""
    out = np.zeros((n, 4))
    if len(w):
        some = odds[w] != 0
        w, doc = w[some], doc[some]
    if len(w):
        o = odds[w]
        order = np.lexsort((-o, doc))
        d, v = doc[order], o[order]
        first = np.searchsorted(d, np.arange(n + 1))
        have = np.diff(first)
        for k in range(2):
            ok = have > k
            out[ok, k] = np.maximum(v[first[:-1][ok] + k], 0)
        out[:, 2] = np.log1p(np.bincount(doc, weights=o > 1.5, minlength=n))
        out[:, 3] = out[:, 0] > 1.5
    return out


def word_odds(w, doc, bad, weight):
    """Log odds of each bucket's presence in bad against good documents; 0 where chance could explain it."""
    b = np.bincount(w, weights=(bad * weight)[doc], minlength=BUCKETS)
    g = np.bincount(w, weights=((1 - bad) * weight)[doc], minlength=BUCKETS)
    nb, ng = max((bad * weight).sum(), 1e-9), max(((1 - bad) * weight).sum(), 1e-9)
    share = nb / (nb + ng)
    z = (b - (b + g) * share) / np.sqrt(np.maximum((b + g) * share * (1 - share), 1e-9))
    o = np.log((b + 0.5) / (nb + 1)) - np.log((g + 0.5) / (ng + 1))
    labels = (weight > 0).sum()
    least = float(np.interp(np.log(max(labels, 1)), np.log([200, 4000]), Z_LEAST))
    o[(np.abs(z) < least) | (b + g < FLOOR)] = 0
    return o


def copies(data, offs):
    """A text's smallest shingle hash, the same for most near copies."""
    folded, s, e, doc = tk.words(data, offs)
    h, own = tk.shingles(tk.hashes(folded, s, e), doc, len(offs) - 1, 5)
    low = np.full(len(offs) - 1, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, own, h)
    return low


def logistic(x, y, weight, l2=2e-3, rounds=30):
    """Newton's method with a ridge; x standardised by the caller."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], l2 * len(x))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        g = x1.T @ (weight * (p - y)) + ridge * beta
        h = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Model:
    """Both views, fitted; `score` gives P(accept) of each view and of both."""

    def __init__(self):
        self.fitted = False

    def fit(self, texts, langs, sources, sizes, labels):
        """labels: 1 accept, 0 reject, -1 unlabelled."""
        if not len(texts):
            return self
        y = np.asarray(labels, float)
        known = y >= 0
        if len(set(y[known])) < 2:
            return self
        bad = 1 - y
        parts, w_all, d_all, low = [], [], [], []
        for a, b, data, offs in _runs(pa.array(texts, pa.string())):
            parts.append(shape(data, offs))
            low.append(copies(data, offs))
            w, d, _ = presence(data, offs)
            w_all.append(w)
            d_all.append(d + a)
        form, w, doc = np.vstack(parts), np.concatenate(w_all).astype(np.int32), np.concatenate(d_all).astype(np.int32)
        del parts, w_all, d_all
        _, group, members = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        once = 1 / members[group]  # near copies count as one text of evidence, and stay in one fold
        m = meta(langs, sources, sizes)
        self.m_mean, self.m_std = m.mean(0), m.std(0) + 1e-9
        m = (m - self.m_mean) / self.m_std
        fold = group % 3
        content_label, meta_label = y.copy(), y.copy()
        sure = np.where(known, 1.0, 0.0)
        c_weight, m_weight = sure.copy(), sure.copy()

        def balance(lab, weight):
            pos, neg = (weight * (lab == 1)).sum(), (weight * (lab == 0)).sum()
            return weight * np.where(lab == 1, (pos + neg) / (2 * max(pos, 1e-9)), (pos + neg) / (2 * max(neg, 1e-9)))

        def ev(lab, weight, exclude):
            use = (weight > 0) & ~exclude
            sel = use[doc]
            odds = word_odds(w[sel], doc[sel], np.where(use, 1 - np.clip(lab, 0, 1), 0), weight * use * once) if sel.any() else np.zeros(BUCKETS)
            return odds

        def content_matrix(lab, weight):
            """Word evidence of each document from the other folds only."""
            x = np.zeros((len(y), 4))
            for f in range(3):
                odds = ev(lab, weight, fold == f)
                sel = (fold == f)[doc]
                x[fold == f] = evidence(w[sel], doc[sel], len(y), odds)[fold == f]
            return x

        for r in range(ROUNDS + 1):
            e = content_matrix(content_label, c_weight)
            x = np.hstack([form, e])
            self.c_mean, self.c_std = x.mean(0), x.std(0) + 1e-9
            x = (x - self.c_mean) / self.c_std
            use = c_weight > 0
            self.c_beta = logistic(x[use], content_label[use], balance(content_label[use], c_weight[use]))
            use = m_weight > 0
            self.m_beta = logistic(m[use], meta_label[use], balance(meta_label[use], m_weight[use]), l2=5e-2)
            zc, zm = np.hstack([x, np.ones((len(x), 1))]) @ self.c_beta, np.hstack([m, np.ones((len(m), 1))]) @ self.m_beta
            if r == ROUNDS or known.all():
                break
            k = max(1, int((~known).sum() * CONFIDENT))
            for z, lab, weight in ((zc, meta_label, m_weight), (zm, content_label, c_weight)):
                free = np.flatnonzero((~known) & (weight == 0))
                order = free[np.argsort(z[free])]
                for part, value in ((order[:k], 0), (order[-k:], 1)):
                    part = part[np.abs(z[part]) > 1.5]
                    lab[part], weight[part] = value, 0.3
        self.odds = ev(content_label, c_weight, np.zeros(len(y), bool))

        def held(x, lab, weight, l2):
            """Scores of each third by weights fitted on the others; its evidence came from the others too."""
            z, x1 = np.zeros(len(y)), np.hstack([x, np.ones((len(x), 1))])
            for f in range(3):
                use = (weight > 0) & (fold != f)
                if len(set(lab[use])) < 2:
                    use = weight > 0
                z[fold == f] = x1[fold == f] @ logistic(x[use], lab[use], balance(lab[use], weight[use]), l2=l2)
            return z

        # calibration and combination on the labels alone
        both = np.stack([held(x, content_label, c_weight, 2e-3)[known], held(m, meta_label, m_weight, 5e-2)[known]], 1)
        ones = np.ones(int(known.sum()))
        self.cal_c = logistic(both[:, :1], y[known], ones, l2=1e-4)
        self.cal_m = logistic(both[:, 1:], y[known], ones, l2=1e-4)
        cal = np.stack([both[:, 0] * self.cal_c[0] + self.cal_c[1], both[:, 1] * self.cal_m[0] + self.cal_m[1]], 1)
        self.mix = logistic(cal, y[known], ones, l2=1e-4)
        self.fitted = True
        return self

    def score(self, texts, langs, sources, sizes):
        n = len(texts)
        if not self.fitted:
            return np.full(n, 0.5), np.full(n, 0.5), np.full(n, 0.5)
        parts = []
        for a, b, data, offs in _runs(texts):
            w, d, _ = presence(data, offs)
            parts.append(np.hstack([shape(data, offs), evidence(w, d, b - a, self.odds)]))
        x = (np.vstack(parts) - self.c_mean) / self.c_std
        m = (meta(langs, sources, sizes) - self.m_mean) / self.m_std
        zc = np.hstack([x, np.ones((n, 1))]) @ self.c_beta * self.cal_c[0] + self.cal_c[1]
        zm = np.hstack([m, np.ones((n, 1))]) @ self.m_beta * self.cal_m[0] + self.cal_m[1]
        z = zc * self.mix[0] + zm * self.mix[1] + self.mix[2]
        p = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        return p(zc), p(zm), p(z)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fit on the bounded sample. docs (doc_id, text, lang, source), labels (doc_id, quality, toxic)."""
    lab = labels.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0).when(F.col("quality") == 1, 1)).alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    chosen = lab.join(ids, "doc_id", "left_semi").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(labelled)
    free = ids.join(lab, "doc_id", "left_anti").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(pool).select("doc_id", F.lit(-1).alias("y"))
    picked = F.broadcast(chosen.select("doc_id", "y").union(free))  # labelled + pool rows of 12 bytes
    rows = docs.select("doc_id", "text", "lang", "source").join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang", "source")).alias("d")).select(F.md5(F.col("doc_id").cast("string")).alias("turn"), "y", "d.*")
    # the sample is bounded, so one task fits the model and the driver gets no more than its weights
    got = mapped(rows.repartition(1).sortWithinPartitions("turn"), _fit_sample, "model binary").first()
    return pickle.loads(got[0]) if got else Model()


def _fit_sample(batches):
    cols: dict[str, list] = {c: [] for c in ("text", "lang", "source", "y")}
    for b in batches:
        for c, values in cols.items():
            values += b.column(c).to_pylist()
    texts = [t or "" for t in cols["text"]]
    model = Model().fit(texts, cols["lang"], cols["source"], [len(t) for t in texts], cols["y"])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """docs with p_content, p_meta, p_quality and keep."""
    model = fit(docs, labels, labelled, pool)
    cols = [c for c in docs.columns if c not in ("p_content", "p_meta", "p_quality", "keep")]
    d = docs.select(*[F.col(f"`{c}`") for c in cols])
    out = d.withColumns({c: F.lit(0.0) for c in ("p_content", "p_meta", "p_quality")}).withColumn("keep", F.lit(True)).schema

    def run(batches):
        for b in batches:
            size = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
            c, m, p = model.score(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist(), size) if b.num_rows else (np.zeros(0),) * 3
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c), pa.array(m), pa.array(p), pa.array(p >= keep_at)], [*b.schema.names, "p_content", "p_meta", "p_quality", "keep"])

    return mapped(d, run, out)


def op2(spark, sf_dir):
    got = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "p_content", "p_meta", "p_quality", "keep")
