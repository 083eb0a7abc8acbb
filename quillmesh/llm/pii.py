"""Personal data: patterns, and a character BiLSTM-CRF that adds what they miss (operator 7).

The base patterns find emails, IPs, card and phone numbers, leftmost and non-overlapping per kind;
matches that fail their check are dropped. The tagger adds what the patterns can't see: data beside other
numbers, and data in writings that no pattern matches (`name [at] host (dot) org`, `10[.]0[.]0[.]1`, cards
with dots, slashes or double spaces, phones without a plus). It reads every stretch that could hold
personal data: one has an @, a bracketed at or dot, or four digits, so text further than a window's overlap
from any of these or a digit has no span by definition. Long stretches are read in overlapping windows;
each window decides the tags of its middle. Tagged spans are reconciled over the whole text: those that
touch a base span, or don't hold what their kind must (an address, four parts of an IP, digits and checksum
of a card, digits of a phone), are left out.

Spans are code points, end exclusive, in order of start, then kind. Null and empty texts have none;
repeated rows have the same spans; texts of any length are read whole; an empty table gives no rows. Of
tagged spans that touch the first stays. Columns of docs stay, but for one named like the output.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import tokens as tk
from quillmesh.llm.pii_model import KINDS, OVERLAP, WINDOW, Tagger, encode, fitted, luhn
from quillmesh.llm.util import mapped, table

#: The base patterns (fixed values).
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# What a leftmost match can begin after: a run's later characters can't begin one if its first can't.
_STARTS = {"email": r"(?<![A-Za-z0-9._%+-])", "ip": r"(?<![0-9])", "card": "", "phone": ""}
_AT = {k: re.compile(p) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE))}
_FROM = {k: re.compile(_STARTS[k] + p) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE))}
TRIGGER = np.zeros(256, bool)
TRIGGER[48:58] = TRIGGER[[ord(c) for c in "@[({"]] = True
#: An at sign or a dot that is written in brackets.
AT = re.compile(r"\s*[\[({]\s*(?:at|@)\s*[\])}]\s*|\s+@\s+", re.I)
DOT = re.compile(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*", re.I)


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d := digits(s)) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(digits(s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        at = 0
        # a match may begin right where the last one ended, in the middle of a run
        while m := (at and _AT[kind].match(text, at)) or _FROM[kind].search(text, at):
            if passes(kind, m.group()):
                out.append((m.start(), k, m.end()))
            at = m.end()
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def stretches(text: str) -> list[tuple[int, int]]:
    """Where personal data could be: around every @ and every digit, joined where windows would meet."""
    at = [m.start() for m in re.finditer(r"[0-9@]|[\[({]\s*(?:at|dot)\s*[\])}]", text, re.I)]
    out: list[list[int]] = []
    for p in at:
        a, b = max(0, p - OVERLAP), min(len(text), p + OVERLAP + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if "@" in (s := text[a:b]) or len(digits(s)) >= 4 or AT.search(s)]


def windows(a: int, b: int) -> list[tuple[int, int, int]]:
    """(start, from, to): windows over [a, b), each with the part whose tags it decides."""
    step = WINDOW - OVERLAP
    out, s = [], a
    while True:
        last = s + WINDOW >= b
        out.append((s, s if s == a else s + OVERLAP // 2, b if last else s + step + OVERLAP // 2))
        if last:
            return out
        s += step


def tagged_spans(texts: list[str], tagger: Tagger, batch: int = 512) -> list[list[tuple[int, int, str]]]:
    """Spans that the tagger finds in each text."""
    tags = [{} for _ in texts]
    todo = [(i, w) for i, t in enumerate(texts) for a, b in stretches(t) for w in windows(a, b)]
    codes = {}
    blank = encode(" ")[0]
    for k in range(0, len(todo), batch):
        part = todo[k : k + batch]
        x = np.full((len(part), WINDOW), blank)
        for j, (i, (s, _, _)) in enumerate(part):
            if i not in codes:
                codes = {i: encode(texts[i])}
            c = codes[i][s : s + WINDOW]
            x[j, : len(c)] = c
        y = tagger.decode(x)
        for j, (i, (s, lo, hi)) in enumerate(part):
            for p in np.flatnonzero(y[j, lo - s : hi - s]):
                tags[i][lo + int(p)] = int(y[j, lo - s + p])
    out = []
    for t in tags:
        spans: list[list] = []
        for p in sorted(t):
            k = (t[p] - 1) // 2
            if spans and spans[-1][1] == p and spans[-1][2] == k and t[p] % 2 == 0:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1, k])
        out.append([(a, b, KINDS[k]) for a, b, k in spans])
    return out


def added(text: str, base: list, found: list) -> list:
    """Tagged spans that hold up and touch no base span."""
    out, taken = [], [(a, b) for a, b, _ in base]
    for a, b, kind in found:
        s = text[a:b]
        while s and s[-1] in " .,-(" or s.startswith(" "):
            a, b = (a + 1, b) if s[0] == " " else (a, b - 1)
            s = text[a:b]
        plain = DOT.sub(".", AT.sub("@", s))
        ok = {
            "email": re.fullmatch(EMAIL, plain) is not None,
            "ip": re.fullmatch(IP, plain) is not None and passes("ip", plain),
            "card": re.fullmatch(r"[0-9](?:[ ./_-]{0,2}[0-9])+", s) is not None and passes("card", s),
            "phone": re.fullmatch(r"\+?[0-9(][\x20().0-9-]+[0-9]", s) is not None and 10 <= len(digits(s)) <= 15 and not re.fullmatch("[0-9]+", s),
        }[kind]
        edge = (a == 0 or not ("0" <= text[a - 1] <= "9")) and (b == len(text) or not ("0" <= text[b] <= "9"))
        if ok and edge and all(b <= x or a >= y for x, y in taken):
            out.append((a, b, kind))
            taken.append((a, b))
    return out


SPAN = "array<struct<start:bigint,end:bigint,kind:string,base:boolean>>"


def _located(batch: pa.RecordBatch, text: str, tagger: Tagger):
    """(row, text, spans by start) of the texts of a batch that may hold any."""
    data, offs = tk.buffer(batch.column(text))
    have = np.unique(np.searchsorted(offs, np.flatnonzero(TRIGGER[data]), "right") - 1)
    texts = [bytes(data[offs[i] : offs[i + 1]]).decode("utf-8", "replace") for i in have]
    for i, t, found in zip(have.tolist(), texts, tagged_spans(texts, tagger)):
        base = base_spans(t)
        more = added(t, base, found)
        every = sorted([(a, KINDS.index(k), b, True) for a, b, k in base] + [(a, KINDS.index(k), b, False) for a, b, k in more])
        yield i, t, [{"start": a, "end": b, "kind": KINDS[k], "base": o} for a, k, b, o in every]


def find(docs: DataFrame, text: str = "text", out: str = "spans", tagger: Tagger | None = None) -> DataFrame:
    """docs with `out`: all spans of each text (start, end, kind, and whether a base pattern found it)."""
    tagger = tagger or fitted()
    cols = [c for c in docs.columns if c != out]
    d = docs.select(*[F.col(f"`{c}`") for c in cols])
    schema = d.withColumn(out, F.lit(None).cast(SPAN)).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            values: list[list] = [[]] * batch.num_rows
            for i, _, spans in _located(batch, text, tagger):
                values[i] = spans
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, out])

    return mapped(d, run, schema)


def masked(text: str, spans: list[dict]) -> str:
    """A text with its spans as kinds in angle brackets (overlapping spans by the first's), in one pass."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], "<", s["kind"].upper(), ">"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets (overlapping spans by the first's)."""
    tagger = tagger or fitted()

    def run(batches):
        for batch in batches:
            new = {i: masked(t, spans) for i, t, spans in _located(batch, text, tagger) if spans}
            k = batch.schema.names.index(text)
            if new:
                values = batch.column(k).to_pylist()
                for i, t in new.items():
                    values[i] = t
                batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
            yield batch

    return mapped(docs, run, docs.schema)


def op7(spark, sf_dir):
    """Counts and digest are of the base spans, so they don't depend on the tagger; `spans` has all."""
    d = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(base).cast("long").alias("n_base"))
