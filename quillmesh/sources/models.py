"""Models from declarations: pattern files and plain sources to the model tables.

Only declarations are read; bodies and initial values are skipped. What can't be read as a member is
skipped to its end, so a malformed file gives what is left of it. Type names are resolved by the file's own
classes, then its imports, then java.lang and the packages imported on demand, as far as SUPERS names them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.graph import written

TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|\.\.\.|[^\s\w]', re.S)
NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
PRIMITIVE = {*T.PRIMITIVES, "boolean", "void"}
SHUT = {"(": ")", "[": "]", "{": "}"}

# Well-known types by what they can be assigned to (fixed values).
SUPERS = {
    "java.lang.Number": "java.lang.Integer java.lang.Long java.lang.Short java.lang.Byte java.lang.Float java.lang.Double java.math.BigInteger java.math.BigDecimal java.util.concurrent.atomic.AtomicInteger java.util.concurrent.atomic.AtomicLong",
    "java.lang.CharSequence": "java.lang.String java.lang.StringBuilder java.lang.StringBuffer",
    "java.util.Collection": "java.util.List java.util.ArrayList java.util.LinkedList java.util.Vector java.util.Stack java.util.Set java.util.HashSet java.util.LinkedHashSet java.util.SortedSet java.util.TreeSet java.util.EnumSet java.util.Queue java.util.Deque java.util.ArrayDeque java.util.PriorityQueue java.util.concurrent.BlockingQueue java.util.concurrent.ConcurrentLinkedQueue java.util.concurrent.LinkedBlockingQueue java.util.concurrent.CopyOnWriteArrayList",
    "java.util.Map": "java.util.HashMap java.util.LinkedHashMap java.util.SortedMap java.util.TreeMap java.util.WeakHashMap java.util.EnumMap java.util.Hashtable java.util.Properties java.util.concurrent.ConcurrentMap java.util.concurrent.ConcurrentHashMap",
    "java.util.Iterator": "java.util.ListIterator java.util.Scanner",
    "java.io.Reader": "java.io.BufferedReader java.io.InputStreamReader java.io.FileReader java.io.StringReader",
    "java.io.Writer": "java.io.BufferedWriter java.io.OutputStreamWriter java.io.FileWriter java.io.StringWriter java.io.PrintWriter",
    "java.io.InputStream": "java.io.FileInputStream java.io.BufferedInputStream java.io.ByteArrayInputStream java.io.DataInputStream java.io.ObjectInputStream",
    "java.io.OutputStream": "java.io.FileOutputStream java.io.BufferedOutputStream java.io.ByteArrayOutputStream java.io.DataOutputStream java.io.ObjectOutputStream java.io.PrintStream",
    "java.net.InetAddress": "java.net.Inet4Address java.net.Inet6Address",
    "java.lang.Object": "java.lang.Boolean java.lang.Character java.lang.Class java.lang.Enum java.lang.Iterable java.lang.Runnable java.lang.Thread java.lang.Comparable java.lang.Process java.lang.Void java.util.Date java.util.UUID java.util.Random java.util.Locale java.util.Optional java.util.Map.Entry java.net.URL java.net.URI java.net.Socket java.net.ServerSocket java.io.File",
    "java.lang.Throwable": "java.lang.Exception java.lang.RuntimeException java.lang.Error java.io.IOException java.sql.SQLException",
}
KNOWN_SUPERS = {t: ([] if s == "java.lang.Object" else [s]) for s, ts in SUPERS.items() for t in ts.split()} | {s: [] for s in SUPERS}


class Models(NamedTuple):
    models: DataFrame
    classes: DataFrame
    attributes: DataFrame
    operations: DataFrame
    parameters: DataFrame
    edges: DataFrame


class _Declarations:
    """One file's declarations, read in one pass."""

    def __init__(self, text: str, package_note: str, class_note: str):
        self.t = [x for x in TOKEN.findall(text) if not x.startswith(("//", "/*"))]
        self.i, self.notes = 0, (package_note, class_note)
        self.package, self.name, self.imports, self.stars, self.classes, self.uses = "*DEFAULT*", None, {}, [], [], []
        self.file()

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.at(-1)

    def named(self, k: int = 0) -> bool:
        return bool(NAME.fullmatch(self.at(k)))

    def balanced(self) -> list[str]:
        """The tokens inside the bracket that opens here."""
        start, open_ = self.i + 1, []
        while self.i < len(self.t):
            x = self.take()
            if x in SHUT:
                open_.append(SHUT[x])
            elif open_ and x == open_[-1]:
                open_.pop()
                if not open_:
                    break
        return self.t[start : self.i - 1]

    def dotted(self) -> str:
        parts = [self.take()]
        while self.at() == "." and (self.named(1) or self.at(1) == "*"):
            self.take()
            parts.append(self.take())
        return ".".join(parts)

    def modifiers(self) -> tuple[set, dict]:
        mods, notes = set(), {}
        while True:
            if self.at() == "@" and self.at(1) != "interface":
                self.take()
                name = self.dotted().rpartition(".")[2]
                notes[name] = self.balanced() if self.at() == "(" else []
            elif self.at() in MODIFIERS:
                mods.add(self.take())
            else:
                return mods, notes

    def variables(self) -> set:
        """Names of the type variables that are declared here."""
        out, depth = set(), 0
        while self.i < len(self.t):
            x = self.take()
            depth += (x == "<") - (x == ">")
            if not depth:
                break
            if depth == 1 and x in "<," and self.named():
                out.add(self.at())
        return out

    def type(self) -> tuple | None:
        """(name, arguments, dimensions) of a type, None if there is none."""
        self.modifiers()
        if self.at() == "?":
            self.take()
            if self.at() in ("extends", "super"):
                self.take()
                return self.type()
            return ("?", [], 0)
        if not self.named():
            return None
        name, args = self.dotted(), []
        while self.at() == "<":
            self.take()
            while self.at() not in (">", "") and (x := self.type()):
                args.append(x)
                while self.at() == "&":  # further bounds
                    self.take()
                    self.type()
                if self.at() == ",":
                    self.take()
            if self.at() != ">":
                return None
            self.take()
            if self.at() == "." and self.named(1):
                self.take()
                name += "." + self.dotted()
        return (name, args, self.dimensions())

    def dimensions(self) -> int:
        n = 0
        while self.at() == "[" and self.at(1) == "]":
            self.i, n = self.i + 2, n + 1
        return n

    def types(self) -> list:
        out = []
        while x := self.type():
            out.append(x)
            if self.at() != ",":
                break
            self.take()
        return out

    def file(self) -> None:
        while self.i < len(self.t):
            mods, notes = self.modifiers()
            x = self.at()
            if x == "package":
                self.take()
                self.package = self.dotted()
            elif x == "import":
                self.take()
                static = self.at() == "static" and bool(self.take())
                name = self.dotted()
                if name.endswith(".*"):
                    self.stars += [] if static else [name[:-2]]
                elif not static:
                    self.imports[name.rpartition(".")[2]] = name
            elif self.declares():
                self.declaration(mods, notes, "", self.package)
            else:
                self.take()

    def declares(self) -> bool:
        x = self.at()
        return x in ("class", "interface", "enum") and self.named(1) or x == "@" and self.at(1) == "interface" or x == "record" and self.named(1) and self.at(2) in ("(", "<")

    def declaration(self, mods: set, notes: dict, outer: str, package: str, variables: frozenset = frozenset()) -> None:
        kind = self.take()
        if kind == "@":
            kind = self.take()
        short = self.take()
        variables = variables | (self.variables() if self.at() == "<" else set())
        c = {"id": outer + short, "full": f"{package}.{outer}{short}", "kind": kind, "supers": [], "ifaces": [], "enum": [] if kind == "enum" else None, "attrs": [], "ops": [], "outer": outer[:-1], "vars": variables}
        if kind == "record" and self.at() == "(":
            c["attrs"] = [(n, t, "private") for n, t in self.parameters()]
        while self.at() not in ("{", ""):
            x = self.take()
            if x == "extends":
                c["ifaces" if kind == "interface" else "supers"] += self.types()
            elif x == "implements":
                c["ifaces"] += self.types()
        if self.notes[0] in notes:
            self.name, package = short, f"{package}.{short}"
            self.package = package
        else:
            outer = c["id"] + "."
            self.classes.append(c)
            self.uses += [(c["id"], x) for x in _used(notes.get(self.notes[1], []))]
        self.take()
        if kind == "enum":
            self.constants(c["enum"])
        while self.at() not in ("}", ""):
            self.member(c, short, outer, package, variables)
        self.take()

    def constants(self, out: list) -> None:
        while self.at() not in (";", "}", ""):
            self.modifiers()
            x = self.take()
            if NAME.fullmatch(x):
                out.append(x)
            while self.at() in ("(", "{"):
                self.balanced()

    def member(self, c: dict, short: str, outer: str, package: str, variables) -> None:
        mods, notes = self.modifiers()
        access = next((m for m in ("public", "private", "protected") if m in mods), None)
        if self.declares():
            return self.declaration(mods, notes, outer, package, frozenset() if "static" in mods else frozenset(variables))
        own = variables | (self.variables() if self.at() == "<" else set())
        if self.at() == short and self.at(1) == "(":
            self.take()
            c["ops"].append((short, None, self.parameters(), True, False, access, own))
            return self.ending()
        t = self.type()
        if t is None or not self.named():
            return self.ending()
        name = self.take()
        if self.at() == "(":
            p = self.parameters()
            t = (t[0], t[1], t[2] + self.dimensions())
            c["ops"].append((name, t, p, False, "static" in mods, access, own))
            return self.ending()
        while True:
            c["attrs"].append((name, (t[0], t[1], t[2] + self.dimensions()), access))
            if self.at() == "=":
                self.value()
            if self.at() != "," or not self.named(1):
                return self.ending()
            self.take()
            name = self.take()

    def value(self) -> None:
        """Past an initial value; a comma between type arguments does not end it."""
        angle = 0
        while self.at() not in (";", "", "}"):
            x = self.at()
            if x == "," and not angle:
                return
            if x in SHUT:
                self.balanced()
                continue
            if x == "<" and self.at(-1)[:1].isupper():
                angle += 1
            elif x == ">" and angle:
                angle -= 1
            self.take()

    def ending(self) -> None:
        """Past the end of a member: its body or a semicolon."""
        while self.at() not in ("}", ""):
            x = self.at()
            if x in SHUT:
                self.balanced()
                if x == "{":
                    return
            elif self.take() == ";":
                return

    def parameters(self) -> list[tuple]:
        """(name, type) of each parameter."""
        inside = self.balanced()
        rest, self.t, self.i, at = self.t, inside, 0, self.i
        out = []
        while self.i < len(self.t):
            t = self.type()
            if t is None:
                break
            many = self.at() == "..." and bool(self.take())
            if not self.named():
                break
            name = self.take()
            if name != "this":  # a receiver is none
                out.append((name, (t[0], t[1], t[2] + many + self.dimensions())))
            if self.at() != ",":
                break
            self.take()
        self.t, self.i = rest, at
        return out


def _used(note: list[str]) -> list[str]:
    """Classes that a note's value, or its `uses`, names as X.class."""
    out, key, depth = [], None, 0
    for i, x in enumerate(note):
        depth += (x in SHUT) - (x in SHUT.values())
        if depth == 0 and note[i + 1 : i + 2] == ["="]:
            key = x
        if x == "class" and i > 1 and note[i - 1] == "." and key in (None, "uses"):
            out.append(note[i - 2])
    return out


def _written(t: tuple) -> str:
    return t[0] + ("<" + ",".join(map(_written, t[1])) + ">" if t[1] else "") + "[]" * t[2]


def _rows(file: str, text: str, package_note: str, class_note: str) -> dict:
    d = _Declarations(text, package_note, class_note)
    by_id = {c["id"]: c for c in d.classes}
    short = {c["id"].rpartition(".")[2]: c for c in d.classes}
    by_full = {c["full"]: c for c in d.classes}
    used: set = set()

    def own(name: str):
        return by_id.get(name) or short.get(name) or by_full.get(name)

    def qualified(name: str, variables) -> str:
        if name in PRIMITIVE:
            return name
        if name in variables or name == "?":
            return "java.lang.Object"
        if c := own(name):
            return c["full"]
        head, dot, tail = name.partition(".")
        if head in d.imports:
            used.add(d.imports[head] + dot + tail)
            return d.imports[head] + dot + tail
        if not dot:
            for p in ["java.lang", *d.stars]:
                if f"{p}.{name}" in KNOWN_SUPERS or f"{p}.{name}" in T.KNOWN or f"{p}.{name}" in T.ASSIGNABLE:
                    if p != "java.lang":
                        used.add(f"{p}.{name}")
                    return f"{p}.{name}"
        return name

    def full(t, variables) -> str:
        return qualified(t[0], variables) + ("<" + ",".join(full(x, variables) for x in t[1]) + ">" if t[1] else "") + "[]" * t[2]

    def supers(name: str, seen=()) -> list:
        """What a type can be assigned to, itself left out."""
        c = by_full.get(name)
        up = [qualified(x[0], c["vars"]) for x in c["supers"] + c["ifaces"]] if c else KNOWN_SUPERS.get(name, [])
        if not c and name.endswith(("Exception", "Error")):
            up = [*up, "java.lang.Throwable"]
        return sorted({y for x in up if x not in seen for y in [x, *supers(x, (*seen, name))]})

    def typed(t, c, variables) -> dict:
        q = full(t, variables)
        base = q.partition("<")[0]
        mine = base in by_full
        return {"type_name": _written(t), "qualified": q, "supers": supers(base), "this_type": c["full"], "defined": mine or t[0] in PRIMITIVE or t[2] > 0 or base.startswith("java."), "binary": not mine and base.startswith("java.")}

    def depends(c, t, variables):
        """Own classes that a type names, arrays left out."""
        if t[2]:
            return
        if t[0] not in variables and (x := own(t[0])) and x is not c:
            yield c["id"], x["id"]
        for a in t[1]:
            yield from depends(c, a, variables)

    classes, attributes, operations, parameters = [], [], [], []
    edges = [(a, x["id"]) for a, b in d.uses if (x := short.get(b.rpartition(".")[2])) and x["id"] != a]
    for c in by_id.values():
        ups = [qualified(x[0], c["vars"]) for x in c["supers"]], [qualified(x[0], c["vars"]) for x in c["ifaces"]]
        known = lambda n: n in by_full or n.startswith("java.")
        classes.append({"class_id": c["id"], "name": c["id"], "full_name": c["full"], "is_interface": c["kind"] == "interface", "is_enum": c["kind"] == "enum", "is_matchable": all(map(known, ups[0] + ups[1])), "super_name": next(filter(known, ups[0]), None), "ifaces": list(filter(known, ups[1])), "enum_consts": None if c["enum"] is None else list(dict.fromkeys(c["enum"]))})
        for name, t, access in c["attrs"]:
            attributes.append({"class_id": c["id"], "attr_id": f"{c['id']}.{name}", "name": name, "full_name": f"{c['full']}.{name}", "access": access, **typed(t, c, c["vars"])})
            edges += depends(c, t, c["vars"])
        for k, (name, t, ps, ctor, static, access, variables) in enumerate(c["ops"]):
            op = f"{c['id']}.{name}#{k}"
            operations.append({"class_id": c["id"], "op_id": op, "name": name, "full_name": f"{c['full']}.{name}", "is_ctor": ctor, "is_static": static, "access": access, "arg_types": [_written(x) for _, x in ps], **typed(t or ("void", [], 0), c, variables)})
            edges += depends(c, t, variables) if t else ()
            parameters += [{"op_id": op, "param_id": f"{op}.{n}", "pos": i, "name": n, "full_name": f"{c['full']}.{name}.{n}", **typed(x, c, variables)} for i, (n, x) in enumerate(ps)]
        if c["outer"] in by_id:
            edges.append((c["id"], c["outer"]))
    return {"model_id": file, "name": d.name, "package": d.package, "imports": sorted(used), "classes": classes, "attributes": attributes, "operations": operations, "parameters": parameters, "edges": [{"src": a, "dst": b} for a, b in dict.fromkeys(edges)]}


_TYPE = "type_name: string, qualified: string, supers: array<string>, this_type: string, defined: boolean, binary: boolean"
SCHEMA = (
    "model_id string, name string, package string, imports array<string>, "
    "classes array<struct<class_id: string, name: string, full_name: string, is_interface: boolean, is_enum: boolean, is_matchable: boolean, super_name: string, ifaces: array<string>, enum_consts: array<string>>>, "
    f"attributes array<struct<class_id: string, attr_id: string, name: string, full_name: string, access: string, {_TYPE}>>, "
    f"operations array<struct<class_id: string, op_id: string, name: string, full_name: string, is_ctor: boolean, is_static: boolean, access: string, arg_types: array<string>, {_TYPE}>>, "
    f"parameters array<struct<op_id: string, param_id: string, pos: int, name: string, full_name: string, {_TYPE}>>, "
    "edges array<struct<src: string, dst: string>>"
)


def load_models(files: DataFrame, package_note: str = "PatternPackage", class_note: str = "PatternClass") -> Models:
    """The model tables of declaration files (file, text): one model a file, files of null text left out.

    A type with the package note is the model's name and package, not a class. An inner class is named
    Outer.Inner. Edges: what class notes name as X.class, own classes in types of fields and results (arrays
    left out), outer classes. A class whose super types aren't known can't be matched. Type variables are objects.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([_rows(f, t, package_note, class_note) for f, t in zip(pdf["file"], pdf["text"])], columns=["model_id", "name", "package", "imports", "classes", "attributes", "operations", "parameters", "edges"])

    read = written(files.filter("text IS NOT NULL").select(F.col("file").cast("string"), "text").mapInPandas(run, SCHEMA))
    rows = lambda c: read.select("model_id", F.explode(c).alias("x")).select("model_id", "x.*")
    kind = T.arg_type(F.col("qualified"), F.col("supers"), F.col("this_type"), F.col("defined"), F.col("binary"))
    o = rows("operations").withColumn("map_name", T.map_name(F.col("full_name"), F.col("arg_types")))
    return Models(
        read.select("model_id", "name", "package", "imports"),
        rows("classes"),
        rows("attributes").select("model_id", "class_id", "attr_id", "name", "full_name", kind.alias("arg_type"), "type_name", "access"),
        o.select("model_id", "class_id", "op_id", "name", "full_name", "map_name", kind.alias("ret_arg_type"), F.col("type_name").alias("ret_type"), "is_ctor", "is_static", "access"),
        rows("parameters").select("model_id", "op_id", "param_id", "pos", "name", "full_name", kind.alias("arg_type"), "type_name"),
        rows("edges"),
    )


def read_models(spark, path: str, endings: tuple[str, ...] = (".java",), **notes) -> Models:
    """The models of all files below a directory whose names end so."""
    f = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    fits = F.lit(False)
    for e in endings:
        fits = fits | F.lower("file").endswith(e)
    return load_models(f.filter(fits), **notes)
