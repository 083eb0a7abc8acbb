"""Column functions over texts, names and types. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{IsAlphabetic}+"
PACKAGE_LINE = r"(?ms)^.*?(^\s*package\s+[\w.]+\s*;.*)$"


def words(text: Column, legacy_tail: bool = False, from_package: bool = False) -> Column:
    """Maximal runs of letters. legacy_tail drops a last run that ends the text; from_package starts at the first package line."""
    t = F.coalesce(text, F.lit(""))
    if from_package:
        t = F.when(t.rlike(PACKAGE_LINE), F.regexp_extract(t, PACKAGE_LINE, 1)).otherwise(t)
    w = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    return F.when(t.rlike(r"\p{IsAlphabetic}\z"), F.slice(w, 1, F.size(w) - 1)).otherwise(w) if legacy_tail else w


def case_parts(word: Column) -> Column:
    """Lower-cased parts of a word, split where a capital follows a small letter."""
    return F.transform(F.split(word, r"(?<=\p{Ll})(?=\p{Lu})"), lambda p: F.lower(p))


def name_words(name: Column, singular: bool = True) -> Column:
    """Words of a name: the whole, and its parts of two characters or more at case, digit, _ and - borders.

    Null for names under three characters. A separator stays at the front of the part after it. Plurals
    in s also give the form without it.
    """
    cut = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?=[_-])", "\u0001")
    parts = F.filter(F.transform(F.split(cut, "\u0001"), lambda p: F.lower(p)), lambda p: F.length(p) >= 2)
    all_ = F.array_union(F.array(F.lower(name)), parts)
    if singular:
        all_ = F.array_union(all_, F.transform(F.filter(all_, lambda p: p.rlike("[^s]s$") & (F.length(p) > 3)), lambda p: F.substring(p, F.lit(1), F.length(p) - 1)))
    return F.when(F.length(name) >= 3, F.array_sort(F.array_distinct(all_)))


def split_name(name: Column) -> Column:
    """Parts of an identifier at case borders and underscores, empty parts left out."""
    return F.filter(F.split(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|_+", "\u0001"), "\u0001"), lambda p: F.length(p) > 0)


def convert_name(name: Column, style: str, prefix: str | None = None) -> Column:
    """A name in a style: letters L U M F S, and I, E, C, P with a number.

    L lower, U upper, M mixed case, F first word lower, S underscores between words; I, E, C: so many
    underscores after the first word, at the end, at the start; P: `prefix` goes before a single word.
    """
    import re

    opts = dict(re.findall(r"([LUMFSIECP])([0-9]*)", style))
    number = lambda k: max(int(opts.get(k) or 0), 0)
    parts = split_name(name)
    if "P" in opts and prefix:
        parts = F.when(F.size(parts) == 1, F.concat(F.array(F.lit(prefix)), parts)).otherwise(parts)
    upper_first = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))

    def one(w, i):
        if "U" in opts:
            word = F.upper(w)
        elif "L" in opts:
            word = w
        else:
            word = F.when(i == 0, w).otherwise(upper_first(w)) if "F" in opts else upper_first(w)
        gap = F.when(i == 1, F.lit("_" * number("I"))).when(i > 1, F.lit("_" if "S" in opts else "")).otherwise(F.lit(""))
        return F.concat(gap, word)

    return F.concat(F.lit("_" * number("C")), F.array_join(F.transform(parts, one), ""), F.lit("_" * number("E")))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal names, falling with edit distance; 1 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).when(F.size(at) == 0, n).otherwise(F.array_min(at) - 1)


def mapped_type(name: Column) -> Column:
    """A type name as an identifier. The marks are fixed values."""
    for old, new in (("<", "_lt_"), (">", "_gt_"), (",", "_cm_"), ("[]", "_ARR_"), ("[", "_lb_"), ("]", "_rb_"), (" ", "")):
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def map_name(full: Column, arg_types: Column) -> Column:
    """full(arg,arg) with mapped types."""
    return F.concat(full, F.lit("("), F.array_join(F.transform(arg_types, mapped_type), ","), F.lit(")"))


def short_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, ".", -1), "$", -1)


def output_name(name: Column, package: Column, outer: Column | None = None) -> Column:
    """A type name without its package, and without its outer class; inside generics too."""
    quoted = lambda c: F.concat(F.lit(r"(?<![\w.])\Q"), c, F.lit(r".\E"))
    out = F.when(F.length(package) > 0, F.regexp_replace(name, quoted(package), F.lit(""))).otherwise(name)
    return out if outer is None else F.when(F.length(outer) > 0, F.regexp_replace(out, quoted(outer), F.lit(""))).otherwise(out)


def as_int(v: Column) -> Column:
    return v.try_cast("double").cast("long")


def as_double(v: Column) -> Column:
    return v.try_cast("double")


def as_string(v: Column) -> Column:
    return v.cast("string")


def as_bool(v: Column) -> Column:
    """True for numbers that are not 0, and for 1..., t..., y...; false for other texts."""
    number = v.try_cast("double")
    return F.when(number.isNotNull(), number != 0).otherwise(F.coalesce(F.lower(v).rlike("^[1ty]"), F.lit(False)))


def import_prefixes(name: Column) -> Column:
    """The name, then the name without its last segments, longest first; two segments at least."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda k: n - k >= 1), lambda k: F.array_join(F.slice(parts, F.lit(1), n - k), "."))


# Type categories by exact name, by assignability and by part of the name, in order of precedence (fixed values).
KNOWN = {
    "java.lang.Boolean": "BOOLEAN", "java.lang.String": "STRING", "java.io.File": "STRING", "java.lang.Object": "OBJECT", "java.util.Date": "DATE",
    "java.sql.Date": "DATE", "java.sql.Timestamp": "DATE", "java.net.URL": "URL", "java.net.URI": "URL", "java.awt.Color": "COLOR", "java.awt.Rectangle": "SHAPE",
}
ASSIGNABLE = {
    "java.util.Collection": "COLLECTION", "java.lang.Iterable": "COLLECTION", "java.util.Map": "MAP", "java.awt.Component": "COMPONENT", "java.awt.geom.Point2D": "POINT",
    "java.awt.Shape": "SHAPE", "java.lang.Number": "NUMBER", "java.lang.Enum": "NUMBER", "java.io.Reader": "INPUT", "java.io.Writer": "OUTPUT", "java.io.InputStream": "INPUT",
    "java.io.OutputStream": "OUTPUT", "java.lang.CharSequence": "STRING", "java.net.InetAddress": "INETADDRESS", "java.util.Enumeration": "ITERATOR", "java.util.Iterator": "ITERATOR",
    "java.awt.Graphics": "GRAPHICS", "java.awt.Event": "EVENT", "java.util.EventObject": "EVENT", "java.net.Socket": "SOCKET", "java.net.ServerSocket": "SOCKET", "java.lang.Throwable": "EXCEPTION",
}
CONTAINS = {"Color": "COLOR", "Point": "POINT", "Date": "DATE", "Time": "DATE", "URI": "URL", "URL": "URL"}
PRIMITIVES = ("byte", "short", "int", "long", "float", "double", "char")


def arg_type(name: Column, supers: Column, this_type: Column | None = None, defined: Column | None = None, binary: Column | None = None) -> Column:
    """Category of a type: its name, its super types (itself included or not), the class it stands in, what is known of it."""
    t = F.when(name == "void", "VOID").when(name == "boolean", "BOOLEAN").when(name.isin(*PRIMITIVES), "NUMBER").when(name.endswith("[]"), "ARRAY")
    bare = F.substring_index(name, "<", 1)
    for k, v in KNOWN.items():
        t = t.when(name == k, v)
    for k, v in ASSIGNABLE.items():
        t = t.when((bare == k) | F.array_contains(F.coalesce(supers, F.array().cast("array<string>")), k), v)
    for k, v in CONTAINS.items():
        t = t.when(name.contains(k), v)
    if this_type is not None:
        t = t.when(name == this_type, "THISTYPE")
    defined, binary = F.lit(True) if defined is None else defined, F.lit(False) if binary is None else binary
    t = t.when(~defined & name.startswith("javax."), "JAVA").when(~defined & name.startswith("android."), "ANDROID").when(~defined, "OTHER")
    return t.when(binary & name.startswith("android."), "ANDROID").when(binary, "JAVA").otherwise("USERTYPE")
