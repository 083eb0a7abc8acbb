"""Readers: directories and archives, saved tables, dictionaries, JSON, XML, build scripts, coordinates, pattern headers."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RELEVANT = (".zip", ".jar", ".java", ".tar")
# The mark of saved tables (a fixed value).
KGRAM_MARK = "========KGRAM======="
MAX_DEPTH = 64  # archives in archives; deeper ones are an error


def relevant(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(zip|jar|java|tar)$")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of all sources below a directory, those in nested archives included; bad archives are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(relevant(F.col("path")))
    plain = files.filter(F.lower("path").endswith(".java")).select(F.col("path").alias("name"), F.decode("content", "UTF-8").alias("text"))
    packed = files.filter(~F.lower("path").endswith(".java")).select("path", "content")
    return plain.unionByName(archive_members(packed))


def archive_members(files: DataFrame) -> DataFrame:
    """(path, content) of archives to (name, text) of the sources inside; an error where archives nest deeper than MAX_DEPTH."""

    def walk(name: str, data: bytes, depth: int):
        low = name.lower()
        if low.endswith(".java"):
            yield name, data.decode("utf-8", "replace")
        elif low.endswith((".zip", ".jar", ".tar")):
            if depth >= MAX_DEPTH:
                raise ValueError(f"archives nested deeper than {MAX_DEPTH}: {name[:200]}")
            try:
                if low.endswith(".tar"):
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        inner = [(m.name, t.extractfile(m).read()) for m in t if m.isfile() and m.name.lower().endswith(RELEVANT)]
                else:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        inner = [(n, z.read(n)) for n in z.namelist() if n.lower().endswith(RELEVANT)]
            except (zipfile.BadZipFile, tarfile.TarError, EOFError, RuntimeError, OSError):
                return  # a bad archive has no members
            for n, d in inner:
                yield from walk(f"{name}!{n}", d, depth + 1)

    def run(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in walk(p, bytes(c), 0)]
            yield pd.DataFrame(rows, columns=["name", "text"])

    return files.mapInPandas(run, "name string, text string")


def read_dictionary(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """(word) of lines of three characters or more, trimmed."""
    return dictionary(spark.read.text(path), "value", lower)


def dictionary(lines: DataFrame, col: str, lower: bool = True) -> DataFrame:
    w = F.trim(F.lower(col) if lower else F.col(col))
    return lines.filter(F.length(col) >= 3).select(w.alias("word")).distinct()


def read_saved_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, term, df) of a saved text table: N, lines of count and term, a mark, N of k-grams, their lines. N is the row of null term.

    One file is one table, so its lines are numbered within it.
    """
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    mark = t.filter(F.col("line") == KGRAM_MARK).select(F.col("pos").alias("mark"))
    t = t.filter("trim(line) <> ''").join(F.broadcast(mark), F.lit(True), "left")
    t = t.filter("pos <> mark OR mark IS NULL").withColumn("kind", F.when(F.col("pos") > F.col("mark"), "kgram").otherwise("word"))
    head = F.col("pos").isin(0) | (F.col("pos") == F.col("mark") + 1)
    return t.select("kind", F.when(~head, F.regexp_extract("line", r"^\s*\d+\s+(.*)$", 1)).alias("term"), F.regexp_extract("line", r"^\s*(\d+)", 1).cast("long").alias("df"))


def paged_docs(pages: DataFrame, body: str = "body") -> DataFrame:
    """(grp, artifact, version, packaging, stamp) of search pages (JSON); bodies under 10 characters are no answer."""
    schema = "struct<response:struct<numFound:bigint,docs:array<struct<g:string,a:string,v:string,latestVersion:string,p:string,timestamp:bigint>>>>"
    d = pages.filter(F.length(body) >= 10).select(F.explode(F.from_json(body, schema)["response"]["docs"]).alias("d"))
    return d.select(F.col("d.g").alias("grp"), F.col("d.a").alias("artifact"), F.coalesce("d.v", "d.latestVersion").alias("version"), F.col("d.p").alias("packaging"), F.col("d.timestamp").alias("stamp"))


def next_pages(pages: DataFrame, key: str = "query", start: str = "start", body: str = "body", size: int = 100, cap: int = 4000) -> DataFrame:
    """(key, start) of pages that are still to be fetched, from those fetched (key, start, body): up to the greatest number of hits told, `cap` at most."""
    found = pages.filter(F.length(body) >= 10).groupBy(key).agg(F.max(F.from_json(body, "struct<response:struct<numFound:bigint>>")["response"]["numFound"]).alias("n"))
    n = F.least("n", F.lit(cap).cast("long"))
    due = found.filter("n > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).alias(start))
    return due.join(pages.select(key, F.col(start).cast("long").alias(start)), [key, start], "left_anti")


def cached_answers(queries: DataFrame, cache: DataFrame, key: str = "query", body: str = "body") -> DataFrame:
    """(key, body, fetch): each query once with its cached answer, null where that has under 10 characters; `fetch` where none is cached."""
    c = cache.groupBy(key).agg(F.max(body).alias(body), F.lit(True).alias("_had"))
    x = queries.select(key).distinct().join(c, key, "left")
    return x.select(key, F.when(F.length(body) >= 10, F.col(body)).alias(body), F.col("_had").isNull().alias("fetch"))


def pom_dependencies(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(file, coordinate) of each dependency; a version that is missing or a variable is LATEST."""
    # comments and exclusions may hold elements of the same names
    plain = F.regexp_replace(F.col(xml), r"(?s)<!--.*?-->|<exclusions>.*?</exclusions>", "")
    inside = F.regexp_extract_all(plain, F.lit(r"(?s)<dependencies>(.*?)</dependencies>"), F.lit(1))
    n = files.select("file", F.explode(inside).alias("block")).select("file", F.explode(F.regexp_extract_all("block", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("body"))
    part = lambda k: F.regexp_extract("body", rf"(?s)<{k}>\s*(.*?)\s*</{k}>", 1)
    n = n.withColumn("grp", part("groupId")).withColumn("artifact", part("artifactId")).filter("artifact <> ''")
    v = part("version")
    v = F.when((v == "") | v.startswith("$"), "LATEST").otherwise(v)
    return n.select("file", F.concat_ws(":", "grp", "artifact", v).alias("coordinate"))


def gradle_libraries(lines: DataFrame, file: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """(file, lib): compile, compileOnly and testCompile lines inside a dependencies block; project and group forms left out."""
    t = lines.select(file, pos, F.trim(line).alias("ln")).filter("ln <> ''")
    opens = F.col("ln").startswith("dependencies")
    shuts = ~opens & (F.col("ln").startswith("}") | F.col("ln").endswith("}"))
    before = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("inside", F.coalesce(F.last(F.when(opens, True).when(shuts, False), ignorenulls=True).over(before), F.lit(False)) & ~opens)
    v = F.trim(F.regexp_extract("ln", r"^(?:compile|compileOnly|testCompile)\s+(.+)$", 1))
    v = F.when(v.startswith("'"), F.regexp_extract(v, r"^'(.*)'", 1)).otherwise(v)
    t = t.filter("inside").withColumn("lib", v).filter("lib <> '' AND NOT startswith(lib, ':') AND NOT startswith(lib, 'project') AND NOT startswith(lib, 'group:')")
    return t.select(file, "lib").distinct()


def coordinates(df: DataFrame, col: str = "coordinate") -> DataFrame:
    """(.., grp, name, version, lib_id) of group:name:version; others have a null lib_id."""
    p = F.split(col, ":")
    ok = F.size(p) == 3
    part = lambda i: F.when(ok, F.get(p, F.lit(i)))
    return df.select("*", part(0).alias("grp"), part(1).alias("name"), part(2).alias("version"), F.when(ok, F.concat(part(0), F.lit(":"), part(1))).alias("lib_id"))


# Keys of pattern headers (fixed values).
HEADER_KEYS = ("source", "library", "libraries", "missing", "keywords", "keyterms", "parameter", "context", "suggestedTerms", "score", "sources")


def pattern_headers(files: DataFrame, text: str = "text", note: str = "Pattern", package: str = "PatternPackage") -> DataFrame:
    """(file, key, value) of annotation entries `@note(key=value)` and `@note(key={a,b})` before the package interface; `note` and `package` name the annotations."""
    head = F.regexp_extract(F.col(text), rf"(?s)^(.*?)(?:@{package}\b|\Z)", 1)
    e = files.select("file", F.explode(F.regexp_extract_all(head, F.lit(rf"(?s)@{note}\s*\((.*?)\)\s*(?=\n|$)"), F.lit(1))).alias("e"))
    e = e.select("file", F.regexp_extract("e", r"^\s*(\w+)\s*=", 1).alias("key"), F.regexp_replace("e", r"^\s*\w+\s*=\s*", "").alias("v")).filter(F.col("key").isin(*HEADER_KEYS))
    values = F.regexp_extract_all("v", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return e.select("file", "key", F.posexplode(values).alias("pos", "value"))


def pattern_edges(files: DataFrame, text: str = "text", note: str = "PatternClass") -> DataFrame:
    """(file, src, dst): classes that a @note(uses={..}) names, where both are declared and differ."""
    c = files.select("file", F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"(?s)@{note}\s*(?:\([^)]*\))?\s*(?:(?:public|abstract|static|final)\s+)*(?:class|interface|enum)\s+\w+"), F.lit(0))).alias("d"))
    c = c.select("file", F.regexp_extract("d", r"(?:class|interface|enum)\s+(\w+)$", 1).alias("src"), F.regexp_extract_all(F.regexp_extract("d", r"(?s)uses\s*=\s*\{?([^})]*)", 1), F.lit(r"(\w+)\.class"), F.lit(1)).alias("uses"))
    names = c.select("file", F.col("src").alias("dst")).distinct()
    return c.select("file", "src", F.explode("uses").alias("dst")).filter("src <> dst").join(names, ["file", "dst"], "left_semi").select("file", "src", "dst").distinct()
