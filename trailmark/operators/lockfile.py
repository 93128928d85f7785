"""Lockfiles of seven formats as dependency rows.

Files are rows ``(path, content)``.  JSON formats are read by ``from_json``
with a map schema, the others as lines whose block or section is found by a
running count; a file is bounded, so a window over its lines is too.  Entries
that can't be read are counted; they never fail the file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import parse_package_spec
from ..storage import stored

# Bounds, name grammars, file names.
MAX_CHARACTERS = 4_194_304
MAX_DEPENDENCIES = 20_000
MAX_TREE_DEPTH = 32
MAX_NAME, MAX_VERSION = 214, 64
SAFE_VERSION = r"^[A-Za-z0-9._+-]+$"
NPM_NAME = r"^(?:@[A-Za-z0-9._-]+/)?[A-Za-z0-9-][A-Za-z0-9._-]*$"
PYPI_NAME = r"^([A-Za-z0-9]|[A-Za-z0-9][A-Za-z0-9._-]*[A-Za-z0-9])$"
RESERVED = ("node_modules", "favicon.ico")
PROTOTYPE_KEYS = ("__proto__", "constructor", "prototype")
HINTS = {"package-lock.json": "npm-lock-v2", "npm-shrinkwrap.json": "npm-lock-v2", "yarn.lock": "yarn-classic", "pnpm-lock.yaml": "pnpm", "requirements.txt": "requirements-txt", "poetry.lock": "poetry-lock"}
OPERATORS = r"(===|==|>=|<=|~=|!=|>|<)"
REQUIREMENT = rf"^([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*(|@.*|\(?\s*{OPERATORS}.*)$"
FORMATS = ("npm-lock-v1", "npm-lock-v2", "yarn-classic", "yarn-berry", "pnpm", "requirements-txt", "poetry-lock")
CANDIDATE = ["path", "ecosystem", "name", "version", "is_dev_only", "depth", "ord"]


def validated_name(ecosystem: Column, raw: Column) -> Column:
    """The name as its registry writes it, or null if it can't be one."""
    name = F.trim(raw)
    fits = (F.length(name) > 0) & (F.length(name) <= MAX_NAME) & ~name.isin(*PROTOTYPE_KEYS)
    pypi = F.when(name.rlike(PYPI_NAME), F.lower(F.regexp_replace(name, r"[-_.]+", "-")))
    npm = F.when(name.rlike(NPM_NAME) & ~name.isin(*RESERVED), name)
    return F.when(fits, F.when(ecosystem == "pypi", pypi).otherwise(npm))


def validated_version(raw: Column) -> Column:
    v = F.trim(raw)
    return F.when((F.length(v) <= MAX_VERSION) & v.rlike(SAFE_VERSION), v)


def _has_line(content: Column, start: str) -> Column:
    return content.rlike(rf"(?m)^{start}")


def detect_format(path: Column, content: Column) -> Column:
    """The format by structure; the file name decides only where that is
    silent.  Null for what is none of them.
    """
    text = F.trim(F.regexp_replace(content, r"\A\s+|\s+\z", ""))
    declared = F.get_json_object(text, "$.lockfileVersion").try_cast("int")
    json = (
        F.when(declared == 1, "npm-lock-v1").when(declared.isin(2, 3), "npm-lock-v2").when(declared.isNotNull(), F.lit(None))
        .when(F.get_json_object(text, "$.packages").startswith("{"), "npm-lock-v2").when(F.get_json_object(text, "$.dependencies").startswith("{"), "npm-lock-v1")
    )
    pnpm = _has_line(content, "lockfileVersion:") & _has_line(content, "(?:packages|snapshots|importers|dependencies|devDependencies):")
    berry = _has_line(content, "__metadata:") | _has_line(content, r"\s+resolution:\s*\S")
    hint = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    hinted = reduce(lambda out, k: F.when(hint == k, HINTS[k]).otherwise(out), HINTS, F.lit(None).cast("string"))
    wanted = F.filter(_logical_lines(content), lambda x: (x != "") & ~x.startswith("-"))
    requirements = _once(wanted, lambda w: (F.size(w) > 0) & F.forall(w, lambda x: F.coalesce(_spec(x).rlike(REQUIREMENT), F.lit(False))))
    return (
        F.when((F.length(content) > MAX_CHARACTERS) | (text == ""), F.lit(None)).when(text.startswith("{"), json)
        .when(_has_line(content, r"\[\[package\]\]"), "poetry-lock").when(pnpm, "pnpm").when(berry, "yarn-berry")
        .when(_has_line(content, r'\s+version\s+"[^"]+"'), "yarn-classic").when(requirements, "requirements-txt").otherwise(hinted)
    )


def _candidates(rows: DataFrame, ecosystem: str, name: Column, version: Column, dev: Column, depth: Column, order: Column) -> DataFrame:
    return rows.select("path", F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), F.coalesce(dev, F.lit(False)).alias("is_dev_only"), depth.cast("int").alias("depth"), order.cast("long").alias("ord"))


def _either(rows: DataFrame, good: Column, bad: Column | None, ecosystem: str, name: Column, version: Column, dev: Column, depth: Column, order: Column) -> DataFrame:
    """Candidates where ``good`` holds, and where ``bad`` does those that only
    count as unreadable, without a name: in one pass, so files are read once.
    Without ``bad`` these are all others.
    """
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    if bad is not None:
        rows = rows.where(F.col("_good") | F.coalesce(bad, F.lit(False)))
    return _candidates(rows, ecosystem, *[F.when(F.col("_good"), c) for c in (name, version, dev, depth, order)])


ENTRY = "version string, dev boolean, link boolean, dependencies map<string,string>"
UNKNOWN_DEPTH = F.lit


def npm_packages(files: DataFrame) -> DataFrame:
    """The flat ``packages`` map: the name follows the last ``node_modules/``,
    the number of them less one is the depth; roots and links are skipped.
    """
    rows = files.select("path", F.posexplode(F.map_entries(F.from_json("content", "packages map<string,string>")["packages"])).alias("ord", "e"))
    rows = rows.where("e.key <> ''").withColumn("v", F.from_json("e.value", ENTRY))
    is_object = F.col("e.value").startswith("{")
    tail = F.regexp_extract("e.key", r"(?s)^(?:.*/)?node_modules/(.*)$", 1)
    depth = F.size(F.split("e.key", "node_modules/")) - 2
    named = is_object & (tail != "") & ~F.coalesce(F.col("v.link"), F.lit(False))
    good = named & F.col("v.version").isNotNull() & ~F.col("e.key").isin(*PROTOTYPE_KEYS)
    bad = F.col("e.key").isin(*PROTOTYPE_KEYS) | ~is_object | (named & F.col("v.version").isNull())
    return _either(rows, good, bad, "npm", tail, F.col("v.version"), F.col("v.dev"), depth, F.col("ord"))


def npm_tree(files: DataFrame) -> DataFrame:
    """The nested ``dependencies`` of the first version, a join-free step a
    level, to MAX_TREE_DEPTH levels.
    """
    now = files.select("path", F.from_json("content", "dependencies map<string,string>")["dependencies"].alias("deps"))
    out: list[DataFrame] = []
    for depth in range(MAX_TREE_DEPTH + 1):
        rows = now.select("path", F.posexplode(F.map_entries("deps")).alias("ord", "e")).withColumn("v", F.from_json("e.value", ENTRY))
        rows, n = stored(rows, "level")
        if depth and not n:
            break
        bad = F.col("e.key").isin(*PROTOTYPE_KEYS) | ~F.col("e.value").startswith("{") | F.col("v.version").isNull()
        out.append(_either(rows, ~bad, bad, "npm", F.col("e.key"), F.col("v.version"), F.col("v.dev"), F.lit(depth), F.lit(depth * 1_000_000) + F.col("ord")))
        now = rows.where(~F.col("e.key").isin(*PROTOTYPE_KEYS) & F.col("v.dependencies").isNotNull()).select("path", F.col("v.dependencies").alias("deps"))
    return reduce(DataFrame.unionByName, out)


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).withColumn("text", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("text <> '' AND NOT startswith(text, '#')")


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2")


def _blocks(files: DataFrame) -> DataFrame:
    """Indented blocks: ``(path, block, header, fields)``; the header is the
    line without indentation before it, and ends with a colon.
    """
    rows = _lines(files).withColumn("is_head", ~F.col("line").rlike(r"^\s"))
    rows = rows.withColumn("block", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("path").orderBy("pos")))
    fields = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "text")))), lambda s: s["text"])
    per = rows.groupBy("path", "block").agg(F.max(F.when(F.col("is_head"), F.col("line"))).alias("header"), fields.alias("fields"))
    return per.where("endswith(header, ':')").withColumn("header", F.expr("substring(header, 1, length(header) - 1)"))


def _field(pattern: str) -> Column:
    """The first field with a non-empty capture of ``pattern``."""
    values = F.filter(F.transform("fields", lambda f: F.regexp_extract(f, pattern, 1)), lambda v: v != "")
    return F.try_element_at(values, F.lit(1))


def yarn_classic(files: DataFrame) -> DataFrame:
    rows = _blocks(files).withColumn("version", _field(r'^version\s+"([^"]*)"$')).where("version IS NOT NULL")
    rows = rows.withColumn("spec", parse_package_spec(_unquoted(F.split("header", ",")[0])))
    good = F.col("spec").isNotNull()
    return _either(rows, good, None, "npm", F.col("spec.name"), F.col("version"), F.lit(False), F.lit(None), F.col("block"))


def yarn_berry(files: DataFrame) -> DataFrame:
    rows = _blocks(files).withColumn("resolution", _unquoted(_field(r"^resolution:\s*(.+)$"))).withColumn("spec", parse_package_spec(F.regexp_extract("resolution", r"^([^:]*):", 1))).where("spec IS NOT NULL")
    rows = rows.withColumn("version", _unquoted(_field(r"^version:\s*(.+)$")))
    good = F.expr("version IS NOT NULL AND spec.version <> 'workspace'")
    return _either(rows, good, F.col("version").isNull(), "npm", F.col("spec.name"), F.col("version"), F.lit(False), F.lit(None), F.col("block"))


def pnpm(files: DataFrame) -> DataFrame:
    rows = _lines(files)
    section = F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_-]*):\s*$", 1)
    mark = F.when(~F.col("line").startswith(" "), section)  # another line without indentation ends a section
    rows = rows.withColumn("section", F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("pos")))
    rows = rows.where(F.col("section").isin("packages", "snapshots") & F.col("line").rlike(r"^ {2}\S"))
    entry = F.regexp_extract("line", r"^ {2}(\S[^:]*):(?:\s.*)?$", 1)
    bare = F.regexp_replace(F.trim(F.regexp_replace(_unquoted(entry), r"\(.*$", "")), r"^/", "")
    at, slash = parse_package_spec(bare), F.when(bare.rlike(r"^.+/[^/]+$"), F.struct(F.regexp_extract(bare, r"^(.+)/[^/]+$", 1).alias("name"), F.regexp_extract(bare, r"([^/]+)$", 1).alias("version")))
    rows = rows.withColumn("spec", F.coalesce(at, slash))
    good = F.col("spec").isNotNull()
    return _either(rows, good, None, "npm", F.col("spec.name"), F.col("spec.version"), F.lit(False), F.lit(None), F.col("pos"))


def _logical_lines(content: Column) -> Column:
    """Lines with continuations joined and comments cut off, trimmed."""
    joined = F.regexp_replace(content, r"\\\r?\n", "")
    return F.transform(F.split(joined, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"(^\s*|\s)#.*$", "")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _spec(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r";.*$", ""), r" --.*$", ""))


def _requirement(line: Column) -> Column:
    """``struct<name, version>`` of a requirement; the name is null if the line
    is none, the version is null unless it is pinned exactly.
    """
    return _once(_spec(line), lambda spec: _once(F.regexp_replace(F.regexp_extract(spec, REQUIREMENT, 2), r"^\(\s*(.*)\)$", "$1"), lambda clauses: _once(spec.rlike(REQUIREMENT), lambda ok: _named(spec, clauses, ok))))


def _named(spec: Column, clauses: Column, ok: Column) -> Column:
    pins = F.filter(F.transform(F.split(clauses, ","), lambda c: F.regexp_extract(F.trim(c), r"^={2,3}\s*([^\s*=][^*]*)$", 1)), lambda v: v != "")
    return F.struct(F.when(ok, F.regexp_extract(spec, REQUIREMENT, 1)).alias("name"), F.when(ok & ~clauses.startswith("@"), F.trim(F.try_element_at(pins, F.lit(1)))).alias("version"))


def requirements(files: DataFrame) -> DataFrame:
    # parsed before they are rows, else each use of a name or version above parses its line anew; of an inner
    # explode Spark would ask for size and null beforehand, and parse all lines for each; the outer one's empty row is dropped
    lines = F.transform(_logical_lines(F.col("content")), lambda x: F.struct(x.alias("text"), F.when((x != "") & ~x.startswith("-"), _requirement(x)).alias("r")))
    rows = files.select("path", F.posexplode_outer(lines).alias("pos", "line")).select("path", "pos", "line.text", "line.r").where("text <> '' AND NOT startswith(text, '-')")
    good = F.col("r.name").isNotNull()
    return _either(rows, good, None, "pypi", F.col("r.name"), F.col("r.version"), F.lit(False), F.lit(None), F.col("pos"))


def poetry(files: DataFrame) -> DataFrame:
    rows = _lines(files).withColumn("is_head", F.col("text").startswith("["))
    rows = rows.withColumn("block", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("path").orderBy("pos")))
    value = lambda key: F.regexp_extract("text", rf"""^{key}\s*=\s*(?:"([^"]+)"|'([^']+)')\s*$""", 1)
    other = lambda key: F.regexp_extract("text", rf"""^{key}\s*=\s*'([^']+)'\s*$""", 1)
    last = lambda key: F.max_by(F.coalesce(F.nullif(value(key), F.lit("")), F.nullif(other(key), F.lit(""))), F.when(F.coalesce(F.nullif(value(key), F.lit("")), F.nullif(other(key), F.lit(""))).isNotNull(), F.col("pos")))
    per = rows.groupBy("path", "block").agg(F.max(F.when(F.col("is_head"), F.col("text"))).alias("head"), last("name").alias("name"), last("version").alias("version")).where("head = '[[package]]' AND (name IS NOT NULL OR version IS NOT NULL)")
    both = F.col("name").isNotNull() & F.col("version").isNotNull()
    return _either(per, both, None, "pypi", F.col("name"), F.col("version"), F.lit(False), F.lit(None), F.col("block"))


PARSERS = {"npm-lock-v1": npm_tree, "npm-lock-v2": npm_packages, "yarn-classic": yarn_classic, "yarn-berry": yarn_berry, "pnpm": pnpm, "requirements-txt": requirements, "poetry-lock": poetry}


def parse_lockfiles(files: DataFrame, formats: tuple[str, ...] = FORMATS) -> tuple[DataFrame, DataFrame]:
    """Dependencies and a report per file of ``files (path, content)``.

    Dependencies are ``(path, ecosystem, name, version, is_dev_only, depth)``:
    one per identity, with the least known depth, and only for development if
    every entry is.  Of a file with more than MAX_DEPENDENCIES the first are
    kept and the report says ``truncated``.  A null version was not pinned or
    not readable.  The report has ``format`` (null with an ``error``),
    ``unpinned`` and ``unparsable`` counts.
    """
    known = files.withColumn("format", detect_format(F.col("path"), F.col("content")))
    raw = reduce(DataFrame.unionByName, [PARSERS[f](known.where(F.col("format") == f)) for f in formats])
    name = validated_name(F.col("ecosystem"), F.col("name"))
    rows = raw.select("path", "ecosystem", name.alias("name"), validated_version(F.col("version")).alias("version"), "is_dev_only", "depth", "ord", F.col("version").alias("raw"))
    good = rows.where("name IS NOT NULL")
    per = good.groupBy("path", "ecosystem", "name", "version").agg(F.bool_and("is_dev_only").alias("is_dev_only"), F.min("depth").alias("depth"), F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("ord", "name", "version"))
    per = per.withColumn("_rank", rank)
    lost = rows.groupBy("path").agg(F.count_if(F.col("name").isNull()).alias("unparsable"), F.count_if(F.col("name").isNotNull() & F.col("version").isNull()).alias("unpinned"))
    total = per.groupBy("path").agg(F.count("*").alias("n"))
    error = F.when(F.length("content") > MAX_CHARACTERS, "too long").when(F.trim("content") == "", "empty").when(F.col("format").isNull(), "no supported format")
    report = known.select("path", "format", error.alias("error")).join(lost, "path", "left").join(total, "path", "left").na.fill(0, ["unparsable", "unpinned", "n"])
    report = report.withColumn("truncated", F.col("n") > MAX_DEPENDENCIES).withColumnRenamed("n", "dependencies")
    return per.where(F.col("_rank") <= MAX_DEPENDENCIES).drop("_rank", "ord"), report
