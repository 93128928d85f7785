"""Persistence scan: path globs and line patterns over a tree of files.

Files are rows ``(path, content BINARY)`` with paths relative to the root.  A
path is tested before its content is touched, literals before patterns, and
the first matching line per file and indicator is the finding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import verdict
from ..functions.literals import needed_literals
from ..sources.indicators import CATALOGUE, Indicator

# The bounds of a scan.
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES, MAX_DEPTH, MAX_FINDINGS = 40_000, 512 * 1024, 64 * 1024 * 1024, 32, 500
SKIPPED = frozenset({".git/objects", ".git/lfs"})
SEVERITIES = ("high", "medium", "low")


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ``**/`` any folders, ``**`` anything,
    ``*`` and ``?`` within a name; case doesn't matter.
    """
    signs = {"**/": r"(?:[\s\S]*/)?", "**": r"[\s\S]*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", pattern)
    return "(?i)^" + "".join(signs.get(p, re.escape(p)) for p in parts) + "$"


def path_matches(path: Column, patterns: Iterable[str]) -> Column:
    tests = [path.rlike(glob_regex(p)) for p in patterns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def owning_package(path: Column) -> Column:
    """The package that a path under ``node_modules`` belongs to, or null."""
    tail = F.regexp_extract(path, r"^(?:.*/)?node_modules/(.+)$", 1)
    name = F.regexp_extract(tail, r"^(@[^/]+/[^/]+|[^@./][^/]*)(?:/|$)", 1)
    return F.when(name != "", name)


def read_tree(spark: SparkSession, root: str, consent: bool, indicators: tuple[Indicator, ...] = CATALOGUE) -> tuple[DataFrame, dict[str, object]]:
    """Files of a local tree for which the user gave consent, and what the
    walk left out.  The root must be an absolute folder, neither the file
    system's root nor a home; links out of the root are not followed.  Only
    files whose path some indicator asks for are opened, in tasks, which must
    see the folder too; the driver only lists names, and the bounds above keep
    that small.  (Spark's own file sources skip hidden files, which are what a
    scan looks for.)
    """
    if not consent:
        raise PermissionError("a scan needs consent")
    real = os.path.realpath(root)
    if not os.path.isabs(root) or real == os.path.sep or real == os.path.realpath(os.path.expanduser("~")) or not os.path.isdir(real):
        raise ValueError("the root must be an absolute folder within the file system, and no home")
    gate = re.compile("|".join(f"(?:{glob_regex(p)[4:]})" for i in indicators for p in i.paths), re.IGNORECASE)
    rows: list[tuple[str, str]] = []
    seen: dict[str, object] = {"outside": 0, "unreadable": 0, "truncated": None, "files": 0, "bytes": 0}
    for folder, folders, names in os.walk(real):
        rel = os.path.relpath(folder, real)
        if (0 if rel == "." else rel.count(os.sep) + 1) > MAX_DEPTH:
            seen["truncated"] = "depth_cap"
            folders[:] = []
            continue
        folders[:] = sorted(d for d in folders if os.path.normpath(os.path.join(rel, d)) not in SKIPPED)
        for n in sorted(names):
            full = os.path.join(folder, n)
            path = os.path.relpath(full, real)
            if os.path.commonpath((os.path.realpath(full), real)) != real:
                seen["outside"] += 1
            elif seen["files"] >= MAX_FILES:
                seen["truncated"] = "file_cap"
            elif seen["bytes"] >= MAX_TOTAL_BYTES:
                seen["truncated"] = "byte_cap"
            else:
                seen["files"] += 1
                if not gate.search(path):
                    continue
                try:
                    seen["bytes"] += min(os.path.getsize(full), MAX_FILE_BYTES)
                except OSError:
                    seen["unreadable"] += 1
                    continue
                rows.append((path, full))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [_head(full) for full in pdf["full"]]})

    listed = spark.createDataFrame(rows, "path string, full string").repartition(max(1, len(rows) // 64))
    read = listed.mapInPandas(opened, "path string, content binary").persist()
    seen["unreadable"] += read.where("content IS NULL").count()
    return read.where("content IS NOT NULL"), seen


def _head(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read(MAX_FILE_BYTES)
    except OSError:
        return None


def _first_line(lines: Column, patterns: tuple[str, ...]) -> Column:
    hits = F.transform(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in patterns)))
    return F.nullif(F.array_position(hits, True).cast("int"), F.lit(0))


def literal_index(indicators: tuple[Indicator, ...]) -> tuple[ahocorasick.Automaton, int]:
    """All literals of all patterns in one automaton, each with a bit for every
    indicator whose patterns may need it; and the bits of those that need none.
    """
    bits: dict[str, int] = {}
    always = 0
    for k, i in enumerate(indicators):
        needs = [needed_literals(p) for p in i.patterns]
        if not all(needs):
            always |= 1 << k
        for literal in frozenset().union(*needs):
            bits[literal] = bits.get(literal, 0) | 1 << k
    automaton = ahocorasick.Automaton()
    for literal, mask in bits.items():
        automaton.add_word(literal, mask)
    automaton.make_automaton()
    return automaton, always


LINE_END = ("\n", "\r", "\u0085", "\u2028", "\u2029")


def path_index(indicators: tuple[Indicator, ...]) -> tuple[dict[bytes, list[tuple[bytes, int]]], re.Pattern[str] | None, list[tuple[re.Pattern[str], int]]]:
    """All globs of all indicators, each once with a bit for every indicator
    that has it: those without a wildcard behind ``**/`` by their last name, the
    others as patterns, and one pattern for any of these.
    """
    bits: dict[str, int] = {}
    for k, i in enumerate(indicators):
        for p in i.paths:
            bits[p] = bits.get(p, 0) | 1 << k
    tails: dict[bytes, list[tuple[bytes, int]]] = {}
    rest: list[tuple[str, int]] = []
    for p, mask in bits.items():
        if p.startswith("**/") and not re.search(r"[*?]", p[3:]):
            tail = b"/" + p[3:].encode().lower()
            tails.setdefault(tail.rpartition(b"/")[2], []).append((tail, mask))
        else:
            rest.append((glob_regex(p)[4:], mask))  # without the flag in front
    end = rf"(?:(?:\r\n|[{''.join(LINE_END)}])?\Z)"  # what $ means to the JVM
    made = [(re.compile(r[:-1] + end, re.IGNORECASE | re.ASCII), mask) for r, mask in rest]
    whole = re.compile("|".join(f"(?:{m.pattern})" for m, _ in made), re.IGNORECASE | re.ASCII) if made else None
    return tails, whole, made


def path_gates(path: str, index: tuple) -> int:
    """As bits, the indicators that ask for a path."""
    tails, whole, made = index
    mask = 0
    ways = [path]
    if path.endswith(LINE_END):
        ways += [path[:-1], path.removesuffix("\r\n")]
    for way in ways:
        low = b"/" + way.encode("utf-8", "surrogatepass").lower()
        for tail, bits in tails.get(low.rpartition(b"/")[2], ()):
            if low.endswith(tail):
                mask |= bits
    if whole is not None and whole.match(path):
        for pattern, bits in made:
            if pattern.match(path):
                mask |= bits
    return mask


def candidates(files: DataFrame, indicators: tuple[Indicator, ...] = CATALOGUE) -> DataFrame:
    """``(path, content, is_text, gates, may)``: files that some indicator's
    path asks for, which ones those are by number, and as bits which of them
    the text can match by the literals that it holds.
    """
    if len(indicators) > 62:
        raise ValueError("at most 62 indicators are scanned for at once")
    spark = files.sparkSession
    paths, index = spark.sparkContext.broadcast(path_index(indicators)), spark.sparkContext.broadcast(literal_index(indicators))  # of the catalogue's size

    @pandas_udf("long")
    def asked(path: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None else path_gates(x, paths.value) for x in path], dtype="int64")

    @pandas_udf("long")
    def may(content: pd.Series) -> pd.Series:
        automaton, always = index.value
        out = []
        for c in content:
            mask = always
            if c and len(automaton):
                for _, bits in automaton.iter(bytes(c).decode("utf-8", "replace").lower()):
                    mask |= bits
            out.append(mask)
        return pd.Series(out, dtype="int64")

    # called non-deterministic, so that a filter on it doesn't ask it twice
    rows = files.select("path", "content", asked.asNondeterministic()("path").alias("_asked")).where("_asked <> 0")
    head = F.substring("content", 1, MAX_FILE_BYTES)
    rows = rows.withColumns({"content": head, "is_text": F.coalesce(F.instr(F.decode(head, "ISO-8859-1"), "\0") == 0, F.lit(False))})
    gates = F.expr(f"filter(sequence(0, {len(indicators) - 1}), k -> (shiftright(_asked, k) & 1L) = 1L)")
    # binary files are looked for literals in vain
    text = F.when(F.col("is_text"), F.col("content")).otherwise(F.lit(b""))
    return rows.select("path", "content", "is_text", gates.alias("gates"), may.asNondeterministic()(text).alias("may"))


def scan_files(files: DataFrame, indicators: tuple[Indicator, ...] = CATALOGUE) -> DataFrame:
    """``(indicator_id, severity, path, line_number, title, package_name)``.

    Of a file the first MAX_FILE_BYTES are read; one with a NUL byte there is
    no text and only its path counts.  ``line_number`` is null for a path.
    Patterns are tried on files whose path asks for them and that hold one of
    their literals.
    """
    bare = sum(1 << k for k, i in enumerate(indicators) if not i.patterns)
    rows = candidates(files, indicators).withColumn("may", F.col("may").bitwiseOR(F.lit(bare).cast("long")))
    tried = F.filter("gates", lambda k: F.call_function("shiftright", F.col("may"), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    lines = F.when(F.col("is_text"), F.split(F.decode("content", "UTF-8"), r"\r?\n")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("path", lines.alias("_lines"), F.explode(tried).alias("_k"))
    line = F.coalesce(*[F.when(F.col("_k") == k, _first_line(F.col("_lines"), i.patterns)) for k, i in enumerate(indicators) if i.patterns], F.lit(None).cast("int"))
    rows = rows.select("path", "_k", line.alias("line_number")).where(F.col("line_number").isNotNull() | F.col("_k").isin([k for k, i in enumerate(indicators) if not i.patterns]))
    said = F.array(*[F.struct(F.lit(i.id).alias("id"), F.lit(i.severity).alias("severity"), F.lit(i.title).alias("title")) for i in indicators])
    rows = rows.withColumn("f", F.get(said, F.col("_k")))
    return rows.select(F.col("f.id").alias("indicator_id"), "f.severity", "path", "line_number", "f.title", owning_package(F.col("path")).alias("package_name"))


def scan_lines(texts: DataFrame, patterns: dict[str, str], text_col: str = "text") -> DataFrame:
    """The first matching line (from 1) of each named pattern in each row."""
    # most texts hold no match, and one look at a text is cheaper than at all its lines
    line = lambda p: F.when(F.col(text_col).rlike(f"(?m){p}"), _first_line(F.col("_lines"), (p,)))
    found = F.array(*[F.struct(F.lit(k).alias("pattern"), line(p).alias("line_number")) for k, p in patterns.items()])
    rest = [c for c in texts.columns if c != text_col]
    texts = texts.withColumn("_lines", F.split(text_col, r"\r?\n"))
    return texts.select(*rest, F.explode(found).alias("f")).where("f.line_number IS NOT NULL").select(*rest, "f.pattern", "f.line_number")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def display_order() -> list[Column]:
    return [severity_rank(F.col("severity")), F.col("path"), F.col("indicator_id"), F.coalesce("line_number", F.lit(0))]


def capped_findings(found: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """The first findings in display order, one per path and indicator."""
    return found.dropDuplicates(["path", "indicator_id"]).orderBy(*display_order()).limit(most)


def scan_answer(found: DataFrame, seen: dict[str, object]) -> DataFrame:
    """One row: counts by severity, a verdict and the limits of the walk."""
    cut_short = seen.get("truncated")
    lost = int(seen.get("outside", 0)) + int(seen.get("unreadable", 0))
    own = verdict.limits(
        (F.lit(cut_short is not None), verdict.limit("budget_rejected", operation=cut_short or "")),
        (F.lit(lost > 0), verdict.limit("scan_capped", examined=F.lit(0), total=lost)),
        (F.col("findings") > MAX_FINDINGS, verdict.limit("scan_capped", examined=MAX_FINDINGS, total=F.col("findings"))),
    )
    counts = found.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    decided = verdict.decide(F.col("findings") > 0, F.lit(verdict.CLOSED), F.lit(False), own, F.lit("the scanned folder"))
    return counts.withColumn("a", decided).select("findings", *SEVERITIES, "a.verdict", "a.rationale", "a.limits")
