"""Ignore rules and globs."""

import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.patterns import glob_regex
from corpuslens.operators.scope import ignored


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("src/**/*.ts", "src/x.ts", True),
        ("src/**/*.ts", "src/a/b/x.ts", True),
        ("src/**/*.ts", "lib/x.ts", False),
        ("**/*.ts", "x.ts", True),
        ("*.service.ts", "src/x.service.ts", True),
        ("auth/", "src/auth/a.ts", True),
        ("auth/*", "src/auth2/a.ts", False),
        ("auth", "src/auth/deep/a.ts", True),
        ("auth", "src/author.ts", False),
        ("src/foo.ts", "src/foo.ts", True),
    ],
)
def test_globs(glob, path, hit):
    assert bool(re.search(glob_regex(glob), path)) is hit


def test_ignore_rules(spark):
    rules = ["dist", "*.log", "!keep.log", "/only.ts", "docs/**/x.md", "build/"]
    want = {
        "dist/a.ts": True,
        "src/dist/a.ts": True,
        "a.log": True,
        "keep.log": False,
        "dist/keep.log": True,
        "only.ts": True,
        "src/only.ts": False,
        "docs/a/b/x.md": True,
        "docs/x.md": True,
        "build/a.ts": True,
        "src/build": False,
    }
    df = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r["path"]: r["i"] for r in df.select("path", ignored(F.col("path"), rules).alias("i")).collect()}
    assert got == want
