"""Facts of source files: a crawl by ``binaryFile`` and rules for each language."""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("/.git/", "/node_modules/", "/build/", "/dist/", "/__pycache__/")
MAX_BYTES = 500_000
Fact = tuple[str, str, str]


def _python(module: str, text: str) -> Iterator[Fact]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield module, "defines_function", node.name
            for a in node.args.args:
                if a.arg not in ("self", "cls"):
                    yield node.name, "has_parameter", a.arg
        elif isinstance(node, ast.ClassDef):
            yield module, "defines_class", node.name
            for b in node.bases:
                yield node.name, "extends", ast.unparse(b)
        elif isinstance(node, ast.Import):
            for n in node.names:
                yield module, "imports", n.name
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield module, "imports_from", node.module
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            doc = ast.get_docstring(node)
            if doc:
                yield node.name, "described_as", doc.strip().splitlines()[0][:200]
            for d in node.decorator_list:
                yield node.name, "decorated_by", ast.unparse(d)


_C_RULES = (("includes", r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]'), ("defines_class", r"(?m)^[ \t]*(?:class|struct)[ \t]+(\w+)[^;{]*\{"), ("in_namespace", r"(?m)^[ \t]*namespace[ \t]+(\w+)"), ("defines_function", r"(?m)^[\w:<>*&~ \t]+?[ *&](\w+)[ \t]*\([^;{}]*\)[ \t]*(?:const[ \t]*)?\{"))
_LEVELS = ("has_title", "has_section", "has_subsection", "has_detail")


def _rules(rules: tuple[tuple[str, str], ...]):
    def run(module: str, text: str) -> Iterator[Fact]:
        for relation, pattern in rules:
            for m in re.finditer(pattern, text):
                if m[1] not in ("if", "for", "while", "switch", "return"):
                    yield module, relation, m[1]

    return run


def _markdown(module: str, text: str) -> Iterator[Fact]:
    for m in re.finditer(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t#]*$", text):
        yield module, _LEVELS[min(len(m[1]), 4) - 1], m[2]


_C, _SHELL = _rules(_C_RULES), _rules((("defines_function", r"(?m)^[ \t]*(?:function[ \t]+)?(\w+)[ \t]*\(\)[ \t]*\{"),))
PARSERS = {".py": _python, ".c": _C, ".h": _C, ".cc": _C, ".cpp": _C, ".hpp": _C, ".md": _markdown, ".sh": _SHELL}


def file_facts(path: str, content: bytes) -> Iterator[Fact]:
    name = os.path.basename(path)
    stem, ext = os.path.splitext(name)
    parent = os.path.basename(os.path.dirname(path))
    if parent:
        yield stem, "part_of", parent
    yield stem, "file_type", ext.lstrip(".")
    yield from PARSERS[ext](stem, content.decode("utf-8", "replace"))


def code_triples(spark: SparkSession, folder: str) -> DataFrame:
    """(path, subject, relation, object) of the files under a folder that have a parser and at most MAX_BYTES; build folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(PARSERS) + "}").load(folder)
    files = files.where(F.col("length") <= MAX_BYTES)
    for part in SKIPPED:
        files = files.where(~F.contains("path", F.lit(part)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *f) for p, c in zip(batch["path"], batch["content"]) for f in file_facts(p, c)]
            yield pd.DataFrame(rows, columns=["path", "subject", "relation", "object"])

    return files.select("path", "content").mapInPandas(run, "path string, subject string, relation string, object string")
