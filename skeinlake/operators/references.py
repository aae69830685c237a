"""Edges from source text: imports, re-exports and cross-file calls of scripts; API surfaces.

Modules are resolved by path (relative specifiers, the usual extensions, index files) and names by
the imports that bring them in: an approximation of what a type checker would find.
"""

from __future__ import annotations

import os.path
import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.tables import apart, settled
from . import scanners as S

_NAMES = r"(?P<names>[^;'\"]*?)"
_IMPORT = re.compile(rf"^[ \t]*import\b\s*(?:type\s+)?(?:{_NAMES}\s*\bfrom\s*)?(?P<q>['\"])(?P<spec>[^'\"\n]+)(?P=q)", re.M)
_EXPORT = re.compile(r"^[ \t]*export\s+(?:type\s+)?(?:(?P<all>\*)(?:\s*as\s+(?P<space>[\w$]+))?|\{(?P<names>[^}]*)\})\s*(?:from\s*(?P<q>['\"])(?P<spec>[^'\"\n]+)(?P=q))?", re.M)
_DEFAULT = re.compile(r"^[ \t]*export\s+default\s+(?:(?:abstract\s+)?class\s+|(?:async\s+)?function\s*\*?\s*)?(?P<name>[A-Za-z_$][\w$]*)", re.M)
_SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
_ROWS = "source_id string, targets array<string>, name string, edge_type string, passed_on string"
#: What a name may stand for.
_NAMED = ("function", "class", "interface", "type", "enum", "namespace")


def _candidates(path: str, spec: str) -> list[str]:
    if not spec.startswith("."):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
    if base.startswith("../"):
        return []
    stem = os.path.splitext(base)[0] if base.endswith((".js", ".jsx", ".mjs", ".cjs")) else base
    tries = [base, *(stem + e for e in _SCRIPT), *(f"{base}/index{e}" for e in _SCRIPT)]
    return list(dict.fromkeys(t for t in tries if t.endswith(_SCRIPT)))


def _bindings(names: str) -> dict[str, str]:
    """Local name -> exported name of an import or export clause."""
    out = {}
    inner = re.search(r"\{([^}]*)\}", names)
    for part in (inner[1] if inner else "").split(","):
        m = re.fullmatch(r"\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*", part)
        if m:
            out[m[2] or m[1]] = m[1]
    head = re.sub(r"\{[^}]*\}", "", names)
    if m := re.search(r"\*\s*as\s+([\w$]+)", head):
        out[m[1]] = "*"
    if m := re.match(r"\s*([\w$]+)", head):
        out[m[1]] = "default"
    return out


def file_references(path: str, text: str) -> list[tuple[str, tuple[str, ...], str, str, str | None]]:
    """(source id, possible target paths, the first that exists is meant; name, edge type, the name under
    which others get it here) of a script. name empty: the module itself; `*`: whatever it exports. The
    edge type ALIAS makes no edge but passes a name on: `export { a as b }` of what was imported or
    stands here, and the default export."""
    if not path.lower().endswith(_SCRIPT):
        return []
    module, out, known = f"{path}::module::default", [], {}
    # specifiers are strings, so these stay; what looks like code in other strings starts no line
    clean = S.silent_script(text, strings=True)
    for m in _IMPORT.finditer(clean):
        targets = _candidates(path, m["spec"])
        out.append((module, targets, "", "IMPORTS", None))
        for local, name in _bindings(m["names"] or "").items():
            known[local] = (targets, name)
    for m in _EXPORT.finditer(clean):
        if m["spec"] is None:
            for shown, local in _bindings("{" + (m["names"] or "") + "}").items():
                targets, name = known.get(local, ([path], local))
                if name != "*" and (targets != [path] or shown != name):
                    out.append((module, targets, name, "ALIAS", shown))
            continue
        targets = _candidates(path, m["spec"])
        if m["all"]:
            out.append((module, targets, "", "RE_EXPORTS", None if m["space"] else "*"))
        else:
            out += [(module, targets, name, "RE_EXPORTS", shown) for shown, name in _bindings("{" + m["names"] + "}").items()]
    if m := _DEFAULT.search(clean):
        targets, name = known.get(m["name"], ([path], m["name"]))
        if name != "*":
            out.append((module, targets, name, "ALIAS", "default"))
    pieces = [p for p in S.script(text) if p.kind in ("function", "method")]
    quiet = S.silent(text, "script")
    for m in re.finditer(r"(?<![\w$.])(new\s+)?([A-Za-z_$][\w$]*)(?:\s*\.\s*([A-Za-z_$][\w$]*))?\s*(?:<[^<>()]*>)?\(", quiet):
        if m[1] or m[2] not in known:
            continue
        targets, name = known[m[2]]
        called = (m[3] or "") if name == "*" else name
        if not called:
            continue
        inner = [p for p in pieces if p.start <= m.start() < p.end]
        source = f"{path}::{max(inner, key=lambda p: p.start).name}" if inner else module
        out.append((source, targets, called, "CALLS", None))
    return list(dict.fromkeys((a, tuple(t), n, e, x) for a, t, n, e, x in out if t))


def references(files: DataFrame) -> DataFrame:
    """file_path, source_id, targets, name, edge_type, passed_on: what the scripts in files (file_path,
    content) refer to, resolved or not. Narrow. Files without text or of other languages give none."""

    def rows(batches):
        for pdf in batches:
            found = [(p, a, list(t), n, e, x) for p, text in zip(pdf["file_path"], pdf["content"]) for a, t, n, e, x in file_references(p, text or "")]
            yield pd.DataFrame(found, columns=["file_path", "source_id", "targets", "name", "edge_type", "passed_on"])

    return files.select("file_path", "content").mapInPandas(rows, "file_path string, " + _ROWS)


def resolve(found: DataFrame, passing: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, target_id, edge_type of references to chunks (id, file_path, chunk_type) that exist.

    The first possible path that is a module is meant. Imports and whole re-exports go to the module.
    A name goes to the chunk of that name in its file, or else to what the file passes on under that
    name (passing: references with passed_on), and so on, step by step, to its definition; no place
    is looked at twice, so circles end. A name that is nowhere gives no edge."""
    modules = chunks.where("chunk_type = 'module'").select(F.col("file_path").alias("target_path")).distinct()
    modules = apart(modules)

    def meant(rows: DataFrame) -> DataFrame:
        tries = rows.select("targets").distinct().select("targets", F.posexplode("targets").alias("place", "target_path"))
        first = tries.join(modules, "target_path").groupBy("targets").agg(F.min_by("target_path", "place").alias("target_path"))
        return rows.join(apart(first), "targets").drop("targets")

    key = ["source_id", "edge_type", "target_path", "name"]
    rows = settled(meant(found.where("edge_type <> 'ALIAS'").select("source_id", "targets", "name", "edge_type").distinct()))
    out = rows.where("name = ''").select("source_id", F.concat("target_path", F.lit("::module::default")).alias("target_id"), "edge_type")
    named = chunks.where(F.col("chunk_type").isin(*_NAMED)).select(F.col("file_path").alias("target_path"), F.regexp_extract("id", r"::([^:]+)$", 1).alias("name"), F.col("id").alias("target_id"))
    named = apart(named)
    on = passing.where("passed_on is not null").select(F.col("file_path").alias("at"), "passed_on", "targets", F.col("name").alias("next")).distinct()
    on = apart(settled(meant(on).withColumnRenamed("target_path", "to")))
    waiting = seen = rows.where("name <> ''").select(*key)
    while True:
        hits = settled(waiting.join(named, ["target_path", "name"]).select(*key, "target_id"))
        out = out.union(hits.select("source_id", "target_id", "edge_type"))
        left = waiting.join(apart(hits.select(*key).distinct()), key, "left_anti")
        fits = (F.col("target_path") == F.col("at")) & ((F.col("passed_on") == F.col("name")) | ((F.col("passed_on") == "*") & (F.col("name") != "default")))
        step = left.join(on, fits).select("source_id", "edge_type", F.col("to").alias("target_path"), F.when(F.col("passed_on") == "*", F.col("name")).otherwise(F.col("next")).alias("name"))
        n = Observation()
        waiting = settled(step.distinct().join(apart(seen), key, "left_anti").observe(n, F.count("*").alias("n")))
        if not n.get["n"]:
            break
        seen = seen.union(waiting)
    return out.where("source_id <> target_id").distinct()


def extract_edges(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, target_id, edge_type of the scripts in files (file_path, content) to chunks that exist,
    the files taken for all there are: a narrow pass over them, then joins (see resolve). Repeated files
    give the same edges once."""
    found, held = settled(references(files)), settled(chunks.select("id", "file_path", "chunk_type"))
    return resolve(found, found, held)


_SURFACE = {
    "py": (re.compile(r"^[ \t]*(?:async\s+)?(?:def|class)\s+\w+[^\n]*?(?:\((?:[^()]|\([^()]*\))*\))?[^:\n]*:", re.M), "hash"),
    "go": (re.compile(r"^(?:func\b[^\n{]*|type\s+\w+[^\n{]*(?:struct|interface))(?=\s*\{)", re.M), "go"),
    "rs": (re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|impl|mod)\b[^\n{;]*(?:\([^{;]*\)[^{;]*)?(?=\s*\{)", re.M), "rust"),
    "java": (re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:(?:class|interface|enum|record)\s+\w+[^{;]*|[\w<>\[\],.?]+\s+\w+\s*\([^)]*\)[^{;]*)(?=\s*\{)", re.M), "c"),
    "php": (re.compile(r"(?:(?:abstract|final|public|private|protected|static)\s+)*(?:class|interface|trait|enum|function)\s+\w+[^{;]*(?=\s*\{)", re.M), "php"),
}


def file_surface(path: str, text: str) -> tuple[str, str]:
    """(surface, strategy) of one file: the heads of its declarations."""
    extension = os.path.splitext(path)[1].lower().removeprefix(".")
    if f".{extension}" in _SCRIPT:
        out = []
        for p in S.script(text):
            body = text[p.start : p.end]
            if p.kind == "method":
                continue
            if not body.startswith("export"):
                continue
            cut = S.silent(body, "script").find("{")
            keep_whole = p.kind in ("interface", "type", "enum")
            out.append(body.strip() if keep_whole or cut < 0 else body[:cut].rstrip() + " { ... }")
        return "\n\n".join(out), "declarations"
    if extension not in _SURFACE:
        return "", "unsupported"
    pattern, style = _SURFACE[extension]
    quiet = S.silent(text, style) if style != "hash" else text
    heads = [text[m.start() : m.end()].strip() for m in pattern.finditer(quiet)]
    return "\n\n".join(f"{h.rstrip(':') if extension == 'py' else h} {{ ... }}" for h in heads if h), "signatures"


def api_surface(files: DataFrame) -> DataFrame:
    """path, surface, strategy for every row of files (file_path, content)."""

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *file_surface(p, t or "")) for p, t in zip(pdf["file_path"], pdf["content"])], columns=["path", "surface", "strategy"])

    return files.select("file_path", "content").mapInPandas(rows, "path string, surface string, strategy string")
