"""Chunking: file text to typed, line-ranged, stably named chunks."""

from __future__ import annotations

import os.path
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import MAX_CHUNK_CHARS, NEW_CHUNK
from . import scanners as S

#: Lines of a window and lines that it shares with the next.
WINDOW, OVERLAP = 50, 10
#: Bytes of text that a Python worker has as objects at a time.
PIECE = 1 << 22
_SCRIPT = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript"}
_OTHER = {"php": "php", "phtml": "php", "sql": "sql", "css": "css", "scss": "scss", "xml": "xml", "yaml": "yaml", "yml": "yaml", "rb": "ruby", "cs": "csharp", "go": "go", "py": "python", "rs": "rust", "java": "java"}


def line_windows(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """file_path, start_line, end_line, content: windows of `size` lines that start every size -
    overlap, until the file's end is reached. Lines from 0. All in the JVM."""
    step = size - overlap
    lines = files.select("file_path", F.split("content", "\n", -1).alias("l"))
    last = F.greatest(F.lit(0), F.ceil((F.size("l") - size) / F.lit(float(step))).cast("int")) * step
    starts = lines.select("file_path", "l", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start_line"))
    return starts.select(
        "file_path", "start_line", (F.least(F.col("start_line") + size, F.size("l")) - 1).alias("end_line"), F.array_join(F.slice("l", F.col("start_line") + 1, F.lit(size)), "\n").alias("content")
    )


def module_chunks(files: DataFrame) -> DataFrame:
    return files.select(
        F.concat("file_path", F.lit("::module::default")).alias("id"), "file_path", F.lit("module").alias("chunk_type"), "content",
        F.lit(0).alias("start_line"), (F.size(F.split("content", "\n", -1)) - 1).alias("end_line"), X.language_of(F.col("file_path")).alias("language"),
    )


def markdown_sections(files: DataFrame) -> DataFrame:
    """A doc chunk from each heading to the line before the next; text before the first heading is
    left out; a file without headings is one chunk. One pass over the lines of a row, no shuffle."""
    heading = r"^#{1,6}\s+"
    rows = files.select("file_path", "content", F.split("content", "\n", -1).alias("l"))
    at = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(heading), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at)
    spans = F.zip_with("at", F.concat(F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), F.array(F.size("l"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("a"), F.size("l").alias("b")))
    cut = rows.withColumn("s", F.explode(F.when(F.size("at") > 0, spans).otherwise(whole)))
    start = F.coalesce(F.col("s.a"), F.lit(0))
    text = F.regexp_replace(F.get("l", F.col("s.a")), heading, "")
    name = F.when(F.col("s.a").isNull(), F.lit("default")).otherwise(F.concat(X.slug(text), F.lit("#L"), F.col("s.a").cast("string")))
    body = F.when(F.col("s.a").isNull(), F.col("content")).otherwise(F.array_join(F.slice("l", start + 1, F.col("s.b") - start), "\n"))
    return cut.select(F.concat("file_path", F.lit("::doc::"), name).alias("id"), "file_path", F.lit("doc").alias("chunk_type"), body.alias("content"), start.alias("start_line"), (F.col("s.b") - 1).alias("end_line"), F.lit("markdown").alias("language"))


def split_text(text: str, most: int) -> list[str]:
    """Parts of at most `most` characters, cut after line ends; a longer line is cut hard. The parts
    joined are the text."""
    parts, held = [], ""
    for line in text.splitlines(keepends=True) if "\r" not in text and not re.search("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text) else re.findall(r"[^\n]*\n|[^\n]+", text):
        if held and len(held) + len(line) > most:
            parts.append(held)
            held = ""
        while len(line) > most:
            parts.append(line[:most])
            line = line[most:]
        held += line
    if held or not parts:
        parts.append(held)
    return parts


def _oversize(chunk: tuple, limits: dict[str, int], strategy: str) -> list[tuple]:
    id_, path, kind, content, start, end, language = chunk
    most = limits.get(kind)
    if most is None or len(content) <= most:
        return [chunk]
    if strategy == "truncate":
        cut = content[:most] + "\n...[TRUNCATED]"
        return [(id_, path, kind, cut, start, start + cut.count("\n"), language)]
    out, line = [], start
    for i, part in enumerate(split_text(content, most), 1):
        n = part.count("\n")
        out.append((f"{id_}#part{i}", path, kind, part, line, line + n - part.endswith("\n"), language))
        line += n
    return out


def split_oversize(chunks: DataFrame, limits: dict[str, int] | None = None, strategy: str = "split") -> DataFrame:
    """Chunks with those over their kind's limit split at line ends, ids `#part<n>`, or truncated."""
    limits = MAX_CHUNK_CHARS if limits is None else limits
    if not limits:
        return chunks
    columns = ["id", "file_path", "chunk_type", "content", "start_line", "end_line", "language"]

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame([y for x in pdf.itertuples(index=False, name=None) for y in _oversize(x, limits, strategy)], columns=columns)

    kinds = [k for k in limits]
    limit = F.element_at(F.create_map(*[F.lit(x) for k in kinds for x in (k, limits[k])]), F.when(F.col("chunk_type").isin(*kinds), F.col("chunk_type")).otherwise(kinds[0]))
    large = F.col("chunk_type").isin(*kinds) & (F.length("content") > limit)
    if strategy == "truncate":
        cut = F.concat(F.substring(F.col("content"), F.lit(1), limit), F.lit("\n...[TRUNCATED]"))
        lines = F.col("start_line") + F.length(cut) - F.length(F.replace(cut, F.lit("\n")))
        over = F.coalesce(large, F.lit(False))
        return chunks.select(*columns).withColumns({"content": F.when(over, cut).otherwise(F.col("content")), "end_line": F.when(over, lines).otherwise(F.col("end_line"))})
    # only what is over a limit goes through Python
    return chunks.select(*columns).where(~large).unionByName(chunks.select(*columns).where(large).mapInPandas(rows, NEW_CHUNK))


def disambiguate(chunks: DataFrame) -> DataFrame:
    """Of chunks with one id those after the first (by line, modules first) get `#L<start_line>`."""
    order = [F.col("start_line"), F.col("chunk_type") != "module", F.col("end_line"), F.col("content")]
    again = F.row_number().over(Window.partitionBy("id").orderBy(*order)) > 1
    return chunks.withColumn("_again", again).withColumn("id", F.when(F.col("_again"), F.concat("id", F.lit("#L"), F.col("start_line").cast("string"))).otherwise(F.col("id"))).drop("_again")


def in_order(chunks: DataFrame) -> DataFrame:
    """chunks with `place`: of each file by first line, its module before others, then by id; from 0."""
    order = [F.col("start_line"), F.col("chunk_type") != "module", F.col("id")]
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("file_path").orderBy(*order)) - 1)


def line_chunk_ids(windows: DataFrame, raw_hash: Column) -> DataFrame:
    """Ids of window chunks: path, lines and twelve digits of the file's hash."""
    digits = F.substring(F.substring_index(raw_hash, ":", -1), 1, 12)
    return windows.withColumn("id", F.concat_ws("::", "file_path", F.lit("chunk"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")), digits))


def file_chunks(path: str, text: str, limits: dict[str, int] | None = None, strategy: str = "split") -> list[tuple]:
    """All chunks of one file but Markdown's: its module first, then its declarations by line."""
    extension = os.path.splitext(path)[1].lower().removeprefix(".")
    language = _SCRIPT.get(extension) or _OTHER.get(extension, "text")
    if extension in _SCRIPT:
        found = S.script(text, extension != "ts")
    else:
        of = {"php": S.php, "java": S.java, "sql": S.sql, "yaml": S.yaml, "yml": S.yaml, "rb": S.ruby, "cs": S.c_sharp, "go": S.go}.get(extension)
        found = of(text) if of else S.styles(text, extension == "scss") if extension in ("css", "scss") else S.xml(text, path) if extension == "xml" else []
    lines = S.Lines(text)
    out = [(f"{path}::module::default", path, "module", text, 0, lines.of(len(text)), language)]
    out += [(f"{path}::{p.name}", path, p.kind, text[p.start : p.end], lines.of(p.start), lines.of(p.end), language) for p in found]
    out.sort(key=lambda c: (c[4], c[2] != "module", c[0]))
    seen: set[str] = set()
    named = []
    for c in out:
        named.append((f"{c[0]}#L{c[4]}", *c[1:]) if c[0] in seen else c)
        seen.add(c[0])
    return [y for c in named for y in _oversize(c, MAX_CHUNK_CHARS if limits is None else limits, strategy)]


def _pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch of file_path, content in slices of about `most` bytes of content, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def chunk_files(files: DataFrame, limits: dict[str, int] | None = None, strategy: str = "split", errors: bool = False) -> DataFrame:
    """Chunks of every row of files (file_path, content), by extension. Markdown is cut in the JVM;
    the rest file by file in Python, narrow and parallel over files. errors: a file that cannot be
    cut ends nothing but gives one row without id, what went wrong in the column `error`."""
    markdown = F.lower("file_path").rlike(r"\.mdx?$")
    columns = ["id", "file_path", "chunk_type", "content", "start_line", "end_line", "language"]

    def cut(path: str, text: str) -> list[tuple]:
        if not errors:
            return file_chunks(path, text, limits, strategy)
        try:
            return [(*c, None) for c in file_chunks(path, text, limits, strategy)]
        except Exception as e:  # noqa: BLE001  any error is the file's own
            return [(None, path, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    names = [*columns, *(["error"] if errors else [])]
    schema = pa.schema([(c, pa.int32() if c.endswith("_line") else pa.string()) for c in names])

    def rows(batches):
        for batch in batches:
            for piece in _pieces(batch):
                found = [c for path, text in zip(*(x.to_pylist() for x in piece.columns)) for c in cut(path, text)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, c)) for c in found], schema)

    files = files.select("file_path", F.coalesce("content", F.lit("")).alias("content"))
    docs = split_oversize(markdown_sections(files.where(markdown)), limits, strategy)
    if errors:
        docs = docs.withColumn("error", F.lit(None).cast("string"))
    return files.where(~markdown).mapInArrow(rows, NEW_CHUNK + (", error string" if errors else "")).unionByName(docs)
