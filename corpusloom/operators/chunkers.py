"""Chunks of Markdown, reStructuredText, Rust, C, Go and Python files.

Files are gated by native patterns first; only what passes reaches the parsers, which need match offsets and so run on
Arrow batches. The table PARSERS is a parameter of `chunked`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import signals
from corpusloom.operators.dedup import first_per_key

# Sizes in characters, and the patterns that find sections, snippets and declarations.
LEAST_BODY, LEAST_CODE, MOST_SECTION = 80, 30, 4000
#: Files that a task makes Python objects of at once, and characters of chunks that it sends on at once.
RUN_FILES, RUN_CHARS = 64, 1_000_000
BRACE_REACH, BRACE_REST, MOST_RAW, MOST_PYTHON = 2000, 600, 1200, 3000
FENCE = re.compile(r"```(\w*)\n(.*?)```", re.DOTALL)
HEADING = re.compile(r"^(#{1,4})\s+(.+)$", re.MULTILINE)
RST_HEADING = re.compile(r"^(.+)\n[=\-~^\"#*+]{3,}\s*$", re.MULTILINE)
RST_CODE = re.compile(r"\.\.\s+code-block::\s*(\w*)\n\n((?:[ \t]+[^\n]*\n|\n)+)")
RST_LITERAL = re.compile(r"::\s*\n\n((?:[ \t]+[^\n]*\n|\n)+)")
RST_INDENT = re.compile(r"^[ \t]{3,}", re.MULTILINE)
RUST_FUNCTION = re.compile(r"((?:///[^\n]*\n)+)[ \t]*(?:#\[.*?\]\n)*[ \t]*(pub(?:\([^)]*\))?\s+)?((?:async\s+)?fn\s+\w+[^{]*\{)", re.DOTALL)
RUST_ITEM = re.compile(r"((?:///[^\n]*\n)+)[ \t]*(pub(?:\([^)]*\))?\s+)?((?:struct|enum|impl|trait)\s+\w+[^{]*\{)", re.DOTALL)
RUST_BARE = re.compile(r"^[ \t]*(pub(?:\([^)]*\))?\s+)?fn\s+(\w+)\s*\(", re.MULTILINE)
C_DOCUMENTED = re.compile(r"/\*\*(.*?)\*/\s*((?:static\s+|inline\s+|__always_inline\s+)*\w[\w\s\*]+\w\s*\([^)]*\)\s*\{)", re.DOTALL)
C_BARE = re.compile(r"^(?:static\s+|inline\s+|__always_inline\s+)?(?:int|void|__u32|__u64|bool|struct\s+\w+\s*\*?)\s+(\w+)\s*\([^)]{0,200}\)\s*\{", re.MULTILINE)
GO_DOCUMENTED = re.compile(r"((?://[^\n]*\n)+)[ \t]*(func\s+(?:\([^)]*\)\s*)?\w+\s*\([^{]*)\{", re.DOTALL)
NAME, NAME_OR_TYPE = re.compile(r"\b(\w+)\s*\("), re.compile(r"\b(\w+)\s*[({<]")
_BRACE = re.compile("[{}]")


@dataclass(frozen=True)
class Chunk:
    """What a parser finds; key is hashed into the id."""

    key: str
    source: str
    lang: str
    kind: str
    title: str
    body: str
    code: tuple[str, ...]


def snippets(text: str) -> list[str]:
    """Fenced code of LEAST_CODE characters or more."""
    return [c for c in (m[2].strip() for m in FENCE.finditer(text)) if len(c) >= LEAST_CODE]


def parts(text: str, most: int = MOST_SECTION, separator: str = "\n\n") -> list[str]:
    """Paragraphs packed in order into parts of about `most` characters, separators not counted; a longer paragraph stays whole."""
    if len(text) <= most:
        return [text]
    out: list[list[str]] = []
    size = 0
    for p in text.split(separator):
        if not out or size + len(p) > most and out[-1]:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p)
    return [separator.join(x) for x in out]


def parts_column(text: Column, most: int = MOST_SECTION, separator: str = "\n\n") -> Column:
    """The same as a native fold: an array of parts."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(state: Column, p: Column) -> Column:
        full = (state["size"] + F.length(p) > most) & (F.size(state["open"]) > 0)
        return F.struct(
            F.when(full, F.array_append(state["done"], F.array_join(state["open"], separator))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.array_append(state["open"], p)).alias("open"),
            F.when(full, F.length(p)).otherwise(state["size"] + F.length(p)).alias("size"),
        )

    ended = F.aggregate(F.split(text, re.escape(separator)), start, step, lambda s: F.array_append(s["done"], F.array_join(s["open"], separator)))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(ended)


def balanced(text: str, start: int) -> str:
    """From start to the brace that closes the first one, looked for in BRACE_REACH characters; else BRACE_REST characters.

    A start of -1 (no brace was found) counts from the text's end, as Python's slices do.
    """
    stop, depth = min(start + BRACE_REACH, len(text)), 0
    places = (m.start() for m in _BRACE.finditer(text, start, stop)) if start >= 0 else (i for i in range(start, stop) if text[i] in "{}")
    for i in places:
        depth += 1 if text[i] == "{" else -1
        if not depth and text[i] == "}":
            return text[start : i + 1]
    return text[start : start + BRACE_REST]


def _sections(text: str, heading: re.Pattern, title: int) -> Iterator[tuple[str, str]]:
    """(title, text up to the next heading) for each heading; what stands before the first is dropped."""
    found = list(heading.finditer(text))
    for m, after in zip(found, [*found[1:], None]):
        yield m[title].strip(), text[m.end() : after.start() if after else len(text)].strip()


def _titled(stem: str) -> str:
    return stem.replace("-", " ").replace("_", " ").title()


def _parted(source: str, key: str, title: str, body: str, code: list[str], most_code: int) -> Iterator[Chunk]:
    for i, part in enumerate(parts(body)):
        yield Chunk(f"{key}_{i}", source, "text", "tutorial_section", title, part, tuple(code[:most_code]))


def markdown(text: str, stem: str) -> Iterator[Chunk]:
    sections = list(_sections(text, HEADING, 2))
    for title, section in sections or [(None, text)]:
        code, body = snippets(section), FENCE.sub("", section).strip()
        if len(body) >= LEAST_BODY or code:
            yield from _parted("markdown", "full" if title is None else title, _titled(stem) if title is None else title, body, code, 3 if title is None else 4)


def _unindented(found: Iterator[re.Match], group: int) -> list[str]:
    return [c for c in (RST_INDENT.sub("", m[group]).strip() for m in found) if len(c) >= LEAST_CODE]


def rst(text: str, stem: str) -> Iterator[Chunk]:
    plain = lambda s: RST_CODE.sub("", RST_LITERAL.sub("", s)).strip()
    sections = list(_sections(text, RST_HEADING, 1))
    if not sections:
        body = plain(text)
        if len(body) >= LEAST_BODY:
            code = _unindented(RST_CODE.finditer(text), 2) + _unindented(RST_LITERAL.finditer(text), 1)
            yield from _parted("kernel_docs", "full", _titled(stem), body, code, 3)
    for title, section in sections:
        code, body = _unindented(RST_CODE.finditer(section), 2), plain(section)
        if len(body) >= LEAST_BODY or code:
            yield from _parted("kernel_docs", title, title, body, code, 4)


class _Code:
    """Chunks of one code file; a name is taken once."""

    def __init__(self, lang: str):
        self.lang, self.seen = lang, set()

    def chunk(self, kind: str, name: str, body: str, code: str, most: int | None = None) -> Iterator[Chunk]:
        if len(code) >= LEAST_CODE and name not in self.seen:
            self.seen.add(name)
            yield Chunk(name, "source", self.lang, kind, name, body, (code[:most],))

    def documented(self, text: str, pattern: re.Pattern, decl: int, name: re.Pattern, doc: Callable[[str], str], brace: str = "\n") -> Iterator[Chunk]:
        for m in pattern.finditer(text):
            head = m[decl].strip()
            found = name.search(head)
            yield from self.chunk("doc_code", found[1] if found else head[:40], doc(m[1]), (head + brace + balanced(text, m.end() - 1)).strip())

    def bare(self, text: str, pattern: re.Pattern, name: int, back: int) -> Iterator[Chunk]:
        for m in pattern.finditer(text):
            if m[name] not in self.seen:
                yield from self.chunk("raw_code", m[name], "", (m[0].strip() + "\n" + balanced(text, text.find("{", m.end() - back))).strip(), MOST_RAW)


def rust(text: str, stem: str) -> Iterator[Chunk]:
    own = _Code("rust")
    doc = lambda d: "\n".join(x.lstrip("/").lstrip() for x in d.splitlines()).strip()
    for pattern in (RUST_FUNCTION, RUST_ITEM):
        yield from own.documented(text, pattern, 3, NAME_OR_TYPE, doc)
    if not own.seen:
        yield from own.bare(text, RUST_BARE, 2, 0)


def c(text: str, stem: str) -> Iterator[Chunk]:
    own = _Code("c")
    yield from own.documented(text, C_DOCUMENTED, 2, NAME, lambda d: d.strip().replace("*", "").strip())
    yield from own.bare(text, C_BARE, 1, 1)


def go(text: str, stem: str) -> Iterator[Chunk]:
    doc = lambda d: "\n".join(x.lstrip("/").strip() for x in d.splitlines()).strip()
    yield from _Code("go").documented(text, GO_DOCUMENTED, 2, NAME, doc, " {\n")


def python(text: str, stem: str) -> Iterator[Chunk]:
    yield Chunk("", "source", "python", "raw_code", stem, "", (text[:MOST_PYTHON],))


def stem(path: str) -> str:
    """A file's name without its last suffix."""
    name = path.rsplit("/", 1)[-1]
    return name.rpartition(".")[0] or name


PARSERS = {"md": markdown, "rst": rst, "rs": rust, "c": c, "h": c, "go": go, "py": python}


def routed(files: DataFrame, gates: dict[str, str] = signals.QUICK_GATES) -> DataFrame:
    """Files whose suffix has a parser, is wanted by the repository, and whose text passes the suffix's gate."""
    wanted = F.when(F.col("suffix") == "md", F.col("include_md")).when(F.col("suffix") == "rst", True).otherwise(F.array_contains("langs", F.col("suffix")))
    passes = F.lit(False)
    for suffix, gate in gates.items():
        passes = F.when(F.col("suffix") == suffix, F.col("text").rlike(gate)).otherwise(passes)
    return files.where(wanted & passes)


def chunked(files: DataFrame, parsers: dict[str, Callable[[str, str], Iterator[Chunk]]] = PARSERS, gates: dict[str, str] = signals.QUICK_GATES) -> DataFrame:
    """Chunks of files (repo, path, file, suffix, text, langs, include_md), the first of each id within its file."""
    fields = [f.split()[0] for f in schemas.CHUNK.split(", ")]
    kinds = [pa.list_(pa.string()) if f == "code" else pa.string() for f in fields] + [pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*fields, "path", "place"])
        rows, size = [], 0
        for r in (one for b in batches for i in range(0, b.num_rows, RUN_FILES) for one in b.slice(i, RUN_FILES).to_pylist()):
            for i, x in enumerate(parsers[r["suffix"]](r["text"], stem(r["path"]))):
                ident = hashlib.sha1(f"{r['repo']}:{r['path']}:{x.key}".encode("utf-8", "surrogatepass")).hexdigest()[:12]
                rows.append((ident, x.source, r["repo"], r["file"], x.lang, x.kind, x.title, x.body, list(x.code), r["path"], i))
                size += len(x.body) + sum(map(len, x.code))
                if size >= RUN_CHARS:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    found = routed(files, gates).select("repo", "path", "file", "suffix", "text").mapInArrow(run, f"{schemas.CHUNK}, path string, place long")
    seq = found.withColumn("seq", F.struct("path", "place"))
    return first_per_key(seq, "id", "seq").select(*fields)


def summary(chunks: DataFrame) -> DataFrame:
    """repo, kind, n, and the repository's total."""
    by_kind = chunks.groupBy("repo", "kind").agg(F.count("*").alias("n"))
    return by_kind.join(by_kind.groupBy("repo").agg(F.sum("n").alias("repo_total")), "repo")
