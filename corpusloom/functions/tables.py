"""Table functions for SQL: chunks of a file and prompts of a chunk, for LATERAL joins; their tables are arguments.

    SELECT f.path, c.* FROM files f, LATERAL file_chunks(f.suffix, f.text, f.path, map('hpp', 'c')) c
    SELECT c.id, p.* FROM chunks c, LATERAL chunk_prompts(c.kind, c.repo, c.lang, c.title, c.body, c.code) p

Constant arguments are checked when a query is analysed, so a wrong parser or template is an error before any task runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusloom.operators import chunkers, prompts

_TEXTS = T.ArrayType(T.StringType())
CHUNKS = T.StructType([T.StructField("place", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("key", "source", "lang", "kind", "title", "body")), T.StructField("code", _TEXTS)])
PROMPTS = T.StructType([T.StructField("prompt_no", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("instruction", "style", "context"))])


@dataclass
class _Prepared(AnalyzeResult):
    """A schema, and the table that a constant argument names."""

    given: list = field(default_factory=list)


def _text(name: str, argument: AnalyzeArgument, kind: type = T.StringType) -> None:
    if not isinstance(argument.dataType, (kind, T.NullType)):
        raise ValueError(f"{name} must be {kind.__name__}, not {argument.dataType.simpleString()}")


class FileChunks:
    """place, key, source, lang, kind, title, body, code of a file's chunks in order; none for a suffix without a parser or a null text.

    parsers: a constant map from suffix to the suffix whose parser reads it, beside the usual ones.
    """

    @staticmethod
    def analyze(suffix: AnalyzeArgument, text: AnalyzeArgument, path: AnalyzeArgument, parsers: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, argument in (("suffix", suffix), ("text", text), ("path", path)):
            _text(name, argument)
        given = dict(parsers.value or {}) if parsers is not None else {}
        if parsers is not None and not parsers.isConstantExpression:
            raise ValueError("parsers must be a constant map")
        if wrong := [x for x in given.values() if x not in chunkers.PARSERS]:
            raise ValueError(f"no parser for {', '.join(map(str, wrong))}")
        return _Prepared(CHUNKS, given=[given])

    def __init__(self, prepared: AnalyzeResult):
        self.parsers = chunkers.PARSERS | {k: chunkers.PARSERS[v] for k, v in prepared.given[0].items()}

    def eval(self, suffix: str, text: str, path: str, parsers: dict | None = None) -> Iterator[tuple]:
        if suffix not in self.parsers or text is None:
            return
        for i, x in enumerate(self.parsers[suffix](text, chunkers.stem(path or ""))):
            yield i, x.key, x.source, x.lang, x.kind, x.title, x.body, list(x.code)


class ChunkPrompts:
    """prompt_no, instruction, style, context of a chunk's prompts; none for a chunk with too little content.

    prompts: a constant JSON list of objects (kind, needs, style, instruction, context) in the place of the usual table.
    """

    @staticmethod
    def analyze(kind: AnalyzeArgument, repo: AnalyzeArgument, lang: AnalyzeArgument, title: AnalyzeArgument, body: AnalyzeArgument, code: AnalyzeArgument, table: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, argument in (("kind", kind), ("repo", repo), ("lang", lang), ("title", title), ("body", body)):
            _text(name, argument)
        _text("code", code, T.ArrayType)
        if table is not None and not table.isConstantExpression:
            raise ValueError("the table of prompts must be a constant")
        given = [prompts.Prompt(**x) for x in json.loads(table.value)] if table is not None and table.value else prompts.PROMPTS
        return _Prepared(PROMPTS, given=prompts.checked(given))

    def __init__(self, prepared: AnalyzeResult):
        self.prompts = prepared.given

    def eval(self, kind: str, repo: str, lang: str, title: str, body: str, code: list, table: str | None = None) -> Iterator[tuple]:
        body, code = body or "", code or []
        if len(body + " ".join(x for x in code if x is not None)) < prompts.LEAST_CONTENT:
            return
        of = prompts.FRAMEWORKS.get(repo, "")
        values = {"title": title, "lang": lang, "body": body.strip(), "code": (code[0] if code else "") or "", "framework": of or prompts.PLAIN, "using": f" using {of}" if of else ""}
        values = {k: _Cut(v or "") for k, v in values.items()}
        able = [p for p in self.prompts if p.kind == kind and values[p.needs]]
        for i, p in enumerate(able):
            yield i, p.instruction.format(**values), p.style, p.context.format(**values)


class _Cut(str):
    """A text of which a format takes so many characters."""

    def __format__(self, size: str) -> str:
        return str(self)[: int(size)] if size else str(self)


def register(spark: SparkSession) -> None:
    """Make file_chunks and chunk_prompts known to the session's SQL."""
    spark.udtf.register("file_chunks", udtf(FileChunks))
    spark.udtf.register("chunk_prompts", udtf(ChunkPrompts))
