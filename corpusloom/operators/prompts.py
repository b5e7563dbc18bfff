"""Prompt expansion of chunks by a table of prompts, message assembly, sampling temperatures."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# Framework names by repository, temperatures by style, least content.
FRAMEWORKS = {
    "aya": "the aya Rust eBPF framework",
    "book": "the aya Rust eBPF framework",
    "libbpf-rs": "libbpf-rs (Rust bindings for libbpf)",
    "redbpf": "the redbpf Rust eBPF framework",
    "bpfman": "bpfman (eBPF program lifecycle manager)",
    "retis": "retis (eBPF network tracing)",
    "ebpf": "the cilium/ebpf Go library",
    "tetragon": "Cilium Tetragon",
    "beyla": "Grafana Beyla",
    "tracee": "Aqua Security Tracee",
    "deepflow": "DeepFlow",
    "libbpf-bootstrap": "libbpf (C)",
    "bcc": "BCC (BPF Compiler Collection)",
    "bpf-developer-tutorial": "libbpf (C)",
    "eunomia-bpf": "eunomia-bpf",
    "learning-ebpf": "libbpf (C)",
    "bpf-perf-tools-book": "BPF performance tools",
}
TEMPERATURES = {"concept": 0.6, "code_walkthrough": 0.3, "api_explain": 0.4, "usage_example": 0.4, "code_analysis": 0.3}
OTHER_TEMPERATURE, LEAST_CONTENT = 0.5, 150
PLAIN = "eBPF"


@dataclass(frozen=True)
class Prompt:
    """A prompt for chunks of a kind that have what it needs (body or code).

    Templates name title, lang, body and code (the first snippet), each with the number of characters that are taken
    (as in {body:800}), framework (the repository's, or a plain name) and using (" using ..." or nothing).
    """

    kind: str
    needs: str
    style: str
    instruction: str
    context: str = ""


# The prompts in their order, with the characters that are taken.
PROMPTS = [
    Prompt("tutorial_section", "body", "concept", "Explain the concept of '{title}' in the context of eBPF development{using}.", "{body:1500}"),
    Prompt("tutorial_section", "code", "code_walkthrough", "Walk me through this eBPF code step by step and explain what it does:\n\n```{lang}\n{code:1200}\n```", "{body:800}"),
    Prompt("doc_code", "code", "api_explain", "Explain what `{title}` does in {framework} and show how to use it.", "Documentation:\n{body:600}\n\nSource:\n```{lang}\n{code:1200}\n```"),
    Prompt("doc_code", "code", "usage_example", "Write a practical example showing how to use `{title}` from the {framework} API. Include the key steps and any important caveats.", "```{lang}\n{code:1200}\n```"),
    Prompt("raw_code", "code", "code_analysis", "Analyze this {lang} eBPF code and explain what it does, how it works, and what eBPF concepts it demonstrates:\n\n```{lang}\n{code:1500}\n```"),
]
FIELDS = {"title", "lang", "body", "code", "framework", "using"}


def checked(prompts: list[Prompt]) -> list[Prompt]:
    """prompts, if their templates can be filled."""
    for p in prompts:
        for template in (p.instruction, p.context):
            for _, field, size, conversion in Formatter().parse(template):
                if field is not None and (field not in FIELDS or conversion or not (size or "1").isdigit()):
                    raise ValueError(f"no such field in the prompt {p.style}: {{{field}:{size}}}")
        if p.needs not in ("body", "code"):
            raise ValueError(f"the prompt {p.style} needs body or code, not {p.needs}")
    return prompts


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template as one concatenation of columns; what values hold is not looked into for fields."""
    parts = []
    for text, field, size, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        if field is not None:
            parts.append(F.left(values[field], F.lit(int(size))) if size else values[field])
    return F.concat(*parts) if parts else F.lit("")


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def framework(repo: Column, names: dict[str, str] = FRAMEWORKS) -> Column:
    return F.coalesce(F.element_at(_map(names), repo), F.lit(""))


def temperature(style: Column) -> Column:
    return F.coalesce(F.element_at(_map(TEMPERATURES), style), F.lit(OTHER_TEMPERATURE))


def message(instruction: Column, context: Column) -> Column:
    return F.when(context != "", F.concat(context, F.lit("\n\n---\n\n"), instruction)).otherwise(instruction)


def enough_content(least: int = LEAST_CONTENT) -> Column:
    return F.length(F.concat(F.coalesce("body", F.lit("")), F.array_join(F.coalesce("code", F.array().cast("array<string>")), " "))) >= least


def expanded(chunks: DataFrame, names: dict[str, str] = FRAMEWORKS, prompts: list[Prompt] = PROMPTS) -> DataFrame:
    """id, repo, prompt_no, instruction, style, context, message, temperature: a row for each of the kind's prompts that the chunk can fill."""
    of = framework(F.col("repo"), names)
    code = F.coalesce(F.get("code", F.lit(0)), F.lit(""))
    values = {"title": F.col("title"), "lang": F.col("lang"), "body": strip(F.coalesce("body", F.lit(""))), "code": code}
    values |= {"framework": F.when(of == "", PLAIN).otherwise(of), "using": F.when(of == "", F.lit("")).otherwise(F.concat(F.lit(" using "), of))}
    rules = [
        F.when((F.col("kind") == p.kind) & (values[p.needs] != ""), F.struct(filled(p.instruction, values).alias("instruction"), F.lit(p.style).alias("style"), filled(p.context, values).alias("context")))
        for p in checked(prompts)
    ]
    made = F.posexplode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("prompt_no", "p")
    out = chunks.where(enough_content()).select("id", "repo", made).select("id", "repo", "prompt_no", "p.*")
    return out.withColumn("message", message(F.col("instruction"), F.col("context"))).withColumn("temperature", temperature(F.col("style")))
