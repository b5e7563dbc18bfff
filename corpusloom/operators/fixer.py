"""Last-mile fixes of generated code by a table of rules: missing lines put in, unused lines taken out.

Not an operator that had to be matched: it follows a description in prose only. Rules are data, and become native
expressions, one after another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Put:
    """If `trigger` is found in code of the language and `there` is not, a line is put in.

    places: (pattern of a whole line with its end, the line to put): the first pattern that is found decides, and the line
    follows its last match. top is put first where none is found.
    """

    lang: str
    trigger: str
    there: str
    top: str
    places: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Drop:
    """If `line` (a whole line, with its end) is found and `used` is not, the line goes."""

    lang: str
    line: str
    used: str


def include(trigger: str, header: str) -> Put:
    """A header for what is used."""
    line = f"#include <{header}>\n"
    return Put("c", trigger, rf"(?m)^[ \t]*#[ \t]*include[ \t]*<{re.escape(header)}>", line, ((r"[ \t]*#[ \t]*include[^\n]*\n", line),))


def go_import(path: str) -> list[Put | Drop]:
    """A Go package by its path: put into the import block, or under the package clause, if it is used; taken out if not."""
    name, quoted = path.rsplit("/", 1)[-1], re.escape(f'"{path}"')
    use = rf'(?<![\w./"]){name}\.[A-Z]'
    own = f'import "{path}"\n'
    put = Put("go", use, rf"(?m)^(?:import[ \t]+|[ \t]+){quoted}", own, ((r"import[ \t]*\([ \t]*\n", f'\t"{path}"\n'), (r"package[ \t]+\w+[ \t]*\n", own)))
    return [put, Drop("go", rf"(?:import[ \t]+|[ \t]+){quoted}[ \t]*\n", use)]


#: The usual table: headers and packages by what code uses of them.
RULES: list[Put | Drop] = [
    include(r"\bSEC\s*\(|\bbpf_(?:printk|map_\w+_elem|get_\w+)\s*\(", "bpf/bpf_helpers.h"),
    include(r"\bbpf_(?:htons|ntohs|htonl|ntohl|cpu_to_be64|be64_to_cpu)\s*\(", "bpf/bpf_endian.h"),
    include(r"\bBPF_(?:KPROBE|KRETPROBE|PROG)\s*\(|\bPT_REGS_\w+\s*\(", "bpf/bpf_tracing.h"),
    include(r"\bBPF_CORE_READ\w*\s*\(", "bpf/bpf_core_read.h"),
    *(x for p in ("fmt", "log", "os", "time", "errors", "github.com/cilium/ebpf/link", "github.com/cilium/ebpf/ringbuf", "github.com/cilium/ebpf/perf", "github.com/cilium/ebpf/rlimit") for x in go_import(p)),
]


def _applied(code: Column, rule: Put | Drop) -> Column:
    if isinstance(rule, Drop):
        return F.when(~code.rlike(rule.used), F.regexp_replace(code, rf"(?m)^{rule.line}", "")).otherwise(code)
    out = F.concat(F.lit(rule.top), code)
    for pattern, line in reversed(rule.places):
        follows = line.replace("\\", "\\\\").replace("$", "\\$")
        out = F.when(code.rlike(f"(?m)^{pattern}"), F.regexp_replace(code, rf"\A([\s\S]*\n|)({pattern})", f"$1$2{follows}")).otherwise(out)
    return F.when(code.rlike(rule.trigger) & ~code.rlike(rule.there), out).otherwise(code)


def fixed(code: Column, lang: Column, rules: list[Put | Drop] = RULES) -> Column:
    """code after all rules of its language, in their order; null stays null. A rule sees what the rules before it left."""
    out = code
    for rule in rules:  # each step binds the code to a name, so that the expression does not double with every rule

        def step(x: Column) -> Column:
            return F.when(lang == rule.lang, _applied(x, rule)).otherwise(x)  # noqa: B023

        out = F.get(F.transform(F.array(out), step), F.lit(0))
    return out
