"""Patterns that a file must match to be read for chunks, and names and directories that are skipped."""

SKIP_DIRS = [
    "vendor", "node_modules", ".git", "target", "__pycache__",
    "testdata", "fixtures", "third_party", "proto", "generated",
    "_build", "dist", "build",
]
SKIP_MD_NAMES = [
    "agents", "agents_notes", "code_of_conduct", "contributing",
    "changelog", "security", "governance", "maintainers", "codeowners",
    "release", "authors", "license", "brewfile", "summary",
    "readme",
]
DOC_WORDS = (
    r"\bebpf\b|\bbpf\b|\bxdp\b|\bkprobe\b|\btracepoint\b|\blsm\b|"
    r"\baya\b|\blibbpf\b|\bcilium\b|\bbcc\b|\bmap\b|\bprogram\b|"
    r"\bsyscall\b|\bkernel\b|\bverifier\b|\bbtf\b|\bco-re\b|"
    r"\bring.buffer\b|\bperf.event\b|\bsocket\b|\btc\b|\bcgroup\b"
)
C_SIGNALS = (
    r"\bSEC\s*\(|BPF_PROG\b|BPF_MAP_TYPE_|bpf_helpers\.h|vmlinux\.h|"
    r"bpf_map_def\b|struct\s+xdp_md\b|struct\s+__sk_buff\b|"
    r"bpf_printk\b|bpf_probe_read|bpf_get_current|BPF_KPROBE\b|"
    r"BPF_TRACEPOINT\b|BPF_XDP\b|BPF_TC\b|BPF_LSM\b|"
    r"bpf_map_lookup_elem|bpf_map_update_elem|LIBBPF_OPTS\b"
)
RUST_SIGNALS = (
    r"#\[xdp\]|#\[kprobe\]|#\[map\]|#\[tracepoint\]|#\[lsm\]|"
    r"#\[uprobe\]|#\[tc\]|#\[cgroup_skb\]|#\[sock_ops\]|"
    r"aya_ebpf|aya-ebpf|use aya::|EbpfLoader|Bpf::load"
)
GO_SIGNALS = (
    r"cilium/ebpf|ebpf\.LoadCollection|ebpf\.NewMap|link\.AttachXDP|"
    r"link\.AttachTracepoint|link\.AttachKprobe|ebpf\.LoadPinnedMap|"
    r"bpf2go|NewReader\b.*ringbuf|perf\.NewReader"
)
PYTHON_SIGNALS = r"(BPF_[A-Z_]+|b\s*=\s*BPF)\s*\("

#: Flags of each gate in Java's dialect: (?U) for Unicode classes, (?d) so that only a line feed ends a line.
GATES = {
    "md": "(?iUd)" + DOC_WORDS,
    "rst": "(?iUd)" + DOC_WORDS,
    "rs": "(?Ud)" + RUST_SIGNALS,
    "c": "(?Ud)" + C_SIGNALS,
    "h": "(?Ud)" + C_SIGNALS,
    "go": "(?Ud)" + GO_SIGNALS,
    "py": "(?Ud)" + PYTHON_SIGNALS,
}

#: The characters that a match can start with, as a class: looked at first, so that most places of a text are passed over.
_STARTS = {"md": "abceklmprstvx", "rst": "abceklmprstvx", "rs": "#auEB", "c": "SBbvsL", "h": "SBbvsL", "go": "celbNp", "py": "Bb"}


def _quick(suffix: str) -> str:
    """The gate's pattern in a form that finds the same texts sooner: its start is looked at before any of its branches.

    A branch of the words between two word boundaries needs the boundary but once for all of them.
    """
    flags, pattern = GATES[suffix].split(")", 1)
    if suffix in ("md", "rst"):
        pattern = r"\b(?:" + "|".join(x.removeprefix(r"\b").removesuffix(r"\b") for x in pattern.split("|")) + r")\b"
    return f"{flags})(?=[{_STARTS[suffix]}])(?:{pattern})"


QUICK_GATES = {suffix: _quick(suffix) for suffix in GATES}

REPOS = {
    "aya": (["rs"], True),
    "book": (["rs"], True),
    "bpf-developer-tutorial": (["c", "rs", "py"], True),
    "bcc": (["c", "py"], True),
    "beyla": (["go"], True),
    "bpfman": (["rs", "c", "go"], True),
    "bpf-perf-tools-book": ([], True),
    "deepflow": (["go", "c"], False),
    "ebpf": (["go", "c"], True),
    "eunomia-bpf": (["rs", "c"], True),
    "learning-ebpf": (["c", "py"], True),
    "libbpf-bootstrap": (["c"], True),
    "libbpf-rs": (["rs", "c"], True),
    "redbpf": (["rs"], False),
    "retis": (["rs", "c"], True),
    "tetragon": (["go", "c"], True),
    "tracee": (["go", "c"], True),
    "linux-bpf-docs": (["c", "h"], False),
    "libbpf": (["c", "h"], False),
}
#: Repositories of which .rst files are read.
RST_REPOS = ["linux-bpf-docs", "bpf-docs"]
