"""Fixes of generated code."""

from pyspark.sql import functions as F

from corpusloom.operators import fixer

C = "#include <vmlinux.h>\n#include <linux/ip.h>\n\nSEC(\"xdp\")\nint f(void *ctx) { return bpf_htons(1); }\n"
GO = 'package main\n\nimport (\n\t"fmt"\n\t"os"\n)\n\nfunc main() { link.AttachXDP(x.link.Y); time.Now(); log := 1; fmtx.Print(os.Args) }\n'


def test_rules(spark):
    cases = [
        (C, "c", "#include <vmlinux.h>\n#include <linux/ip.h>\n#include <bpf/bpf_helpers.h>\n#include <bpf/bpf_endian.h>\n\nSEC(\"xdp\")\nint f(void *ctx) { return bpf_htons(1); }\n"),
        ("int f() { return BPF_CORE_READ(a, b); }", "c", "#include <bpf/bpf_core_read.h>\nint f() { return BPF_CORE_READ(a, b); }"),
        (C, "rust", C),
        (None, "c", None),
        ("", "c", ""),
        (C, None, C),
        (GO, "go", 'package main\n\nimport (\n\t"github.com/cilium/ebpf/link"\n\t"time"\n\t"os"\n)\n\nfunc main() { link.AttachXDP(x.link.Y); time.Now(); log := 1; fmtx.Print(os.Args) }\n'),
        ("package p\nfunc f() { fmt.Println() }\n", "go", 'package p\nimport "fmt"\nfunc f() { fmt.Println() }\n'),
        ('package p\nimport "fmt"\nfunc f() {}\n', "go", "package p\nfunc f() {}\n"),
        ("fmt.Println()", "go", 'import "fmt"\nfmt.Println()'),
    ]
    df = spark.createDataFrame([(i, c, lang) for i, (c, lang, _) in enumerate(cases)], "i int, code string, lang string")
    got = df.select("i", fixer.fixed(F.col("code"), F.col("lang")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [want for *_, want in cases]
    again = df.select("i", fixer.fixed(fixer.fixed(F.col("code"), F.col("lang")), F.col("lang")).alias("x")).orderBy("i").collect()
    assert again == got


def test_own_rules(spark):
    rules = [fixer.Put("py", r"np\.", "(?m)^import numpy", "import numpy as np\n"), fixer.Drop("py", "import os\n", r"os\.")]
    df = spark.createDataFrame([("import os\nnp.ones(1) # $1\\\n",)], "code string")
    assert df.select(fixer.fixed(F.col("code"), F.lit("py"), rules)).first()[0] == "import numpy as np\nnp.ones(1) # $1\\\n"
