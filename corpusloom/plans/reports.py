"""Text reports as tables of lines: a, b, c (their order) and line, made by the cluster and written in range order.

`numbered` gives each line its number, `write` one text file with all of them; `text` is for the console, which shows the
first CONSOLE lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.operators import evaluate
from corpusloom.sources import joined

#: Lines that are shown at most; files hold all.
CONSOLE = 10_000
_ORDER = ["a", "b", "c"]


def _decimal(x: Column, pattern: str = "0.0") -> Column:
    """A number with as many decimals as the pattern, its exact value rounded half to even."""
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def _share(n: Column, of: Column) -> Column:
    """Percent with one decimal; "-" where there is nothing to share."""
    return F.when(of > 0, F.concat(_decimal(F.try_divide(100.0 * n, of)), F.lit("%"))).otherwise("-")


def _lines(rows: DataFrame, a: int, b: Column | None, *lines: Column | str) -> DataFrame:
    """A block of a report: for each row, some lines (null ones are left out)."""
    texts = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    place = F.lit("") if b is None else b
    return rows.select(F.lit(a).alias("a"), place.cast("string").alias("b"), F.posexplode(texts).alias("c", "line")).where("line is not null")


def _key(*parts: Column) -> Column:
    """A text that sorts as (number, ...): numbers from 0 are padded, texts follow as they are."""
    return F.concat_ws("\x01", *parts)


def _rising(n: Column) -> Column:
    return F.lpad(n.cast("string"), 20, "0")


def _falling(n: Column) -> Column:
    return F.lpad((F.lit(10**18) - n).cast("string"), 20, "0")


def _union(*blocks: DataFrame) -> DataFrame:
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def numbered(lines: DataFrame) -> DataFrame:
    """line_no, line: in order, without blanks at the ends of lines."""
    return runtime.ordered(lines, _ORDER, "line_no", "report").select("line_no", F.rtrim("line").alias("line"))


def write(lines: DataFrame, path: str) -> None:
    """One text file, joined from the parts of all tasks."""
    joined.write(lines.orderBy(*_ORDER).select("line"), path)


def text(lines: DataFrame, most: int = CONSOLE) -> str:
    """A report for the console."""
    return "\n".join(r["line"] for r in lines.orderBy(*_ORDER).limit(most).collect())


def chunks_by_repo(summary: DataFrame) -> DataFrame:
    rows = summary.select("repo", "repo_total").distinct()
    return _lines(rows, 0, _key(_falling(F.col("repo_total")), F.col("repo")), F.format_string("  %-30s %6d", "repo", "repo_total"))


def cleaning(n_before: int, n_kept: int, kept: DataFrame, drops: DataFrame, by: tuple[str, ...] = ("repo", "style")) -> DataFrame:
    """What was kept and dropped, and why; drop reasons by falling count, then name."""
    before, n = F.lit(n_before), F.lit(n_kept)
    blocks = [_lines(kept.sparkSession.range(1), 0, None, F.format_string("FINAL DATASET: %,d samples", n), F.format_string("Removed      : %,d (%s)", before - n, _share(before - n, before)), "", "Drop reasons:")]
    blocks.append(_lines(drops, 1, _key(_falling(F.col("n")), F.col("reason")), F.format_string("  %-35s %6d", "reason", "n")))
    for i, column in enumerate(by):
        blocks.append(_lines(kept.sparkSession.range(1), 2 + 2 * i, None, "", f"Final samples by {column}:"))
        groups = kept.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
        blocks.append(_lines(groups, 3 + 2 * i, _key(_falling(F.col("n")), F.col("value")), F.format_string("  %-30s %6d  (%s%%)", "value", "n", _decimal(F.try_divide(100.0 * F.col("n"), n)))))
    return _union(*blocks)


def evaluation(results: DataFrame, tag: str, model: str, title: str = "Evaluation results") -> DataFrame:
    """Header, overall and category pass rates, then a line for each problem in the order of seq (id where there is none)."""
    total = evaluate.overall(results)
    share = F.format_string("Overall pass@1 : %d/%d (%s)", "passed", "total", _share(F.col("passed"), F.col("total")))
    head = _lines(total, 0, None, title, "=" * 50, f"Model  : {model}", f"Tag    : {tag}", "", share, "", "By category:")
    groups = evaluate.by_category(results)
    categories = _lines(groups, 1, F.col("category"), F.format_string("  %-20s %d/%d  (%s%%)", "category", "passed", "n", _decimal(100 * F.col("passed") / F.col("n"), "0")))
    between = _lines(results.sparkSession.range(1), 2, None, "", "Per-problem results:")
    mark = F.format_string("  [%s] %-15s (%s) %ss", F.when(F.col("passed"), "PASS").otherwise("FAIL"), "id", "category", _decimal(F.col("latency_s")))
    why = F.when(~F.coalesce("passed", F.lit(False)) & (F.coalesce("error", F.lit("")) != ""), F.concat(F.lit("         ↳ "), F.left("error", F.lit(120))))
    order = _rising(F.col("seq")) if "seq" in results.columns else F.col("id")
    return _union(head, categories, between, _lines(results, 3, order, mark, why))


def comparison(a: DataFrame, b: DataFrame, tag_a: str, tag_b: str) -> DataFrame:
    """A title, a line for each problem whose outcome changed, by id, then the totals."""
    spark = a.sparkSession
    head = _lines(spark.range(1), 0, None, f"Comparison: {tag_a} vs {tag_b}", "=" * 60)
    changed = evaluate.compared(a, b).where("outcome <> 'unchanged'")
    each = _lines(changed, 1, F.col("id"), F.format_string("  %-9s: %s", F.upper("outcome"), "id"))
    say = F.format_string
    tags = [t.replace("%", "%%") for t in (tag_a, tag_b)]
    totals = _lines(evaluate.comparison(a, b), 2, None, "", say(tags[0] + " pass@1: %d/%d", "passed_a", "total"), say(tags[1] + " pass@1: %d/%d", "passed_b", "total"), say("Improved  : %d", "improved"), say("Regressed : %d", "regressed"), say("Unchanged : %d", "unchanged"))
    return _union(head, each, totals)
