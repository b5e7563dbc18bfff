"""Queries of the package's own operators over whole test tables, with their DuckDB oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions import signals, tables, text
from corpusloom.operators import chunkers, dedup, evaluate, generate, prompts, quality
from corpusloom.plans import clean, reports, source_catalogue
from corpusloom.runtime import table
from corpusloom.sources import files

#: Topic words under which the test tables keep rows; the default topic keeps almost none of them.
TOPIC, TOPIC_SQL = r"(?i)\b(the|of|und|die|les|que|los)\b", r"\b(the|of|und|die|les|que|los)\b"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as question-answer rows in the order of doc_id."""
    q = F.concat(F.lit("What does the source "), F.col("source"), F.lit(" say in "), F.coalesce("lang", F.lit("?")), F.lit(", part "), F.col("n_chars").cast("string"), F.lit("?"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), q.alias("question"), F.col("text").alias("answer"), "source", "lang")


def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.checked(_pairs(spark, sf_dir)).select("seq", F.coalesce("reason", F.lit("")).alias("reason"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.checked(_pairs(spark, sf_dir), topic=TOPIC).groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with ordered turns in the record schema."""
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value")))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", text.first_turn("conversations", "human").alias("question"), text.first_turn("conversations", "gpt").alias("answer"))


def sharegpt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.array_join(F.transform("conversations", lambda t: F.concat(t["from"], F.lit(": "), t["value"])), "\n")
    return _talks(spark, sf_dir).select("conv_id", F.size("conversations").alias("n_turns"), flat.alias("flat"))


def _by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("question"), F.col("source").alias("answer"), "source")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_reasons(_by_text(spark, sf_dir)).where("dup_reason is null").select("seq")


def exact_dedup_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_reasons(_by_text(spark, sf_dir)).select("seq", F.coalesce("dup_reason", F.lit("")).alias("dup_reason"))


def first_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.substring(F.sha1(F.concat_ws(":", "source", "lang", F.left("text", F.lit(8)))), 1, 12)
    rows = table(spark, sf_dir, "documents").select(ident.alias("id"), "doc_id", "n_chars")
    return dedup.first_per_key(rows, "id", "doc_id")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(F.col("conv_id").alias("seq"), "question")


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signatures(_questions(spark, sf_dir), "question").select("seq", "n_shingles")


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signatures(_questions(spark, sf_dir), "question").select("seq", F.posexplode("signature").alias("place", "value"))


def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.buckets(dedup.signatures(_questions(spark, sf_dir), "question")).select("seq", "band", F.array_join(F.transform("key", lambda x: x.cast("string")), ",").alias("key"))


def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(runtime.written(dedup.signatures(_questions(spark, sf_dir), "question"), "signatures"))


def neardup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_classes(runtime.written(dedup.signatures(_questions(spark, sf_dir), "question"), "signatures"))


def neardup_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    return dedup.near_dropped(runtime.written(dedup.signatures(rows, "text"), "signatures"))


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = clean.steps(_pairs(spark, sf_dir), TOPIC)
    return kept.select("seq", "source", "lang")


def drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.steps(_pairs(spark, sf_dir), TOPIC)[1]


def source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.breakdown(table(spark, sf_dir, "documents"), "source")


def style_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.breakdown(table(spark, sf_dir, "documents"), "lang").select("value", "n")


WORDS = ["The", "of", "and", "worthless", "und", "die", "que", "los"]


def keyword_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.keyword_columns(F.col("text"), F.array(*map(F.lit, WORDS)))
    return table(spark, sf_dir, "documents").select("doc_id", *(got[k].alias(k) for k in ("n_found", "n_required", "passed", "detail")))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("passed"), "toxic")


def pass_at_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.overall(_results(spark, sf_dir))


def pass_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_category(_results(spark, sf_dir))


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "labels")
    a = rows.where("doc_id % 7 <> 3").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("passed"))
    return a, rows.where("doc_id % 5 <> 1").select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("passed"))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compared(*_two_runs(spark, sf_dir))


def compare_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.comparison(*_two_runs(spark, sf_dir))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return generate.pending(chunks, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_chunk_id")))


#: Test sources as repositories: each source stands for the repository with its place in the table.
_REPO_OF = {f"src{i}": r for i, r in enumerate(prompts.FRAMEWORKS)}


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("tutorial_section", "doc_code", "raw_code"))), (F.col("doc_id") % 3 + 1).cast("int"))
    repo = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _REPO_OF.items() for x in kv)), F.col("source")), F.lit("elsewhere"))
    code = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.reverse("text")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), repo.alias("repo"), F.col("lang"), kinds.alias("kind"), F.concat(F.lit("part "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), code.alias("code"))


def framework_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", prompts.framework(F.col("repo")).alias("framework"))


def prompt_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.expanded(_chunks(spark, sf_dir)).select("id", "prompt_no", "style", "temperature", "message")


#: A table of one prompt, as SQL takes it.
ONE_PROMPT = '[{"kind": "doc_code", "needs": "body", "style": "summary", "instruction": "Sum up {title} ({lang}) in {framework}: {body:40}"}]'


def prompt_expand_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_expand by the table function, in SQL, and the prompts of a table given as an argument."""
    tables.register(spark)
    return spark.sql(
        """
        SELECT c.id, p.prompt_no, p.style, CASE WHEN p.context <> '' THEN concat(p.context, '\n\n---\n\n', p.instruction) ELSE p.instruction END AS message
        FROM {chunks} c, LATERAL chunk_prompts(c.kind, c.repo, c.lang, c.title, c.body, c.code) p
        UNION ALL
        SELECT c.id, p.prompt_no, p.style, p.instruction FROM {chunks} c, LATERAL chunk_prompts(c.kind, c.repo, c.lang, c.title, c.body, c.code, {table}) p
        """,
        chunks=_chunks(spark, sf_dir),
        table=ONE_PROMPT,
    )


def generate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = prompts.expanded(_chunks(spark, sf_dir))
    answers = generate.generated(asked, generate.echo, "You test.", tries=1)
    return generate.samples(answers, "You test.").select("source_chunk_id", "style", text.first_turn("conversations", "gpt").alias("answer"))


def strip_think_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.concat(F.lit("<think>a\nb</think> ```py\n"), F.col("text"), F.lit("\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", text.without_fences(text.without_thoughts(wrapped)).alias("answer"))


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.element_at(F.array(*map(F.lit, ("vendor/a.c", "src/README.md", "src/Code-of-Conduct.md", "src/vendor.c", "docs/guide.md"))), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat_ws("/", F.regexp_replace("url", "[?#].*$", ""), part)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).select("page_id", files.skipped(F.col("path")).alias("skipped"), files.suffix(F.col("path")).alias("suffix"))


def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunkers.parts_column(F.col("text"), 4000, "\n")).alias("part", "body"))
    return rows.select("doc_id", "part", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkers.summary(_chunks(spark, sf_dir))


def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are counted while they are written, not again."""
    rows, n = runtime.counted(_pairs(spark, sf_dir), "pairs", all=F.count(F.lit(1)))
    kept, drops = clean.steps(rows, TOPIC)
    kept, m = runtime.counted(kept, "kept", kept=F.count(F.lit(1)))
    return reports.numbered(reports.cleaning(n["all"], m["kept"], kept, drops, ("source", "lang")))


_NOT_QUERIES = {"table", "queries", "oracle_sql"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if getattr(v, "__module__", "") == __name__ and re.match("[a-z]", k) and k not in _NOT_QUERIES}
    return own | source_catalogue.queries()


_WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"
_Q = "'What does the source ' || source || ' say in ' || coalesce(lang, '?') || ', part ' || n_chars::varchar || '?'"


def _reason_sql(topic: str) -> str:
    return f"""CASE WHEN length(question) < 20 THEN 'question_too_short' WHEN length(answer) < 150 THEN 'answer_too_short'
    WHEN {_WORDS.format('answer')} < 30 THEN 'answer_too_few_words' WHEN length(answer) > 8000 THEN 'answer_too_long'
    WHEN regexp_matches(left(answer, 100), '^(I (don''t|cannot|can''t)|Sorry|I''m not sure|As an AI|I apologize)', 'i') THEN 'bad_answer_pattern'
    WHEN regexp_matches(right(answer, 100), '\\.\\.\\.\\n?$|to be continued|continued in part|end of response', 'i') THEN 'incomplete_answer'
    WHEN NOT regexp_matches(question || ' ' || left(answer, 500), '{topic}', 'i') THEN 'no_ebpf_signal' ELSE '' END"""


_PAIRS_SQL = f"pairs AS (SELECT doc_id AS seq, {_Q} AS question, coalesce(text, '') AS answer, source, lang FROM documents)"
_TURNS_SQL = "turns AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS question, coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id)"
_NORMAL = "regexp_replace(regexp_replace(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '^$', '')"


def _exact_sql(source: str) -> str:
    return f"""hashed AS (SELECT *, md5(question || '|||' || answer) AS eh, md5({_NORMAL.format('question')}) AS qh FROM {source}),
    marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN first_value(eh) OVER w = eh THEN 'duplicate_qa' ELSE 'duplicate_question' END AS dup_reason FROM hashed WINDOW w AS (PARTITION BY qh ORDER BY seq))"""


def _signature_sql(source: str, column: str) -> str:
    """CTEs grams(seq, h), sig(seq, place, value) of a source with seq."""
    a, b = dedup.permutations()
    values = ", ".join(f"({i}, {x}::bigint, {y}::bigint)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())))
    return f"""normal AS (SELECT seq, {_NORMAL.format(column)} AS t FROM {source}),
    grams AS (SELECT DISTINCT seq, substr(t, i, 5) AS g FROM (SELECT seq, t, unnest(generate_series(1, length(t) - 4)) AS i FROM normal WHERE length(t) >= 5)),
    hashes AS (SELECT seq, ('0x' || substr(md5(g), 1, 8))::bigint & 2147483647 AS h FROM grams),
    perms AS (SELECT * FROM (VALUES {values}) AS v(place, a, b)),
    sig AS (SELECT seq, place, min((a * h + b) % 2147483647) AS value FROM hashes, perms GROUP BY seq, place
      UNION ALL SELECT seq, place, 0 FROM normal, perms WHERE length(t) < 5),
    sigs AS (SELECT seq, list(value ORDER BY place) AS s FROM sig GROUP BY seq),
    near AS (SELECT x.seq AS i, y.seq AS j, len(list_filter(list_zip(x.s, y.s), lambda p: p[1] = p[2])) AS n_equal FROM sigs x JOIN sigs y ON x.seq > y.seq),
    found AS (SELECT i, j, n_equal FROM near WHERE n_equal >= 109)"""


def oracle_sql() -> dict[str, str]:
    e = lambda s: s.replace("'", "''")
    topic = re.sub(r"^\(\?\w+\)", "", quality.TOPIC)
    clean_sql = f"""WITH {_PAIRS_SQL}, checked AS (SELECT *, {_reason_sql(TOPIC_SQL)} AS reason FROM pairs), passed AS (SELECT * FROM checked WHERE reason = ''),
    {_exact_sql('passed')}, single AS (SELECT * FROM marked WHERE dup_reason = ''), {_signature_sql('single', 'question')}, gone AS (SELECT DISTINCT j FROM found)"""
    repo = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REPO_OF.items()) + " ELSE 'elsewhere' END"
    name = "CASE repo " + " ".join(f"WHEN '{k}' THEN '{e(v)}'" for k, v in prompts.FRAMEWORKS.items()) + " ELSE '' END"
    chunks = f"""chunks AS (SELECT doc_id::varchar AS id, {repo} AS repo, lang, ['tutorial_section', 'doc_code', 'raw_code'][doc_id % 3 + 1] AS kind,
    'part ' || doc_id AS title, text AS raw, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, CASE WHEN doc_id % 4 = 0 THEN '' ELSE reverse(text) END AS code FROM documents),
    named AS (SELECT *, {name} AS fw, CASE WHEN ({name}) = '' THEN 'eBPF' ELSE {name} END AS fb FROM chunks WHERE length(raw || code) >= 150)"""
    fence = lambda n: f"'```' || lang || chr(10) || left(code, {n}) || chr(10) || '```'"
    two = "chr(10) || chr(10)"
    made = f"""made AS (
    SELECT id, 0 AS k, 'concept' AS style, 0.6::double AS temperature, left(body, 1500) AS context, 'Explain the concept of ''' || title || ''' in the context of eBPF development' || CASE WHEN fw = '' THEN '' ELSE ' using ' || fw END || '.' AS instruction FROM named WHERE kind = 'tutorial_section' AND body <> ''
    UNION ALL SELECT id, 1, 'code_walkthrough', 0.3::double, left(body, 800), 'Walk me through this eBPF code step by step and explain what it does:' || {two} || {fence(1200)} FROM named WHERE kind = 'tutorial_section' AND code <> ''
    UNION ALL SELECT id, 0, 'api_explain', 0.4::double, 'Documentation:' || chr(10) || left(body, 600) || {two} || 'Source:' || chr(10) || {fence(1200)}, 'Explain what `' || title || '` does in ' || fb || ' and show how to use it.' FROM named WHERE kind = 'doc_code' AND code <> ''
    UNION ALL SELECT id, 1, 'usage_example', 0.4::double, {fence(1200)}, 'Write a practical example showing how to use `' || title || '` from the ' || fb || ' API. Include the key steps and any important caveats.' FROM named WHERE kind = 'doc_code' AND code <> ''
    UNION ALL SELECT id, 0, 'code_analysis', 0.3::double, '', 'Analyze this ' || lang || ' eBPF code and explain what it does, how it works, and what eBPF concepts it demonstrates:' || {two} || {fence(1500)} FROM named WHERE kind = 'raw_code' AND code <> ''),
    asked AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS prompt_no, style, temperature, CASE WHEN context <> '' THEN context || {two} || '---' || {two} || instruction ELSE instruction END AS message FROM made)"""
    words = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    results = "results AS (SELECT l.doc_id AS id, d.lang AS category, l.quality = 1 AS passed FROM labels l JOIN documents d USING (doc_id))"
    runs = """a AS (SELECT doc_id AS id, quality = 1 AS passed FROM labels WHERE doc_id % 7 <> 3), b AS (SELECT doc_id AS id, toxic = 0 AS passed FROM labels WHERE doc_id % 5 <> 1),
    j AS (SELECT a.id, a.passed AS passed_a, coalesce(b.passed, false) AS passed_b FROM a LEFT JOIN b USING (id)),
    c AS (SELECT *, CASE WHEN passed_a = passed_b THEN 'unchanged' WHEN passed_b THEN 'improved' ELSE 'regressed' END AS outcome FROM j)"""
    skip = "[" + ", ".join(f"'{x}'" for x in signals.SKIP_DIRS) + "]"
    names = "[" + ", ".join(f"'{x}'" for x in signals.SKIP_MD_NAMES) + "]"
    paths = "paths AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/' || ['vendor/a.c', 'src/README.md', 'src/Code-of-Conduct.md', 'src/vendor.c', 'docs/guide.md'][page_id % 5 + 1] AS path FROM pages)"
    return {
        "quality_reasons": f"WITH {_PAIRS_SQL} SELECT seq, {_reason_sql(topic)} AS reason FROM pairs",
        "quality_counts": f"WITH {_PAIRS_SQL} SELECT {_reason_sql(TOPIC_SQL)} AS reason, count(*) AS n FROM pairs GROUP BY 1",
        "turns": f"WITH {_TURNS_SQL} SELECT * FROM turns",
        "sharegpt_rows": "SELECT conv_id, CAST(count(*) AS INT) AS n_turns, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS flat FROM conversations GROUP BY conv_id",
        "exact_dedup": f"WITH t AS (SELECT doc_id AS seq, text AS question, source AS answer FROM documents), {_exact_sql('t')} SELECT seq FROM marked WHERE dup_reason = ''",
        "exact_dedup_reasons": f"WITH t AS (SELECT doc_id AS seq, text AS question, source AS answer FROM documents), {_exact_sql('t')} SELECT seq, dup_reason FROM marked",
        "first_per_id": "SELECT id, doc_id, n_chars FROM (SELECT substr(sha1(source || ':' || lang || ':' || left(text, 8)), 1, 12) AS id, doc_id, n_chars, row_number() OVER (PARTITION BY substr(sha1(source || ':' || lang || ':' || left(text, 8)), 1, 12) ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
        "shingle_counts": f"WITH {_TURNS_SQL}, q AS (SELECT conv_id AS seq, question FROM turns), {_signature_sql('q', 'question')} SELECT n.seq, CAST(count(g.g) AS INT) AS n_shingles FROM normal n LEFT JOIN grams g USING (seq) GROUP BY n.seq",
        "minhash_signature": f"WITH {_TURNS_SQL}, q AS (SELECT conv_id AS seq, question FROM turns), {_signature_sql('q', 'question')} SELECT seq, place, value FROM sig",
        "lsh_buckets": f"WITH {_TURNS_SQL}, q AS (SELECT conv_id AS seq, question FROM turns), {_signature_sql('q', 'question')} SELECT seq, CAST(place // 4 AS INT) AS band, string_agg(value::varchar, ',' ORDER BY place) AS key FROM sig GROUP BY seq, place // 4",
        "neardup_pairs": f"WITH {_TURNS_SQL}, q AS (SELECT conv_id AS seq, question FROM turns), {_signature_sql('q', 'question')} SELECT i, j, CAST(n_equal AS INT) AS n_equal FROM found WHERE i IN (SELECT max(seq) FROM sigs GROUP BY s) AND j IN (SELECT max(seq) FROM sigs GROUP BY s)",
        "neardup_classes": f"WITH {_TURNS_SQL}, q AS (SELECT conv_id AS seq, question FROM turns), {_signature_sql('q', 'question')} SELECT seq, max(seq) OVER (PARTITION BY s) AS last FROM sigs",
        "neardup_dropped": f"WITH q AS (SELECT doc_id AS seq, coalesce(text, '') AS text FROM documents), {_signature_sql('q', 'text')} SELECT DISTINCT j AS seq FROM found",
        "clean_pipeline": f"{clean_sql} SELECT seq, source, lang FROM single WHERE seq NOT IN (SELECT j FROM gone)",
        "drop_report": f"{clean_sql} SELECT reason, count(*) AS n FROM (SELECT 'quality:' || reason AS reason FROM checked WHERE reason <> '' UNION ALL SELECT 'exact:' || dup_reason FROM marked WHERE dup_reason <> '' UNION ALL SELECT 'neardup:similar_question' FROM gone) GROUP BY 1",
        "source_breakdown": "SELECT coalesce(source, 'unknown') AS value, count(*) AS n, 100.0::double * count(*) / (SELECT count(*) FROM documents) AS pct FROM documents GROUP BY 1",
        "style_breakdown": "SELECT coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1",
        "keyword_check": f"""WITH f AS (SELECT doc_id, list_filter({words}, lambda k: contains(lower(text), lower(k))) AS found, list_filter({words}, lambda k: NOT contains(lower(text), lower(k))) AS missing FROM documents)
    SELECT doc_id, CAST(len(found) AS INT) AS n_found, CAST(greatest(3, {len(WORDS)} // 2) AS INT) AS n_required, len(found) >= greatest(3, {len(WORDS)} // 2) AS passed,
    'Found ' || len(found) || '/{len(WORDS)} keywords. Missing: [' || array_to_string(list_transform(missing[1:5], lambda k: '''' || k || ''''), ', ') || ']' AS detail FROM f""",
        "pass_at_1": f"WITH {results} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, 100.0::double * count(*) FILTER (passed) / count(*) AS pct FROM results",
        "pass_by_category": f"WITH {results} SELECT category, count(*) FILTER (passed) AS passed, count(*) AS n, 100.0::double * count(*) FILTER (passed) / count(*) AS pct FROM results GROUP BY category",
        "compare_runs": f"WITH {runs} SELECT id, passed_a, passed_b, outcome FROM c",
        "compare_totals": f"WITH {runs} SELECT count(*) AS total, count(*) FILTER (passed_a) AS passed_a, count(*) FILTER (outcome = 'improved') AS improved, count(*) FILTER (outcome = 'regressed') AS regressed, count(*) FILTER (outcome = 'unchanged') AS unchanged, (SELECT count(*) FILTER (passed) FROM b) AS passed_b FROM c",
        "resume_pending": "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "framework_lookup": f"WITH {chunks} SELECT id, {name} AS framework FROM chunks",
        "prompt_expand": f"WITH {chunks}, {made} SELECT id, prompt_no, style, temperature, message FROM asked",
        "prompt_expand_sql": f"WITH {chunks}, {made} SELECT id, prompt_no, style, message FROM asked UNION ALL SELECT id, 0, 'summary', 'Sum up ' || title || ' (' || lang || ') in ' || fb || ': ' || left(body, 40) FROM named WHERE kind = 'doc_code' AND body <> ''",
        "generate_samples": f"WITH {chunks}, {made} SELECT id AS source_chunk_id, style, regexp_replace('Asked at ' || temperature || ': ' || message, '^\\s+|\\s+$', '', 'g') AS answer FROM asked",
        "strip_think_fences": "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM documents",
        "path_filter": f"""WITH {paths} SELECT page_id, list_has_any(string_split(path, '/'), {skip}) OR (lower(path) LIKE '%.md' AND list_contains({names}, replace(lower(regexp_extract(path, '([^/]+)\\.[^./]+$', 1)), '-', '_'))) AS skipped,
    regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS suffix FROM paths""",
        "paragraph_pack": """WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
    s(doc_id, i, part, size) AS (SELECT doc_id, 1, 0, length(p[1]) FROM d WHERE length(text) > 4000
      UNION ALL SELECT s.doc_id, s.i + 1, CASE WHEN s.size + length(d.p[s.i + 1]) > 4000 THEN s.part + 1 ELSE s.part END, CASE WHEN s.size + length(d.p[s.i + 1]) > 4000 THEN length(d.p[s.i + 1]) ELSE s.size + length(d.p[s.i + 1]) END FROM s JOIN d USING (doc_id) WHERE s.i < len(d.p)),
    b AS (SELECT s.doc_id, s.part, string_agg(d.p[s.i], chr(10) ORDER BY s.i) AS body FROM s JOIN d USING (doc_id) GROUP BY s.doc_id, s.part UNION ALL SELECT doc_id, 0, text FROM d WHERE length(text) <= 4000)
    SELECT doc_id, CAST(part AS INT) AS part, CAST(length(body) AS INT) AS n_chars, md5(body) AS body_md5 FROM b""",
        "chunk_summary": f"WITH {chunks} SELECT repo, kind, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY repo) AS BIGINT) AS repo_total FROM chunks GROUP BY repo, kind",
        "cleaning_report": f"""{clean_sql}, kept AS (SELECT * FROM single WHERE seq NOT IN (SELECT j FROM gone)), n AS (SELECT (SELECT count(*) FROM kept) AS k, (SELECT count(*) FROM pairs) AS a),
    reasons AS (SELECT reason, count(*) AS n FROM (SELECT 'quality:' || reason AS reason FROM checked WHERE reason <> '' UNION ALL SELECT 'exact:' || dup_reason FROM marked WHERE dup_reason <> '' UNION ALL SELECT 'neardup:similar_question' FROM gone) GROUP BY 1),
    lines AS (SELECT 0 AS p, 0 AS r, [format('FINAL DATASET: {{:,}} samples', k), format('Removed      : {{:,}} ({{}}%)', a - k, printf('%.1f', 100 * (a - k) / a)), '', 'Drop reasons:'] AS l FROM n
      UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, reason), [format('  {{:<35}} {{:>6}}', reason, n)] FROM reasons
      UNION ALL SELECT 2, 0, ['', 'Final samples by source:'] UNION ALL SELECT 4, 0, ['', 'Final samples by lang:']
      UNION ALL SELECT 3, row_number() OVER (ORDER BY count(*) DESC, v), [format('  {{:<30}} {{:>6}}  ({{}}%)', v, count(*), printf('%.1f', 100.0::double * count(*) / (SELECT k FROM n)))] FROM (SELECT coalesce(source, 'unknown') AS v FROM kept) GROUP BY v
      UNION ALL SELECT 5, row_number() OVER (ORDER BY count(*) DESC, v), [format('  {{:<30}} {{:>6}}  ({{}}%)', v, count(*), printf('%.1f', 100.0::double * count(*) / (SELECT k FROM n)))] FROM (SELECT coalesce(lang, 'unknown') AS v FROM kept) GROUP BY v),
    flat AS (SELECT p, r, generate_subscripts(l, 1) AS c, unnest(l) AS line FROM lines) SELECT CAST(row_number() OVER (ORDER BY p, r, c) - 1 AS INT) AS line_no, regexp_replace(line, '\\s+$', '') AS line FROM flat""",
    } | source_catalogue.oracle_sql()
