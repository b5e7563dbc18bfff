"""Record schemas, as DDL."""

CHUNK = "id string, source string, repo string, file string, lang string, kind string, title string, body string, code array<string>"
TURNS = "array<struct<from:string,value:string>>"
SAMPLE = f"conversations {TURNS}, source_chunk_id string, repo string, style string"
FAILURE = "chunk_id string, error string, repo string"
PROBLEM = "id string, category string, difficulty string, check string, prompt string, concepts array<string>, keywords array<string>"
RESULT = "id string, category string, difficulty string, passed boolean, error string, latency_s double, answer string"
RUN = f"tag string, model string, total int, passed int, results array<struct<{RESULT.replace(' string', ':string').replace(' boolean', ':boolean').replace(' double', ':double').replace(', ', ',')}>>"
REPO = "repo string, langs array<string>, include_md boolean"
