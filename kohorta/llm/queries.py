"""The corpus operators bound to the given tables, with the fixed parameters of their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.llm.decontaminate import contamination
from kohorta.llm.jaccard import jaccard_components
from kohorta.llm.langid import identify_language
from kohorta.llm.line_dedup import without_recurring_lines
from kohorta.llm.ngram_lm import interpolated_scores
from kohorta.llm.packing import pack_sequences
from kohorta.llm.pieces import encode_pieces
from kohorta.llm.pii import personal_data
from kohorta.llm.token_files import read_token_files, write_token_files
from kohorta.llm.topk import exact_top_k
from kohorta.llm.url_filter import host_and_path, judge_urls
from kohorta.llm.vector_codes import compress_vectors
from kohorta.llm.whitening import whiten
from kohorta.session import read_table, scratch_path

QUERIES, ORACLES = {}, {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op8_jaccard_join(spark: SparkSession, location: str) -> DataFrame:
    return jaccard_components(read_table(spark, location, "documents"), shingle=3, threshold=(90, 100))


@query
def op2_best_fit_packing(spark: SparkSession, location: str) -> DataFrame:
    return pack_sequences(read_table(spark, location, "documents"), "word_bpe_49k.json", "dropped", 1, 4096)


@query
def op4_token_files(spark: SparkSession, location: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(read_table(spark, location, "documents"), folder, "byte_bpe_50k.json",
                                              "leading", 0))


@query
def op7_decontamination(spark: SparkSession, location: str) -> DataFrame:
    found = contamination(read_table(spark, location, "documents"), read_table(spark, location, "benchmark"), 10)
    return found.drop("spans")


@query
def op6_deleted_interpolation(spark: SparkSession, location: str) -> DataFrame:
    return interpolated_scores(read_table(spark, location, "documents"), folds=5, out_fold=1)


@query
def op10_language_id(spark: SparkSession, location: str) -> DataFrame:
    return identify_language(read_table(spark, location, "documents"), folds=4, out_fold=2)


@query
def op5_personal_data(spark: SparkSession, location: str) -> DataFrame:
    return personal_data(read_table(spark, location, "documents"))


@query
def op9_exact_top_k(spark: SparkSession, location: str) -> DataFrame:
    return exact_top_k(read_table(spark, location, "embeddings"), F.col("vec_id") % 100 == 0, 10, 1024)


ORACLES["op9_exact_top_k"] = """
WITH p AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM p q JOIN p c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op1_line_dedup(spark: SparkSession, location: str) -> DataFrame:
    cleaned = without_recurring_lines(read_table(spark, location, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"),
                          F.length("text").cast("bigint").alias("n_chars"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]
LEVELS, RARE, MANY, Z, WEIGHT, PURITY = 4, 3, 20, 2.576, 10.0, 0.5


@query
def op3_url_templates(spark: SparkSession, location: str) -> DataFrame:
    pages, labels = read_table(spark, location, "pages"), read_table(spark, location, "labels")
    # a page's url names its document by number; the labels are those of the documents
    _, path = host_and_path(F.col("url"))
    number = pages.select("page_id", F.regexp_extract(path, "([0-9]+)", 1).try_cast("bigint").alias("doc_id"))
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad")
    marks = number.join(labels.select("doc_id", bad), "doc_id").select("page_id", "bad")
    return judge_urls(pages, marks, RULES, LEVELS, RARE, MANY, Z, WEIGHT, PURITY)


def _url_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    steps = []
    for i in range(1, LEVELS + 1):
        steps.append(f"""
c{i} AS (SELECT host, t{i - 1} AS t, segs[{i}] AS seg, sum(n) AS c_n, sum(labelled) AS c_l, sum(bad) AS c_b FROM r{i - 1}
  WHERE len(segs) >= {i} GROUP BY ALL),
p{i} AS (SELECT host, t, count(*) AS kids, sum(c_l) AS p_l, sum(c_b) AS p_b FROM c{i} GROUP BY ALL),
k{i} AS (SELECT c.host, c.t, seg, CASE WHEN kids > 1 AND ((kids >= {MANY} AND c_n <= {RARE}) OR c_l = 0 OR p_l = c_l
    OR p_b = 0 OR p_b = p_l OR abs(c_b::DOUBLE / c_l - (p_b - c_b)::DOUBLE / (p_l - c_l)) < {Z} * sqrt((p_b::DOUBLE / p_l)
      * (1 - p_b::DOUBLE / p_l) * (1.0::DOUBLE / c_l + 1.0::DOUBLE / (p_l - c_l)))) THEN '*' ELSE seg END AS node
  FROM c{i} c JOIN p{i} p ON c.host = p.host AND c.t = p.t),
r{i} AS (SELECT r.* EXCLUDE (t{i - 1}), CASE WHEN node IS NULL THEN t{i - 1} ELSE t{i - 1} || '/' || node END AS t{i}
  FROM r{i - 1} r LEFT JOIN k{i} k ON r.host = k.host AND r.t{i - 1} = k.t AND r.segs[{i}] = k.seg AND len(segs) >= {i})""")
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [(f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, "
             f"'/{r.partition('/')[2]}')", v, r) for v, r in rules]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, _, r in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
u AS (SELECT page_id, translate(raw, '{upper}', '{lower}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT page_id, count(*) AS labelled, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM u JOIN labels ON TRY_CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) = doc_id
  WHERE toxic IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
s AS (SELECT host, regexp_replace(path, '[0-9]+', '<n>', 'g') AS shape, count(*) AS n, coalesce(sum(labelled), 0) AS labelled,
  coalesce(sum(bad), 0) AS bad FROM u LEFT JOIN m USING (page_id) GROUP BY ALL),
r0 AS (SELECT *, list_filter(string_split(shape, '/'), lambda x: x <> '') AS segs, '' AS t0 FROM s),{",".join(steps)},
f AS (SELECT host, shape, labelled, bad, CASE WHEN len(segs) > {LEVELS} THEN t{LEVELS} || '/**' ELSE t{LEVELS} END AS template
  FROM r{LEVELS}),
g AS (SELECT CASE WHEN sum(labelled) > 0 THEN 1 - sum(bad)::DOUBLE / sum(labelled)::DOUBLE ELSE 1 END AS prior FROM s),
q AS (SELECT host, template, (sum(labelled) - sum(bad) + {WEIGHT}::DOUBLE * any_value(prior)) / (sum(labelled) + {WEIGHT}::DOUBLE)
  AS purity FROM f, g GROUP BY ALL)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END AS verdict,
  template, purity
FROM (SELECT *, regexp_replace(path, '[0-9]+', '<n>', 'g') AS shape FROM u) JOIN f USING (host, shape) JOIN q USING (host, template)"""


ORACLES["op3_url_templates"] = _url_sql()


@query
def op11_whitening(spark: SparkSession, location: str) -> DataFrame:
    return whiten(read_table(spark, location, "embeddings"), components=4, scale=256)


@query
def op12_piece_spans(spark: SparkSession, location: str) -> DataFrame:
    found = encode_pieces(read_table(spark, location, "documents"), "piece_bpe_32k.model")
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.array_max("ends").alias("n_bytes"))


@query
def op13_vector_codes(spark: SparkSession, location: str) -> DataFrame:
    coded, books = compress_vectors(read_table(spark, location, "embeddings"), 8, 16, 6, 4096)
    ordered = F.array_sort(F.collect_list(F.struct("part", "entry", "components")))
    written = books.agg(F.array_join(F.flatten(F.transform(ordered, lambda b: b["components"])).cast("array<string>"), ","))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return coded.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
                        F.sha2(F.lit(written.first()[0]), 256).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    def assigned(i):
        return f"""a{i} AS MATERIALIZED (SELECT n, part, entry, d FROM (
    SELECT p.n, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN b{i} b ON p.part = b.part AND p.j = b.j GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY n, part ORDER BY d, entry) = 1)"""
    steps = []
    for i in range(rounds):
        steps.append(assigned(i))
        steps.append(f"""s{i} AS (SELECT a.part, a.entry, p.j, sum(p.x) AS s, count(*) AS c
  FROM a{i} a JOIN p ON a.n = p.n AND a.part = p.part GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.j, CAST(CASE WHEN c IS NULL THEN b.x ELSE (s - ((s % c) + c) % c) // c END AS BIGINT) AS x
  FROM b{i} b LEFT JOIN s{i} s ON b.part = s.part AND b.entry = s.entry AND b.j = s.j)""")
    return f"""
WITH r AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS n, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT CAST(greatest(1, ceil(max(len(embedding)) / {parts}.0)) AS BIGINT) AS width FROM r),
l AS (SELECT n, width, unnest(range(width * {parts})) AS k,
  unnest(list_concat(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)),
    list_transform(range(width * {parts} - len(embedding)), lambda x: CAST(0 AS BIGINT)))) AS x FROM r, w),
p AS MATERIALIZED (SELECT n, k // width AS part, k % width AS j, x FROM l),
e AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS entry FROM (
  SELECT n, row_number() OVER (PARTITION BY vec_id ORDER BY list_concat(list_transform(embedding,
    lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)), [CAST(0 AS BIGINT)])) AS copy FROM r) WHERE copy = 1 ORDER BY n LIMIT {entries}),
b0 AS MATERIALIZED (SELECT part, entry, j, x FROM e JOIN p ON e.n = p.n),
{", ".join(steps)},
{assigned(rounds)},
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT n, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, sum(d) AS error FROM a{rounds} GROUP BY n)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN r ON o.n = r.n, h"""


ORACLES["op13_vector_codes"] = _codes_sql()
