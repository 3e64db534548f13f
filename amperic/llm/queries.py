"""The text queries by name, and the SQL that checks them where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperic.llm import bpe, chat, hamming, lines, mixing, near, personal, product_codes, quality, repeats, resample, secret_scan, wrapper
from amperic.llm.common import documents, prepared

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir), vocabulary=RANKS, pattern=PATTERN)


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(documents(spark, sf_dir), vocabulary_path=RANKS, pattern=PATTERN, ids=False)


@query(
    """WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS lost FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query(
    """WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, '')) AS n, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
begun AS (
  SELECT doc_id, source, CAST(sum(n) OVER (PARTITION BY source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS begin FROM docs),
sizes AS (SELECT source, pow(CAST(sum(n) AS DOUBLE), 0.5) AS w FROM docs GROUP BY source),
exact AS (
  SELECT source, (1000 - (SELECT count(*) FROM sizes)) * w / (SELECT fsum(w) FROM sizes) AS e FROM sizes),
shares AS (
  SELECT row_number() OVER (ORDER BY source) AS i, source,
    1 + CAST(floor(e) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, source)
      <= 1000 - (SELECT CAST(sum(1 + floor(e)) AS BIGINT) FROM exact) THEN 1 ELSE 0 END AS n
  FROM exact),
turns AS (
  SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS i, (SELECT list(CAST(0 AS BIGINT) ORDER BY i) FROM shares) AS done
  UNION ALL
  SELECT r.t + 1, x.i, list_concat(r.done[1:x.i - 1], [r.done[x.i] + 1], r.done[x.i + 1:])
  FROM turns r, LATERAL (
    SELECT p.i FROM shares p WHERE r.done[p.i] < p.n AND r.done[p.i] * 1000 // p.n <= r.t
    ORDER BY (r.done[p.i] * 1000 + 1000 + p.n - 1) // p.n, p.n DESC, p.source LIMIT 1) x
  WHERE r.t < 1000),
plan AS (SELECT t - 1 AS slot, i, done[i] - 1 AS k FROM turns WHERE t > 0)
SELECT b.doc_id, b.source, begin // 16384 AS block, begin // 16384 // s.n * 1000 + p.slot AS slot,
  begin // 16384 * 1000 // s.n AS release, (begin // 16384 * 1000 + 1000 + s.n - 1) // s.n AS deadline, begin
FROM begun b JOIN shares s USING (source) JOIN plan p ON p.i = s.i AND p.k = begin // 16384 % s.n"""
)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return mixing.mix_sources(docs).drop("text")


@query(
    r"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
safe AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS t,
    replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS r
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 20) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id"""
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"),
    )
    done = chat.render(chat.fold_events(chat.streamed_events(rows.unionByName(more))))
    turns = chat.read_back(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_text(prepared(spark).read.parquet(f"{sf_dir}/pages.parquet"))


@query(
    """WITH codes AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true)),
pairs AS (
  SELECT q.id AS query_id, r.id AS neighbour_id,
    CAST(list_sum(list_transform(list_zip(q.code, r.code), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM codes q JOIN codes r ON q.id % 20 = 0 AND q.id <> r.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10"""
)
def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hamming.embedding_codes(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hamming.hamming_top_k(rows, rows.filter("id % 20 = 0"), k=10)


@query()
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


@query()
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the remaining text, the removed runs, and whether there are any."""
    done = repeats.remove_repeats(documents(spark, sf_dir)).drop("kept")
    return done.withColumnRenamed("kept_text", "kept").withColumn("repeats", F.col("n_removed") > 0)


@query()
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resample(documents(spark, sf_dir), target)


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 64) -> str:
    """The codebooks and codes of op12, all distances compared."""
    dims = range(1, width // parts + 1)
    gap = " + ".join(f"(x[{d}] - c[{d}]) * (x[{d}] - c[{d}])" for d in dims)
    low = lambda d: f"(sum(x[{d}]) - ((sum(x[{d}]) % count(*)) + count(*)) % count(*)) // count(*)"
    means = ", ".join(f"CAST({low(d)} AS BIGINT)" for d in dims)
    blocks = [
        f"""parts AS (
  SELECT vec_id, label, p, list_transform(embedding[p * {len(dims)} + 1 : (p + 1) * {len(dims)}], lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings, (SELECT unnest(range({parts})) AS p)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""book0 AS (
  SELECT p, row_number() OVER w - 1 AS e, x AS c FROM parts WINDOW w AS (PARTITION BY p ORDER BY vec_id, x) QUALIFY row_number() OVER w <= {entries})""",
    ]
    for r in range(rounds + 1):
        blocks.append(
            f"""near{r} AS (
  SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min({{'d': {gap}, 'e': e}}) AS m FROM parts JOIN book{r} USING (p) GROUP BY vec_id, p)"""
        )
        if r < rounds:
            blocks.append(
                f"""book{r + 1} AS (
  SELECT p, e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, m.e AS e, [{means}] AS c FROM near{r} GROUP BY 1, 2) n USING (p, e))"""
            )
    blocks.append(
        f"""coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)"""
    )
    return f"""WITH {", ".join(blocks)}
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.product_codes(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(documents(spark, sf_dir))
