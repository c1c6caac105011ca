"""The queries of this package, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import chat, editcount, media, mixing, neardup, packing, pages, quality, secrets, stages, topk
from termweave.llm.common import read, text_of

ODD_TURN = "\\### Assistant: </turn> ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), keep=[])
    return mixed.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = secrets.of_kinds(F.col("secret_spans"), 0, len(secrets.BASE) - 1)
    counts = [F.size(secrets.of_kinds(F.col("secret_spans"), i, i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.described(base).cast("binary"), 256).alias("base_sha256"), secrets.described(F.col("secret_spans")).alias("spans"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts become a media column; what is returned is read from that column by an operator of its own."""
    return media.read_media(media.to_media(read(spark, sf_dir, "documents"))).drop("error")


def op4_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(ODD_TURN).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    return chat.read_back(chat.format_conversations(rows.unionByName(odd)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, read(spark, sf_dir, "labels"))
    scored = quality.with_score(documents, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), n=4)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to each document: words put in after a third, 40 characters cut from the middle, the last ten replaced."""
    n = F.length(text_of()).cast("int")
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("text"))
    edits = F.array(edit(n / 3, n / 3, " (put in later) "), edit(n / 2, n / 2 + 40, ""), edit(n - 34, n - 24, "the end."))
    trees = editcount.with_trees(read(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")))
    out = editcount.apply_edits(trees)
    return out.select("doc_id", "n_pretokens", "n_tokens", "tokens_after", "chars_after", "chars_encoded_again")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_media_columns, op4_format_chat, op5_quality, op6_extract_html, op7_pack, op8_exact_top_k, op9_minhash_near_dedup, op10_token_counts, pipeline)}


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::VARCHAR), 1, 15) AS BIGINT) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS clamp_at, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS r FROM sources),
levels AS (
  SELECT r, clamp_at / weight AS own,
         ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE - coalesce(sum(clamp_at) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl, weight, clamp_at
  FROM ordered),
level AS (SELECT arg_min(lvl, r) AS lvl FROM levels WHERE lvl * weight <= clamp_at),
targets AS (
  SELECT o.source, source_size, coalesce(least(clamp_at, lvl * weight), clamp_at) AS target
  FROM ordered o CROSS JOIN level),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.epochs, round(p.target)::BIGINT - p.epochs * p.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.place) AS tied, count(*) OVER (PARTITION BY d.source, d.place) AS n
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + CASE WHEN upto <= need THEN size WHEN upto - tied < need THEN least(size, (need - upto + tied) // n) ELSE 0 END)::BIGINT AS taken
FROM run
"""

def _op2_sql() -> str:
    """Positions are running sums of the lengths of the pieces between matches and of the matches."""
    parts, kinds = [], []
    for n, r in enumerate(secrets.RULES):
        pattern = r.java.replace("'", "''")
        kinds.append(f"'{r.kind}'")
        parts.append(
            f"SELECT doc_id, {n} AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS start, length(h[i]) AS size "
            f"FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {r.group}) AS g FROM texts)) WHERE length(g[i]) >= {r.least}"
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
named AS (SELECT doc_id, kind, start::BIGINT AS start, ([{", ".join(kinds)}])[kind + 1] || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM found),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN summed USING (doc_id)
"""


OP2_SQL = _op2_sql()

OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
pieces AS (
  SELECT *, '### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' WHEN 'tool' THEN 'Tool' ELSE '=' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') END
         || ': ' || regexp_replace(text, '([\\#<:])', '\\\1', 'g') || ' </turn>' || chr(10) AS piece FROM turns),
whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(length(piece))::BIGINT AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END, '' ORDER BY turn NULLS LAST, role, text) AS roles
  FROM pieces GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
       regexp_full_match(roles, 's|s?u(a[ut])*a?') AS well_formed
FROM whole
"""

OP8_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
both_ways AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_ways JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * i >= 80 * (p.n + q.n - i)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_secret_scan": OP2_SQL, "op4_format_chat": OP4_SQL, "op8_exact_top_k": OP8_SQL, "op9_minhash_near_dedup": OP9_SQL}
