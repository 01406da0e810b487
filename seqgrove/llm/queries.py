"""The registered queries of these operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, decontaminate, jaccard_join, license_scan, lm_scoring, mixing, source_divergence, token_counts, token_output, topk_search, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Both turns of the conversation that is added to the table.
TRICKY = "\\### Assistant: </turn> ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = rows.unionByName(extra)
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    events = rows.select(F.col("conv_id").alias("conv"), seq.alias("seq"), F.lit("message").alias("kind"), seq.alias("message"), "role", "text")
    back = chat_format.read_back(chat_format.format_chats(events))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l'))
          + length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')) + 14 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_of(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT] AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, pos)),
g AS (
  SELECT *, first_value(CASE WHEN left_words::DOUBLE / left_weight::DOUBLE * weight::DOUBLE < cap::DOUBLE THEN left_words::DOUBLE / left_weight::DOUBLE END IGNORE NULLS)
            OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE level * weight::DOUBLE END AS target FROM g),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN 2 * start + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         from_hex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
q AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (substr(bits, (i * 5 + 1)::BIGINT, 5)::BIT::INTEGER) + 1, 1)), '') AS payload_digest
  FROM (SELECT * FROM p)),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM r
"""



def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_table(spark, sf_dir, "documents")).select("doc_id", "digest", "license_id", "notices")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lm_scoring.held_out_rows(F.col("doc_id"))
    s = lm_scoring.score_texts(_table(spark, sf_dir, "documents"), ~held)
    return s.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 75 * (u.n + v.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b)::BIGINT AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP9_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM k GROUP BY 1),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
             1 + (1000000000 * (coalesce(n.n, 0)::HUGEINT + 1)) // (g.total::HUGEINT + v.v) AS p,
             1 + (1000000000 * (k.all_n::HUGEINT + 1)) // (v.lang_n::HUGEINT + v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dropped = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    reports = conversation_repair.with_digest(conversation_repair.repair(rows, dropped=dropped))
    return reports.withColumnRenamed("conv", "conv_id")


def _edit(cost: str, way: str, letter: str, said: str = "") -> str:
    """A way with one more edit. Ways are cost (9 digits), audit, chr(1) and the turns, each after a line feed: the least in
    string order is the cheapest, then the one of least audit."""
    more = f" || chr(10) || {said}" if said else ""
    return f"(lpad((left({way}, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({way}, 10, strpos({way}, chr(1)) - 10) || '{letter}' || substr({way}, strpos({way}, chr(1))){more})"


def _inserted(*ways: str) -> str:
    return ", ".join(_edit("5", w, "I", "'user:'") for w in ways)


_USER, _ASSISTANT = "'user:' || r['text']", "'assistant:' || r['text']"
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
m AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM m),
f AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM o),
g AS (SELECT *, shown = '' OR again AS must_go, shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS cut FROM f),
steps AS (SELECT conv_id, max(i) AS n, list({{'role': role, 'text': text, 'must_go': must_go, 'cut': cut}} ORDER BY i) AS rows FROM g GROUP BY 1),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' || chr(1) AS s0, NULL::VARCHAR AS s1, '000000005I' || chr(1) || chr(10) || 'user:' AS s2,
         '000000010II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:' AS s3 FROM steps
  UNION ALL
  SELECT conv_id, i, s0, s1, least(u, {_inserted("s0", "s1", "a")}),
         least(a, {", ".join(_edit("5", w, "I", "'assistant:'") for w in ("u", _edit("5", "s0", "I", "'user:'"), _edit("5", "s1", "I", "'user:'")))})
  FROM (
    SELECT conv_id, i, {_edit("2", "s0", "D")} AS s0,
           least({_edit("2", "s1", "D")}, CASE WHEN kept AND c = 's' THEN {_edit("k", "s0", "K", "said")} END) AS s1,
           least({_edit("2", "s2", "D")}, CASE WHEN kept AND c = 'u' THEN {_edit("k", "s013", "K", "said")} END, CASE WHEN kept THEN {_edit("k + 1", "s013", "R", _USER)} END) AS u,
           least({_edit("2", "s3", "D")}, CASE WHEN kept AND c = 'a' THEN {_edit("k", "s2", "K", "said")} END, CASE WHEN kept THEN {_edit("k + 1", "s2", "R", _ASSISTANT)} END) AS a
    FROM (SELECT dp.conv_id, dp.i + 1 AS i, s0, s1, s2, s3, least(s0, s1, s3) AS s013, rows[dp.i + 1] AS r, NOT r['must_go'] AS kept, left(r['role'], 1) AS c, 5 * r['cut']::INTEGER AS k, r['role'] || ':' || r['text'] AS said
          FROM dp JOIN steps ON dp.conv_id IS NOT DISTINCT FROM steps.conv_id WHERE dp.i < n))),
best AS (SELECT dp.conv_id, least(s0, s3) AS way FROM dp JOIN steps ON dp.conv_id IS NOT DISTINCT FROM steps.conv_id WHERE i = n),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (shown = '') AS blank, count(*) FILTER (shown <> '' AND again) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(way, 9)::BIGINT, 0) AS cost, coalesce(substr(way, 10, strpos(way, chr(1)) - 10), '') AS audit,
       sha256(coalesce(substr(way, strpos(way, chr(1)) + 2), '')) AS repaired_sha256
FROM every LEFT JOIN faults ON every.conv_id IS NOT DISTINCT FROM faults.conv_id LEFT JOIN best ON every.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_decontamination": op3_decontamination,
    "op4_token_output": op4_token_output,
    "op5_mixing": op5_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_topk_search": op9_topk_search,
    "op10_warc": op10_warc,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_counts": op13_token_counts,
}
ORACLE: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op2_chat_formatting": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_topk_search": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}
