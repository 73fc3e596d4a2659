"""The registered queries of this subpackage: one per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskengine.llm import (
    chat, collocations, decontaminate, fim, html_extract, langid, mixing, quality, secrets, simhash, substring, token_counts, token_ids)
from riskengine.llm.common import read

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")))


# The planted conversation of op2's contract: its texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    events = chat.events_of(table.unionByName(extra))
    return chat.digest(chat.read_back(chat.render(chat.reconstruct(events))))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.rules(docs, read(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract(read(spark, sf_dir, "pages")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, read(spark, sf_dir, "benchmark")))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents").select("lang", "text"))


IDS_TOKENIZER = "byte_bpe_50k.json"


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_ids.digest(token_ids.round_trip(docs, tokenizer_path(IDS_TOKENIZER)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_chat, op3_quality, op4_simhash, op5_langid, op6_html, op7_secrets, op8_substring, op9_tokens,
                            op10_decontaminate, op11_fim, op12_phrases, op13_token_ids)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM docs GROUP BY source),
shares AS (
  SELECT *, 3 * source_size AS cap,
         3 * source_size * (sum(w) OVER () - coalesce(sum(w) OVER before, 0))
           <= w * (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) AS capped
  FROM per
  WINDOW before AS (ORDER BY 3 * source_size / CAST(w AS DOUBLE), source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (sum(source_size) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target,
         CAST(greatest(1, ceil(sqrt(CAST(source_size AS DOUBLE)))) AS BIGINT) AS n_blocks
  FROM shares),
placed AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, d.place % t.n_blocks AS block
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
blocks AS (
  SELECT source, block, source_size, target, CAST(sum(size) AS BIGINT) AS words,
         CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS INTEGER)) ELSE 0 END AS base
  FROM placed GROUP BY source, block, source_size, target),
fill AS (
  SELECT 0 AS pass, *, target - CAST(base * source_size AS DOUBLE) AS missing, 0 AS extra FROM blocks
  UNION ALL
  SELECT pass + 1, source, block, source_size, target, words, base,
         missing - CAST(sum(CASE WHEN now THEN words ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE),
         CASE WHEN now THEN 1 ELSE extra END
  FROM (SELECT *, free AND sum(CASE WHEN free THEN words ELSE 0 END) OVER (
                    PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= missing AS now
        FROM (SELECT *, extra = 0 AND base < 3 AND words <= missing AS free FROM fill) f) n
  QUALIFY bool_or(now) OVER ()),
filled AS (SELECT * FROM fill WHERE pass = (SELECT max(pass) FROM fill))
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(d.size * (b.base + b.extra) AS BIGINT) AS taken
FROM placed d JOIN filled b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block
"""


def _escaped(column: str) -> str:
    """Escaping of ``chat``, spelled out for an engine without lookahead."""
    angle, square = "|".join(chat.ANGLE_RESTS), "|".join(chat.SQUARE_RESTS)
    return (f"regexp_replace(regexp_replace({column}, '(<)(\\\\*)({angle})', '\\1\\\\\\2\\3', 'g'), "
            f"'(\\[)(\\\\*)({square})', '\\1\\\\\\2\\3', 'g')")


OP2_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
sized AS (
  SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS flat_role FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(24 + length({_escaped('flat_role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM joined
"""

OP8_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT r, ws, unnest(range(1, len(ws) - {substring.WINDOW} + 2)) AS i FROM docs WHERE len(ws) >= {substring.WINDOW}),
windows AS (SELECT r, i, array_to_string(ws[i:i + {substring.WINDOW - 1}], ' ') AS win FROM places),
repeated AS (SELECT r, i FROM windows WHERE win IN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {substring.WINDOW})) AS p FROM repeated),
marked AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
kept AS (SELECT k.r, string_agg(k.w, ' ' ORDER BY k.p) AS t
         FROM words k ANTI JOIN gone g ON k.r = g.r AND k.p = g.p GROUP BY k.r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN marked m ON d.r = m.r LEFT JOIN kept k ON d.r = k.r
"""

_FOLDED = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP10_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS ws FROM benchmark),
grams AS (SELECT DISTINCT item, least(len(ws), {decontaminate.N_GRAM}) AS n, unnest(list_transform(
            range(1, greatest(1, len(ws) - {decontaminate.N_GRAM - 1}) + 1),
            lambda i: array_to_string(ws[i:i + least(len(ws), {decontaminate.N_GRAM}) - 1], ' '))) AS gram
          FROM items WHERE len(ws) > 0),
places AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(ws) >= n),
hits AS (SELECT p.r, p.i, p.n, g.item FROM places p JOIN grams g ON g.n = p.n AND array_to_string(p.ws[p.i:p.i + p.n - 1], ' ') = g.gram),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.names, '')) AS items_sha256,
       coalesce(w.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words w ON d.r = w.r LEFT JOIN found f ON d.r = f.r
"""

OP11_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, {', '.join(f"CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))}
  FROM docs),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fim.FIM_PERCENT}
              THEN 'plain' WHEN h4 % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM listed, range(1, 4) r(k))),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f
         WHERE k >= 2 AND c >= {collocations.MIN_COUNT}),
cuts AS (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp
         FROM cand c, range(1, 3) r(j) WHERE j < c.k),
rated AS (SELECT c.lang, c.k, c.phrase, c.a, j, l.c AS l, r.c AS r,
                 CAST({collocations.SCALE}::HUGEINT * c.a * c.a // (l.c::HUGEINT * r.c) AS BIGINT) AS score
          FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp AND l.k = c.j
          JOIN f r ON r.lang = c.lang AND r.phrase = c.rp AND r.k = c.k - c.j),
least AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN cand g ON g.lang = s.lang AND g.k > s.k
         AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.a >= {collocations.CONTAINED_PERCENT} * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least JOIN totals USING (lang) ANTI JOIN gone USING (lang, phrase)
QUALIFY rank <= {collocations.TOP}
"""

ORACLES: dict[str, str] = {"op1_mixing": OP1_SQL, "op2_chat": OP2_SQL, "op8_substring": OP8_SQL,
                           "op10_decontaminate": OP10_SQL, "op11_fim": OP11_SQL, "op12_phrases": OP12_SQL}
