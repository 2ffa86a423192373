"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tersely.llm.ball_kmeans import cluster_vectors
from tersely.llm.chat_format import format_chats
from tersely.llm.common import read_table
from tersely.llm.decontaminate import contaminated
from tersely.llm.impact_search import search
from tersely.llm.jaccard_join import join_similar
from tersely.llm.media import text_media
from tersely.llm.mixing import mix_sources
from tersely.llm.quality_classifier import classify
from tersely.llm.quality_rules import apply_rules
from tersely.llm.secrets import find_secrets
from tersely.llm.substring_dedup import dedup_substrings
from tersely.llm.suffix_dedup import dedup_suffixes
from tersely.llm.token_counts import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(read_table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("rk")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read_table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_secret_scans": op7_secret_scans,
    "op8_decontamination": op8_decontamination,
    "op9_chat_format": op9_chat_format,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_media_columns": op12_media_columns,
    "op13_ball_kmeans": op13_ball_kmeans,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_mix_sources"] = """
WITH RECURSIVE docs AS (SELECT doc_id, source, greatest(1, ceil(coalesce(strlen(text), 0) / 4))::BIGINT AS tokens FROM documents),
per AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY source),
whole AS (SELECT sum(tokens)::DOUBLE AS total, count(*)::DOUBLE AS n, floor(sum(tokens) * 1.0)::BIGINT AS budget FROM per),
evens(i, low, width) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN (SELECT ln(sum(pow(tokens / total, low + width / 2))) - (low + width / 2) * sum(pow(tokens / total, low + width / 2) * ln(tokens / total)) / sum(pow(tokens / total, low + width / 2)) >= 0.95 * ln(any_value(n)) FROM per, whole)
    THEN low + width / 2 ELSE low END, width / 2 FROM evens WHERE i < 45),
withins(i, low, width) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN (SELECT pow(min(tokens / total), low + width / 2 - 1) / sum(pow(tokens / total, low + width / 2)) * any_value(budget) / any_value(total) > 4.0 FROM per, whole)
    THEN low + width / 2 ELSE low END, width / 2 FROM withins WHERE i < 45),
one AS (SELECT -sum(tokens / total * ln(tokens / total)) >= 0.95 * ln(any_value(n)) AS even, pow(min(tokens / total), -1) / count(*) * any_value(budget) / any_value(total) <= 4.0 AS within0, any_value(budget) / any_value(total) <= 4.0 AS within1 FROM per, whole),
exponent AS (SELECT greatest(
  CASE WHEN even THEN 1.0 ELSE (SELECT low FROM evens WHERE i = 45) END,
  CASE WHEN NOT within1 THEN 1.0 WHEN within0 THEN 0.0 ELSE (SELECT low + width FROM withins WHERE i = 45) END) AS a FROM one),
z AS (SELECT sum(pow(tokens / total, a)) AS z FROM per, whole, exponent),
sources AS (SELECT source, tokens AS all_tokens, least(floor(pow(tokens / total, a) / z * budget + 1e-6), floor(tokens * 4.0))::BIGINT AS budget, ceil(tokens / 262144)::BIGINT AS blocks FROM per, whole, exponent, z),
planned AS (SELECT *, budget // all_tokens AS whole, budget - budget // all_tokens * all_tokens AS rest FROM sources WHERE budget > 0),
copies AS (
  SELECT d.doc_id, d.source, d.tokens, p.*EXCLUDE (source), unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch
  FROM docs d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source),
keyed AS (SELECT *, md5('0|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS key FROM copies),
dealt AS (SELECT *, ('0x' || substr(key, 1, 15))::BIGINT % blocks AS block FROM keyed),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY block, key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM dealt)
SELECT doc_id, source, tokens, epoch::BIGINT AS epoch, block, round(least(1.0::DOUBLE, (epoch * all_tokens + block * all_tokens / blocks) / budget), 9) AS position, key
FROM summed WHERE epoch < whole OR upto <= rest
"""

ORACLE_SQL["op9_chat_format"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
pre AS (SELECT conv_id, place, n, string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far FROM placed),
whole AS (SELECT n, so_far, min(conv_id) AS conv_id, count(*) AS n_copies FROM pre WHERE place = n GROUP BY n, so_far),
kept AS (SELECT w.* FROM whole w WHERE NOT EXISTS (SELECT 1 FROM pre p WHERE p.place < p.n AND p.place = w.n AND p.so_far = w.so_far))
SELECT k.conv_id, k.n AS n_turns, k.n_copies, string_agg('<|' || p.role || '|>' || chr(10) || p.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY p.place) AS chat
FROM kept k JOIN placed p USING (conv_id) GROUP BY k.conv_id, k.n, k.n_copies
"""

ORACLE_SQL["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
lines AS (SELECT r, doc_id, source, line FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
norm AS (SELECT r, doc_id, source, array_to_string(regexp_extract_all(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
frequent AS (SELECT norm.source, line FROM norm JOIN hosts h ON h.source IS NOT DISTINCT FROM norm.source GROUP BY norm.source, line HAVING count(DISTINCT r) > 10 AND 100 * count(DISTINCT r) > 5 * any_value(h.n)),
lost AS (SELECT r, sum(words)::BIGINT AS n FROM norm JOIN frequent f ON norm.line = f.line AND norm.source IS NOT DISTINCT FROM f.source GROUP BY r),
figures AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_line_words
  FROM w LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_line_words) >= 30 * n_words AS kept
FROM figures
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op4_suffix_array_dedup"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
windows AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
later AS (SELECT r, i FROM (SELECT r, i, coalesce(doc_id, 9223372036854775807) AS id, min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY k) AS first FROM windows) WHERE id > first),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM later),
spans AS (SELECT r, count(*) AS n, count(*) FILTER (fresh) AS spans FROM (SELECT r, p, p - 1 IS DISTINCT FROM lag(p) OVER (PARTITION BY r ORDER BY p) AS fresh FROM gone) GROUP BY r),
bytes AS (SELECT r, unnest(range(0, length(h) // 2)) AS p, h FROM d WHERE r IN (SELECT r FROM spans)),
kept AS (SELECT b.r, string_agg(substr(b.h, 2 * b.p + 1, 2), '' ORDER BY b.p) AS h FROM bytes b ANTI JOIN gone g ON g.r = b.r AND g.p = b.p GROUP BY b.r)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN s.n IS NULL THEN d.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM d LEFT JOIN spans s ON s.r = d.r LEFT JOIN kept k ON k.r = d.r
"""

ORACLE_SQL["op5_substring_dedup"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
windows AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
rows AS (SELECT r, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM d),
kept AS (SELECT w.r, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS text FROM rows w ANTI JOIN gone g ON g.r = w.r AND g.p = w.p GROUP BY w.r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, (len(d.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.r = d.r
"""

ORACLE_SQL["op6_ngram_jaccard_join"] = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

ORACLE_SQL["op8_decontamination"] = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
places AS (SELECT doc_id AS id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
item_places AS (SELECT item_id AS id, w, unnest(range(1, len(w) + 1)) AS p FROM items WHERE len(w) >= 8),
seeds AS (
  SELECT id, p, '0 ' || w[p] || ' ' || w[p + 1] || ' ' || w[p + 3] || ' ' || w[p + 4] || ' ' || w[p + 6] || ' ' || w[p + 7] AS seed FROM places WHERE p + 7 <= len(w)
  UNION ALL SELECT id, p, '1 ' || w[p] || ' ' || w[p + 1] || ' ' || w[p + 4] || ' ' || w[p + 6] || ' ' || w[p + 8] || ' ' || w[p + 9] FROM places WHERE p + 9 <= len(w)),
item_seeds AS (
  SELECT id, p, '0 ' || w[p] || ' ' || w[p + 1] || ' ' || w[p + 3] || ' ' || w[p + 4] || ' ' || w[p + 6] || ' ' || w[p + 7] AS seed FROM item_places WHERE p + 7 <= len(w)
  UNION ALL SELECT id, p, '1 ' || w[p] || ' ' || w[p + 1] || ' ' || w[p + 4] || ' ' || w[p + 6] || ' ' || w[p + 8] || ' ' || w[p + 9] FROM item_places WHERE p + 9 <= len(w)),
hits AS (SELECT DISTINCT s.id AS doc_id, i.id AS item_id, s.p - i.p AS shift FROM seeds s JOIN item_seeds i ON s.seed = i.seed),
pairs AS (SELECT h.doc_id, h.item_id, h.shift, i.p, d.w[i.p + h.shift] = i.w[i.p] AS same FROM hits h JOIN item_places i ON i.id = h.item_id JOIN d ON d.doc_id = h.doc_id WHERE i.p + h.shift BETWEEN 1 AND len(d.w)),
sums AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER o AS s, sum(same::INT) OVER o AS m FROM pairs WINDOW o AS (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS UNBOUNDED PRECEDING)),
now AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS UNBOUNDED PRECEDING)) AS now FROM sums),
since AS (SELECT *, m - coalesce(max(CASE WHEN now = 0 THEN m END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS UNBOUNDED PRECEDING), 0) AS matched, max(now) OVER (PARTITION BY doc_id, item_id, shift) AS best, sum(same::INT) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM now),
found AS (SELECT doc_id, item_id, shift, any_value(best) AS best, any_value(total) AS total, arg_min(matched, p) AS matched FROM since WHERE now = best GROUP BY doc_id, item_id, shift)
SELECT doc_id, item_id, max(best)::BIGINT AS score, max(matched)::BIGINT AS n_matched FROM found JOIN items USING (item_id) WHERE best >= 12 OR 100 * total >= 75 * len(items.w) GROUP BY doc_id, item_id
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL["op11_ranked_search"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS words FROM documents),
whole AS (SELECT count(*) AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
q AS MATERIALIZED (SELECT item_id, text, unnest(list_distinct({TERMS})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term),
scores AS (
  SELECT q.item_id, q.text, tf.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.words) * n) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN d ON d.r = tf.r, whole GROUP BY q.item_id, q.text, tf.r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def kmeans_sql(rounds: int = 10) -> str:
    """Every vector against every centroid, round by round."""
    near = "a{0} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, sum((e.x - k.x) * (e.x - k.x))::BIGINT AS d FROM e JOIN k{0} k USING (p) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
    move = "k{1} AS MATERIALIZED (SELECT c, p, coalesce(m.x, k.x) AS x FROM k{0} k LEFT JOIN (SELECT c, p, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM e JOIN a{0} USING (r) GROUP BY c, p) m USING (c, p))"
    steps = ",\n".join(f"{near.format(i)},\n{move.format(i, i + 1)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
whole AS (SELECT r FROM (SELECT r, unnest(embedding)::DOUBLE AS x FROM v) GROUP BY r HAVING count(x) = 64 AND bool_and(isfinite(x))),
e AS MATERIALIZED (SELECT r, p, floor(1024 * x)::BIGINT AS x FROM (SELECT r, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS p FROM v SEMI JOIN whole USING (r))),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v SEMI JOIN whole USING (r) QUALIFY c < 8),
k0 AS MATERIALIZED (SELECT c, p, x FROM first JOIN e USING (r)),
{steps},
{near.format(rounds)},
digests AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM k{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN digests USING (c)
"""


ORACLE_SQL["op13_ball_kmeans"] = kmeans_sql()


def media_sql() -> str:
    """The file of each text in hexadecimal, box by box, and the CRC by its table."""

    def name(kind: str) -> str:
        return f"'{kind.encode().hex()}'"

    def u32(*values: object) -> str:
        return " || ".join(f"printf('%08x', {v})" for v in values)

    def box(kind: str, body: str) -> str:
        return f"printf('%08x', length({body}) // 2 + 8) || {name(kind)} || {body}"

    matrix = u32(65536, 0, 0, 0, 65536, 0, 0, 0, 1073741824)
    entry = u32(86) + " || " + name("raw ") + " || '0000000000000001' || repeat('00', 16) || '0010000c0048000000480000000000000001' || repeat('00', 32) || '0028ffff'"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
sized AS (SELECT *, length(h) // 2 AS n_bytes, greatest(1, (length(h) // 2 + 191) // 192) AS n FROM d),
p AS MATERIALIZED (SELECT r, doc_id, n_bytes, n, h || repeat('20', 192 * n - n_bytes) AS payload, (n + 7) // 8 AS chunks, n % 8 AS rest, (n + 11) // 12 AS keys, (n >= 8)::INT + (n % 8 > 0)::INT AS runs,
  593 + 4 * ((n + 11) // 12) + 12 * ((n >= 8)::INT + (n % 8 > 0)::INT) + 4 * ((n + 7) // 8) AS start FROM sized),
lists AS (SELECT r, (SELECT string_agg(printf('%08x', 12 * i + 1), '' ORDER BY i) FROM unnest(range(keys)) t(i)) AS key_list, (SELECT string_agg(printf('%08x', start + 1536 * i), '' ORDER BY i) FROM unnest(range(chunks)) t(i)) AS places,
  (SELECT string_agg(start + 2304 * i || '+192', ',' ORDER BY i) FROM unnest(range(keys)) t(i)) AS ranges FROM p),
stbl AS (SELECT *, {box("stsd", f"({u32(0, 1)} || {entry})")} || {box("stts", f"({u32(0, 1, 'n', 1)})")} || {box("stss", f"({u32(0, 'keys')} || key_list)")}
  || {box("stsc", f"({u32(0, 'runs')} || CASE WHEN n >= 8 THEN {u32(1, 8, 1)} ELSE '' END || CASE WHEN rest > 0 THEN {u32('chunks', 'rest', 1)} ELSE '' END)")} || {box("stsz", f"({u32(0, 192, 'n')})")} || {box("stco", f"({u32(0, 'chunks')} || places)")} AS stbl FROM p JOIN lists USING (r)),
minf AS (SELECT *, {box("vmhd", f"({u32(1, 0, 0)})")} || {box("dinf", f"({u32(28)} || {name('dref')} || {u32(0, 1, 12)} || {name('url ')} || {u32(1)})")} || {box("stbl", "stbl")} AS minf FROM stbl),
mdia AS (SELECT *, {box("mdhd", f"({u32(0, 0, 0, 25, 'n', 0x55C40000)})")} || {box("hdlr", f"({u32(0, 0)} || {name('vide')} || {u32(0, 0, 0)} || {name('frames')} || '00')")} || {box("minf", "minf")} AS mdia FROM minf),
trak AS (SELECT *, {box("tkhd", f"({u32(7, 0, 0, 1, 0, 'n', 0, 0, 0, 0)} || {matrix} || {u32(16 << 16, 12 << 16)})")} || {box("mdia", "mdia")} AS trak FROM mdia),
moov AS (SELECT *, {box("mvhd", f"({u32(0, 0, 0, 25, 'n', 65536)} || '0100' || repeat('00', 10) || {matrix} || repeat('00', 24) || {u32(2)})")} || {box("trak", "trak")} AS moov FROM trak),
media AS (SELECT *, {u32(24)} || {name("ftyp")} || {name("qt  ")} || {u32(0)} || {name("qt  isom")} || {box("moov", "moov")} || {box("mdat", "payload")} AS media FROM moov),
crcs(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crcs WHERE k < 8),
crc(r, i, c) AS (SELECT r, 0, 4294967295::BIGINT FROM p UNION ALL
  SELECT crc.r, crc.i + 1, xor(c >> 8, v) FROM crc JOIN p USING (r) JOIN crcs ON k = 8 AND crcs.i = xor(c & 255, ('0x' || substr(payload, length(payload) - 31 + 2 * crc.i, 2))::BIGINT) WHERE crc.i < 16)
SELECT doc_id, n_bytes, 192 * n AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, xor(c, 4294967295) AS tail_crc32, length(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'raw :' || 40 * n || ':' || n || ':' || ranges AS feature, 'raw ' AS codec, 40 * n AS duration_ms, keys AS n_keyframes
FROM media JOIN crc USING (r) WHERE i = 16
"""


ORACLE_SQL["op12_media_columns"] = media_sql()
