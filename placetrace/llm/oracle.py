"""Checking SQL for the queries whose results SQL can express, over the same whole tables."""

ORACLE = {}

# All pairs of documents that share a three-word shingle, by whole numbers, and the groups they form.
ORACLE["op4_minhash_join"] = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS q FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * q >= 85 * (x.n + y.n - q)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, root) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT b, root FROM reached JOIN both_ways ON a = doc_id WHERE root < b)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id, d.doc_id = min(root) AS kept
FROM reached d LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

# All pairs of vectors.
ORACLE["op10_embedding_links"] = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached(vec_id, root) AS (SELECT vec_id, vec_id FROM v
  UNION SELECT b, root FROM reached JOIN links ON a = vec_id WHERE root < b)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, min(root)::BIGINT AS component_id,
  vec_id = min(root) AS kept FROM reached GROUP BY vec_id"""

# All windows of 100 bytes, told apart by MD5, in the order of doc_id and start.
ORACLE["op3_suffix_dedup"] = """WITH raw AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, n, b, substr(h, 2 * b + 1, 1200) AS part
  FROM (SELECT doc_id, n, h, unnest(range(0, n - 99, 500)) AS b FROM raw WHERE n >= 100)),
windows AS (SELECT doc_id, b + i AS s, md5_number(substr(part, 2 * i + 1, 200)) AS w
  FROM (SELECT doc_id, n, b, part, unnest(range(0, least(500, n - 99 - b))) AS i FROM blocks)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM windows)
  WHERE r > 1),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
numbered AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS low, max(s) + 100 AS high FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, high AS low, lead(low) OVER (PARTITION BY doc_id ORDER BY low) AS high FROM spans
  UNION ALL SELECT doc_id, 0, min(low) FROM spans GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * g.low + 1, 2 * (coalesce(g.high, n) - g.low)), '' ORDER BY g.low) AS h
  FROM gaps g JOIN raw USING (doc_id) GROUP BY g.doc_id),
totals AS (SELECT doc_id, sum(high - low) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT r.doc_id, r.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.h, r.h))) AS kept_sha256
FROM raw r LEFT JOIN kept k USING (doc_id) LEFT JOIN totals t USING (doc_id)"""

# The CRC by its table, the seeded ranks by windows.
ORACLE["op7_shards"] = """WITH RECURSIVE crc_step(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_step WHERE k = 8),
raw AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, source, n, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM raw),
sized AS (SELECT doc_id, n + 8 AS size, coalesce('s' || source, 'n') AS stratum,
    xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS crc
  FROM bytes, crc_table),
seeded AS (SELECT *, ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null') || '|' || crc::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u,
    ('0x' || substr(md5('7|' || stratum), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS phase FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, doc_id, crc, size) - 1 AS r,
    count(*) OVER (PARTITION BY stratum) AS n_s FROM seeded),
placed AS (SELECT *, row_number() OVER (ORDER BY (r + phase) / n_s, stratum, r) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (place * 24) // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (place - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut"""

# The CRC of every distinct feature by its table; gains, noise and ranks over all rows.
ORACLE["op13_importance_resample"] = r"""WITH RECURSIVE crc_step(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_step WHERE k = 8),
both_sides AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM both_sides),
runs AS (SELECT side, id, len(w) AS n, unnest(w) AS f FROM words
  UNION ALL SELECT side, id, len(w), unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT side, id, len(w), unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
counted AS (SELECT side, id, f, count(*) AS times FROM runs GROUP BY ALL),
coded AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(f)), '..'),
    lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table),
held AS (SELECT bucket, coalesce(sum(times) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(times) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t
  FROM counted JOIN coded USING (f) GROUP BY bucket),
totals AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM held),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM held, totals),
weights AS (SELECT id, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight
  FROM counted JOIN coded USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS fit,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 'd'),
ranked AS (SELECT doc_id, fit, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY fit) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r.fit AND r <= 5 * n // 100 THEN r END AS rank FROM scored JOIN ranked r USING (doc_id)"""


def _after(state, cost, letter, line=None):
    """SQL for a state (cost c, audit a, text t) after one more edit that adds ``line``."""
    text = f"{state}.t" if line is None else f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


def _repair_sql():
    """Row by row, the cheapest way to each state: nothing yet (z), after system (s), user (u) and assistant (a)."""
    blank = r"[^\x20\x09-\x0D]"

    def moved(source, initial, role):
        keep = _after(source, "e", "K", "role || ':' || text")
        if role is None:
            return f"CASE WHEN NOT must AND r = '{initial}' THEN {keep} END"
        recast = _after(source, "e + 2", "R", f"'{role}:' || text")
        return f"CASE WHEN must THEN NULL WHEN r = '{initial}' THEN {keep} ELSE {recast} END"

    def least(*options):
        return "list_min([" + ", ".join(options) + "])"

    gone = {x: _after(x, 3, "D") for x in "zsua"}
    step = f"""{gone["z"]} AS z, {least(gone["s"], moved("z", "s", None))} AS s,
      {least(gone["u"], *(moved(x, "u", "user") for x in "zsa"))} AS u, {least(gone["a"], moved("u", "a", "assistant"))} AS a"""
    user = least("u", *(_after(x, 2, "I", "'user:'") for x in "zsa"))
    first = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""WITH RECURSIVE crc_step(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_step WHERE k = 8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
hits AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295,
    list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 20 AS hit
  FROM named, crc_table),
spoilt AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM spoilt),
faults AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
    NOT regexp_matches(text, '{blank}') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    regexp_extract(text, '({blank})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut FROM placed),
seen AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS e FROM faults),
counted AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE NOT blank AND again) AS duplicate, sum(e) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id),
walk(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {first}::{kind}, NULL::{kind}, {{'c': 2, 'a': 'I', 't': 'user:'}}::{kind},
    {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}::{kind} FROM counted
  UNION ALL
  SELECT conv_id, i, z, s, u, {least("a", _after("u", 2, "I", "'assistant:'"))} FROM (
    SELECT conv_id, i, z, s, {user} AS u, a FROM (
      SELECT w.conv_id, w.i + 1 AS i, {step} FROM walk w JOIN seen x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1))),
ends AS (SELECT w.conv_id, list_min([z, a]) AS best FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id"""


ORACLE["op12_conversation_repair"] = _repair_sql()
