"""The same results as SQL over the given tables, where SQL can express them.

Written from the definitions: no hashing, winnowing or bands. Tokenized packing, learnt scores
and drawn surrogates are beyond SQL; tests/llm compares them with plain code.
"""

from __future__ import annotations

from sittings.llm import license, sharding

WORD = r"[^\x20\x09-\x0D]+"
BLANK_WORD = r"[^\x20\x09-\x0D]"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM split
),
entries AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b USING (gram)
  WHERE a.doc_id < b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, b FROM either UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a
),
least AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least USING (doc_id)"""

LINES = f"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
),
triples AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
),
again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i FROM triples
              QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1))
  GROUP BY doc_id
),
lines AS (
  SELECT doc_id, source, text, line,
         array_to_string(regexp_extract_all({LOWERED.replace("text", "line")}, '{WORD}'), ' ') AS plain
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '{BLANK_WORD}')
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1),
common AS (
  SELECT source, plain FROM lines GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 20
),
gone AS (
  SELECT doc_id, CAST(sum(len(string_split(plain, ' '))) AS BIGINT) AS n_removed
  FROM lines SEMI JOIN common USING (source, plain) GROUP BY 1
),
counted AS (
  SELECT doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_removed, 0) AS n_removed
  FROM split LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id)
  LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * n_removed <= 60 * n_words AS kept
FROM counted"""

PASSAGES = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT doc_id, i FROM windows
        QUALIFY doc_id > min(doc_id) OVER (PARTITION BY gram))
),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN removed USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

BYTES = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n
  FROM documents
),
windows AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS gram
  FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM bytes)
),
starts AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY gram) > 1),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run
        FROM (SELECT doc_id, i,
                     CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400
                          THEN 0 ELSE 1 END AS opens
              FROM starts))
  GROUP BY doc_id, run
),
shorter AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 512)) AS gram
  FROM (SELECT doc_id, h, unnest(range(0, n - 255)) AS i FROM bytes)
),
again AS (
  SELECT doc_id, CAST(sum(least(256, coalesce(following - i, 256))) AS BIGINT) AS repeated
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following
        FROM (SELECT doc_id, i FROM shorter QUALIFY count(*) OVER (PARTITION BY gram) > 1))
  GROUP BY 1
),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs
),
joined AS (
  SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head,
         max(b) AS last, sum(b - a) AS removed, count(*) AS spans
  FROM gaps JOIN bytes USING (doc_id) GROUP BY 1
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       coalesce(repeated, 0) AS n_repeated_256, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN joined USING (doc_id) LEFT JOIN again USING (doc_id)"""

BENCHMARK = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS w
  FROM benchmark
),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, least(13, len(w)) AS n,
               unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM items WHERE len(w) > 0)
),
split AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS w FROM documents
),
windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM split, (SELECT DISTINCT n FROM item_windows))
),
found AS (SELECT doc_id, item, i, n FROM windows JOIN item_windows USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1
),
ids AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
  FROM found GROUP BY 1
),
words AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM split),
item_terms AS (SELECT DISTINCT item, array_to_string(w, ' ') AS whole, unnest(w) AS term FROM items),
occurs AS (SELECT term, count(*) AS n FROM words SEMI JOIN item_terms USING (term) GROUP BY 1),
rare AS (
  SELECT item, whole, term, count(*) OVER (PARTITION BY item, whole) AS needed
  FROM (SELECT * FROM item_terms JOIN occurs USING (term)
        QUALIFY row_number() OVER (PARTITION BY item, whole ORDER BY n, term) <= 3)
),
near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near_items
  FROM (SELECT a.doc_id, a.item, a.whole, a.place
        FROM (SELECT DISTINCT doc_id, item, whole, place FROM words JOIN rare USING (term)) a
        JOIN (SELECT doc_id, item, whole, place, term, needed FROM words JOIN rare USING (term)) b
          ON a.doc_id = b.doc_id AND a.item = b.item AND a.whole = b.whole AND b.place BETWEEN a.place - 29 AND a.place
        GROUP BY ALL HAVING count(DISTINCT b.term) = any_value(b.needed))
  GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_near_items, 0) AS n_near_items, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN near USING (doc_id)"""


def sharded() -> str:
    table = ", ".join(map(str, sharding.fill(sharding.shard_names())))
    return f"""
SELECT doc_id, source, slot, ([{table}])[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, source, CAST(CAST(
        '0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
        % {sharding.SLOTS} AS INTEGER) AS slot
      FROM documents)"""


def licensed() -> str:
    """Windows are looked at where they share a shingle with a template."""
    texts = {n: " ".join(license.template_words(t)) for n, t in license.TEMPLATES.items()}
    templates = ", ".join(f"('{n}', '{t}')" for n, t in texts.items())
    cuts = ", ".join(f"({n}, {w}, {step})" for n, w, step in license.windows(license.TEMPLATES))
    return f"""
WITH templates AS (SELECT name, string_split(t, ' ') AS w FROM (VALUES {templates}) v(name, t)),
cuts AS (SELECT * FROM (VALUES {cuts}) v(words, win, step)),
parts AS (
  SELECT DISTINCT name, words, win, step, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT name, w, len(w) AS words, unnest(range(1, len(w) - 3)) AS i FROM templates)
  JOIN cuts USING (words)
),
sizes AS (SELECT name, count(*) AS size FROM parts GROUP BY 1),
split AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS w FROM documents),
grams AS (
  SELECT doc_id, total, i, array_to_string(w[i + 1:i + 5], ' ') AS gram
  FROM (SELECT doc_id, w, len(w) AS total, unnest(range(0, len(w) - 4)) AS i FROM split)
),
shared AS (
  SELECT doc_id, name, words, step, win, total, gram, i
  FROM grams JOIN parts USING (gram)
),
placed AS (
  SELECT *, unnest(range(greatest(0, CAST(ceil((i + 5 - win) / step::DOUBLE) AS BIGINT)),
    least(CAST(floor(i / step::DOUBLE) AS BIGINT),
          CAST(ceil(greatest(total - win, 0) / step::DOUBLE) AS BIGINT)) + 1)) AS k
  FROM shared
),
common AS (
  SELECT doc_id, name, words, k, count(DISTINCT gram) AS n FROM placed GROUP BY 1, 2, 3, 4
),
matched AS (
  SELECT doc_id, name, words, n, CAST(k * step AS BIGINT) * 1000000000 // win AS place
  FROM common JOIN sizes USING (name) JOIN cuts USING (words) WHERE 100 * n >= 80 * size
),
best AS (
  SELECT doc_id, name, max(n) AS n
  FROM (SELECT * FROM matched QUALIFY n = max(n) OVER (PARTITION BY doc_id, words ORDER BY place
          RANGE BETWEEN 999999999 PRECEDING AND 999999999 FOLLOWING))
  GROUP BY 1, 2
),
listed AS (
  SELECT doc_id, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses,
         string_agg(CAST(n AS VARCHAR), ',' ORDER BY name) AS shingles
  FROM best GROUP BY 1
)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses,
       coalesce(shingles, '') AS shingles
FROM documents LEFT JOIN listed USING (doc_id)"""


EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


TRIE = """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
wanted AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
  FROM ids
),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
joined AS (
  SELECT wanted.conv_id, 0 AS own, place, role, text FROM wanted JOIN placed ON placed.conv_id = base AND place <= h
  UNION ALL
  SELECT wanted.conv_id, 1, place, role, text FROM wanted JOIN placed USING (conv_id) WHERE place > h
),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
         list({'r': role, 't': text}) OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)
  UNION ALL SELECT conv_id, 0, 0, [] FROM ids
),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes
  FROM paths GROUP BY path, depth
),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ended AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS listed
  FROM paths JOIN lengths USING (conv_id, depth) GROUP BY path
),
children AS (SELECT path[:len(path) - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
within AS (SELECT DISTINCT top.path AS path, low.path AS below
           FROM paths AS top JOIN paths AS low USING (conv_id) WHERE low.depth >= top.depth),
sums AS (
  SELECT within.path, count(*) FILTER (children.n IS NULL) AS n_leaves,
         CAST(sum((nodes.n_convs - 1) * nodes.bytes) AS BIGINT) AS saved_tokens
  FROM within JOIN nodes ON nodes.path = below LEFT JOIN children ON children.path = below
  GROUP BY within.path
)
SELECT nodes.conv_id, nodes.depth, above.conv_id AS parent_conv_id, nodes.n_convs,
       coalesce(children.n, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(listed, '')) AS ends_sha256
FROM nodes JOIN sums USING (path) LEFT JOIN children USING (path) LEFT JOIN ended USING (path)
LEFT JOIN nodes AS above ON nodes.depth > 0 AND above.path = nodes.path[:len(nodes.path) - 1]"""


ORACLE: dict[str, str] = {
    "op1_minhash": MINHASH,
    "op3_line_frequency": LINES,
    "op4_seed_extend": PASSAGES,
    "op5_suffix_sort": BYTES,
    "op6_license_bands": licensed(),
    "op8_lookup_sharding": sharded(),
    "op9_inverted_index": BENCHMARK,
    "op11_block_trie": TRIE,
    "op12_counting_filters": EXACT,
}
