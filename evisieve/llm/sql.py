"""DuckDB SQL of the queries that SQL can express, written without the operators' methods."""

from __future__ import annotations

from . import quality

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM documents),
  s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
  reach AS (SELECT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
  comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
  SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON a = doc_id"""

SUBSTRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS i FROM d)),
  twice AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
  step AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER p + 400 THEN 0 ELSE 1 END AS new FROM twice WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step),
  span AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM island GROUP BY doc_id, k),
  gap AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), NULL) AS e, k FROM span UNION ALL SELECT doc_id, 0, min(a), 0 FROM span GROUP BY doc_id),
  kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(e, length(h) // 2) - a)), '' ORDER BY k) AS t FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id),
  cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
  SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_SYMBOLS = quoted(quality.SYMBOLS)
_SOLID = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"
_LINE = f"""((length(l) - length(translate(l, {_SYMBOLS}, ''))) > {quality.SYMBOL_SHARE} * greatest(length({_SOLID.format('l')}), 1) AND length(l) - length(translate(l, {_SYMBOLS}, '')) >= 4)
    OR len(regexp_extract_all(l, {quoted(quality.SEPARATORS)})) >= 3 OR (length(l) <= 80 AND regexp_matches(l, {quoted(quality.MENU)})) OR regexp_matches(l, {quoted(quality.BOILERPLATE)})"""

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
  rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
  line AS (SELECT doc_id, unnest(ls) AS l FROM d),
  lost AS (SELECT doc_id, sum(length({_SOLID.format('l')})) FILTER (WHERE NOT ({_LINE})) AS solid, count(*) FILTER (WHERE {_LINE}) AS n FROM line GROUP BY doc_id),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
  base AS (SELECT doc_id, len(w) AS n_words, length({_SOLID.format('t')}) AS word_chars, length(t) - length(translate(t, {_SYMBOLS}, '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, lost.n AS n_lines_removed, coalesce(solid, 0) AS solid
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
  verdict AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 - solid / word_chars <= {quality.MOST_LOST} AS kept, n_lines_removed FROM verdict"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
  b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + 12], ' '))) AS g FROM b WHERE len(w) > 0),
  size AS (SELECT DISTINCT k FROM bw),
  dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size)),
  hit AS MATERIALIZED (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, g)),
  n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
  pos AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
  freq AS MATERIALIZED (SELECT t, count(*) AS n FROM pos GROUP BY t),
  bt AS (SELECT DISTINCT item, g, unnest(string_split(g, ' ')) AS t FROM bw),
  rare AS MATERIALIZED (SELECT DISTINCT item, rarest[1] AS t1, rarest[2] AS t2, rarest[3] AS t3 FROM (SELECT item, g, list(t ORDER BY coalesce(n, 0), t) AS rarest FROM bt LEFT JOIN freq USING (t) GROUP BY item, g) WHERE len(rarest) >= 3),
  pl AS MATERIALIZED (SELECT t, doc_id, list(p) AS ps FROM pos WHERE t IN (SELECT unnest([t1, t2, t3]) FROM rare) GROUP BY t, doc_id),
  one AS MATERIALIZED (SELECT item, t2, t3, doc_id, ps FROM rare JOIN pl ON t = t1),
  both_ AS MATERIALIZED (SELECT item, t3, one.doc_id, list_filter(one.ps, lambda x: len(list_filter(pl.ps, lambda y: abs(x - y) <= 26)) > 0) AS ps FROM one JOIN pl ON t = t2 AND pl.doc_id = one.doc_id),
  close AS MATERIALIZED (SELECT DISTINCT item, both_.doc_id FROM both_ JOIN pl ON t = t3 AND pl.doc_id = both_.doc_id WHERE len(list_filter(both_.ps, lambda x: len(list_filter(pl.ps, lambda y: abs(x - y) <= 26)) > 0)) > 0),
  near AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, item FROM close EXCEPT SELECT doc_id, item FROM hit) GROUP BY doc_id),
  its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(w) AS contaminated, coalesce(near.n, 0) AS n_near_items FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)"""

_QUINTET = "('0x' || substr(h, 5 * k + 1, 5))::BIGINT"
_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({} >> {}) & 31)::INT + 1, 1)"
_CHARS = " || ".join(_CHAR.format(_QUINTET, s) for s in (15, 10, 5, 0))
WARC = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
  SELECT page_id, octet_length(b) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: {_CHARS}), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

#: CRC-32 of an id's decimal text, bit by bit; the empty text of a null id has none.
_BITS = "list_transform(range(0, 8 * length({0}::VARCHAR)), lambda k: CASE WHEN k % 8 = 0 THEN ord(substr({0}::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT)"
CRC32 = f"xor(list_reduce([4294967295::BIGINT] || {_BITS}, lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"

MANIFEST = f"""WITH RECURSIVE leaf AS MATERIALIZED (SELECT doc_id, lang, {_LEAF.format("n_chars")} AS h, {_LEAF.format(f"(n_chars + CASE WHEN {CRC32.format('doc_id')} % 7 = 0 THEN 1 ELSE 0 END)")} AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
  tree AS (SELECT lang, 0 AS lv, i, n, h FROM leaf UNION ALL SELECT lang, lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, lv, i // 2),
  sub AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
  top AS (SELECT 0 AS lv, i, n, h FROM sub UNION ALL SELECT lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 2),
  way AS (SELECT doc_id, 0 AS part, lv, leaf.i >> lv AS p, t.h FROM leaf JOIN (SELECT DISTINCT lang AS l, lv, n AS w FROM tree WHERE n > 1) x ON x.l IS NOT DISTINCT FROM leaf.lang LEFT JOIN (SELECT lang AS l2, lv AS lv2, i AS i2, h FROM tree) t ON t.l2 IS NOT DISTINCT FROM leaf.lang AND lv2 = lv AND i2 = xor(leaf.i >> lv, 1)
    UNION ALL SELECT doc_id, 1, x.lv, sub.i >> x.lv, t.h FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang CROSS JOIN (SELECT DISTINCT lv FROM top WHERE n > 1) x LEFT JOIN top t ON t.lv = x.lv AND t.i = xor(sub.i >> x.lv, 1)),
  proof AS (SELECT doc_id, list(CASE WHEN h IS NULL THEN '-' WHEN p % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY part, lv) AS steps, coalesce(string_agg(h, '' ORDER BY part, lv), '') AS t FROM way GROUP BY doc_id),
  whole AS (SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(t, '')) AS proof_sha256,
    list_reduce([now] || coalesce(steps, []), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang LEFT JOIN proof ON proof.doc_id = leaf.doc_id)
  SELECT *, folded_root = root AS verified FROM whole"""

EARLIER_WORDS = f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
  win AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
  step AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER p + 20 THEN 0 ELSE 1 END AS new FROM later WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step),
  span AS (SELECT doc_id, k, min(i) AS a, max(i) + 20 AS b FROM island GROUP BY doc_id, k),
  gap AS (SELECT doc_id, k, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), 9000000000) AS e FROM span UNION ALL SELECT doc_id, 0, 1, min(a) FROM span GROUP BY doc_id),
  kept AS (SELECT g.doc_id, flatten(list(w[a : least(e - 1, len(w))] ORDER BY k)) AS v FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id),
  cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n FROM span GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(coalesce(v, w), ' ')) AS kept_sha256, coalesce(n, 0) > 0 AS has_repeats FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_TURN = "sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[:32]"
PREFIX_TRIE = f"""WITH own AS (SELECT conv_id, {CRC32.format('conv_id')} % 9 AS h, list({_TURN} ORDER BY turn NULLS FIRST, {_TURN}) AS s, list(octet_length(encode(coalesce(text, '')))::BIGINT ORDER BY turn NULLS FIRST, {_TURN}) AS z FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  conv AS MATERIALIZED (SELECT o.conv_id, list_slice(coalesce(b.s, []), 1, o.h) || list_slice(o.s, o.h + 1, len(o.s)) AS s, list_slice(coalesce(b.z, []), 1, o.h) || list_slice(o.z, o.h + 1, len(o.z)) AS z FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
  pre AS (SELECT conv_id, d, d = len(s) AS ends, array_to_string(s[1 : d], '') AS p, CASE WHEN d > 0 THEN z[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM conv)),
  node AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM pre GROUP BY p, d),
  kids AS MATERIALIZED (SELECT left(p, 32 * (d::INT - 1)) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
  up AS (SELECT node.p, left(node.p, 32 * k) AS a, (node.n_convs - 1) * size AS saved, (kids.n IS NULL)::INT AS leaf FROM (SELECT *, unnest(range(0, d::INT + 1))::INT AS k FROM node) node LEFT JOIN kids ON kids.p = node.p),
  tot AS (SELECT a, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY a)
  SELECT node.conv_id, node.d AS depth, par.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(node.e) AS ends_sha256
  FROM node JOIN tot ON tot.a = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node par ON node.d > 0 AND par.p = left(node.p, 32 * (node.d::INT - 1))"""

SQL = {
    "op11_earlier_words": EARLIER_WORDS,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_manifest": MANIFEST,
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op7_substrings": SUBSTRINGS,
    "op8_quality": QUALITY,
    "op9_decontamination": DECONTAMINATION,
    "op10_warc": WARC,
}
