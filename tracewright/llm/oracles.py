"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from . import reputation

OP6 = r"""
WITH u AS (
  SELECT CAST(page_id AS BIGINT) AS page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
marks AS (SELECT doc_id AS page_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS k FROM u LEFT JOIN marks USING (page_id) GROUP BY host),
names AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM hosts),
labels2 AS (SELECT *, split_part(name, '.', -2) || '.' || split_part(name, '.', -1) AS two FROM names),
units AS (
  SELECT host, n, k, CASE WHEN regexp_matches(name, '^[0-9.]*$') OR NOT contains(name, '.') THEN name WHEN two IN {two} THEN CASE WHEN split_part(name, '.', -3) = '' THEN two ELSE split_part(name, '.', -3) || '.' || two END ELSE two END AS domain,
    CASE WHEN regexp_matches(name, '^[0-9.]*$') OR NOT contains(name, '.') THEN name WHEN two IN {two} THEN two ELSE split_part(name, '.', -1) END AS suffix
  FROM labels2),
total AS (SELECT round((coalesce(sum(k), 0) + 1e0) / (coalesce(sum(n), 0) + 20e0), 9) AS p FROM units),
d AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM units GROUP BY ALL),
s AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, any_value(total.p) AS p FROM d, total GROUP BY suffix),
sr AS (SELECT least(greatest(round(coalesce(sum(pow(k - n*p, 2) - n*p*(1-p)) / nullif(sum(n*(n-1e0)*p*(1-p)), 0), 0), 9), 0.001e0), 0.9e0) AS rho FROM s WHERE n > 0),
sp AS (SELECT suffix, ((1/rho - 1)*p + k) / ((1/rho - 1)*p + k + (1/rho - 1)*(1-p) + n - k) AS p FROM s, sr),
dj AS (SELECT d.*, sp.p FROM d JOIN sp USING (suffix)),
dr AS (SELECT least(greatest(round(coalesce(sum(pow(k - n*p, 2) - n*p*(1-p)) / nullif(sum(n*(n-1e0)*p*(1-p)), 0), 0), 9), 0.001e0), 0.9e0) AS rho FROM dj WHERE n > 0),
dp AS (SELECT domain, suffix, ((1/rho - 1)*p + k) / ((1/rho - 1)*p + k + (1/rho - 1)*(1-p) + n - k) AS p FROM dj, dr),
hj AS (SELECT units.*, dp.p FROM units JOIN dp USING (domain, suffix)),
hr AS (SELECT least(greatest(round(coalesce(sum(pow(k - n*p, 2) - n*p*(1-p)) / nullif(sum(n*(n-1e0)*p*(1-p)), 0), 0), 9), 0.001e0), 0.9e0) AS rho FROM hj WHERE n > 0),
hp AS (SELECT host, n, k, (1/rho - 1)*p + k AS a, (1/rho - 1)*(1-p) + n - k AS b FROM hj, hr),
series AS (
  SELECT host, sum(exp(lgamma(a + b + i) - lgamma(a + b) - lgamma(a + 1 + i) + lgamma(a + 1) + i * ln(x))) AS total
  FROM (SELECT host, a, b, total.p AS x, unnest(range(0, 1000)) AS i FROM hp, total WHERE a > total.p * (a + b) * 1.000000001e0) GROUP BY host),
scores AS (
  SELECT hp.host, n, k, a / (a + b) AS mean, CASE WHEN series.total IS NOT NULL THEN round(least(1e0, exp(a * ln(total.p) + b * ln(1 - total.p) + lgamma(a + b) - lgamma(a + 1) - lgamma(b)) * series.total), 6) END AS below
  FROM hp LEFT JOIN series ON hp.host = series.host, total),
r AS (
  SELECT u.*, n, k, mean, below, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u JOIN scores USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN below < 0.05e0 THEN 'block' ELSE 'allow' END AS verdict,
  n AS labelled, k AS bad, round(mean, 6) AS mean, below
FROM r
""".replace("{two}", str(reputation.TWO_LABEL_SUFFIXES))

OP8 = r"""
WITH items AS (
  SELECT item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 5),
grams AS (SELECT item_id, n, w, unnest(range(0, n - 4)) AS off FROM items),
keys AS (SELECT item_id, n, off, array_to_string(w[off + 1 : off + 5], ' ') AS g FROM grams),
docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
ats AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS pos FROM docs WHERE len(w) >= 5),
dk AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS g FROM ats),
starts AS (SELECT DISTINCT doc_id, item_id, n, pos AS start FROM dk JOIN keys USING (g)),
inside AS (
  SELECT s.doc_id, s.item_id, s.n, s.start, dk.g
  FROM starts s JOIN dk ON dk.doc_id = s.doc_id AND dk.pos >= s.start AND dk.pos <= s.start + s.n - 5),
a AS (SELECT doc_id, item_id, n, start, g, count(*) AS c FROM inside GROUP BY ALL),
b AS (SELECT item_id, g, count(*) AS c FROM keys GROUP BY ALL),
size AS (SELECT doc_id, item_id, n, start, sum(c) AS total FROM a GROUP BY ALL),
same AS (SELECT doc_id, item_id, start, sum(least(a.c, b.c)) AS common FROM a JOIN b USING (item_id, g) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, n, start, common / (total + n - 4 - common)::DOUBLE AS s FROM size JOIN same USING (doc_id, item_id, start)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, start) AS k FROM sim WHERE s >= 0.8)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS window_start, CAST(n AS INTEGER) AS n_words, round(s, 6) AS similarity FROM best WHERE k = 1
"""

OP12 = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    list_transform(range(0, 4), lambda k: CAST('0x' || substr(sha256('1:' || doc_id), 8 * k + 1, 8) AS BIGINT)) AS h
  FROM documents),
c AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b FROM u),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1 : a], '') AS pre, array_to_string(w[a + 1 : b], '') AS mid, array_to_string(w[b + 1 : n], '') AS suf
  FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM f),
r AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(substr(output, 4), '<P>', 1) END AS restored
  FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM r
"""

_FRAMED = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"


def _climbed(source: str, levels: int, name: str) -> str:
    """Levels of a tree over ``source`` (``tree, i, hash, m``; m nodes) to ``name`` (``tree, hash``); runs of siblings as ``name_c<k>``."""
    sql = f"{name}_n0 AS (SELECT * FROM {source})"
    for k in range(1, levels + 1):
        sql += f""",
{name}_c{k} AS (SELECT tree, i // 16 AS run, m, string_agg(hash, '' ORDER BY i) AS hashes FROM {name}_n{k - 1} GROUP BY ALL),
{name}_n{k} AS (SELECT tree, run AS i, CASE WHEN m = 1 THEN hashes ELSE sha256(hashes) END AS hash, (m + 15) // 16 AS m FROM {name}_c{k})"""
    return sql + f",\n{name} AS (SELECT tree, hash FROM {name}_n{levels})"


def _folded(rows: str, levels: int, name: str, out: str) -> str:
    """``rows`` (``tree, i, proof, f`` and others) taken up ``name``'s levels: siblings added to ``proof``, ``f`` folded."""
    sql = ""
    for k in range(1, levels + 1):
        before, after = (rows if k == 1 else f"{out}_{k - 1}"), (out if k == levels else f"{out}_{k}")
        spot = f"(i // {16 ** (k - 1)}) % 16 * 64"
        sql += f""",
{after} AS (
  SELECT r.* REPLACE (CASE WHEN c.m = 1 THEN proof ELSE proof || substr(hashes, 1, {spot}) || substr(hashes, {spot} + 65) END AS proof,
    CASE WHEN c.m = 1 THEN f ELSE sha256(substr(hashes, 1, {spot}) || f || substr(hashes, {spot} + 65)) END AS f)
  FROM {before} r JOIN {name}_c{k} c ON c.tree = r.tree AND c.run = r.i // {16**k})"""
    return sql

def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text bit by bit, which DuckDB has no function for."""
    step = "list_reduce(range(0, 8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b))"
    return f"xor(list_reduce([ascii(x)::BIGINT for x in string_split({text}, '')], lambda a, b: {step}, 4294967295::BIGINT), 4294967295)"


#: Five levels are enough for a million documents of a source, two for 256 sources.
OP13 = f"""
WITH d AS (SELECT doc_id, source, coalesce(':' || source, '-') AS tree, lang, n_chars, text, crc32 % 5 = 0 AS tampered FROM (SELECT *, {crc32_sql('doc_id::VARCHAR')} AS crc32 FROM documents)),
l AS (
  SELECT doc_id, tree, sha256({"||".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS hash,
    CASE WHEN tampered THEN sha256({"||".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))}) END AS claimed
  FROM d),
leaves AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS i, hash, count(*) OVER (PARTITION BY tree) AS m, doc_id, claimed FROM l),
plain AS (SELECT tree, i, hash, m FROM leaves),
{_climbed("plain", 5, "s")},
tops AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, hash, count(*) OVER () AS m, tree AS source FROM s),
topnodes AS (SELECT tree, i, hash, m FROM tops),
{_climbed("topnodes", 2, "t")},
start AS (SELECT tree, i, doc_id, hash AS leaf, '' AS proof, coalesce(claimed, hash) AS f FROM leaves){_folded("start", 5, "s", "low")},
mid AS (SELECT tops.tree, tops.i, doc_id, leaf, proof, f, tops.hash AS subroot FROM low JOIN tops ON low.tree = tops.source){_folded("mid", 2, "t", "top")}
SELECT doc_id, leaf, subroot, t.hash AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.hash AS verified FROM top CROSS JOIN t
"""
