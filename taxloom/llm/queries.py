"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.llm import exact, fingerprint, langid, lines, minhash, mixing, negatives, pieces, pii, sharding, trie, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score and runs of every text, by a CRF that learns from the documents that aren't held out.

    Null texts and texts without a letter are 'und' with score 0; repeated and null ids keep their rows.
    """
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; nulls have one byte, repeated and null ids keep their rows."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its lines of recurring templates; null texts and rows without an id stay as they are."""
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingles are alike by 0.8; texts without words and null ids are alone."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the copy with the largest id; null texts are empty ones, a null id stays only among null ids."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot in the Pfair schedule of its source; null sources are one, repeated rows each have a place."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text: the ids, their number, and the digests of the text and of what decoding gives."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(text, 256).alias("text_sha256"))
    decoded = pieces.decode(pieces.encode(docs))
    return decoded.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", "text_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC files and back; null html is an empty payload, repeated ids are records of their own."""
    found = warc.archive_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form, and their likeness; null texts are empty ones."""
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans and those that boosted trees add; null texts have none."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations; null roles and texts are empty, rows without a conv_id take no part."""
    turns, conversations = trie.spliced(trie.numbered_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, conversations)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anchor and positive the first three rows of other labels that score 50 to 95 percent of the positive.

    A row without a vec_id is no anchor and keeps its label; rows with repeated ids are rows of their own.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))
    return negatives.mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: the longest rule's, else by its host's reputation; null urls have an empty host and path."""
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_sharding": op2_sharding,
    "op3_lines": op3_lines,
    "op4_minhash": op4_minhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_pieces": op7_pieces,
    "op8_warc": op8_warc,
    "op9_fingerprint": op9_fingerprint,
    "op10_pii": op10_pii,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filters": op13_url_filters,
}

_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

SQL: dict[str, str] = {
    "op2_sharding": f"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range::BIGINT AS c, 0 AS i FROM range(256)
  UNION ALL SELECT b, {_CRC_STEP}, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS mark FROM documents),
placed AS (
  SELECT doc_id, size, text, mark,
    (sum(size) OVER w - size)::BIGINT AS byte_offset, row_number() OVER w AS n, (sum(size) OVER ())::BIGINT AS total
  FROM docs WINDOW w AS (ORDER BY mark, doc_id ROWS UNBOUNDED PRECEDING)),
grouped AS (SELECT *, min(byte_offset) OVER (PARTITION BY text) AS start, (sum(size) OVER (PARTITION BY text))::BIGINT AS bytes FROM placed),
sharded AS (SELECT *, (CASE WHEN bytes * 1600 <= total THEN start ELSE byte_offset END * 16 // total)::INTEGER AS shard FROM grouped),
hexed AS (SELECT DISTINCT text, hex(encode(text)) AS h FROM docs),
summed AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2),
    lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM hexed, crc)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, byte_offset
FROM sharded JOIN summed USING (text)
""",
    "op4_minhash": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w != '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT u AS node, u AS root FROM links UNION SELECT v, root FROM reach JOIN links ON u = node)
SELECT doc_id, len(s) AS n_shingles, coalesce(least(doc_id, c), doc_id) AS component_id, coalesce(least(doc_id, c), doc_id) = doc_id AS kept
FROM sets LEFT JOIN (SELECT node, min(root) AS c FROM reach GROUP BY node) ON node = doc_id
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op6_mixing": """
WITH RECURSIVE counted AS (
  SELECT coalesce('s' || source, 'null') AS key, count(*) AS n, floor(sqrt(count(*)) * 1000)::BIGINT AS r FROM documents GROUP BY 1),
weighed AS (SELECT key, greatest(1, (2000 * r + sum(r) OVER ()::BIGINT) // (2 * sum(r) OVER ()::BIGINT)) AS w FROM counted),
common AS (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) AS g, sum(w)::BIGINT AS ws FROM weighed),
slots AS (SELECT key, w // g AS c, ws // g AS d FROM weighed, common),
names AS (SELECT list(key ORDER BY key) AS names, list(c::BIGINT ORDER BY key) AS cs, any_value(d)::BIGINT AS d FROM slots),
run AS (
  SELECT -1::BIGINT AS slot, list_transform(cs, lambda c: 0::BIGINT) AS ks, 0::BIGINT AS pick FROM names
  UNION ALL
  SELECT slot + 1, list_transform(ks, lambda k, i: k + CASE WHEN i = pick_next THEN 1 ELSE 0 END), pick_next
  FROM (
    SELECT slot, ks, list_min(list_transform(ks, lambda k, i: CASE WHEN k < cs[i] AND k * d // cs[i] <= slot + 1
      THEN -((-(k + 1) * d) // cs[i]) * 100000 + i ELSE 9000000000000000 END)) % 100000 AS pick_next, d
    FROM run, names) WHERE slot + 1 < d),
turns AS (
  SELECT names[pick] AS key, ks[pick] - 1 AS turn, slot AS slot0, (ks[pick] - 1) * d // cs[pick] AS release0,
    -((-ks[pick] * d) // cs[pick]) AS deadline0, cs[pick] AS c, d
  FROM run, names WHERE slot >= 0),
numbered AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS key, row_number() OVER (
    PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS n FROM documents)
SELECT doc_id, source, c / d AS target, (n // 16)::BIGINT AS block, (n % 16)::INTEGER AS block_row,
  (n // 16 // c * d + release0)::BIGINT AS release, (n // 16 // c * d + deadline0)::BIGINT AS deadline,
  (n // 16 // c * d + slot0)::BIGINT AS slot
FROM numbered JOIN turns ON turns.key = numbered.key AND n // 16 % c = turn
""",
    "op8_warc": """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform([15, 10, 5, 0], lambda k:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> k) & 31) + 1]), '')), '') AS payload_digest
  FROM hashed)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM coded
""",
    "op11_prefix_trie": f"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range::BIGINT AS c, 0 AS i FROM range(256)
  UNION ALL SELECT b, {_CRC_STEP}, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c AS conv_id, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM own), crc),
turns AS (
  SELECT c.conv_id, o.pos, 0 AS step, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= h
  UNION ALL SELECT c.conv_id, o.pos, 1, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > h),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY step, pos) AS depth, text,
    length(role)::VARCHAR || ':' || length(text)::VARCHAR || ':' || role || text AS turn FROM turns),
prefixes AS (
  SELECT conv_id, depth, text, sha256(string_agg(sha256(turn), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS path,
    coalesce(sha256(string_agg(sha256(turn), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS above,
    max(depth) OVER (PARTITION BY conv_id) = depth AS last
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '', NULL, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
  SELECT path, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n,
    len(list_filter(regexp_split_to_array(any_value(text), '[\\x20\\x09-\\x0D]+'), lambda w: w != '')) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM prefixes GROUP BY path),
kids AS (SELECT above AS path, count(*) AS kids FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (
  SELECT p.path, count(*) FILTER (k.kids IS NULL) AS leaves, sum((v.n - 1) * v.words)::BIGINT AS saved
  FROM nodes v JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth LEFT JOIN kids k ON k.path = v.path GROUP BY p.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children,
  b.leaves AS n_leaves, b.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes a ON a.path = n.above
""",
    "op12_hard_negatives": """
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v, true), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.row != b.row),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) AS place FROM scored WHERE same) WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row)::INTEGER AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
""",
    "op13_url_filters": """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
rules(r_verdict, r_host, r_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS said
  FROM split, rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id),
rows AS (
  SELECT page_id, host, path, rule, said, regexp_matches(host, '^[0-9.]+(:[0-9]*)?$|^[[]') AS number,
    CASE WHEN said = 'block' THEN 1 WHEN said = 'allow' THEN 0 END AS bad FROM split LEFT JOIN fits USING (page_id)),
hosts AS (
  SELECT host, CASE WHEN number THEN host ELSE array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') END AS domain,
    CASE WHEN number THEN host ELSE string_split(host, '.')[-1] END AS suffix, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM rows GROUP BY host, number),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
every AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM suffixes),
children AS (
  SELECT 'host' AS level, h.n, h.bad / h.n AS rate, d.bad / d.n AS parent FROM hosts h JOIN domains d USING (domain, suffix) WHERE h.n > 0
  UNION ALL SELECT 'domain', d.n, d.bad / d.n, s.bad / s.n FROM domains d JOIN suffixes s USING (suffix) WHERE d.n > 0
  UNION ALL SELECT 'suffix', s.n, s.bad / s.n, e.bad / e.n FROM suffixes s, every e WHERE s.n > 0),
moments AS (
  SELECT level, sum(round((n * (rate - parent) * (rate - parent) - parent * (1 - parent)) * 1000000)::HUGEINT)::DOUBLE AS over,
    sum(round(parent * (1 - parent) * (n - 1) * 1000000)::HUGEINT)::DOUBLE AS room FROM children GROUP BY level),
strengths AS (
  SELECT level, CASE WHEN room <= 0 THEN 10.0 WHEN over / room <= 1 / 1001.0::DOUBLE THEN 1000.0 ELSE greatest(1.0, 1 / (over / room) - 1) END::DOUBLE AS m FROM moments
  UNION ALL SELECT l, 10.0 FROM (VALUES ('host'), ('domain'), ('suffix')) x(l) WHERE l NOT IN (SELECT level FROM moments)),
means3 AS (
  SELECT suffix, (s.bad + m * CASE WHEN e.n > 0 THEN e.bad / e.n ELSE 0.5 END) / (s.n + m) AS mean FROM suffixes s, every e, strengths WHERE level = 'suffix'),
means2 AS (SELECT domain, d.suffix, (d.bad + m * mean) / (d.n + m) AS mean FROM domains d JOIN means3 USING (suffix), strengths WHERE level = 'domain'),
means1 AS (SELECT host, h.n, m, (h.bad + m * mean) / (h.n + m) AS mean FROM hosts h JOIN means2 USING (domain, suffix), strengths WHERE level = 'host')
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN mean - 1.645 * sqrt(greatest(mean * (1 - mean), 0) / (means1.n + m + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM rows JOIN means1 USING (host)
""",
}
