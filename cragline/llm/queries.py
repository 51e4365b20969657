"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shipped
from . import chosen_path, contamination, embedding_dedup, filter_audit, lattice_lm, license_scan, packing, quality_rules, secret_scan, shard_partition, spelling, toxicity, window_packing


TOKENIZER = "byte_bpe_50k.json"  #: vocabulary file of op13


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents name a source only: it is the owner, and its part in one language the repository
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"), verdict("live"), verdict("shared"), verdict("example"))


def op3_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the score of a text is that of the model learned from the training rows; the vocabulary's own has a column of its own
    found = lattice_lm.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("fitted_score").alias("score"), F.col("score").alias("vocabulary_score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no paths: most lie in source/language/hundred, every tenth one or two directories higher;
    # a short text with a licence speaks for its directory and what is below it
    docs = _table(spark, sf_dir, "documents")
    source, lang, hundred = F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string")
    name, tenth = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.pmod("doc_id", F.lit(10))
    path = F.when(tenth == 0, F.concat_ws("/", source, lang, name)).when(tenth == 1, F.concat_ws("/", source, name)).otherwise(F.concat_ws("/", source, lang, hundred, name))
    return license_scan.scan(docs, path, F.col("words") <= 100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_links(_table(spark, sf_dir, "documents"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_partition.shard(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        packed = window_packing.pack_windows(_table(spark, sf_dir, "documents"), f.read())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (op1_embedding_dedup, op2_secret_scan, op3_lattice_likelihood, op4_license_scan, op5_quality_rules, op6_jaccard_join, op7_contamination, op8_shards, op9_toxicity, op10_packing, op11_filter_audit, op12_spelling_variants, op13_window_packing, pipeline)
    return {f.__name__: shipped(f) for f in found}


#: Words of a text as lists, and its five-word shingles, for DuckDB.
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['<' || array_to_string(w, ' ')] ELSE [] END"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = e.vec_id
"""

OP6 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS h FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT i.a, i.b, c = x.n AND c = y.n AS same FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE c * 1.8::DOUBLE >= 0.8::DOUBLE * (x.n + y.n) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, (SELECT min(b) FROM l WHERE l.a = d.doc_id AND l.same)) AS set_id,
  (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links, c.m AS class_id, d.doc_id = c.m AS kept
FROM documents d JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS h FROM b WHERE len(w) >= 5),
x AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS h FROM d WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
i AS (SELECT doc_id, item_id, count(*) AS c FROM x JOIN q USING (h) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, c AS shared, n AS item_shingles, c / n::DOUBLE AS containment FROM i JOIN n USING (item_id)
WHERE c >= 0.8::DOUBLE * n - 1e-9
"""




def _found(kind: str, pattern: str, value: str = "{found}") -> str:
    """Matches of ``pattern`` with their places: running lengths of what lies between matches and of these."""
    rank = secret_scan.KINDS.index(kind)
    return f"""SELECT row, {rank} AS rank, '{kind}' AS kind, unnest(range(len(m))) AS i, unnest(m) AS found, unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap, {value.format(found="unnest(m)")} AS value
    FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS gaps FROM t)"""


_ASSIGN = secret_scan.ASSIGN_RE.replace("'", "''")
_ASSIGN_ALL = _ASSIGN.replace("([A-Za-z", "(?:[A-Za-z")
OP2 = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
f AS ({_found('assign', _ASSIGN_ALL, "regexp_extract({found}, '" + _ASSIGN + "', 1)")}
  UNION ALL {_found('access', 'AKIA[A-Z0-9]+')} UNION ALL {_found('hex', '[0-9a-f]+')} UNION ALL {_found('opaque', '[A-Za-z0-9+/_-]+')}),
s AS (SELECT row, rank, kind, value, sum(gap + length(found)) OVER (PARTITION BY row, rank ORDER BY i)::BIGINT AS e, length(found) AS n FROM f),
c AS (SELECT row, rank, kind, value, e - n AS b, e FROM s WHERE CASE kind WHEN 'assign' THEN length(value) >= 6 WHEN 'access' THEN n >= 20 WHEN 'hex' THEN n >= 24
  ELSE n >= 20 AND regexp_matches(value, '[0-9].*[0-9]') AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[A-Za-z0-9+]{{{secret_scan.UNBROKEN}}}')
    AND ((len(regexp_extract_all(value, '[A-Za-z]+|[0-9]+')) - len(regexp_extract_all(value, '[A-Za-z0-9]+'))) * 100 >= length(regexp_replace(value, '[+/_-]', '', 'g')) * {secret_scan.TURNS}
    OR len(regexp_extract_all(value, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')) * 100 >= length(regexp_replace(value, '[+/_-]', '', 'g')) * {secret_scan.RUNS}) END),
k AS (SELECT c.*, source, concat_ws('/', source, lang) AS repository FROM c JOIN t USING (row)
  WHERE kind <> 'opaque' OR NOT EXISTS (SELECT 1 FROM c x WHERE x.row = c.row AND x.kind <> 'opaque' AND x.b < c.e AND c.b < x.e)),
o AS (SELECT value, count(DISTINCT coalesce('=' || source, 'null')) AS owners FROM k GROUP BY value),
v AS (SELECT k.*, kind || ':' || b || ':' || e AS span, CASE WHEN owners >= {secret_scan.COPIED} THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict FROM k JOIN o USING (value)
  WHERE kind <> 'opaque' OR owners < {secret_scan.COPIED}),
a AS (SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY b, rank) FILTER (WHERE kind <> 'opaque') AS base, string_agg(span, ',' ORDER BY b, rank) AS spans,
  count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'shared') AS n_shared, count(*) FILTER (WHERE verdict = 'example') AS n_example FROM v GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example FROM t LEFT JOIN a USING (row)
"""

_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
OP8 = f"""
WITH RECURSIVE bits AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
t AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text IS NULL AS no_text, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents),
h AS MATERIALIZED (SELECT row, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (instr('123456789ABCDEF', left(h, 1)) * 16 + instr('123456789ABCDEF', right(h, 1)))::BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM t, bits),
g0 AS MATERIALIZED (SELECT text, no_text, min(doc_id) AS first, count(*) AS n, sum(size)::BIGINT AS bytes FROM t GROUP BY text, no_text),
total AS (SELECT sum(bytes)::BIGINT AS total FROM g0),
r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, first NULLS FIRST) - 1 AS place, total - (sum(bytes) OVER (ORDER BY bytes DESC, first NULLS FIRST) - bytes) AS left_over FROM g0, total),
few AS (SELECT coalesce(min(place), 0) AS alone FROM r WHERE place >= 15 OR bytes * (16 - place) <= left_over),
o AS MATERIALIZED (SELECT r.*, alone, sum(bytes) FILTER (WHERE place >= alone) OVER (ORDER BY first NULLS FIRST)::BIGINT AS upto FROM r, few),
s AS MATERIALIZED (SELECT upto, bytes, 16 - alone AS shards FROM o WHERE place >= alone),
lim AS (SELECT max(bytes) AS largest, max(upto) AS all_bytes, max(shards) AS shards FROM s),
greedy(capacity, shards, all_bytes, k, pos) AS (
  SELECT unnest(range(greatest(largest, ceil(all_bytes / shards::DOUBLE)::BIGINT), ceil(all_bytes / shards::DOUBLE)::BIGINT + largest + 1)), shards, all_bytes, 0::BIGINT, 0::BIGINT FROM lim
  UNION ALL SELECT g.capacity, g.shards, g.all_bytes, g.k + 1, x.upto FROM greedy g ASOF JOIN (SELECT upto FROM s UNION SELECT 0) x ON g.pos + g.capacity >= x.upto WHERE g.k < g.shards),
best AS (SELECT min(capacity) AS capacity FROM greedy WHERE k = shards AND pos >= all_bytes),
cuts AS (SELECT pos FROM greedy JOIN best USING (capacity) WHERE k BETWEEN 1 AND shards - 1),
p AS (SELECT text, no_text, first, CASE WHEN place < alone THEN place ELSE alone + (SELECT count(*) FROM cuts WHERE upto > pos) END::INT AS shard FROM o)
SELECT t.doc_id, t.size, h.text_crc32, 'bytes' AS law, p.shard, row_number() OVER (PARTITION BY p.shard ORDER BY p.first NULLS FIRST, t.doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM t JOIN h USING (row) JOIN p ON p.text = t.text AND p.no_text = t.no_text
"""


OP11 = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM t),
c AS (SELECT row, count(*) AS total, count(DISTINCT word) AS uniq FROM w GROUP BY row),
s AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(total, 0) < 100 AS a, 100 * coalesce(uniq, 0) < 80 * coalesce(total, 0) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t LEFT JOIN c USING (row) JOIN s USING (text) LEFT JOIN l USING (doc_id)),
p AS (SELECT part, (a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT) AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
k AS (SELECT filter_order, step::INT AS step, (1 << (ascii(filter_order[step]) - 65))::INT AS mine, list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(filter_order[i]) - 65))::INT)) AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
x AS (SELECT part, filter_order, step, mine, n, good, toxic, fails & mine <> 0 AS mine_fails, fails & coalesce(earlier, 0)::INT <> 0 AS gone, fails = mine AS only_mine FROM p, k),
r AS (SELECT part, filter_order, step, mine, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT mine_fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND mine_fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND mine_fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE only_mine), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE NOT gone AND mine_fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND mine_fails), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (mine), (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM r
"""

OP12 = f"""
WITH RECURSIVE bits AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
r AS MATERIALIZED (SELECT concat(doc_id::VARCHAR, ':', run) AS keyed, run, count(*) AS times FROM
  (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
h AS MATERIALIZED (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(keyed)), '..'), lambda h: (instr('123456789ABCDEF', left(h, 1)) * 16 + instr('123456789ABCDEF', right(h, 1)))::BIGINT)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r, bits),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
d AS MATERIALIZED (SELECT word, i, left(word, i::INT) || substring(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
g AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest),
b AS (SELECT g.a AS word, count(*) AS n_near, first(v.word ORDER BY v.n DESC, encode(v.word)) AS best, first(v.n ORDER BY v.n DESC, encode(v.word)) AS best_n FROM g JOIN v ON v.word = g.b GROUP BY g.a),
f AS MATERIALIZED (SELECT v.word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
e(word, root) AS (SELECT word, word FROM f UNION ALL SELECT e.word, f.form FROM e JOIN f ON f.word = e.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e USING (word) JOIN f z ON z.word = e.root WHERE z.form IS NULL
"""


def oracle_sql() -> dict:
    return {"op1_embedding_dedup": OP1, "op2_secret_scan": OP2, "op6_jaccard_join": OP6, "op7_contamination": OP7, "op8_shards": OP8, "op11_filter_audit": OP11, "op12_spelling_variants": OP12}
