"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), "a key for the registered query")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import classes

    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import without_repeats

    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: (host, path, verdict)
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fold, scored, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5, 0))
    return scored(docs, model).select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored, train
    from .quality import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7, 2)
    model = train(docs.where(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", *(F.round(c, 6).alias(c) for c in ("base_score", "score")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_lm_scoring": op7_lm_scoring,
    "op9_packing": op9_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op10_html_extraction": op10_html_extraction,
    "op2_jaccard_join": op2_jaccard_join,
    "op8_decontamination": op8_decontamination,
}

WORD_SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: (r, doc_id, pos, w, n): the words of each row of documents; r tells repeated rows apart.
WORDS = f"""d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{{}}') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS pos, len(ws) AS n FROM d)"""

#: CRC-32 of an id's digits, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"


def _level_sql(n: int, key: str) -> str:
    """Discounts d{n} and context sums t{n} of the n-grams g{n}, by their counts k."""
    how = "greatest(count(*) FILTER (WHERE k = {}), 1e-9::DOUBLE)"
    y = f"WITH c AS (SELECT {', '.join(f'{how.format(i)} AS c{i}' for i in (1, 2, 3, 4))} FROM g{n}), y AS (SELECT *, c1 / (c1 + 2 * c2) AS y FROM c)"
    d = [f"least(greatest({i} - {i + 1} * y * c{i + 1} / c{i}, 0.1::DOUBLE), {i - 1} + 0.9::DOUBLE)" for i in (1, 2, 3)]
    sums = "sum(k) AS s, sum(CASE WHEN k = 1 THEN d[1] WHEN k = 2 THEN d[2] ELSE d[3] END) AS left_over"
    return f"d{n} AS ({y} SELECT [{', '.join(d)}] AS d FROM y), t{n} AS (SELECT {key}{', ' if key else ''}{sums} FROM g{n}, d{n}{f' GROUP BY {key}' if key else ''})"


def _p_sql(n: int, below: str) -> str:
    cut = f"(SELECT d FROM d{n})[least(g{n}.k, 3)::INT]"
    return f"CASE WHEN t{n}.s IS NULL THEN {below} ELSE (coalesce(greatest(g{n}.k - {cut}, 0), 0) + t{n}.left_over * {below}) / t{n}.s END"


ORACLE_SQL = {
    "op7_lm_scoring": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({CRC32} % 7 = 2, false) AS held_out, list_append(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+'), ' end') AS ws FROM documents),
w AS (SELECT r, held_out, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
tok AS (SELECT r, held_out, w, coalesce(lag(w, 1) OVER o, ' start') AS v, coalesce(lag(w, 2) OVER o, ' start') AS u FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
c AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w), a AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) + 1 AS kinds FROM c),
g3 AS (SELECT u, v, w, count(*) AS k FROM tok WHERE NOT held_out GROUP BY u, v, w), g2 AS (SELECT v, w, count(*) AS k FROM g3 GROUP BY v, w), g1 AS (SELECT w, count(*) AS k FROM g2 GROUP BY w),
{_level_sql(3, "u, v")}, {_level_sql(2, "v")}, {_level_sql(1, "")},
p1 AS (SELECT tok.*, c.c, a.n, a.kinds, {_p_sql(1, "(1 / a.kinds::DOUBLE)")} AS p FROM tok LEFT JOIN c ON tok.w = c.w LEFT JOIN g1 ON tok.w = g1.w CROSS JOIN t1 CROSS JOIN a),
p2 AS (SELECT p1.* EXCLUDE (p), {_p_sql(2, "p1.p")} AS p FROM p1 LEFT JOIN g2 ON p1.v = g2.v AND p1.w = g2.w LEFT JOIN t2 ON p1.v = t2.v),
p3 AS (SELECT p2.* EXCLUDE (p), {_p_sql(3, "p2.p")} AS p FROM p2 LEFT JOIN g3 ON p2.u = g3.u AND p2.v = g3.v AND p2.w = g3.w LEFT JOIN t3 ON p2.u = t3.u AND p2.v = t3.v)
SELECT any_value(d.doc_id) AS doc_id, any_value(d.held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + kinds))), 6) AS base_score, round(sum(log10(p)), 6) AS score
FROM p3 JOIN d ON p3.r = d.r GROUP BY d.r""",
    "op2_jaccard_join": f"""
WITH RECURSIVE {WORDS.format(r"[^\x20\x09-\x0D]+")},
s AS (SELECT r, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS s FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
sets AS (SELECT DISTINCT r, s FROM s WHERE s IS NOT NULL UNION ALL SELECT r, string_agg(w, ' ' ORDER BY pos) FROM w WHERE n < 4 GROUP BY r),
size AS (SELECT r, count(*) AS k FROM sets GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shared JOIN size x ON a = x.r JOIN size y ON b = y.r WHERE 100 * shared.k >= 85 * (x.k + y.k - shared.k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS x FROM d UNION SELECT reach.r, ways.b FROM reach JOIN ways ON reach.x = ways.a)
SELECT d.doc_id, coalesce(any_value(size.k), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM d LEFT JOIN size ON d.r = size.r JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.x GROUP BY d.r, d.doc_id""",
    "op8_decontamination": f"""
WITH {WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")},
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
spots AS (SELECT item, ws, least(13, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS a FROM i WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item, k, array_to_string(ws[a:a + k - 1], ' ') AS t FROM spots),
thirteen AS (SELECT r, pos, 13 AS k, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS t FROM w WHERE n >= 13),
short AS (SELECT r, a - 1 AS pos, k, array_to_string(ws[a:a + k - 1], ' ') AS t FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM wins WHERE k < 13))),
found AS (SELECT o.r, o.pos, o.k, wins.item FROM (SELECT * FROM thirteen UNION ALL SELECT * FROM short) o JOIN wins ON o.t = wins.t AND o.k = wins.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT r, pos, k FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN named ON d.r = named.r""",
    "op6_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))::BIGINT) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
 FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_line_dedup": f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {WORD_SPACE})")} AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
marked AS (SELECT a.r, a.doc_id, a.line, a.pos, h.k IS NOT NULL AND a.doc_id <> h.holder AS gone FROM keyed a LEFT JOIN hot h ON a.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
    "op4_url_filter": f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules AS (SELECT * FROM (VALUES {", ".join(str(r) for r in URL_RULES)}) AS t(rh, rp, rv)),
fits AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
 FROM parts JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rv, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1""",
}
