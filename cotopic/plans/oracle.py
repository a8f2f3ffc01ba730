"""Independent DuckDB SQL for every catalogue query, over the driver tables.

Each string is self-contained: it derives the corpus from the raw tables with CTEs and
computes the report in plain SQL, so it checks the Spark plans end to end.
"""

from __future__ import annotations

from cotopic.plans.catalogue import BROKEN, HISTORY_MIN_MENTIONS, NEWEST, SEED, SMALL_TOP, STAR_TOPIC, TEXT_TOPIC, TOPIC_LIST

# Fixed values, written out so that a wrong entry in the library shows.
MONTH_NAMES = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro",
               "novembro", "dezembro"]
OUTLETS = ["record", "noticiasaominuto", "lusa", "jornaldenegocios", "tsf", "sicnoticias", "expresso", "publico", "dn",
           "observador", "sapo", "iol", "rtp", "cnn", "cmjornal", "jn", "nit", "dinheirovivo", "aeiou"]

R = 9  # rounding digits, as in the catalogue

STAR = r"""
star_m AS (
  SELECT l.l_orderkey AS id, p.p_name AS keyword, CAST(sum(l.l_quantity) AS INTEGER) AS n
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE p.p_name IS NOT NULL
  GROUP BY l.l_orderkey, p.p_name
),
star_a AS (
  SELECT CAST(o.o_orderkey AS BIGINT) AS id,
         CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS INTEGER) AS timestamp,
         c.c_mktsegment AS source,
         'https://archive.example/noFrame/replay/' || strftime(o.o_orderdate, '%Y%m%d')
           || '000000/https://www.' || lower(c.c_mktsegment) || '.example/story-'
           || CAST(o.o_orderkey AS VARCHAR) AS archive,
         CAST((o.o_orderkey % 9) - 4 AS DOUBLE) / 4 AS sentiment
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""

TEXT = r"""
text_tok AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS token FROM documents
),
text_m AS (
  SELECT doc_id AS id, token AS keyword, CAST(count(*) AS INTEGER) AS n
  FROM text_tok WHERE token <> '' GROUP BY doc_id, token
),
text_a AS (
  SELECT CAST(d.doc_id AS BIGINT) AS id,
         CAST((1998 + d.doc_id % 25) * 100 + 1 + d.doc_id % 12 AS INTEGER) AS timestamp,
         d.source,
         'https://archive.example/noFrame/replay/'
           || CAST(CAST((1998 + d.doc_id % 25) * 100 + 1 + d.doc_id % 12 AS INTEGER) AS VARCHAR)
           || '15000000/' || p.url AS archive,
         CAST(l.quality - l.toxic AS DOUBLE) AS sentiment
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
  LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(name: str, m: str, a: str, topic: str, min_mentions: int = 4) -> str:
    return f"""
{name} AS (
  SELECT a.* FROM {a} a JOIN {m} t ON t.id = a.id
  WHERE t.keyword = {q(topic)} AND t.n > {min_mentions}
)"""


def rel(name: str, h: str, m: str, min_count: int = 5) -> str:
    return f"""
{name} AS (
  SELECT x.keyword, CAST(sum(x.n) AS BIGINT) AS count,
         sum(h.sentiment * x.n) / nullif(sum(CASE WHEN h.sentiment IS NOT NULL THEN x.n END), 0) AS sentiment,
         count(*) AS articles, min(h.archive) AS first_archive, max(h.archive) AS last_archive
  FROM {h} h JOIN {m} x ON x.id = h.id
  WHERE x.n IS NOT NULL
  GROUP BY x.keyword HAVING sum(x.n) >= {min_count}
)"""


STAR_BASE = "WITH " + STAR + "," + hits("hits", "star_m", "star_a", STAR_TOPIC) + "," + rel("rel", "hits", "star_m") + f""",
neigh AS (SELECT * FROM rel WHERE keyword <> {q(STAR_TOPIC)})
"""

NAMES = "[" + ", ".join(q(n) for n in MONTH_NAMES) + "]"


def seg5(col: str) -> str:
    return f"string_split({col}, '/')[6]"


def cap_month(col: str) -> str:
    s = seg5(col)
    return f"(substr({s}, 1, 4) || '/' || substr({s}, 5, 2))"


def outlet_case(col: str) -> str:
    whens = " ".join(f"WHEN contains({col}, {q(t)}) THEN {q(t)}" for t in OUTLETS)
    return f"(CASE {whens} ELSE '404' END)"


def quantiles(src: str, prefix: str = "") -> str:
    return ", ".join(
        f"quantile_cont(sentiment, {lvl}) AS {prefix}q{int(lvl * 100)}" for lvl in (0.1, 0.3, 0.7, 0.9))


def top_n(name: str, src: str, n: int) -> str:
    return f"""
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY count DESC, keyword) AS rnk FROM {src}) WHERE rnk <= {n}
)"""


def history(h: str, m: str, topic: str) -> str:
    """CTEs arts, top5, hist for a topic history over hits table ``h``."""
    return f""",
arts AS (SELECT timestamp, count(archive) AS articles FROM {h} WHERE timestamp IS NOT NULL GROUP BY timestamp),
mm AS (
  SELECT h.timestamp, x.keyword, sum(x.n) AS mentions
  FROM {h} h JOIN {m} x ON x.id = h.id
  WHERE x.n IS NOT NULL AND x.keyword <> {q(topic)}
  GROUP BY h.timestamp, x.keyword
),
top5 AS (
  SELECT * FROM (SELECT timestamp, keyword,
    row_number() OVER (PARTITION BY timestamp ORDER BY mentions DESC, keyword) AS rnk FROM mm) WHERE rnk <= 5
),
tops AS (
  SELECT timestamp, string_agg(CAST(rnk AS VARCHAR) || '. ' || keyword, '<br>' ORDER BY rnk) AS top_label
  FROM top5 GROUP BY timestamp
),
j AS (
  SELECT make_date(a.timestamp // 100, a.timestamp % 100, 1) AS month, a.articles, t.top_label
  FROM arts a JOIN tops t ON t.timestamp = a.timestamp
),
spine AS (
  SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM j
),
hist AS (
  SELECT strftime(s.month, '%Y-%m') AS month, coalesce(j.articles, 0) AS articles,
         coalesce(j.top_label, '-') AS top_label,
         {NAMES}[month(s.month)] || ' de ' || CAST(year(s.month) AS VARCHAR) AS month_label
  FROM spine s LEFT JOIN j ON j.month = s.month
)
"""


ORACLE: dict[str, str] = {}

ORACLE["corpus_summary"] = "WITH " + STAR + """
SELECT count(*) AS articles, min(timestamp) AS first_month, max(timestamp) AS last_month FROM star_a"""

ORACLE["read_status_partition"] = "WITH " + STAR + "\nSELECT id, timestamp FROM star_a"

ORACLE["mentions"] = "WITH " + STAR + "\nSELECT CAST(id AS BIGINT) AS id, keyword, n FROM star_m WHERE n IS NOT NULL"

ORACLE["topic_hits"] = f"""
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS timestamp,
       c_mktsegment AS source
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = {q(STAR_TOPIC)}
                     GROUP BY l_orderkey HAVING sum(l_quantity) > 4)"""

ORACLE["topic_hits_layout"] = ORACLE["topic_hits"]

ORACLE["topic_summary"] = STAR_BASE + f"""
SELECT count(*) AS articles, min(timestamp) AS first_month,
       {NAMES}[min(timestamp) % 100] || ' de ' || CAST(min(timestamp) // 100 AS VARCHAR) AS first_label
FROM hits"""

ORACLE["topic_sources"] = STAR_BASE + f"""
SELECT source, count(*) AS articles,
       round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), {R}) AS pct
FROM hits GROUP BY source"""

ORACLE["monthly_articles"] = STAR_BASE + "SELECT timestamp, count(archive) AS articles FROM hits GROUP BY timestamp"

ORACLE["monthly_mentions"] = STAR_BASE + f"""
SELECT h.timestamp, x.keyword, CAST(sum(x.n) AS BIGINT) AS mentions
FROM hits h JOIN star_m x ON x.id = h.id
WHERE x.n IS NOT NULL AND x.keyword <> {q(STAR_TOPIC)}
GROUP BY h.timestamp, x.keyword"""

ORACLE["monthly_top_keywords"] = STAR_BASE + history("hits", "star_m", STAR_TOPIC) + """
SELECT timestamp, CAST(rnk AS BIGINT) AS rank, keyword FROM top5"""

ORACLE["topic_history"] = ("WITH " + STAR + "," + hits("hits40", "star_m", "star_a", STAR_TOPIC, HISTORY_MIN_MENTIONS)
                           + history("hits40", "star_m", STAR_TOPIC) + """
SELECT month, CAST(articles AS BIGINT) AS articles, top_label, month_label FROM hist""")

ORACLE["history_peak"] = STAR_BASE + history("hits", "star_m", STAR_TOPIC) + f"""
SELECT round(CAST(max(articles) AS DOUBLE) * 1.1, {R}) AS peak FROM hist"""

ORACLE["relations"] = STAR_BASE + f"SELECT keyword, count, round(sentiment, {R}) AS sentiment FROM rel"

ORACLE["relation_months"] = STAR_BASE + """
SELECT x.keyword, h.timestamp, CAST(sum(x.n) AS BIGINT) AS mentions
FROM hits h JOIN star_m x ON x.id = h.id
WHERE x.n IS NOT NULL AND x.keyword IN (SELECT keyword FROM rel)
GROUP BY x.keyword, h.timestamp"""

ORACLE["relation_sources"] = STAR_BASE + f""",
per AS (
  SELECT x.keyword, h.source, count(*) AS articles
  FROM hits h JOIN star_m x ON x.id = h.id WHERE x.n IS NOT NULL
  GROUP BY x.keyword, h.source
)
SELECT p.keyword, p.source, p.articles, round(CAST(p.articles AS DOUBLE) * 100 / r.articles, {R}) AS pct
FROM per p JOIN rel r ON r.keyword = p.keyword"""

ORACLE["relations_nested"] = STAR_BASE + """,
rm AS (
  SELECT x.keyword, CAST(h.timestamp AS VARCHAR) AS k, sum(x.n) AS mentions
  FROM hits h JOIN star_m x ON x.id = h.id
  WHERE x.n IS NOT NULL AND x.keyword IN (SELECT keyword FROM rel)
  GROUP BY x.keyword, k
)
SELECT r.keyword, r.count,
       '{' || string_agg('"' || rm.k || '":' || CAST(rm.mentions AS VARCHAR), ',' ORDER BY rm.k) || '}' AS months_json
FROM rel r JOIN rm ON rm.keyword = r.keyword
GROUP BY r.keyword, r.count"""

ORACLE["neighbours_top"] = STAR_BASE + "," + top_n("top", "neigh", SMALL_TOP) + "\nSELECT keyword, count FROM top"

ORACLE["sentiment_quantiles"] = STAR_BASE + """,
qa AS (SELECT """ + quantiles("neigh") + """ FROM neigh)
SELECT """ + ", ".join(f"round(q{p}, {R}) AS q{p}" for p in (10, 30, 70, 90)) + " FROM qa"

ORACLE["sentiment_thresholds"] = STAR_BASE + "," + top_n("top", "neigh", SMALL_TOP) + """,
qa AS (SELECT """ + quantiles("neigh", "a_") + """ FROM neigh),
qt AS (SELECT """ + quantiles("top", "t_") + """ FROM top)
SELECT round(a_q10 * 0.4 + t_q10 * 0.6, 9) AS q10, round(a_q30 * 0.3 + t_q30 * 0.7, 9) AS q30,
       round(a_q70 * 0.3 + t_q70 * 0.7, 9) AS q70, round(a_q90 * 0.4 + t_q90 * 0.6, 9) AS q90
FROM qa, qt"""

def nodes_sql(base: str) -> str:
    return base + "," + top_n("top", "neigh", 125) + """,
qa AS (SELECT """ + quantiles("neigh", "a_") + """ FROM neigh),
qt AS (SELECT """ + quantiles("top", "t_") + """ FROM top),
thr AS (
  SELECT a_q10 * 0.4 + t_q10 * 0.6 AS q10, a_q30 * 0.3 + t_q30 * 0.7 AS q30,
         a_q70 * 0.3 + t_q70 * 0.7 AS q70, a_q90 * 0.4 + t_q90 * 0.6 AS q90
  FROM qa, qt
),
mc AS (SELECT min(count) AS min_count FROM top),
n AS (
  SELECT t.*, mc.min_count,
    CASE WHEN t.sentiment IS NULL OR thr.q10 IS NULL THEN NULL
         WHEN t.sentiment <= thr.q10 THEN 'very negative'
         WHEN t.sentiment <= thr.q30 THEN 'negative'
         WHEN t.sentiment < thr.q70 THEN 'neutral'
         WHEN t.sentiment < thr.q90 THEN 'positive'
         ELSE 'very positive' END AS band,
    string_split(t.keyword, ' ') AS w
  FROM top t, thr, mc
)
SELECT keyword, count,
  round(pow(ln(count / min_count) * 3, 1.5) + 50, 9) AS size,
  band,
  CASE band WHEN 'very negative' THEN '#CC0000' WHEN 'negative' THEN '#EF5350' WHEN 'neutral' THEN '#CCCCCC'
            WHEN 'positive' THEN '#66BB6A' WHEN 'very positive' THEN '#00C851' END AS color,
  CASE WHEN contains(keyword, ' ')
       THEN array_to_string(list_slice(w, 1, len(w) // 2), ' ') || '<br>'
            || array_to_string(list_slice(w, len(w) // 2 + 1, len(w)), ' ')
       ELSE keyword END AS label,
  'Tópico: ' || keyword || '<br>Menções: ' || CAST(count AS VARCHAR) || '<br>Último registo: '
    || """ + cap_month("last_archive") + """ AS caption,
  """ + cap_month("first_archive") + """ AS first_seen,
  """ + cap_month("last_archive") + """ AS last_seen
FROM n"""


ORACLE["relation_nodes"] = nodes_sql(STAR_BASE)

ORACLE["relation_years"] = STAR_BASE + "," + top_n("top", "neigh", 125) + """,
per AS (
  SELECT x.keyword, h.timestamp // 100 AS year, sum(x.n) AS mentions
  FROM hits h JOIN star_m x ON x.id = h.id
  WHERE x.n IS NOT NULL AND h.timestamp IS NOT NULL AND x.keyword IN (SELECT keyword FROM top)
  GROUP BY x.keyword, year
),
span AS (SELECT keyword, min(year) AS m0, max(year) AS m1 FROM per GROUP BY keyword),
b AS (
  SELECT t.keyword,
    least(TRY_CAST(substr(""" + seg5("t.first_archive") + """, 1, 4) AS INTEGER), s.m0) AS y0,
    greatest(TRY_CAST(substr(""" + seg5("t.last_archive") + """, 1, 4) AS INTEGER), s.m1) AS y1
  FROM top t LEFT JOIN span s ON s.keyword = t.keyword
),
spine AS (SELECT keyword, unnest(generate_series(y0, y1)) AS year FROM b WHERE y0 IS NOT NULL AND y1 IS NOT NULL)
SELECT s.keyword, CAST(s.year AS INTEGER) AS year, CAST(coalesce(p.mentions, 0) AS BIGINT) AS mentions
FROM spine s LEFT JOIN per p ON p.keyword = s.keyword AND p.year = s.year"""

ORACLE["relation_exists"] = STAR_BASE + """
SELECT k.keyword, k.keyword IN (SELECT keyword FROM neigh) AS present
FROM (SELECT DISTINCT trim(keyword) AS keyword FROM star_m) k"""

ORACLE["relation_summary"] = STAR_BASE + f"""
SELECT keyword, count, round(sentiment, {R}) AS sentiment, round((sentiment + 1) / 2 * 100, {R}) AS gauge FROM neigh"""

ORACLE["relation_history"] = STAR_BASE + """,
arts AS (SELECT make_date(timestamp // 100, timestamp % 100, 1) AS month, count(archive) AS articles
         FROM hits WHERE timestamp IS NOT NULL GROUP BY timestamp),
months AS (SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM arts),
km AS (
  SELECT x.keyword, make_date(h.timestamp // 100, h.timestamp % 100, 1) AS month, sum(x.n) AS mentions
  FROM hits h JOIN star_m x ON x.id = h.id
  WHERE x.n IS NOT NULL AND h.timestamp IS NOT NULL AND x.keyword IN (SELECT keyword FROM neigh)
  GROUP BY x.keyword, h.timestamp
)
SELECT n.keyword, strftime(m.month, '%Y-%m') AS month,
       CAST(coalesce(a.articles, 0) AS BIGINT) AS articles, CAST(coalesce(km.mentions, 0) AS BIGINT) AS mentions
FROM neigh n CROSS JOIN months m
LEFT JOIN arts a ON a.month = m.month
LEFT JOIN km ON km.keyword = n.keyword AND km.month = m.month"""

def articles_sql(base: str, m: str) -> str:
    return base + r""",
rows AS (
  SELECT x.keyword, h.archive, string_split(h.archive, '/') AS parts
  FROM hits h JOIN """ + m + r""" x ON x.id = h.id
  WHERE x.n IS NOT NULL AND x.keyword IN (SELECT keyword FROM neigh)
),
s AS (SELECT *, CASE WHEN parts[-1] <> '' THEN parts[-1] ELSE parts[-2] END AS slug FROM rows),
c AS (SELECT *, regexp_replace(split_part(split_part(slug, '?', 1), '_', 1), '^\d{4}-\d{2}-\d{2}-', '') AS clean FROM s),
t AS (SELECT *, CASE WHEN contains(clean, '-') THEN lower(clean) ELSE slug END AS title FROM c),
d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword, title
      ORDER BY TRY_CAST(parts[6] AS BIGINT) DESC NULLS LAST, archive ASC NULLS FIRST) AS rn FROM t) WHERE rn = 1
),
f AS (
  SELECT keyword, title,
    substr(parts[6], 1, 4) || '-' || substr(parts[6], 5, 2) || '-' || substr(parts[6], 7, 2) AS capture_date,
    replace(parts[9], 'www.', '') AS host,
    nullif(array_to_string(list_slice(parts, 7, len(parts)), '/'), '') AS original_url,
    archive
  FROM d
)
SELECT keyword, title, capture_date, host, original_url, """ + outlet_case("host") + """ AS outlet, archive FROM f"""


ORACLE["relation_articles"] = articles_sql(STAR_BASE, "star_m")

ORACLE["outlet_match"] = "WITH " + STAR + "," + TEXT + """,
hosts AS (
  SELECT DISTINCT replace(string_split(archive, '/')[9], 'www.', '') AS host
  FROM (SELECT archive FROM star_a UNION ALL SELECT archive FROM text_a)
)
SELECT host, """ + outlet_case("host") + " AS outlet FROM hosts"

ORACLE["recommend"] = STAR_BASE + f"""
SELECT keyword FROM neigh ORDER BY sha256('{SEED}:' || keyword), keyword LIMIT 5"""

ORACLE["keyword_weights"] = STAR_BASE + "SELECT keyword, count FROM neigh"

ORACLE["topic_key"] = "WITH " + STAR + """
SELECT DISTINCT keyword, substr(sha256(keyword), 1, 10) AS topic_key FROM star_m WHERE n IS NOT NULL"""

ALL_TOPICS = "WITH " + STAR + """,
hits_all AS (
  SELECT a.*, t.keyword AS topic FROM star_a a JOIN star_m t ON t.id = a.id WHERE t.n > 4
),
rel_all AS (
  SELECT h.topic, x.keyword, CAST(sum(x.n) AS BIGINT) AS count,
         sum(h.sentiment * x.n) / nullif(sum(CASE WHEN h.sentiment IS NOT NULL THEN x.n END), 0) AS sentiment,
         count(*) AS articles, min(h.archive) AS first_archive, max(h.archive) AS last_archive
  FROM hits_all h JOIN star_m x ON x.id = h.id
  WHERE x.n IS NOT NULL
  GROUP BY h.topic, x.keyword HAVING sum(x.n) >= 5
)
"""

ORACLE["relations_all_topics"] = ALL_TOPICS + f"SELECT topic, keyword, count, round(sentiment, {R}) AS sentiment FROM rel_all"

ORACLE["relation_store_roundtrip"] = ALL_TOPICS + f"""
SELECT topic, keyword, count, round(sentiment, {R}) AS sentiment, articles, first_archive, last_archive FROM rel_all"""

ORACLE["text_relations"] = ("WITH " + TEXT + "," + hits("thits", "text_m", "text_a", TEXT_TOPIC) + ","
                            + rel("trel", "thits", "text_m")
                            + f"\nSELECT keyword, count, round(sentiment, {R}) AS sentiment FROM trel")

TEXT_BASE = ("WITH " + TEXT + "," + hits("hits", "text_m", "text_a", TEXT_TOPIC) + "," + rel("rel", "hits", "text_m")
             + f""",
neigh AS (SELECT * FROM rel WHERE keyword <> {q(TEXT_TOPIC)})
""")

ORACLE["text_relation_nodes"] = nodes_sql(TEXT_BASE)

ORACLE["text_topic_history"] = TEXT_BASE + history("hits", "text_m", TEXT_TOPIC) + """
SELECT month, CAST(articles AS BIGINT) AS articles, top_label, month_label FROM hist"""

ORACLE["text_relation_articles"] = articles_sql(TEXT_BASE, "text_m")

ORACLE["relations_topic_list"] = "WITH " + STAR + """,
hits_l AS (
  SELECT a.*, t.keyword AS topic FROM star_a a JOIN star_m t ON t.id = a.id
  WHERE t.n > 4 AND t.keyword IN (""" + ", ".join(q(t) for t in TOPIC_LIST) + f""")
)
SELECT h.topic, x.keyword, CAST(sum(x.n) AS BIGINT) AS count,
       round(sum(h.sentiment * x.n) / nullif(sum(CASE WHEN h.sentiment IS NOT NULL THEN x.n END), 0), {R}) AS sentiment
FROM hits_l h JOIN star_m x ON x.id = h.id
WHERE x.n IS NOT NULL
GROUP BY h.topic, x.keyword HAVING sum(x.n) >= 5"""

ORACLE["outlet_match_table"] = "WITH " + TEXT + """,
hosts AS (SELECT DISTINCT replace(string_split(archive, '/')[9], 'www.', '') AS host FROM text_a)
SELECT host, """ + outlet_case("host") + " AS outlet FROM hosts"

ORACLE["text_sentiment_quantiles"] = TEXT_BASE + """,
qa AS (SELECT """ + quantiles("neigh") + """ FROM neigh)
SELECT """ + ", ".join(f"round(q{p}, {R}) AS q{p}" for p in (10, 30, 70, 90)) + " FROM qa"


# --- defaults of the cut-offs, a search without results, and reports over them

ORACLE["topic_history_default"] = STAR_BASE + history("hits", "star_m", STAR_TOPIC) + """
SELECT month, CAST(articles AS BIGINT) AS articles, top_label, month_label FROM hist"""

ORACLE["neighbours_top_default"] = STAR_BASE + "," + top_n("top", "neigh", 125) + "\nSELECT keyword, count FROM top"

ORACLE["sentiment_thresholds_default"] = ORACLE["sentiment_thresholds"].replace(f"rnk <= {SMALL_TOP}", "rnk <= 125")

ABSENT_BASE = "WITH " + STAR + "," + hits("hits", "star_m", "star_a", "no such part") + "," + rel("rel", "hits", "star_m")

ORACLE["absent_topic"] = ABSENT_BASE + f"\nSELECT keyword, count, round(sentiment, {R}) AS sentiment FROM rel"

ORACLE["relation_articles_all"] = STAR_BASE + """
SELECT x.keyword, h.archive FROM hits h JOIN star_m x ON x.id = h.id
WHERE x.n IS NOT NULL AND x.keyword IN (SELECT keyword FROM neigh)"""

ORACLE["history_peak_two"] = ORACLE["relation_history"].replace("SELECT n.keyword, strftime", "SELECT keyword, round(greatest(max(articles), max(mentions))::DOUBLE * 1.1, 9) AS peak FROM (\nSELECT n.keyword, strftime") + ") GROUP BY keyword"

ORACLE["relation_exists_trimmed"] = STAR_BASE + """
SELECT k.keyword, k.keyword IN (SELECT keyword FROM neigh) AS present
FROM (SELECT DISTINCT trim(keyword) AS keyword FROM star_m) k"""

ORACLE["relations_json_roundtrip"] = STAR_BASE + f""",
rm AS (
  SELECT x.keyword, CAST(h.timestamp AS VARCHAR) AS k, sum(x.n) AS mentions
  FROM hits h JOIN star_m x ON x.id = h.id
  WHERE x.keyword IN (SELECT keyword FROM rel) GROUP BY x.keyword, k),
rs AS (
  SELECT x.keyword, h.source AS k, count(*) AS articles
  FROM hits h JOIN star_m x ON x.id = h.id
  WHERE x.keyword IN (SELECT keyword FROM rel) GROUP BY x.keyword, k),
jm AS (SELECT keyword, '{{' || string_agg('"' || k || '":' || CAST(mentions AS VARCHAR), ',' ORDER BY k) || '}}' AS months FROM rm GROUP BY keyword),
js AS (SELECT keyword, '{{' || string_agg('"' || k || '":' || CAST(articles AS VARCHAR), ',' ORDER BY k) || '}}' AS sources FROM rs GROUP BY keyword)
SELECT r.keyword, r.count, round(r.sentiment, {R}) AS sentiment, jm.months, js.sources
FROM rel r JOIN jm USING (keyword) JOIN js USING (keyword)"""

ORACLE["search_detail"] = STAR_BASE + """
SELECT x.keyword, CAST(sum(x.n) AS BIGINT) AS count, CAST(count(DISTINCT h.archive) AS BIGINT) AS articles
FROM hits h JOIN star_m x ON x.id = h.id WHERE x.keyword = 'blue ring' GROUP BY x.keyword HAVING sum(x.n) >= 5"""


# --- the record store: the same answers as from the corpus

ORACLE["records_relations"] = ALL_TOPICS + f"""
SELECT topic, keyword, count, round(sentiment, {R}) AS sentiment, articles, first_archive, last_archive FROM rel_all
WHERE topic IN ({", ".join(q(t) for t in TOPIC_LIST)})"""

ORACLE["records_detail"] = ORACLE["search_detail"]
ORACLE["records_months"] = ORACLE["relation_months"]
ORACLE["records_sources"] = ORACLE["relation_sources"]
ORACLE["records_history"] = ORACLE["relation_history"]
ORACLE["records_years"] = ORACLE["relation_years"]
ORACLE["records_topic_history"] = ORACLE["topic_history_default"]
ORACLE["records_nodes"] = ORACLE["relation_nodes"]
ORACLE["records_articles"] = ORACLE["relation_articles"] + f" WHERE keyword = {q(TOPIC_LIST[2])}"

ORACLE["articles_newest"] = "SELECT keyword, position, archive FROM (SELECT keyword, archive, row_number() OVER " \
    "(PARTITION BY keyword ORDER BY capture_date DESC NULLS LAST, archive DESC NULLS LAST) AS position FROM (\n" \
    + ORACLE["relation_articles"] + f"\n)) WHERE position <= {NEWEST}"

ORACLE["relations_all_topics_top"] = ALL_TOPICS + f"""
SELECT topic, keyword, count FROM (
  SELECT topic, keyword, count, row_number() OVER (PARTITION BY topic ORDER BY count DESC, keyword) AS rnk FROM rel_all WHERE keyword <> topic)
WHERE rnk <= {NEWEST}"""

ORACLE["corpus_summary_statistics"] = ORACLE["corpus_summary"]

ORACLE["read_rejects"] = "WITH " + STAR + f"""
SELECT timestamp, count(*) AS articles, CAST(count(*) FILTER (WHERE id % {BROKEN} = 0) AS BIGINT) AS rejected FROM star_a GROUP BY timestamp"""

ORACLE["relations_scoped"] = STAR_BASE + "," + top_n("top", "neigh", SMALL_TOP) + """
SELECT keyword, count, (SELECT count(*) FROM rel) AS relations FROM top"""
