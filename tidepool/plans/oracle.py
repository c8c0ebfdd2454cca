"""The same queries in SQL, for comparison on the same tables; the few that SQL cannot express have none."""

from __future__ import annotations

from tidepool.config import DEFAULT_TURN_TAG, EXEMPT_MARKER, FIRST_TURN_TAG, NEGATIONS, NOISE_MARKERS, PROTECTED_MARKERS, STOP_WORDS, TURN_TAGS
from tidepool.functions.text import PUNCTUATION, SPACE
from tidepool.operators.journal import CONFIRMED, CORRECTED
from tidepool.plans.inputs import AS_OF, KEYWORD, KEYWORDS, OWNER, PROMPTS, SEEDS


def _any(column: str, words: tuple[str, ...]) -> str:
    return "coalesce(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ", false)"


def _tokens(column: str) -> str:
    low = f"lower(coalesce({column}, ''))"
    return f"list_concat(regexp_extract_all({low}, '[a-z0-9_]+'), regexp_extract_all({low}, '[一-鿿]'))"


def _normal(column: str) -> str:
    return f"regexp_replace({column}, '[{SPACE}{PUNCTUATION}]', '', 'g')"


def _grams(column: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({_normal(column)}), 1)), lambda i: substr({_normal(column)}, i, 2)))"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


_TAGS = "CASE WHEN regexp_matches(tags, '^\\s*\\[') AND json_valid(tags) THEN array_to_string(from_json(tags, '[\"VARCHAR\"]'), ',') ELSE coalesce(tags, '') END"
_PROTECTED = f"(coalesce(layer = 'core', false) OR {_any('tags', PROTECTED_MARKERS)})"
_DECAY = f"""
WITH m AS (SELECT id, heat, {_PROTECTED} AS protected, try_strptime(substr(last_sparked_at, 1, 19), '%Y-%m-%d %H:%M:%S') AS sparked FROM memories WHERE heat > 0),
d AS (SELECT *, greatest(0.0::DOUBLE, coalesce(date_diff('second', sparked, TIMESTAMP '{AS_OF}') / 86400.0::DOUBLE, 1.0::DOUBLE)) AS days FROM m),
n AS (SELECT *, CASE WHEN protected THEN greatest(heat * exp(-0.02::DOUBLE * days), 0.5::DOUBLE) ELSE heat * exp(-0.10::DOUBLE * days) END AS new_heat FROM d),
decayed AS (SELECT id, heat, new_heat, protected, abs(new_heat - heat) > 1e-6 AS changed, NOT protected AND new_heat < 0.15 AS cold FROM n)
"""
_KEYWORDS = "fixed(keyword) AS (VALUES " + ", ".join(f"('{k}')" for k in KEYWORDS) + f"), keywords AS (SELECT keyword FROM fixed UNION SELECT regexp_extract(content, '{KEYWORD}', 0) FROM memories WHERE id % 100 = 0 AND regexp_matches(content, '{KEYWORD}'))"
_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY id) AS counter FROM memories WHERE owner IS NOT NULL AND id IS NOT NULL)"
_TURNS = f"WITH {_SEQ}, turns AS (SELECT id, owner, counter, content AS usr, lead(content) OVER (PARTITION BY owner ORDER BY id) AS assistant, lead(content, 2) OVER (PARTITION BY owner ORDER BY id) AS next_user FROM seq)"
_GRAMS = f"""
WITH r AS (SELECT owner, id, content, {_any('tags', (EXEMPT_MARKER,))} AS exempt, row_number() OVER (PARTITION BY owner ORDER BY id) AS seq FROM memories WHERE status = 'active' AND content IS NOT NULL AND owner IS NOT NULL),
g AS (SELECT owner, id, seq, exempt, {_grams('content')} AS grams, length({_normal('content')}) AS n FROM r),
pairs AS (SELECT a.id, b.id AS old, a.n, a.seq - b.seq AS gap, b.exempt, CASE WHEN least(len(a.grams), len(b.grams)) > 0 THEN len(list_intersect(a.grams, b.grams)) / least(len(a.grams), len(b.grams))::DOUBLE ELSE 0.0 END AS overlap
  FROM g a JOIN g b ON a.owner = b.owner AND b.seq < a.seq AND b.seq >= a.seq - 30)
"""
_SUPERSEDE = "(SELECT id, old AS outdated, round(overlap, 6) AS overlap FROM pairs WHERE gap <= 10 AND NOT exempt AND overlap >= 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY old DESC) = 1)"
_SEL = f"""
WITH opt AS (SELECT row_number() OVER (ORDER BY name) - 1 AS oid, name, trim(name || ' ' || description) AS text FROM (SELECT name, min(coalesce(description, '')) AS description FROM tools WHERE name IS NOT NULL GROUP BY name)),
ot AS (SELECT oid, w, count(*) AS tf FROM (SELECT oid, unnest({_tokens('text')}) AS w FROM opt) GROUP BY oid, w),
os AS (SELECT oid, len({_tokens('text')}) AS dl, len(list_distinct({_tokens('text')})) AS size FROM opt),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM os WHERE dl > 0),
idf AS (SELECT w, count(*) AS df, ln(1 + (max(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM ot, st GROUP BY w),
wt AS (SELECT w, oid, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part FROM ot JOIN os USING (oid) JOIN idf USING (w), st),
ctx AS (SELECT gold_id AS qid, context, label FROM gold),
sc AS (SELECT qid, oid, count(*) AS shared, sum(part) AS bm25 FROM (SELECT DISTINCT qid, w FROM (SELECT qid, unnest({_tokens('context')}) AS w FROM ctx)) JOIN wt USING (w) GROUP BY qid, oid),
fl AS (SELECT c.qid, o.oid, o.name, round(least(coalesce(bm25, 0), 40) / 20.0::DOUBLE, 12) AS s FROM ctx c CROSS JOIN opt o LEFT JOIN sc ON sc.qid = c.qid AND sc.oid = o.oid),
mx AS (SELECT *, max(s) OVER (PARTITION BY qid) AS top FROM fl),
pr AS (SELECT *, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY qid) AS p, row_number() OVER (PARTITION BY qid ORDER BY s DESC, oid) AS k FROM mx),
pred AS (SELECT qid, max(CASE WHEN k = 1 THEN oid END) AS choice, max(CASE WHEN k = 1 THEN p END) AS confidence, max(CASE WHEN k = 1 THEN p END) - coalesce(max(CASE WHEN k = 2 THEN p END), 0) AS margin FROM pr GROUP BY qid),
names AS (SELECT list(name ORDER BY oid) AS names FROM opt),
rp AS (SELECT qid, coalesce(s[1], b[1], names[1]) AS name, coalesce(s[1], b[1]) IS NOT NULL AS opinion FROM (SELECT qid, names,
  list_filter(names, lambda x: contains(replace(low, '_', ' '), replace(lower(x), '_', ' '))) AS s, list_filter(names, lambda x: contains(low, lower(x))) AS b FROM (SELECT qid, lower(coalesce(context, '')) AS low FROM ctx), names)),
dec AS (SELECT c.qid, c.label, o.oid, pred.choice = o.oid AS ok, pr.p AS p_gold, confidence, margin FROM ctx c JOIN opt o ON o.name = c.label JOIN pred ON pred.qid = c.qid JOIN pr ON pr.qid = c.qid AND pr.oid = o.oid),
ecet AS (SELECT coalesce(sum(n * abs(a - c)) / sum(n), 0) AS ece FROM (SELECT count(*) AS n, avg(confidence) AS c, avg(ok::INT) AS a FROM dec GROUP BY least(9, floor(confidence * 10))))
"""
_ADJ = "adj AS (SELECT src AS node, dst AS neighbour, coalesce(relation, '关联') AS relation, ord * 2 AS adj_ord FROM edges WHERE src <> '' AND dst <> '' UNION ALL SELECT dst, src, coalesce(relation, '关联'), ord * 2 + 1 FROM edges WHERE src <> '' AND dst <> '')"
_FTS = f"""
WITH {_KEYWORDS}, ph AS (SELECT DISTINCT keyword, lower(trim(keyword)) AS p FROM keywords WHERE length(trim(keyword)) >= 3),
d AS (SELECT id, lower(coalesce(content, '')) AS c, lower(coalesce(tags, '')) AS t, greatest(length(coalesce(content, '')) - 2, 0) + greatest(length(coalesce(tags, '')) - 2, 0) AS dl FROM memories),
w AS (SELECT count(*) AS n_all, avg(dl) AS avgdl FROM d),
h AS (SELECT keyword, id, dl, len(list_filter(range(1, greatest(length(c) - length(p) + 2, 1)), lambda i: substr(c, i, length(p)) = p)) + len(list_filter(range(1, greatest(length(t) - length(p) + 2, 1)), lambda i: substr(t, i, length(p)) = p)) AS tf
  FROM d JOIN ph ON contains(c, p) OR contains(t, p)),
f AS (SELECT keyword, count(*) AS n FROM h GROUP BY keyword),
s AS (SELECT keyword, id, round(-greatest(ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), CASE WHEN ln((n_all - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) > 0 THEN 0 ELSE 1e-6 END) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 9) AS score FROM h JOIN f USING (keyword), w),
ranked AS (SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY score, id) AS rank, id, score FROM s),
sd AS (SELECT id, lower({_TAGS} || coalesce(content, '')) AS x FROM memories WHERE owner = '{OWNER}' AND status = 'active'),
scan AS (SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY id) AS rank, id FROM sd JOIN keywords ON keyword <> '' AND contains(x, lower(keyword)))
"""


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["heat_decay"] = _DECAY + "SELECT id, heat, round(new_heat, 6) AS new_heat, protected, changed, cold FROM decayed"
    q["heat_decay_summary"] = _DECAY + "SELECT count(*) FILTER (changed) AS changed, count(*) FILTER (protected) AS protected, count(*) FILTER (cold) AS cold FROM decayed"
    q["heat_histogram"] = f"""SELECT owner, count(*) AS total, count(*) FILTER (heat > 0) AS hot, count(*) FILTER ({_PROTECTED}) AS protected, count(*) FILTER (heat > 0 AND heat < 0.15 AND NOT {_PROTECTED}) AS sunk,
      count(*) FILTER (heat > 2) AS over_2, count(*) FILTER (heat > 1 AND heat <= 2) AS over_1, count(*) FILTER (heat >= 0.5 AND heat <= 1) AS over_half, count(*) FILTER (heat > 0 AND heat < 0.5) AS under_half FROM memories GROUP BY owner"""
    q["heat_spark_pulse"] = "SELECT id, round(least(coalesce(heat, 0) + 0.3::DOUBLE * coalesce(hit_count, 0), 5.0::DOUBLE), 6) AS new_heat FROM memories"
    q["protected_rows"] = f"SELECT id FROM memories WHERE {_PROTECTED}"
    q["read_active"] = f"SELECT id, coalesce(ts, '') AS ts, {_TAGS} AS tags, coalesce(content, '') AS content FROM memories WHERE owner = '{OWNER}' AND status = 'active'"
    last = "SELECT owner, id, content, row_number() OVER (PARTITION BY owner ORDER BY id DESC) AS k FROM memories"
    q["read_recent"] = f"SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY id) AS rank, id, content FROM ({last} WHERE status = 'active') WHERE k <= 30"
    q["read_recent_all_status"] = f"SELECT owner, k AS rank, id, content FROM ({last}) WHERE k <= 30"
    q["ledger_counts"] = "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'outdated') AS outdated, count(*) FILTER (layer = 'core') AS core, count(*) FILTER (heat > 0) AS hot FROM memories"
    identity = "SELECT row_number() OVER (ORDER BY confidence DESC NULLS LAST, id) AS rank, id, substr(content, 1, 60) AS line FROM memories WHERE layer = 'core'"
    q["identity_topk"] = f"SELECT * FROM ({identity}) WHERE rank <= 3"
    q["weak_points"] = "SELECT DISTINCT source AS topic FROM memories WHERE heat >= confidence"
    q["std_object_preview"] = "SELECT id, substr(content, 1, 30) AS preview, layer FROM memories"
    q["owner_sequence"] = f"WITH {_SEQ} SELECT owner, id, counter AS seq FROM seq"
    q["status_ledger"] = _GRAMS + f"SELECT m.id, coalesce(max(s.id), m.id) AS at, CASE WHEN max(s.id) IS NULL THEN m.status ELSE 'outdated' END AS status FROM memories m LEFT JOIN {_SUPERSEDE} s ON s.outdated = m.id WHERE m.status = 'active' GROUP BY m.id, m.status"
    bare = _strip("content")
    shell = f"coalesce(length({bare}) < 5 OR {_strip(f'replace(replace({bare}, $$用户：$$, $$$$), $$助手：$$, $$$$)')} = '', true)"
    q["write_gates"] = f"SELECT id, CASE WHEN {shell} THEN 'shell' WHEN {_any('content', NOISE_MARKERS)} THEN 'noise' ELSE 'pass' END AS verdict, CASE WHEN {_any('tags', PROTECTED_MARKERS)} THEN 'core' ELSE 'plain' END AS new_layer FROM memories"
    q["turn_text"] = _TURNS + "SELECT id, '用户：' || substr(coalesce(usr, ''), 1, 300) || chr(10) || '助手：' || substr(coalesce(assistant, ''), 1, 300) AS text FROM turns"
    q["turn_tags"] = _TURNS + f"SELECT id, CASE WHEN counter = 1 THEN '{FIRST_TURN_TAG}' " + " ".join(f"WHEN {_any('usr', words)} THEN '{tag}'" for tag, words in TURN_TAGS) + f" ELSE '{DEFAULT_TURN_TAG}' END AS tag FROM turns"
    date = "(\\d{1,2})月(\\d{1,2})日"
    q["event_time"] = f"""SELECT id, CASE WHEN contains(content, '昨天') THEN strftime(TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') WHEN contains(content, '前天') THEN strftime(TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S')
      WHEN regexp_matches(content, '{date}') THEN '2026-' || lpad(regexp_extract(content, '{date}', 1), 2, '0') || '-' || lpad(regexp_extract(content, '{date}', 2), 2, '0') || ' 00:00:00'
      WHEN regexp_matches(content, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN regexp_extract(content, '\\d{{4}}-\\d{{2}}-\\d{{2}}') || ' 00:00:00' ELSE '' END AS event_time FROM memories"""
    q["dedup_window"] = _GRAMS + "SELECT id, old AS duplicate_of, round(overlap, 6) AS overlap FROM pairs WHERE n >= 12 AND overlap >= 0.95 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, old DESC) = 1"
    q["supersede"] = _GRAMS + f"SELECT * FROM {_SUPERSEDE}"
    bare = f"regexp_replace(t, '{'|'.join(NEGATIONS)}', '', 'g')"
    q["core_conflict"] = f"""WITH t AS (SELECT id, owner, layer, {_normal('lower(content)')} AS t, {_normal("lower('不' || content)")} AS n FROM memories),
      a AS (SELECT id, owner, {bare.replace('(t,', '(n,')} AS bare FROM t WHERE id % 100 = 0 OR layer = 'core'), c AS (SELECT id AS core_id, owner, {bare} AS bare, {bare} <> t AS negated FROM t WHERE layer = 'core')
      SELECT id, min(core_id) AS core_id FROM a JOIN c ON a.owner = c.owner AND a.bare = c.bare WHERE a.bare <> '' AND NOT negated GROUP BY id"""
    q["normalise"] = f"SELECT id, {_normal('content')} AS text FROM memories"
    q["char_bigrams"] = f"SELECT id, len({_grams('content')})::BIGINT AS n FROM (SELECT id, coalesce(content, '') AS content FROM memories)"
    q["bigram_overlap"] = _TURNS + f", g AS (SELECT id, {_grams('usr')} AS a, {_grams('assistant')} AS b FROM turns WHERE usr IS NOT NULL AND assistant IS NOT NULL) SELECT id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE ELSE 0.0::DOUBLE END, 6) AS overlap FROM g"
    q["tokenize"] = f"SELECT id, array_to_string({_tokens('content')}, ' ') AS tokens FROM memories"
    q["token_bigrams"] = f"SELECT id, array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || '_' || t[i + 1]))), ' ') AS bigrams FROM (SELECT id, {_tokens('content')} AS t FROM memories)"
    q["token_estimate"] = "SELECT doc_id, floor(len(regexp_extract_all(coalesce(text, ''), '[一-鿿]')) + len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) * 1.3::DOUBLE)::BIGINT AS tokens FROM documents"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    q["concept_extract"] = f"SELECT id, array_to_string(list_filter(regexp_extract_all(coalesce(content, ''), '[一-鿿]{{2,6}}|[A-Za-z]{{3,}}'), lambda w: w NOT IN ({stop}))[1:8], ' ') AS concepts FROM memories"
    q["core_keywords"] = "SELECT DISTINCT keyword FROM (SELECT unnest(regexp_extract_all(coalesce(content, ''), '[一-鿿]{2,6}')) AS keyword FROM memories WHERE layer = 'core' UNION ALL SELECT unnest(regexp_extract_all(coalesce(tags, ''), '[一-鿿]{2,4}')) FROM memories WHERE layer = 'core')"
    q["fts_search"] = _FTS + "SELECT keyword, rank, id, round(score, 6) AS score FROM ranked WHERE rank <= 10"
    q["scan_search"] = _FTS + "SELECT keyword, rank, id FROM scan WHERE rank <= 5"
    q["search_with_fallback"] = _FTS + "SELECT keyword, rank, id FROM ranked WHERE rank <= 5 UNION ALL SELECT keyword, rank, id FROM scan WHERE rank <= 5 AND keyword NOT IN (SELECT keyword FROM ranked)"
    q["option_catalogue"] = _SEL + "SELECT oid, name, text FROM opt"
    q["gold_known"] = "SELECT gold_id AS qid, context, label FROM gold WHERE label IN (SELECT name FROM tools)"
    q["stored_model"] = "SELECT e.key AS w, round(e.value, 9) AS idf, avgdl, n FROM (SELECT unnest(map_entries(lex.idf)) AS e, lex.avgdl AS avgdl, lex.n::BIGINT AS n FROM lex_model)"
    q["idf_fit"] = _SEL + "SELECT w, df, round(idf, 9) AS idf FROM idf"
    q["bm25_scores"] = _SEL + "SELECT c.qid, o.oid, coalesce(shared, 0) AS shared, round(coalesce(bm25, 0), 6) AS bm25 FROM ctx c CROSS JOIN opt o LEFT JOIN sc ON sc.qid = c.qid AND sc.oid = o.oid"
    grams = "list_distinct(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || '_' || t[i + 1]))"
    q["selector_features"] = _SEL + f""", cg AS (SELECT qid, unnest({grams}) AS g FROM (SELECT qid, {_tokens('context')} AS t FROM ctx)), og AS (SELECT oid, unnest({grams}) AS g FROM (SELECT oid, {_tokens('text')} AS t FROM opt)),
      xb AS (SELECT qid, oid, count(*) AS shared_bigrams FROM cg JOIN og USING (g) GROUP BY qid, oid)
      SELECT c.qid, os.oid, coalesce(shared, 0) AS shared, least(coalesce(shared, 0), 5)::BIGINT AS ov, least(floor(coalesce(shared, 0) * 10 / greatest(1, size)), 10)::BIGINT AS ratio, coalesce(shared_bigrams, 0)::BIGINT AS shared_bigrams, round(least(coalesce(bm25, 0), 40) / 20, 6) AS bm25
      FROM ctx c CROSS JOIN os LEFT JOIN sc ON sc.qid = c.qid AND sc.oid = os.oid LEFT JOIN xb ON xb.qid = c.qid AND xb.oid = os.oid"""
    q["selector_probs"] = _SEL + "SELECT qid, oid, round(p, 6) AS p FROM pr"
    q["selector_predict"] = _SEL + "SELECT qid, choice, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM pred"
    q["selector_topk"] = _SEL + "SELECT qid, k AS rank, name, round(p, 4) AS p FROM pr WHERE k <= 5"
    q["selector_gate"] = _SEL + "SELECT qid, choice, round(confidence, 4) >= 0.05 AND round(margin, 4) >= 0.03 AS passed FROM pred"
    q["rule_pick"] = _SEL + "SELECT qid, name, opinion FROM rp"
    q["eval_metrics"] = _SEL + "SELECT count(*) AS n, count(*) FILTER (ok) AS hits, round(avg(ok::INT), 6) AS top1, round(avg(-ln(greatest(p_gold, 1e-12))), 6) AS logloss, round(max(ece), 6) AS ece FROM dec, ecet"
    q["eval_per_class"] = _SEL + "SELECT label, count(*) AS n, count(*) FILTER (ok) AS hits, round(avg(ok::INT), 6) AS accuracy FROM dec GROUP BY label"
    q["ece"] = _SEL + "SELECT round(ece, 6) AS ece FROM ecet"
    q["baselines"] = _SEL + """, maj AS (SELECT label AS majority FROM dec GROUP BY label ORDER BY count(*) DESC, min(qid) LIMIT 1), k AS (SELECT count(*) AS n_options FROM opt)
      SELECT count(*) AS n, max(majority) AS majority, round(avg((label = majority)::INT), 6) AS majority_top1, round(avg((label = rp.name)::INT), 6) AS rule_top1, round(avg(ok::INT), 6) AS bm25_top1, round(avg(1.0::DOUBLE / n_options), 6) AS random_top1 FROM dec JOIN rp USING (qid), maj, k"""
    q["gate_sweep"] = _SEL + """, th(threshold) AS (VALUES (0.0::DOUBLE), (0.15), (0.20), (0.25), (0.30), (0.40), (0.50)),
      e AS (SELECT threshold, ok, label = rp.name AS rule, round(confidence, 4) >= threshold AND round(margin, 4) >= 0.03 AS injected FROM dec JOIN rp USING (qid), th)
      SELECT threshold, count(*) FILTER (injected) AS injected, round(count(*) FILTER (injected) / count(*), 4) AS coverage, CASE WHEN count(*) FILTER (injected) > 0 THEN round(count(*) FILTER (injected AND ok) / count(*) FILTER (injected), 4) END AS hint_top1,
      count(*) FILTER (injected AND NOT ok) AS harm, CASE WHEN count(*) FILTER (injected) > 0 THEN round(count(*) FILTER (injected AND ok) / count(*) FILTER (injected) - avg(rule::INT), 4) END AS gain FROM e GROUP BY threshold"""
    q["opinion_subsets"] = _SEL + "SELECT opinion, count(*) AS n, round(avg(ok::INT), 6) AS selector_top1, round(avg((label = rp.name)::INT), 6) AS rule_top1 FROM dec JOIN rp USING (qid) GROUP BY opinion"
    q["turn_answer"] = _SEL + "SELECT rp.qid, CASE WHEN passed THEN 1 ELSE 2 END::BIGINT AS channel, CASE WHEN passed THEN opt.name ELSE rp.name END AS text FROM rp JOIN (SELECT qid, choice, round(confidence, 4) >= 0.05 AND round(margin, 4) >= 0.03 AS passed FROM pred) USING (qid) JOIN opt ON opt.oid = choice"
    q["label_dist"] = "SELECT label, count(*) AS n FROM gold GROUP BY label"
    q["latency_percentiles"] = "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS largest, round(list_sort(list(value))[greatest(0, floor(count(*) * 0.95::DOUBLE)::BIGINT - 1) + 1], 6) AS p95 FROM events WHERE value IS NOT NULL"
    q["graph_load"] = f"WITH {_ADJ} SELECT * FROM adj"
    q["graph_sense"] = f"""WITH n AS (SELECT id AS node, coalesce(nullif(title, ''), id) AS title, ord FROM nodes), w AS (SELECT DISTINCT node, unnest(string_split_regex(lower(title), '[{SPACE}]+')) AS w FROM n),
      t AS (SELECT gold_id AS qid, lower(context) AS x FROM gold WHERE context IS NOT NULL), h AS (SELECT qid, node, 0.8::DOUBLE AS score FROM t JOIN n ON contains(x, lower(title)) UNION ALL SELECT qid, node, 0.5::DOUBLE FROM t JOIN w ON length(w) > 1 AND contains(x, w)),
      b AS (SELECT qid, node, max(score) AS score FROM h GROUP BY qid, node)
      SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord, node) AS rank, node, title, score FROM b JOIN n USING (node)) WHERE rank <= 5"""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    q["graph_walk"] = f"""WITH {_ADJ}, seeds(qid, rank, node) AS (VALUES {', '.join(f"({a}::BIGINT, {b}, '{c}')" for a, b, c in SEEDS)} UNION ALL SELECT 1000 + ord, 1, id FROM nodes WHERE ord % 100 = 0), s AS (SELECT qid, node, min(rank) AS place FROM seeds GROUP BY qid, node),
      f1 AS (SELECT s.qid, s.place AS parent, adj_ord, neighbour AS node, relation FROM s JOIN adj USING (node) WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.qid = s.qid AND x.node = neighbour) QUALIFY row_number() OVER (PARTITION BY s.qid, neighbour ORDER BY s.place, adj_ord) = 1),
      c1 AS (SELECT qid, parent, coalesce(sum(count(*)) OVER (PARTITION BY qid ORDER BY parent {before}), 0) AS earlier FROM f1 GROUP BY qid, parent),
      l1 AS (SELECT f1.qid, (earlier + row_number() OVER (PARTITION BY f1.qid, f1.parent ORDER BY adj_ord))::BIGINT AS place, node, relation, 1::BIGINT AS depth FROM f1 JOIN c1 ON c1.qid = f1.qid AND c1.parent = f1.parent WHERE earlier < 8),
      f2 AS (SELECT l1.qid, l1.place AS parent, adj_ord, neighbour AS node, adj.relation FROM l1 JOIN adj ON adj.node = l1.node WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.qid = l1.qid AND x.node = neighbour) AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.qid = l1.qid AND x.node = neighbour)
        QUALIFY row_number() OVER (PARTITION BY l1.qid, neighbour ORDER BY l1.place, adj_ord) = 1),
      c2 AS (SELECT qid, parent, (SELECT count(*) FROM l1 WHERE l1.qid = f2.qid) + coalesce(sum(count(*)) OVER (PARTITION BY qid ORDER BY parent {before}), 0) AS earlier FROM f2 GROUP BY qid, parent),
      l2 AS (SELECT f2.qid, (earlier + row_number() OVER (PARTITION BY f2.qid, f2.parent ORDER BY adj_ord))::BIGINT AS place, node, relation, 2::BIGINT AS depth FROM f2 JOIN c2 ON c2.qid = f2.qid AND c2.parent = f2.parent WHERE earlier < 8)
      SELECT * FROM l1 UNION ALL SELECT * FROM l2"""
    sense = q["graph_sense"].replace("SELECT gold_id AS qid, lower(context) AS x FROM gold WHERE context IS NOT NULL", "SELECT qid, lower(text) AS x FROM texts")
    walk = f"WITH {_ADJ}, seeds AS (SELECT qid, rank, node FROM hits), s AS (" + q["graph_walk"].split("), s AS (", 1)[1]
    q["prefetch"] = f"""WITH texts(qid, text) AS (VALUES {', '.join(f"({a}::BIGINT, '{b}')" for a, b in PROMPTS)} UNION ALL SELECT 1000 + gold_id, context FROM gold WHERE gold_id % 100 = 0), hits AS ({sense}), near AS ({walk}),
      told AS (SELECT qid, rank AS place, title FROM hits UNION ALL SELECT qid, place + 1000000, coalesce(nullif(title, ''), id, node) FROM near LEFT JOIN nodes ON id = node),
      asked AS (SELECT qid, title, min(place) AS place, 3 AS most FROM told GROUP BY qid, title UNION ALL SELECT qid, text, 0, 5 FROM texts WHERE text <> '' AND qid NOT IN (SELECT qid FROM hits)),
      keywords AS (SELECT DISTINCT title AS keyword FROM asked), ph AS {_FTS.split(", ph AS ", 1)[1]},
      found AS (SELECT keyword, rank, id FROM ranked WHERE rank <= 5 UNION ALL SELECT keyword, rank, id FROM scan WHERE rank <= 5 AND keyword NOT IN (SELECT keyword FROM ranked)),
      e AS (SELECT qid, id, min(place * 1000 + rank) AS first FROM asked JOIN found ON title = keyword WHERE rank <= most GROUP BY qid, id)
      SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first, id) AS rank, id FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY first, id) <= 5"""
    step = "SELECT p.qid, h.neighbour AS node, sum(p.strength * h.share * 0.5::DOUBLE) AS strength FROM {0} p JOIN sh h ON h.node = p.node GROUP BY p.qid, h.neighbour"
    q["spread"] = f"""WITH {_ADJ}, dg AS (SELECT node, count(*) AS d FROM adj GROUP BY node), sh AS (SELECT node, neighbour, count(*) / max(d)::DOUBLE AS share FROM adj JOIN dg USING (node) GROUP BY node, neighbour),
      p0(qid, node, strength) AS (VALUES (0::BIGINT, 'n0', 1.0::DOUBLE), (0, 'n5', 0.5), (1, 'n7', 1.0) UNION ALL SELECT 1000 + ord, id, 1.0 FROM nodes WHERE ord % 100 = 0), p1 AS ({step.format('p0')}), p2 AS ({step.format('p1')})
      SELECT qid, node, round(sum(strength), 9) AS strength FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY qid, node"""
    q["cooccurrence"] = "WITH i AS (SELECT DISTINCT src, relation FROM edges WHERE src IS NOT NULL AND relation IS NOT NULL) SELECT x.relation AS a, y.relation AS b, count(*) AS n FROM i x JOIN i y ON x.src = y.src AND x.relation < y.relation GROUP BY 1, 2 HAVING count(*) >= 2"
    q["theme_partition"] = f"""WITH RECURSIVE {_ADJ}, links AS (SELECT DISTINCT node, neighbour FROM adj), r(node, far) AS (SELECT DISTINCT node, node FROM links UNION SELECT r.node, l.neighbour FROM r JOIN links l ON l.node = r.far),
      p AS (SELECT node, min(far) AS part FROM r GROUP BY node), d AS (SELECT node, count(*) AS d FROM links GROUP BY node)
      SELECT node, part, row_number() OVER (PARTITION BY part ORDER BY d DESC, node) = 1 AS is_centre FROM p JOIN d USING (node)"""
    q["recall_channels"] = _FTS.replace("('notes_')", "('notes_'), ('logbook')") + f""", idn AS ({identity}), weak AS (SELECT DISTINCT source AS topic FROM memories WHERE heat >= confidence AND source IS NOT NULL),
      a AS (SELECT 'identity' AS channel, 1::BIGINT AS channel_rank, rank, id::VARCHAR AS id, line FROM idn UNION ALL SELECT 'lit', 2, rank, ranked.id::VARCHAR, substr(coalesce(content, ''), 1, 25) FROM ranked JOIN memories m ON m.id = ranked.id WHERE keyword = 'logbook'
      UNION ALL SELECT 'premonition', 4, row_number() OVER (ORDER BY id DESC), id::VARCHAR, substr(coalesce(content, ''), 1, 25) FROM memories WHERE owner = '{OWNER}' AND status = 'active' UNION ALL SELECT 'weak', 5, row_number() OVER (ORDER BY topic), topic, topic FROM weak)
      SELECT * FROM a WHERE rank <= 3"""
    q["time_cover"] = f"""WITH o AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS age_rank, count(*) OVER () AS n FROM memories WHERE owner = '{OWNER}'), k AS (SELECT max(n) AS n, least(max(n), 10) AS near FROM o),
      ages AS (SELECT unnest(range(1, near + 1)) AS age FROM k UNION SELECT least(n, greatest(1, round(near * pow(n / near::DOUBLE, i / (20 - near)::DOUBLE))))::BIGINT FROM k, (SELECT unnest(range(1, 21)) AS i) WHERE i <= 20 - near)
      SELECT id, age_rank FROM o WHERE age_rank IN (SELECT age FROM ages)"""
    old = f"coalesce(date_diff('second', try_strptime(substr(replace(replace(created_at, '/', '-'), 'T', ' '), 1, 19), '%Y-%m-%d %H:%M:%S'), TIMESTAMP '{AS_OF}') > 30 * 86400, false)"
    q["compress"] = f"SELECT id, c AS compressed, CASE WHEN c THEN substr(content, 1, 40) || '…' ELSE content END AS skeleton FROM (SELECT id, content, coalesce({old} AND NOT coalesce(layer = 'core', false) AND length(content) > 40, false) AS c FROM memories)"
    q["hourly_narrative"] = "SELECT user_id AS grp, date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT event_type) AS kinds, arg_min(event_type, (ts, event_type)) AS first_kind FROM events GROUP BY 1, 2"
    q["journal_dataset"] = """SELECT user_id::VARCHAR AS run_id, 'task ' || max(CASE WHEN event_type = 'signup' THEN event_id END) AS context, 'view,click' AS names, arg_min(event_type, event_id) FILTER (event_type IN ('view', 'click')) AS gold FROM events WHERE user_id IS NOT NULL GROUP BY user_id
      HAVING count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type IN ('view', 'click')) > 0"""
    q["shadow_report"] = "SELECT count(*) FILTER (event_type = 'error') AS suggestions, count(*) FILTER (event_type = 'purchase') AS results, count(*) FILTER (event_type = 'purchase' AND value > 50) AS matched, round(count(*) FILTER (event_type = 'purchase' AND value > 50) / count(*) FILTER (event_type = 'purchase'), 6) AS rate FROM events"
    low = "lower(coalesce(next_user, ''))"
    q["effect_ledger"] = _TURNS + f""", e AS (SELECT owner, coalesce(contains(lower(assistant), lower(usr)) AND usr <> '', false) AS cited, {_any(low, CORRECTED)} AS corrected, {_any(low, CONFIRMED)} AND NOT {_any(low, CORRECTED)} AS confirmed FROM turns)
      SELECT owner, count(*) FILTER (cited) AS cited, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (corrected) AS corrected, count(*) FILTER (cited) + 2 * count(*) FILTER (confirmed) - 2 * count(*) FILTER (corrected) AS score FROM e GROUP BY owner"""
    q["stream_windows"] = "SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"
    return q
