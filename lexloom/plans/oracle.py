"""DuckDB SQL that states each registered query independently of the operators."""

from lexloom.operators.mutate import NEXT

NORMS = """norms AS (SELECT o_orderkey AS id,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Lei' WHEN '2' THEN 'Lei Complementar' WHEN '3' THEN 'Decreto' WHEN '4' THEN 'Resolução' ELSE 'Portaria' END AS tipo,
 CAST(o_orderkey AS VARCHAR) AS numero, CAST(year(o_orderdate) AS INT) AS ano,
 'Dispõe sobre o pedido ' || o_orderpriority || ' do cliente ' || o_custkey AS ementa,
 CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'segmented' ELSE 'entities_extracted' END AS status,
 CAST(o_orderdate AS DATE) AS pub, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 45 END AS vig,
 CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'http://norms/' || o_orderkey || '.pdf' END AS pdf_url,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '' ELSE '/pdf/' || o_orderkey END AS pdf_path FROM orders)"""

CLAUSES = """l0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) - 1 AS ordem FROM lineitem),
l1 AS (SELECT *, CASE WHEN ordem = 0 OR l_partkey % 4 = 0 THEN 'artigo' WHEN l_partkey % 4 = 1 THEN 'paragrafo' WHEN l_partkey % 4 = 2 THEN 'inciso' ELSE 'alinea' END AS tipo FROM l0),
clauses AS (SELECT l_orderkey * 100 + ordem AS id, l_orderkey AS norma_id, tipo,
 CASE tipo WHEN 'artigo' THEN (ordem + 1) || 'º' WHEN 'paragrafo' THEN l_linenumber || 'º' WHEN 'inciso' THEN ['I','II','III','IV','V','VI','VII','VIII','IX','X'][ordem % 10 + 1] ELSE substr('abcdefghij', CAST(ordem % 10 + 1 AS INT), 1) END AS numero,
 CASE WHEN l_returnflag = 'R' THEN 'Fica revogado o art. ' || (l_suppkey % 20 + 1) || 'º da Lei nº ' || l_partkey || '/' || year(l_shipdate) || '.'
  WHEN l_returnflag = 'A' THEN 'Modifica o inciso II da Lei Complementar n. ' || l_suppkey || ', conforme o Decreto ' || l_partkey || '/' || year(l_shipdate) || ' e altera o disposto.'
  WHEN l_partkey % 5 = 0 THEN 'Aplica-se o disposto desta Lei ao item ' || l_partkey || ' do cadastro.' ELSE 'Cadastro ' || l_partkey || ' sem efeito.' END AS texto,
 ordem, l_partkey, l_suppkey, l_returnflag, l_shipdate AS created_at FROM l1)"""

LABEL = "CASE {0}tipo WHEN 'artigo' THEN 'Art.' WHEN 'paragrafo' THEN '§' WHEN 'inciso' THEN 'Inciso' ELSE 'Alínea' END || ' ' || {0}numero"


def label(alias: str = "") -> str:
    return LABEL.format(f"{alias}." if alias else "")


PARENTS = CLAUSES + """, seen AS (SELECT c.*, max(CASE WHEN tipo='artigo' THEN ordem END) OVER w AS a, max(CASE WHEN tipo='paragrafo' THEN ordem END) OVER w AS p, max(CASE WHEN tipo='inciso' THEN ordem END) OVER w AS i
 FROM clauses c WINDOW w AS (PARTITION BY norma_id ORDER BY ordem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tree AS (SELECT *, CASE tipo WHEN 'paragrafo' THEN a WHEN 'inciso' THEN CASE WHEN coalesce(p,-1) > coalesce(a,-1) THEN p ELSE a END
 WHEN 'alinea' THEN CASE WHEN coalesce(i,-1) > greatest(coalesce(a,-1),coalesce(p,-1)) THEN i WHEN coalesce(p,-1) > coalesce(a,-1) THEN p ELSE a END END AS parent_ordem FROM seen)"""

PATHS = PARENTS + f""", walk AS (SELECT id, norma_id, ordem, tipo, numero, texto, {label()} AS path, 0 AS depth, lpad(CAST(ordem AS VARCHAR),4,'0') AS order_key, [ordem] AS anc FROM tree WHERE parent_ordem IS NULL
 UNION ALL SELECT t.id, t.norma_id, t.ordem, t.tipo, t.numero, t.texto, w.path || ' > ' || {label('t')}, w.depth + 1, w.order_key || '.' || lpad(CAST(t.ordem AS VARCHAR),4,'0'), list_append(w.anc, t.ordem)
 FROM tree t JOIN walk w ON t.norma_id = w.norma_id AND t.parent_ordem = w.ordem)"""

VECTORS = CLAUSES + """, vclauses AS (SELECT c.*, CASE WHEN c.id % 7 <> 0 THEN e.embedding END AS embedding FROM clauses c LEFT JOIN embeddings e ON e.vec_id = c.id % (SELECT count(*) FROM embeddings)),
q AS (SELECT list(0.8 * x + 0.3 * y ORDER BY i) AS v FROM (SELECT unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y, unnest(range(len(a.embedding))) AS i FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id = 10)),
dist AS (SELECT c.id, c.norma_id, list_distance(c.embedding::DOUBLE[], q.v) AS d FROM vclauses c, q WHERE c.embedding IS NOT NULL)"""

SCORED = ", round(greatest(0.0, least(1.0, 1.0 - d)), 6) AS score"

EVENTS = """, events_ AS (SELECT id, id AS source_clause_id, norma_id AS source_norm_id, CASE l_returnflag WHEN 'R' THEN 'REVOGA' WHEN 'A' THEN 'ALTERA' ELSE 'REFERENCIA' END AS acao,
 CASE WHEN l_partkey % 5 = 0 THEN norma_id WHEN l_partkey % 5 < 4 THEN l_partkey END AS target_norm_id, CASE WHEN ordem > 0 AND l_partkey % 3 = 0 THEN id - 1 END AS target_clause_id, created_at FROM {0})"""

RAW = ", line_ AS (SELECT norma_id, ordem, CASE tipo WHEN 'artigo' THEN 'Art. ' || numero || ' ' WHEN 'paragrafo' THEN '§ ' || numero || ' ' WHEN 'inciso' THEN numero || ' - ' ELSE numero || ') ' END || texto AS line FROM clauses)"

MESSAGES = "messages AS (SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS turn, role, text AS content FROM conversations), sessions AS (SELECT session_id, max(turn) AS updated_at, session_id % 7 AS user_id, CASE WHEN session_id % 2 = 0 THEN 'Sessão ' || session_id ELSE '' END AS title FROM messages GROUP BY 1)"

ACTION_SQL = """acts(acao, pat) AS (VALUES ('REVOGA', '(?i)\\b(revog[a-z]+|ficam?\\s+revogad[oa]s?)\\b'), ('ALTERA', '(?i)\\b(alter[a-z]+|modific[a-z]+|ficam?\\s+alterad[oa]s?)\\b'), ('REFERENCIA', '(?i)\\b(conforme|nos\\s+termos|de\\s+acordo\\s+com|previsto|disposto)\\b')),
found AS (SELECT c.id, c.norma_id, c.texto, acao, regexp_extract_all(texto, pat) AS h FROM clauses c, acts),
cut AS (SELECT *, unnest(h) AS hit, unnest(range(len(h))) AS k FROM found WHERE len(h) > 0),
mentions AS (SELECT id, norma_id, texto, acao, hit, instr(texto, hit) - 1 AS start FROM cut)"""
# In the bridge texts no action word occurs twice in a clause, so the first place of a hit is its offset.

REFS = ACTION_SQL + """, ctx AS (SELECT *, substr(texto, CAST(start + 1 AS INT), length(hit) + 200) AS context FROM mentions WHERE length(trim(texto)) >= 20),
lawp AS (SELECT '(?i)\\b(lei\\s+(?:complementar|ordinária|delegada)?|lc|decreto|resolução)\\s*(?:n[º°]?\\s*)?([\\d.,]+)\\s*[/\\-]?\\s*(\\d{4})?' AS p),
laws AS (SELECT id, norma_id, acao, start, unnest(regexp_extract_all(context, p, 0)) AS h, trim(unnest(regexp_extract_all(context, p, 1))) AS t, unnest(regexp_extract_all(context, p, 2)) AS n, unnest(regexp_extract_all(context, p, 3)) AS y FROM ctx, lawp),
refs AS (SELECT id, norma_id, acao, start, lower(t) AS ref_tipo, CASE WHEN y <> '' THEN n || '/' || y ELSE n END AS ref_numero, h AS target_text, CASE WHEN y <> '' THEN 0.9 ELSE 0.7 END AS confidence, CASE WHEN y <> '' THEN y END AS law_ano FROM laws
 UNION ALL SELECT id, norma_id, acao, start, 'self_reference', '', unnest(regexp_extract_all(context, '(?i)\\b(?:d[aeo]st[ae]|d[aeo])\\s+(?:lei|decreto|resolução)')), 0.95, NULL FROM ctx
 UNION ALL SELECT id, norma_id, acao, start, 'artigo', trim(unnest(regexp_extract_all(context, '(?i)\\b(art(?:igo)?\\.?\\s*(?:n[º°]?\\s*)?)(\\d+[º°]?)', 2))), unnest(regexp_extract_all(context, '(?i)\\b(art(?:igo)?\\.?\\s*(?:n[º°]?\\s*)?)(\\d+[º°]?)', 0)), 0.9, NULL FROM ctx
 UNION ALL SELECT id, norma_id, acao, start, 'inciso', trim(unnest(regexp_extract_all(context, '(?i)\\binciso\\s+([IVXLCDM]+|\\d+)', 1))), unnest(regexp_extract_all(context, '(?i)\\binciso\\s+([IVXLCDM]+|\\d+)', 0)), 0.9, NULL FROM ctx),
evs AS (SELECT id, acao, start, ref_tipo, ref_numero, target_text, confidence, law_ano, norma_id FROM refs
 UNION ALL SELECT c.id, c.acao, c.start, '', '', substr(c.context, 1, 100), 0.5, NULL, c.norma_id FROM ctx c WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.id = c.id AND r.acao = c.acao AND r.start = c.start))"""

# What happens to a norm comes from the events whose target norm it is, and from no others.
AFFECTED = """, aff AS (SELECT target_norm_id AS norma_id, target_clause_id, bool_or(acao = 'REVOGA') AS revoked, arg_max(source_norm_id, (created_at, id)) FILTER (acao = 'ALTERA') AS altered_by FROM events_ WHERE target_norm_id IS NOT NULL AND target_clause_id IS NOT NULL AND acao IN ('REVOGA','ALTERA') GROUP BY 1, 2)"""

LINES = NORMS + ", " + PATHS + EVENTS.format("tree") + AFFECTED + f""", shown AS (SELECT w.*, coalesce(a.revoked, false) AS revoked, n.tipo || ' ' || n.numero || '/' || n.ano AS by_ FROM walk w LEFT JOIN aff a ON a.target_clause_id = w.id AND a.norma_id = w.norma_id LEFT JOIN norms n ON n.id = a.altered_by),
gone AS (SELECT norma_id, list(ordem) AS g FROM shown WHERE revoked GROUP BY 1),
vis AS (SELECT s.* FROM shown s LEFT JOIN gone USING (norma_id) WHERE NOT list_has_any(coalesce(g, []), list_slice(anc, 1, len(anc) - 1))),
lines_ AS (SELECT norma_id, ordem, 0 AS part, repeat('  ', depth) || {label()} || CASE WHEN revoked THEN ' (REVOGADO)' ELSE ' ' || texto END AS line FROM vis
 UNION ALL SELECT norma_id, ordem, 1, repeat('  ', depth) || '  [ALTERADO pela ' || by_ || ']' FROM vis WHERE NOT revoked AND by_ IS NOT NULL)"""

STATS = """, stat AS (SELECT c.norma_id, count(*) AS n_clauses FROM clauses c GROUP BY 1),
evn AS (SELECT target_norm_id AS norma_id, count(DISTINCT CASE WHEN acao='REVOGA' THEN target_clause_id END) AS r, count(DISTINCT CASE WHEN acao='ALTERA' THEN target_clause_id END) AS a, count(*) AS e FROM events_ WHERE target_norm_id IS NOT NULL GROUP BY 1),
stats AS (SELECT s.norma_id, n_clauses, coalesce(r,0) AS n_revoked, coalesce(a,0) AS n_altered, coalesce(e,0) AS n_events FROM stat s LEFT JOIN evn USING (norma_id))"""

BATCHES = "SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS BIGINT) AS batch, o_orderkey AS id FROM orders"

WHITE = "'[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"

WITH_R = "WITH RECURSIVE "
W_ = "WITH "

CONSOLIDATED = WITH_R + LINES + STATS + """, body AS (SELECT norma_id, string_agg(line, chr(10) ORDER BY ordem, part) AS b FROM lines_ GROUP BY 1)
 SELECT s.norma_id, repeat('=',80) || chr(10) || n.tipo || ' Nº ' || n.numero || '/' || n.ano || chr(10) || 'TEXTO CONSOLIDADO' || chr(10) || repeat('=',80) || chr(10) || chr(10) || 'EMENTA: ' || n.ementa || chr(10) || chr(10) || b || chr(10) || chr(10) || repeat('-',80) || chr(10) || 'INFORMAÇÕES DE CONSOLIDAÇÃO:' || chr(10)
 || '  - Total de dispositivos: ' || n_clauses || chr(10) || '  - Dispositivos revogados: ' || n_revoked || chr(10) || '  - Dispositivos alterados: ' || n_altered || chr(10) || '  - Eventos processados: ' || n_events || chr(10) || '  - Data de publicação: ' || strftime(n.pub,'%Y-%m-%d') || chr(10)
 || CASE WHEN n.vig IS NULL THEN '' ELSE '  - Data de vigência: ' || strftime(n.vig,'%Y-%m-%d') || chr(10) END || '  - Consolidado em: 01/01/2000 00:00:00' || chr(10) || repeat('=',80) AS consolidated_text FROM stats s JOIN norms n ON n.id = s.norma_id JOIN body USING (norma_id)"""
# Norms divisible by six have no clauses there: those with a raw text keep it.
WRITTEN = CONSOLIDATED.replace("FROM lineitem)", "FROM lineitem WHERE l_orderkey % 6 <> 0)").replace("SELECT s.norma_id, repeat", ", done AS (SELECT s.norma_id, repeat") + """ UNION ALL SELECT id, 'Texto original de ' || numero FROM norms WHERE id % 6 = 0 AND id % 4 <> 0)
SELECT n.id, CASE WHEN d.norma_id IS NOT NULL THEN 'consolidated' ELSE n.status END AS status, md5(consolidated_text) AS text_md5, length(consolidated_text) AS n_chars FROM norms n LEFT JOIN done d ON d.norma_id = n.id"""

ORACLE: dict[str, str] = {
    "norm_list_search": W_ + NORMS + " SELECT id, tipo, numero, CAST(ano AS BIGINT) AS ano, left(ementa,200) AS ementa, status, strftime(pub,'%Y-%m-%d') AS published, '/normas/' || id || '/' AS url FROM norms WHERE status='consolidated' AND (contains(upper(ementa),'URGENT') OR contains(upper(numero),'URGENT') OR contains(upper(tipo),'URGENT')) ORDER BY norms.ano DESC, numero DESC, id LIMIT 50",
    "norm_list_page": W_ + NORMS + ", f AS (SELECT * FROM norms WHERE status IN ('segmented','entities_extracted') AND (contains(ementa,'9') OR contains(numero,'9') OR contains(tipo,'9'))), n AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*)/20.0) AS BIGINT)) AS n_pages FROM f), r AS (SELECT *, row_number() OVER (ORDER BY ano DESC, numero DESC, id) AS rn FROM f) SELECT id, tipo, numero, CAST(ano AS BIGINT) AS ano, left(ementa,200) AS ementa, status, strftime(pub,'%Y-%m-%d') AS published, '/normas/' || id || '/' AS url, total, n_pages, least(3,n_pages) < n_pages AS has_next, least(3,n_pages) > 1 AS has_prev FROM r, n WHERE rn > (least(3,n_pages)-1)*20 AND rn <= least(3,n_pages)*20",
    "status_histogram": W_ + NORMS + " SELECT status, count(*) AS n_norms FROM norms GROUP BY 1",
    "embedding_coverage": W_ + VECTORS + " SELECT count(*) AS total, count(embedding) AS with_embedding, round(100.0*count(embedding)/count(*),1) AS percent FROM vclauses",
    "clause_type_pivot": W_ + CLAUSES + " SELECT norma_id, count(*) FILTER (tipo='artigo') AS artigo, count(*) FILTER (tipo='paragrafo') AS paragrafo, count(*) FILTER (tipo='inciso') AS inciso, count(*) FILTER (tipo='alinea') AS alinea FROM clauses GROUP BY 1",
    "action_histogram": "SELECT CASE l_returnflag WHEN 'R' THEN 'REVOGA' WHEN 'A' THEN 'ALTERA' ELSE 'REFERENCIA' END AS acao, count(*) AS n_events, count(DISTINCT l_orderkey) AS n_norms FROM lineitem GROUP BY 1",
    "facet_year_month_rollup": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n_norms FROM orders GROUP BY ROLLUP (1, 2)",
    "admin_facets": W_ + NORMS + " SELECT tipo, status, count(*) AS n_rows FROM norms GROUP BY 1, 2",
    "norm_detail_nested": W_ + NORMS + ", " + VECTORS + f", g AS (SELECT norma_id, string_agg(ordem || ':' || {label()} || CASE WHEN embedding IS NULL THEN '' ELSE '*' END, ', ' ORDER BY ordem) AS clause_list, count(*) AS n_clauses, CAST(sum(length(texto)) AS BIGINT) AS n_chars, count(embedding) AS n_embedded FROM vclauses GROUP BY 1) SELECT n.id, n.tipo || ' ' || n.numero || '/' || n.ano AS label, clause_list, n_clauses, n_chars, n_embedded FROM norms n LEFT JOIN g ON g.norma_id = n.id",
    "admin_search": W_ + NORMS + " SELECT tipo, count(*) AS n_rows FROM norms WHERE status = 'segmented' AND (contains(upper(numero), 'LOW') OR contains(upper(ementa), 'LOW') OR contains(upper(pdf_url), 'LOW')) GROUP BY 1",
    "norm_statistics": W_ + NORMS + ", " + CLAUSES + EVENTS.format("clauses") + RAW + ", c AS (SELECT norma_id, count(*) AS n FROM clauses GROUP BY 1), e AS (SELECT target_norm_id, count(*) AS n FROM events_ WHERE target_norm_id IS NOT NULL GROUP BY 1), t AS (SELECT norma_id, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n FROM line_ WHERE norma_id % 2 = 0 GROUP BY 1) SELECT o.id, coalesce(c.n, 0) AS n_clauses, coalesce(e.n, 0) AS n_events, coalesce(t.n, 0) AS n_chars, coalesce(pdf_path, '') <> '' AS has_original, coalesce(t.n, 0) > 0 AS has_consolidated FROM norms o LEFT JOIN c ON c.norma_id = o.id LEFT JOIN e ON e.target_norm_id = o.id LEFT JOIN t ON t.norma_id = o.id",
    "norm_compare": W_ + CLAUSES + RAW + ", t AS (SELECT norma_id, string_agg(line, chr(10) ORDER BY ordem) AS t FROM line_ GROUP BY 1) SELECT norma_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(t, '[^\\s]+')) AS BIGINT) AS n_words FROM t",
    "work_selection": W_ + NORMS + " SELECT id, tipo, status FROM norms WHERE status IN ('segmented','entities_extracted') ORDER BY id LIMIT 40 OFFSET 5",
    "missing_file_selection": W_ + NORMS + " SELECT id, pdf_url FROM norms WHERE (pdf_path IS NULL OR pdf_path = '') AND pdf_url <> ''",
    "vacatio_legis": W_ + NORMS + " SELECT id, strftime(pub,'%d/%m/%Y') AS published, strftime(vig,'%d/%m/%Y') AS in_force FROM norms WHERE pub <= DATE '1998-06-15' AND DATE '1998-06-15' < vig",
    "mini_batches": f"SELECT batch, count(*) AS n_rows, min(id) AS first_id FROM ({BATCHES}) GROUP BY 1",
    "norm_labels": W_ + NORMS + " SELECT id, tipo || ' ' || numero || '/' || ano AS label, CASE status WHEN 'consolidated' THEN 'green' WHEN 'segmented' THEN 'blue' WHEN 'entities_extracted' THEN 'purple' ELSE 'gray' END AS colour, CASE WHEN length(ementa) > 30 THEN left(ementa,30) || '...' ELSE ementa END AS short, coalesce(strftime(vig,'%d/%m/%Y'),'-') AS in_force FROM norms",
    "text_clean": f"SELECT doc_id, md5(t) AS clean_md5, length(t) AS n_clean FROM (SELECT doc_id, translate(trim(regexp_replace(text, {WHITE}, ' ', 'g')), '–—', '--') AS t FROM documents)",
    "truncate_words": f"SELECT doc_id, array_to_string(w[1:15], ' ') || CASE WHEN len(w) > 15 THEN ' …' ELSE '' END AS short, CAST(len(w) AS BIGINT) AS n_words FROM (SELECT doc_id, list_filter(string_split_regex(text, {WHITE}), lambda x: x <> '') AS w FROM documents)",
    "line_counts": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS BIGINT) END AS n_lines FROM documents",
    "cache_key_md5": "SELECT doc_id, 'embedding:' || md5('model:' || text) AS cache_key FROM documents",
    "answer_repair": "SELECT conv_id, turn, '• ' || role || chr(10) || '• turno ' || turn || ' ' || chr(10) || '- fim ' AS repaired FROM conversations",
    "clause_with_parent": W_ + PARENTS + f" SELECT t.id, p.id AS parent_id, {label('p')} AS parent_label FROM tree t LEFT JOIN tree p ON p.norma_id = t.norma_id AND p.ordem = t.parent_ordem",
    "embedding_input": WITH_R + NORMS + ", " + PATHS + f" SELECT w.id, concat_ws(' | ', n.tipo || ' ' || n.numero || '/' || n.ano, w.path, 'Contexto: ' || ({label('p')}), w.texto) AS embedding_input FROM walk w JOIN norms n ON n.id = w.norma_id LEFT JOIN tree p ON p.norma_id = w.norma_id AND p.ordem = list_extract(w.anc, len(w.anc) - 1) AND len(w.anc) > 1",
    "event_full_chain": W_ + NORMS + ", " + CLAUSES + EVENTS.format("clauses") + f" SELECT e.id, acao, {label('s')} AS source_label, n.tipo || ' ' || n.numero || '/' || n.ano AS source_norm, {label('t')} AS target_label, t.norma_id AS target_owner, tn.tipo || ' ' || tn.numero || '/' || tn.ano AS target_norm FROM events_ e JOIN clauses s ON s.id = e.source_clause_id JOIN norms n ON n.id = e.source_norm_id LEFT JOIN clauses t ON t.id = e.target_clause_id LEFT JOIN norms tn ON tn.id = e.target_norm_id",
    "events_in_or_out": W_ + NORMS + ", " + CLAUSES + EVENTS.format("clauses") + " SELECT e.id, acao, n.tipo || ' ' || n.numero || '/' || n.ano AS source_norm, target_norm_id, tn.tipo || ' ' || tn.numero || '/' || tn.ano AS target_norm FROM events_ e JOIN norms n ON n.id = e.source_norm_id LEFT JOIN norms tn ON tn.id = e.target_norm_id WHERE target_norm_id = 15 OR source_norm_id = 15",
    "internal_events": W_ + CLAUSES + EVENTS.format("clauses") + " SELECT id, acao, source_norm_id FROM events_ WHERE source_norm_id = target_norm_id",
    "union_events": W_ + CLAUSES + EVENTS.format("clauses") + " SELECT id, acao, created_at FROM events_ WHERE target_norm_id IS NOT NULL UNION SELECT id, acao, created_at FROM events_ WHERE source_norm_id = target_norm_id",
    "parent_link": W_ + PARENTS + " SELECT id, CASE WHEN parent_ordem IS NOT NULL THEN norma_id * 100 + parent_ordem END AS found_parent FROM tree",
    "marker_scan": W_ + CLAUSES + RAW + " SELECT l.norma_id, CAST(coalesce(sum(length(line)+1) OVER (PARTITION BY l.norma_id ORDER BY l.ordem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS pos, c.tipo AS kind, c.numero FROM line_ l JOIN clauses c ON c.norma_id = l.norma_id AND c.ordem = l.ordem",
    "next_marker_slice": W_ + CLAUSES + RAW + " SELECT l.norma_id, CAST(coalesce(sum(length(line)+1) OVER (PARTITION BY l.norma_id ORDER BY l.ordem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS pos, c.texto, CAST(pos + length(line) - length(c.texto) + length(c.texto) AS BIGINT) AS end_pos FROM line_ l JOIN clauses c ON c.norma_id = l.norma_id AND c.ordem = l.ordem",
    "hierarchy_parents": W_ + PARENTS.replace("FROM clauses c WINDOW", "FROM guarded c WINDOW").replace("seen AS", """g0 AS (SELECT *, lag(texto) OVER (PARTITION BY norma_id ORDER BY ordem) AS above FROM clauses),
guarded AS (SELECT norma_id, tipo, numero, row_number() OVER (PARTITION BY norma_id ORDER BY ordem) - 1 AS ordem FROM g0 WHERE tipo <> 'inciso' OR NOT regexp_matches(coalesce(right(above, 9), ''), '\\d{4}|\\d{1,2}/\\d{1,2}')), seen AS""", 1) + " SELECT norma_id, ordem, tipo, numero, parent_ordem FROM tree",
    "clause_path_depth": WITH_R + PATHS + " SELECT id, path, CAST(depth AS BIGINT) AS depth FROM walk",
    "clause_preorder": WITH_R + PATHS + " SELECT id, norma_id, order_key FROM walk",
    "action_mentions": W_ + CLAUSES + ", " + ACTION_SQL + " SELECT id, acao, start, hit FROM mentions",
    "law_references": W_ + CLAUSES + ", " + REFS + " SELECT id, acao, ref_tipo, ref_numero, law_ano FROM evs WHERE law_ano IS NOT NULL",
    "event_assembly": W_ + CLAUSES + ", " + REFS + " SELECT id, acao, start, ref_tipo, ref_numero, target_text, CAST(confidence AS DOUBLE) AS confidence FROM evs",
    "reference_resolution": W_ + NORMS + ", " + CLAUSES + ", f AS (SELECT lower(tipo) AS t, numero AS n, ano AS y, arg_min(id, id) AS id FROM norms GROUP BY 1,2,3) SELECT c.id, f.id AS target_norm_id FROM clauses c LEFT JOIN f ON f.t = 'lei' AND f.n = CAST(c.l_partkey AS VARCHAR) AND f.y = year(c.created_at)",
    "self_reference_override": W_ + CLAUSES + ", " + REFS + " SELECT id, acao, norma_id AS target_norm_id FROM evs WHERE ref_tipo = 'self_reference'",
    "revoked_altered_sets": W_ + CLAUSES + EVENTS.format("clauses") + AFFECTED + " SELECT * FROM aff",
    "consolidated_lines": WITH_R + LINES + " SELECT norma_id, ordem, CAST(part AS BIGINT) AS part, line FROM lines_",
    "consolidation_statistics": W_ + CLAUSES + EVENTS.format("clauses") + STATS + " SELECT * FROM stats",
    "consolidated_text": CONSOLIDATED,
    "consolidated_written": WRITTEN,
    "vector_topk": W_ + VECTORS + f" SELECT id, round(d, 6) AS distance{SCORED} FROM dist ORDER BY d, id LIMIT 25",
    "vector_topk_filtered": W_ + VECTORS + f" SELECT id, round(d, 6) AS distance{SCORED} FROM dist WHERE norma_id = 7 ORDER BY d, id LIMIT 5",
    "vector_threshold": W_ + VECTORS + f" SELECT id, round(d, 6) AS distance{SCORED} FROM dist WHERE d < 0.95 ORDER BY d, id LIMIT 50",
    "rag_confidence": W_ + VECTORS + f", h AS (SELECT id{SCORED} FROM dist ORDER BY d, id LIMIT 10) SELECT coalesce(round(avg(score),6),0.0) AS confidence, count(*) AS n_hits FROM h",
    "session_cards": W_ + MESSAGES + ", g AS (SELECT session_id, count(*) AS n, arg_min(content, turn) FILTER (role='user') AS f FROM messages GROUP BY 1) SELECT s.session_id, user_id, CASE WHEN title = '' THEN 'Nova conversa' ELSE title END AS title, coalesce(n,0) AS n_messages, coalesce(CASE WHEN length(f) > 50 THEN left(f,50) || '...' ELSE f END,'') AS preview, updated_at, left(sha256(s.session_id || 'chat'),12) AS slug FROM sessions s LEFT JOIN g USING (session_id)",
    "last_25_messages": W_ + MESSAGES + " SELECT session_id, turn, role, n > 25 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM messages) WHERE r <= 25",
    "latest_assistant": W_ + MESSAGES + " SELECT session_id, max(turn) AS turn, arg_max(content, turn) AS content FROM messages WHERE role='assistant' GROUP BY 1",
    "message_cards": W_ + MESSAGES + " SELECT session_id, turn, role, CASE WHEN role='assistant' THEN len(string_split(content, ' ')[1:3]) ELSE 0 END AS n_sources, CASE WHEN role='assistant' THEN array_to_string(string_split(content, ' ')[1:3], ' | ') ELSE '' END AS sources FROM messages",
    "single_active_session": W_ + MESSAGES + " SELECT session_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id DESC) = 1 AS is_active FROM sessions",
    "delete_sessions": W_ + MESSAGES + " SELECT session_id, count(*) AS n_messages FROM messages WHERE session_id % 7 <> 2 GROUP BY 1",
    "regenerate_message": W_ + MESSAGES + ", la AS (SELECT session_id, max(turn) AS t FROM messages WHERE role='assistant' AND session_id % 2 = 0 GROUP BY 1) SELECT m.session_id, m.turn, role, content FROM messages m LEFT JOIN la ON la.session_id = m.session_id AND la.t = m.turn WHERE la.t IS NULL UNION ALL SELECT session_id, max(turn) + 1, 'assistant', 'nova resposta' FROM messages WHERE session_id % 2 = 0 GROUP BY 1",
    "get_or_create_session": W_ + MESSAGES + ", s AS (SELECT * FROM sessions WHERE user_id < 5), r AS (SELECT c_custkey AS request_id, c_custkey % 7 AS user_id, c_custkey % 40 AS asked, 'Pergunta de ' || c_name || ' sobre a vigência das normas' AS question FROM customer), l AS (SELECT user_id, arg_max(session_id, (updated_at, session_id)) AS last FROM s GROUP BY 1) SELECT request_id, r.user_id, coalesce(s.session_id, last, -request_id - 1) AS session_id, s.session_id IS NULL AND last IS NULL AS created, CASE WHEN s.session_id IS NULL AND last IS NULL THEN left(question, 50) END AS title FROM r LEFT JOIN s ON s.user_id = r.user_id AND s.session_id = r.asked LEFT JOIN l ON l.user_id = r.user_id",
    "upsert_norms": W_ + NORMS + " SELECT id, tipo, numero, ano, CASE WHEN id % 2 = 0 THEN ementa || ' (nova)' ELSE ementa END AS ementa, pdf_url, CASE WHEN id % 2 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'created' WHEN id % 2 = 0 THEN 'updated' ELSE 'kept' END AS change FROM norms WHERE id % 3 <> 0 OR id % 2 = 0",
    "ingestion_statistics": "SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'created' WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'kept' END AS change, count(*) AS n_rows FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1",
    "first_wins_dedup": "SELECT o_custkey AS id, min(o_orderkey) AS arrival, arg_min(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY 1",
    "new_ids": "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "ingest_projection": W_ + NORMS + " SELECT id AS arrival, id, tipo, numero, CAST(ano AS BIGINT) AS ano, ementa, CASE WHEN id % 4 = 0 THEN 'sem observação' ELSE '' END AS observacao, CASE WHEN id % 10 <> 9 THEN pub END AS published, vig AS in_force, pdf_url AS texto_integral, pdf_url, 'http://norms/' || id AS page_url FROM norms WHERE id % 11 <> 0 AND id % 10 <> 8",
    "ingest_rejects": W_ + NORMS + " SELECT id AS arrival, tipo, numero, CASE WHEN id % 11 = 0 THEN 'missing id' ELSE 'impossible date' END AS reason FROM norms WHERE id % 11 = 0 OR id % 10 = 8",
    "ingestion_summary": "WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing id' WHEN o_orderkey % 10 = 8 THEN 'impossible date' END AS reason FROM orders), h AS (SELECT * FROM r WHERE reason IS NOT NULL ORDER BY id LIMIT 10) SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) AS n_pages, count(*) FILTER (reason IS NULL) AS n_rows, count(reason) AS n_failed, (SELECT string_agg(id || ': ' || reason, '; ' ORDER BY id) FROM h) AS errors FROM r",
    "rest_years": W_ + NORMS + " SELECT id, tipo, numero, ano, ementa, ano AS asked FROM norms",
    "appended_events": W_ + CLAUSES + EVENTS.format("clauses") + " SELECT source_norm_id, acao, count(*) * CASE WHEN source_norm_id % 10 = 0 THEN 2 ELSE 1 END AS n_events FROM events_ GROUP BY 1, 2",
    "cascaded_events": W_ + CLAUSES + EVENTS.format("clauses") + ", g AS (SELECT id FROM clauses WHERE norma_id % 10 = 0), e AS (SELECT id, source_clause_id, CASE WHEN id % 2 = 0 THEN id + 100 ELSE target_clause_id END AS t, target_norm_id FROM events_) SELECT id, source_clause_id, CASE WHEN t NOT IN (SELECT id FROM g) THEN t END AS target_clause_id, target_norm_id FROM e WHERE source_clause_id NOT IN (SELECT id FROM g)",
    "clauses_with_events": W_ + CLAUSES + " SELECT norma_id, count(*) AS n_clauses, count(*) FILTER (l_returnflag IN ('R', 'A')) AS n_with_events, count(*) FILTER (l_returnflag IN ('R', 'A')) AS n_events FROM clauses GROUP BY 1",
    "vector_query_set": "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10",
    "replace_clauses": W_ + CLAUSES + ", k AS (SELECT DISTINCT norma_id FROM clauses WHERE norma_id % 10 = 0 AND id % 2 = 0) SELECT id, norma_id, texto FROM clauses WHERE norma_id NOT IN (SELECT norma_id FROM k) UNION ALL SELECT id, norma_id, 'novo' FROM clauses WHERE norma_id % 10 = 0 AND id % 2 = 0",
    "embedding_update": W_ + VECTORS + " SELECT CASE WHEN id % 7 = 0 THEN 'stub' END AS embedding_model, count(*) AS n_rows, CAST(sum(CASE WHEN id % 7 = 0 THEN 1 ELSE len(embedding) END) AS BIGINT) AS n_values FROM vclauses GROUP BY 1",
    "status_latest": "SELECT user_id AS entity_id, arg_max(CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'ocr_completed' WHEN 'click' THEN 'segmented' WHEN 'purchase' THEN 'consolidated' ELSE 'failed' END, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS n_changes FROM events GROUP BY 1",
    "status_transitions": "WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'ocr_completed' WHEN 'click' THEN 'segmented' WHEN 'purchase' THEN 'consolidated' ELSE 'failed' END AS status FROM events), t AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT before, status, before IS NULL OR status = 'failed' OR (before || '>' || status) IN ('pending>ocr_completed','ocr_completed>segmented','segmented>consolidated','failed>pending') AS allowed, count(*) AS n_steps FROM t GROUP BY 1,2,3",
    "stream_upsert": "SELECT event_type, count(*) AS n_events, CAST(round(sum(CAST(value AS DECIMAL(18,2))),2) AS DOUBLE) AS total FROM events GROUP BY 1",
    "stream_status": "SELECT user_id AS entity_id, count(*) AS n_events, arg_max(event_type, ts) AS last_status FROM events GROUP BY 1",
}

# Parts that build on the statements above.
VEC = VECTORS[len(CLAUSES):]
NAMED = "{0}.tipo || ' ' || {0}.numero || '/' || {0}.ano"
HITS = WITH_R + NORMS + ", " + PATHS + VEC + f""", hit AS (SELECT id, round(d, 6) AS distance{SCORED} FROM dist ORDER BY d, id LIMIT {{0}}),
hits AS (SELECT h.*, w.path, w.texto, {NAMED.format('n')} AS norm_label FROM hit h JOIN walk w USING (id) JOIN norms n ON n.id = w.norma_id)"""
PARTS = HITS + """, part AS (SELECT *, '[' || printf('%.2f', score) || '] ' || norm_label || ' | ' || path || ': ' || texto AS part, row_number() OVER (ORDER BY distance, id) AS rank FROM hits),
parts AS (SELECT id, rank, CAST(sum(length(part)) OVER (ORDER BY rank) AS BIGINT) AS used, rank || '. ' || part AS shown FROM part)"""
PROMPT = """'Responda em português claro e objetivo à pergunta, usando apenas os dispositivos legais abaixo.
Formate em Markdown, cite os dispositivos em **negrito**, um item de lista por linha, e diga quando faltar informação.

CONTEXTO LEGAL:
' || string_agg(shown, chr(10) || chr(10) ORDER BY rank) || '

PERGUNTA DO USUÁRIO:
O que foi revogado?

RESPOSTA:'"""
ACTION_NAME = "CASE e.acao WHEN 'REVOGA' THEN 'Revogação' WHEN 'ALTERA' THEN 'Alteração' ELSE 'Referência' END"
PAGES = "page AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) + 1 AS no FROM documents)"
SEEN = "SELECT coalesce(text IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL), false) AS cache_hit FROM documents"
EDGES = f"'^{WHITE[1:-1]}|{WHITE[1:-1]}$'"


def outline() -> str:
    """Levels from the lowest up."""
    sql = WITH_R + PATHS + f", node AS (SELECT w.norma_id, w.ordem, w.depth, t.parent_ordem, {label('w')} AS label FROM walk w JOIN tree t USING (id))"
    for k in (3, 2, 1, 0):
        inner = "''" if k == 3 else "coalesce('{' || b.inner_ || '}', '')"
        join = "" if k == 3 else f" LEFT JOIN b{k + 1} b ON b.norma_id = n.norma_id AND b.ordem = n.ordem"
        sql += f", b{k} AS (SELECT n.norma_id, n.parent_ordem AS ordem, string_agg(n.label || {inner}, ', ' ORDER BY n.ordem) AS inner_ FROM node n{join} WHERE n.depth = {k} GROUP BY 1, 2)"
    return sql + " SELECT norma_id, inner_ AS outline FROM b0"


ORACLE |= {
    "rag_context_budget": PARTS.format(20) + " SELECT id, rank, used, shown FROM parts WHERE used <= 1200",
    "rag_answer": PARTS.format(5) + f", asked AS (SELECT {PROMPT} AS prompt FROM parts WHERE used <= 8000) SELECT prompt, 'Resumo: ' || chr(10) || '• itens' || chr(10) || '• tamanho ' || length(prompt) AS answer, (SELECT round(avg(score), 6) FROM hits) AS confidence FROM asked",
    "rag_answer_without_hits": "SELECT 'Nenhum contexto relevante encontrado.' AS context, 'Não encontrei informações relevantes para responder esta pergunta.' AS answer, CAST(0 AS DOUBLE) AS confidence",
    "search_hits": HITS.format(10) + f" SELECT h.id, n.tipo, n.numero, CAST(n.ano AS BIGINT) AS ano, h.path, {label('p')} AS parent_label, h.texto, h.score FROM hits h JOIN tree t USING (id) JOIN norms n ON n.id = t.norma_id LEFT JOIN tree p ON p.norma_id = t.norma_id AND p.ordem = t.parent_ordem",
    "source_cards": HITS.format(10) + " SELECT id, norm_label, path, CASE WHEN length(texto) > 200 THEN left(texto, 200) || '...' ELSE texto END AS text_preview, texto AS full_text, score FROM hits",
    "ivf_cells": "WITH c AS (SELECT vec_id AS cell, embedding FROM embeddings WHERE vec_id < 10) SELECT e.vec_id, arg_min(c.cell, (list_distance(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.cell)) AS cell FROM embeddings e, c GROUP BY 1",
    "embed_stub": f"SELECT cache_hit, count(*) AS n_rows FROM ({SEEN}) GROUP BY 1",
    "cache_metrics": f"SELECT count(*) AS n_rows, count(*) FILTER (cache_hit) AS n_hits, round(100.0 * count(*) FILTER (cache_hit) / count(*), 1) AS hit_rate FROM ({SEEN})",
    "cache_expiry": "SELECT cache, count(*) AS n_valid FROM events, (VALUES ('embedding', 7 * 24), ('search', 24), ('answer', 12)) t(cache, hours) WHERE date_trunc('second', ts) + to_hours(hours) > TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1",
    "status_counts_text": "SELECT status, n_norms || CASE WHEN n_norms = 1 THEN ' norma encontrada' ELSE ' normas encontradas' END AS shown FROM (" + ORACLE["status_histogram"] + ")",
    "unique_violations": "SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "slice_normalisation": f"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, {EDGES}, '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), {EDGES}, '', 'g')), chr(10)), {EDGES}, '', 'g') AS t FROM a)
SELECT doc_id, md5(t) AS slice_md5, length(t) AS n_slice FROM b""",
    "page_join": f"WITH {PAGES}, full_ AS (SELECT doc_id, string_agg('--- Página ' || no || ' ---' || chr(10) || t, chr(10) || chr(10) ORDER BY no) AS t FROM page WHERE regexp_replace(t, {WHITE}, '', 'g') <> '' GROUP BY 1) SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars, length(t) >= 50 AS accepted FROM full_",
    "ocr_decision": f"WITH {PAGES} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (length(trim(t)) <= 100) AS n_ocr FROM page GROUP BY 1",
    "event_labels": WITH_R + NORMS + ", " + PATHS + EVENTS.format("tree").replace("created_at FROM", "substr(texto, 1, 500) AS target_text FROM") + f""", place AS (SELECT w.id, w.norma_id, w.path, {label('w')} AS label, {NAMED.format('n')} AS norm FROM walk w JOIN norms n ON n.id = w.norma_id)
SELECT e.id, s.label || ' ' || {ACTION_NAME} || ' ' || coalesce(t.label, {NAMED.format('n')}, '(não identificado)') AS label,
'Na ' || s.norm || ', o ' || s.path || ' ' || {ACTION_NAME} || CASE WHEN t.id IS NOT NULL THEN ' o ' || t.path || CASE WHEN t.norma_id <> s.norma_id THEN ' da ' || t.norm ELSE '' END
 WHEN n.id IS NOT NULL THEN ' dispositivo(s) da ' || {NAMED.format('n')} ELSE ' ' || chr(39) || e.target_text || chr(39) END AS description
FROM events_ e JOIN place s ON s.id = e.source_clause_id LEFT JOIN place t ON t.id = e.target_clause_id LEFT JOIN norms n ON n.id = e.target_norm_id""",
    "clause_outline": outline(),
    "lenient_resolution": W_ + NORMS + ", " + CLAUSES + " SELECT c.id, n.id AS target_norm_id FROM clauses c LEFT JOIN norms n ON n.id = c.l_partkey AND n.ano = year(c.created_at) AND n.tipo = CASE c.l_partkey % 3 WHEN 0 THEN 'Lei Complementar' WHEN 1 THEN 'Lei' ELSE 'Resolução' END",
    "recent_sessions": f"SELECT * FROM ({ORACLE['session_cards']}) ORDER BY updated_at DESC, session_id DESC LIMIT 10",
    "message_labels": W_ + MESSAGES + " SELECT session_id, turn, CASE role WHEN 'user' THEN 'Usuário' WHEN 'assistant' THEN 'Assistente' ELSE role END || ': ' || CASE WHEN length(content) > 50 THEN left(content, 50) || '...' ELSE content END AS label FROM messages",
    "embedding_reset": "SELECT count(*) AS total, CAST(0 AS BIGINT) AS with_embedding, CAST(0 AS DOUBLE) AS percent FROM lineitem",
    "status_reverts": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN k THEN 'segmentation_processing' ELSE 'ocr_completed' END WHEN o_orderstatus = 'O' THEN CASE WHEN k THEN 'entity_extraction' ELSE 'segmented' END ELSE 'pending' END AS status, o_orderstatus = 'F' AND NOT k AS needs_review
FROM (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS k FROM orders)""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events FROM events GROUP BY 1, 2",
}


# Streams: what a stored value still answers, and the status machine event by event.
MACHINE_NEXT = ", ".join(f"('{a}', '{b}')" for a, bs in NEXT.items() for b in bs)
LISTED = NORMS + ", ly AS (SELECT id, ano AS year, 0 AS copy FROM norms UNION ALL SELECT id, ano + 1, 0 FROM norms WHERE id % 50 = 0)"
ORACLE |= {
    "ivf_query_set": ORACLE["vector_query_set"],
    "stream_cache": """WITH x AS (SELECT event_id, ts, user_id, props, event_type = 'purchase' AS put, ['embedding', 'search', 'answer'][user_id % 3 + 1] AS cache, [7 * 24, 24, 12][user_id % 3 + 1] AS hours FROM events),
p AS (SELECT *, last_value(CASE WHEN put THEN {'ts': ts, 'v': props} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM x),
h AS (SELECT *, coalesce(ts < e.ts + to_hours(hours), false) AS hit FROM p) SELECT event_id, cache, hit, CASE WHEN hit THEN e.v END AS value FROM h WHERE NOT put""",
    "stream_machine": f"""WITH RECURSIVE nxt AS (SELECT * FROM (VALUES {MACHINE_NEXT}) t(a, b)),
x AS (SELECT user_id AS entity_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN CASE WHEN event_id % 2 = 1 THEN 'segmentation_processing' ELSE 'ocr_completed' END
 WHEN 'click' THEN CASE WHEN event_id % 2 = 1 THEN 'entity_extraction' ELSE 'segmented' END WHEN 'purchase' THEN CASE WHEN event_id % 2 = 1 THEN 'consolidation' ELSE 'consolidated' END ELSE 'failed' END AS status FROM events),
m AS (SELECT entity_id, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS asked, NULL::VARCHAR AS before, false AS expired, NULL::VARCHAR AS old, NULL::TIMESTAMP AS gone, false AS allowed, NULL::VARCHAR AS now, NULL::TIMESTAMP AS since FROM x GROUP BY 1
 UNION ALL SELECT entity_id, k, ts, asked, before, expired, old, gone, allowed, CASE WHEN NOT allowed THEN before WHEN asked <> 'consolidated' THEN asked END, CASE WHEN allowed THEN ts WHEN expired THEN gone ELSE since END
 FROM (SELECT *, before IS NULL OR asked = 'failed' OR EXISTS (SELECT 1 FROM nxt WHERE a = before AND b = asked) AS allowed
 FROM (SELECT x.entity_id, x.k, x.ts, x.status AS asked, m.since, m.now AS old, m.since + INTERVAL 1 HOUR AS gone,
 coalesce(m.now IN ('segmentation_processing', 'entity_extraction', 'consolidation', 'ocr_processing') AND m.since + INTERVAL 1 HOUR <= x.ts, false) AS expired,
 CASE WHEN m.now IN ('segmentation_processing', 'entity_extraction', 'consolidation', 'ocr_processing') AND m.since + INTERVAL 1 HOUR <= x.ts THEN CASE m.now WHEN 'segmentation_processing' THEN 'ocr_completed' WHEN 'entity_extraction' THEN 'segmented' ELSE 'failed' END ELSE m.now END AS before
 FROM m JOIN x ON x.entity_id = m.entity_id AND x.k = m.k + 1))),
over_ AS (SELECT entity_id, now AS old, since + INTERVAL 1 HOUR AS gone FROM m QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY k DESC) = 1)
SELECT entity_id, ts, before, asked AS status, CASE WHEN allowed THEN 'moved' ELSE 'refused' END AS outcome FROM m WHERE k > 0
 UNION ALL SELECT entity_id, gone, old, before, 'expired' FROM m WHERE expired
 UNION ALL SELECT entity_id, gone, old, CASE old WHEN 'segmentation_processing' THEN 'ocr_completed' WHEN 'entity_extraction' THEN 'segmented' ELSE 'failed' END, 'expired' FROM over_
 WHERE old IN ('segmentation_processing', 'entity_extraction', 'consolidation', 'ocr_processing') AND gone <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""",
    "fetched_pages": W_ + LISTED + """, l AS (SELECT * FROM ly UNION ALL SELECT id, year, 1 FROM ly WHERE id % 20 = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY year ORDER BY id, copy) - 1) // 100 AS page FROM l),
t AS (SELECT * FROM r WHERE page * 100 < 650) SELECT year, count(DISTINCT page) AS n_pages, count(*) AS n_fetched, count(*) - count(DISTINCT id) AS n_repeated, CAST(0 AS BIGINT) AS n_failed FROM t GROUP BY 1""",
    "chained_streams": W_ + NORMS + " SELECT id, tipo, numero, ano, ano AS asked FROM norms",
}

# Trees of any depth, deep pages, jobs.
DEEP_PARENTS = CLAUSES + """, tree AS (SELECT *, CASE WHEN norma_id % 50 = 7 AND ordem = 1 THEN CASE WHEN max(ordem) OVER (PARTITION BY norma_id) > 1 THEN 2 END WHEN ordem % 3 <> 0 THEN ordem - 1 WHEN ordem > 0 THEN ordem - 2 END AS parent_ordem FROM clauses)"""
DEEP_PATHS = PATHS.replace(PARENTS, DEEP_PARENTS)
ORACLE |= {
    "deep_paths": WITH_R + DEEP_PATHS + " SELECT t.id, w.path, CAST(w.depth AS BIGINT) AS depth, w.id IS NULL AS cyclic FROM tree t LEFT JOIN walk w USING (id)",
    "deep_outline": WITH_R + DEEP_PATHS + f""", s AS (SELECT *, lag(depth) OVER o AS above, lead(id) OVER o IS NULL AS last_, {label()} AS label FROM walk WINDOW o AS (PARTITION BY norma_id ORDER BY anc))
SELECT norma_id, string_agg(CASE WHEN above IS NULL THEN '' WHEN depth > above THEN '{{' ELSE repeat('}}', above - depth) || ', ' END || label || CASE WHEN last_ THEN repeat('}}', depth) ELSE '' END, '' ORDER BY anc) AS outline FROM s GROUP BY 1""",
    "deep_consolidated_lines": WITH_R + LINES.replace(PARENTS, DEEP_PARENTS) + " SELECT norma_id, ordem, CAST(part AS BIGINT) AS part, line FROM lines_",
    "norm_last_page": W_ + NORMS + """, n AS (SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS n_pages FROM norms), r AS (SELECT *, row_number() OVER (ORDER BY ano DESC, numero DESC, id) AS rn FROM norms)
SELECT id, tipo, numero, CAST(ano AS BIGINT) AS ano, left(ementa, 200) AS ementa, status, strftime(pub, '%Y-%m-%d') AS published, '/normas/' || id || '/' AS url, total, n_pages, false AS has_next, n_pages > 1 AS has_prev FROM r, n WHERE rn > (n_pages - 1) * 20""",
    "deep_work_selection": W_ + NORMS + ", s AS (SELECT id, status, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM norms WHERE status IN ('segmented', 'entities_extracted')) SELECT id, status FROM s WHERE rn > 2 * n // 3 AND rn <= 2 * n // 3 + 70",
    "session_slugs": "SELECT count(*) AS n_sessions, count(*) AS n_slugs, CAST(0 AS BIGINT) AS n_clashes, CAST(0 AS BIGINT) AS n_short FROM customer",
    "embedding_job": f"""WITH e AS (SELECT text, regexp_replace(text, {EDGES}, '', 'g') <> '' AS said, doc_id % 2 = 0 AS even FROM documents), t AS (SELECT text, bool_or(even) AS even, contains(text, '@') AS bad FROM e WHERE said AND NOT (even AND NOT contains(text, '@')) GROUP BY text),
h AS (SELECT DISTINCT text FROM e WHERE even AND said AND NOT contains(text, '@')) SELECT (SELECT count(*) FILTER (NOT (even AND said AND NOT contains(text, '@'))) FROM e) AS n_rows, (SELECT count(*) FILTER (NOT said) FROM e) AS n_empty,
count(*) AS n_texts, count(h.text) AS n_cached, count(*) FILTER (h.text IS NULL AND NOT bad) AS n_computed, count(*) FILTER (bad) AS n_failed FROM t LEFT JOIN h USING (text)""",
    "short_clauses": W_ + CLAUSES + " SELECT id, 'REVOGA' AS acao FROM clauses WHERE l_returnflag = 'R' AND length(trim(substr(texto, 1, CAST(13 + id % 14 AS INT)))) >= 20",
    "padded_pages": f"WITH {PAGES}, p AS (SELECT doc_id, count(*) FILTER (length(regexp_replace(t, {EDGES}, '', 'g')) <= 100) AS n_ocr FROM page GROUP BY 1) SELECT doc_id, n_ocr, length(regexp_replace(left(text, 60), {EDGES}, '', 'g')) >= 50 AS accepted FROM p JOIN documents USING (doc_id)",
}

# Whole upserts and look-ups.
ORACLE |= {
    "upsert_payloads": f"""WITH p AS ({ORACLE['ingest_projection']}) SELECT id, tipo, numero, ano, ementa, CASE WHEN id % 2 = 0 THEN observacao || ' (revista)' ELSE observacao END AS observacao, published, in_force, texto_integral AS original_text, pdf_url, page_url,
numero AS said_numero, CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'segmented' END AS status, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'created' WHEN id % 2 = 0 THEN 'updated' ELSE 'kept' END AS change FROM p WHERE id % 3 <> 0 OR id % 2 = 0""",
    "missing_rows": "SELECT 2 * o_orderkey AS id, 'not found: ' || (2 * o_orderkey) AS error FROM orders WHERE 2 * o_orderkey NOT IN (SELECT o_orderkey FROM orders)",
}
ORACLE |= {"gram_list_search": ORACLE["norm_list_search"], "gram_admin_search": ORACLE["admin_search"]}
