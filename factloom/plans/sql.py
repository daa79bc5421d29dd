"""DuckDB SQL of the projections, as common table expressions that the queries' SQL begins with."""

from __future__ import annotations

CAT = """cat AS (SELECT source||'/'||lang||'/doc_'||doc_id||'.'||(CASE doc_id%6 WHEN 0 THEN 'js' WHEN 1 THEN 'ts' WHEN 2 THEN 'md' WHEN 3 THEN 'json' WHEN 4 THEN 'png' ELSE 'txt' END) AS path,
 'file' AS kind, CASE WHEN strlen(text)>8000 THEN 'oversize' WHEN doc_id%17=0 THEN 'ignored' ELSE 'captured' END AS disposition,
 CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS blob, doc_id, source, lang, text FROM documents)"""
DIRS = """dirs AS (SELECT '' AS path UNION SELECT source FROM cat UNION SELECT source||'/'||lang FROM cat)"""
SYM = """ln AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM cat),
off AS (SELECT *, CAST(coalesce(sum(strlen(line)+1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS "start" FROM ln),
sym0 AS (SELECT doc_id, path, i, "start", "start"+strlen(line) AS "end", split_part(line,' ',1)||'_'||length(line) AS name, line FROM off WHERE line<>''),
sym AS (SELECT *, 'symbol:'||path||':'||"start"||':'||"end" AS id FROM sym0)"""
CALLS = """calls AS (SELECT 'call:'||path||':'||"start"||':'||"end" AS id, doc_id, path, "start", "end", id AS owner, name AS owner_name,
 CASE WHEN i%7=6 THEN 'missing?' WHEN i%5=4 THEN first_value(name) OVER (PARTITION BY doc_id ORDER BY i) WHEN i%3=1 THEN coalesce(beside,'missing?') ELSE coalesce(lead(name,2) OVER (PARTITION BY doc_id ORDER BY i),'missing?') END AS label,
 CASE WHEN i%11=10 THEN 'member' ELSE 'identifier' END AS form FROM sym LEFT JOIN (SELECT doc_id-1 AS doc_id, i, name AS beside FROM sym) USING (doc_id, i))"""
BAD = """bad AS (SELECT DISTINCT path FROM cat JOIN labels USING (doc_id) WHERE toxic=1)"""
EDGES = """named AS (SELECT name AS label, count(*) AS n, min(id) AS found, min(path) AS found_path FROM sym GROUP BY name),
res AS (SELECT c.*, CASE WHEN form<>'identifier' THEN 'not_identifier' WHEN b.path IS NOT NULL THEN 'bad_file' WHEN n IS NULL THEN 'missing' WHEN n>1 THEN 'ambiguous' WHEN bt.path IS NOT NULL THEN 'bad_target_file' ELSE 'resolved' END AS basis, found
 FROM calls c LEFT JOIN named USING (label) LEFT JOIN bad b ON b.path=c.path LEFT JOIN bad bt ON bt.path=found_path),
calle AS (SELECT id, owner AS source, CASE WHEN basis='resolved' THEN found END AS target, 'call_candidate' AS kind, path, label, basis FROM res)"""
NODES = """percount AS (SELECT path, count(*) AS n FROM sym GROUP BY path),
nodes AS (SELECT 'file:'||path AS id, path, regexp_extract(path,'[^/]*$') AS name, kind, 'dir:'||regexp_replace(path,'/[^/]*$','') AS parent, CAST(0 AS BIGINT) AS "start", bytes AS "end", coalesce(n,0) AS function_count, disposition FROM cat LEFT JOIN percount USING (path)
 UNION ALL SELECT 'dir:'||path, path, regexp_extract(path,'[^/]*$'), 'directory', CASE WHEN path='' THEN NULL WHEN path LIKE '%/%' THEN 'dir:'||regexp_replace(path,'/[^/]*$','') ELSE 'dir:' END, 0, 0, 0, 'directory' FROM dirs
 UNION ALL SELECT id, path, name, 'function', 'file:'||path, "start", "end", 0, 'captured' FROM sym)"""
IMPORTS = """imp0 AS (SELECT doc_id, path, 0 AS k, (doc_id*7+3)%(SELECT count(*) FROM documents) AS t FROM cat UNION ALL SELECT doc_id, path, 1, (doc_id*11+5)%(SELECT count(*) FROM documents) FROM cat),
imports AS (SELECT 'import:'||i.path||':'||k AS id, i.doc_id, i.path, CASE WHEN (i.doc_id+k)%13<>0 THEN t END AS target_doc, k=1 AS type_only FROM imp0 i)"""
VERSIONS = """va AS (SELECT doc_id, path, blob, bytes, text FROM cat WHERE doc_id%10<>0),
vb0 AS (SELECT doc_id, CASE WHEN doc_id%10=3 THEN 'moved/'||path ELSE path END AS path, CASE WHEN doc_id%10=2 THEN text||chr(10)||'edited' ELSE text END AS text FROM cat WHERE doc_id%10<>1),
vb AS (SELECT doc_id, path, sha256(text) AS blob, CAST(strlen(text) AS BIGINT) AS bytes, text FROM vb0)"""
QUEUE = """q AS (SELECT sha256(user_id||':p:'||event_id) AS id, event_id, CAST(user_id AS VARCHAR) AS owner,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' ELSE 'queued' END AS state,
 coalesce(CAST(json_extract_string(props,'$.k') AS BIGINT),0) AS priority, epoch_us(ts)//1000 AS created_at,
 CASE WHEN event_type='click' THEN epoch_us(ts)//1000+60000 END AS lease_expires_at, CASE WHEN event_type='click' THEN 'worker-'||(event_id%4) END AS lease_holder FROM events)"""
BOXES = """box AS (SELECT p_partkey AS id, p_partkey*37%1000 AS x, p_partkey*91%1000 AS y, CAST(p_size%20+5 AS BIGINT) AS w, p_partkey%11+4 AS h FROM part)"""
MARKDOWN = """md AS (SELECT 'conv_'||conv_id||'.md' AS path, string_agg('# '||role||chr(10)||CASE WHEN turn%5=4 THEN '```'||chr(10)||'# not a heading'||chr(10)||'```' ELSE text END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""
ERRORS = """ee0 AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events WHERE event_type='error'),
ee AS (SELECT DISTINCT a, b FROM ee0 WHERE b IS NOT NULL)"""
NATIONS = """ne0 AS (SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY ALL),
ne AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM ne0) WHERE place<=2)"""
IR = """ir AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem)"""

PARTS = dict(cat=CAT, dirs=DIRS, sym=SYM, calls=CALLS, bad=BAD, edges=EDGES, nodes=NODES, imports=IMPORTS, versions=VERSIONS, queue=QUEUE, boxes=BOXES, markdown=MARKDOWN, errors=ERRORS, nations=NATIONS, ir=IR)


def using(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(PARTS[p] for p in parts)
