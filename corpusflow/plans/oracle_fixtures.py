"""DuckDB SQL for the derived fixtures (the same rules as ``sources/fixtures.py``).

Used only by the oracle SQL strings; each string is a list of CTEs that can be
joined with ``with_ctes``. The oracle derives expected chunk spans, names and
descriptions from ``lineitem`` directly, never by parsing Java.
"""

from __future__ import annotations

NL = "chr(10)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes)


JAVA = f"""
java_orders AS (
  SELECT o_orderkey AS okey, substr(o_orderpriority, 1, 1) AS digit,
         'Order' || o_orderkey ||
         (['Controller','Service','Repository','Dao','Config','Model',''])[o_orderkey % 7 + 1] AS cls
  FROM orders),
java_items AS (
  SELECT l_orderkey AS okey, l_partkey, l_linenumber, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS mi
  FROM lineitem),
java_methods AS (
  SELECT okey, mi,
         (['get','set','create','add','update','delete','find','search','run'])[l_partkey % 9 + 1]
           || l_partkey AS mname,
         CASE WHEN l_returnflag = 'A' THEN 'int' ELSE 'void' END AS rtype,
         'public static ' || CASE WHEN l_returnflag = 'A' THEN 'int' ELSE 'void' END || ' ' ||
         (['get','set','create','add','update','delete','find','search','run'])[l_partkey % 9 + 1]
           || l_partkey || '(int a) {{' || {NL} ||
         '        if (a > ' || l_linenumber || ') {{ a = a - 1; }}' || {NL} || '        ' ||
         CASE l_returnflag WHEN 'R' THEN 'System.out.println(a);' WHEN 'A' THEN 'return a;'
              ELSE 'a = a + 1;' END || {NL} || '    }}' AS body
  FROM java_items),
java_bodies AS (
  SELECT okey, string_agg('    ' || body, {NL} ORDER BY mi) AS methods, count(*) AS k
  FROM java_methods GROUP BY okey),
java_files AS (
  SELECT o.okey, o.cls, 'shop/p' || o.digit || '/' || o.cls || '.java' AS rel_path,
         coalesce(b.k, 0) AS k,
         'public class ' || o.cls || ' {{' ||
           CASE WHEN o.okey % 5 = 0 THEN ' /** Handles order ' || o.okey || '. */' ELSE '' END ||
           {NL} || coalesce(b.methods || {NL}, '') || '}}' AS class_text,
         'package com.shop.p' || o.digit || ';' || {NL} || {NL} || 'import java.util.List;' || {NL} ||
           'import com.shop.base.*;' || {NL} || {NL} || 'public class ' || o.cls || ' {{' ||
           CASE WHEN o.okey % 5 = 0 THEN ' /** Handles order ' || o.okey || '. */' ELSE '' END ||
           {NL} || coalesce(b.methods || {NL}, '') || '}}' AS content
  FROM java_orders o LEFT JOIN java_bodies b ON o.okey = b.okey),
java_chunks AS (
  SELECT substr(md5(rel_path), 1, 16) || '_file_0' AS chunk_id, rel_path AS file_path, 'java' AS file_type,
         'file' AS chunk_type, 'file_content' AS chunk_name, 1 AS start_line, 7 + 4 * k AS end_line,
         content AS code_content,
         CASE WHEN content LIKE '%Controller%' THEN 'REST API Controller handling HTTP requests'
              WHEN content LIKE '%Service%' THEN 'Business logic service layer'
              WHEN content LIKE '%Repository%' THEN 'Data access layer with database operations'
              WHEN content LIKE '%Config%' THEN 'Configuration class'
              ELSE 'Java source file' END AS description,
         '' AS context, CAST(NULL AS VARCHAR) AS parent_class
  FROM java_files
  UNION ALL
  SELECT substr(md5(rel_path), 1, 16) || '_class_6', rel_path, 'java', 'class', cls, 6, 7 + 4 * k,
         class_text,
         CASE WHEN okey % 5 = 0 THEN 'Handles order ' || okey || '.'
              WHEN cls LIKE '%Controller%' THEN 'REST API Controller: ' || cls || ' handles HTTP requests and routing'
              WHEN cls LIKE '%Service%' THEN 'Business Service: ' || cls || ' implements core business logic'
              WHEN cls LIKE '%Repository%' OR cls LIKE '%Dao%' THEN 'Data Access: ' || cls || ' handles database operations'
              WHEN cls LIKE '%Config%' THEN 'Configuration: ' || cls || ' defines application settings'
              WHEN cls LIKE '%Model%' OR cls LIKE '%Entity%' OR cls LIKE '%DTO%' THEN 'Data Model: ' || cls || ' represents domain object'
              ELSE 'Class: ' || cls END,
         '', cls
  FROM java_files
  UNION ALL
  SELECT substr(md5(f.rel_path), 1, 16) || '_method_' || (7 + 4 * (m.mi - 1)), f.rel_path, 'java', 'method',
         m.mname, 7 + 4 * (m.mi - 1), 10 + 4 * (m.mi - 1), m.body,
         CASE WHEN m.mname LIKE 'get%' THEN 'Getter method for retrieving data'
              WHEN m.mname LIKE 'set%' THEN 'Setter method for updating data'
              WHEN m.mname LIKE 'create%' OR m.mname LIKE 'add%' THEN 'Creates or adds new data'
              WHEN m.mname LIKE 'update%' THEN 'Updates existing data'
              WHEN m.mname LIKE 'delete%' OR m.mname LIKE 'remove%' THEN 'Deletes data'
              WHEN m.mname LIKE 'find%' OR m.mname LIKE 'search%' THEN 'Queries and retrieves data'
              ELSE 'Method: ' || m.mname || '() returns ' || m.rtype END,
         f.cls, f.cls
  FROM java_methods m JOIN java_files f ON m.okey = f.okey)
"""

DOC_TREE = """
doc_tree AS (
  SELECT doc_id, text AS content,
         (['src','docs/_x','.git','build','node_modules/m','a/target/b'])[(doc_id // 8) % 6 + 1] || '/' ||
         doc_id || (['.java','.py','.xml','.yaml','.properties','.sql','.md','.html'])[doc_id % 8 + 1] AS rel_path,
         (['.java','.py','.xml','.yaml','.properties','.sql','.md','.html'])[doc_id % 8 + 1] AS ext
  FROM documents
  UNION ALL
  SELECT page_id, html,
         (['src','docs/_x','.git','build','node_modules/m','a/target/b'])[(page_id // 8) % 6 + 1] || '/page' ||
         page_id || '.html', '.html'
  FROM pages),
indexed_tree AS (
  SELECT * FROM doc_tree
  WHERE NOT regexp_matches(rel_path, '(^|/)(\\.[^/]*|node_modules|dist|build|target)/')
    AND ext IN ('.java','.py','.xml','.yaml','.properties','.sql','.md'))
"""

# generic chunks of the documents' tree (the .java ones hold prose: file chunk only)
TREE_CHUNKS = """
tree_chunks AS (
  SELECT substr(md5(rel_path), 1, 16) AS chunk_id, rel_path AS file_path, substr(ext, 2) AS file_type,
         'file' AS chunk_type, string_split(rel_path, '/')[-1] AS chunk_name, 1 AS start_line,
         length(content) - length(replace(content, chr(10), '')) + 1 AS end_line,
         content AS code_content, 'File: ' || string_split(rel_path, '/')[-1] AS description,
         '' AS context, CAST(NULL AS VARCHAR) AS parent_class
  FROM indexed_tree WHERE ext <> '.java'
  UNION ALL
  SELECT substr(md5(rel_path), 1, 16) || '_file_0', rel_path, 'java', 'file', 'file_content', 1,
         length(content) - length(replace(content, chr(10), '')) + 1, content,
         CASE WHEN content LIKE '%Controller%' THEN 'REST API Controller handling HTTP requests'
              WHEN content LIKE '%Service%' THEN 'Business logic service layer'
              WHEN content LIKE '%Repository%' THEN 'Data access layer with database operations'
              WHEN content LIKE '%Config%' THEN 'Configuration class'
              ELSE 'Java source file' END,
         '', CAST(NULL AS VARCHAR)
  FROM indexed_tree WHERE ext = '.java')
"""

ALL_CHUNKS = """
all_chunks AS (SELECT * FROM tree_chunks UNION ALL SELECT * FROM java_chunks)
"""

# project files: documents as {source}/{doc_id}.md, version 1 + (doc_id // 20) % 4
PROJECT_CHUNKS = """
project_chunks AS (
  SELECT source AS project, (doc_id // 20) % 4 + 1 AS version,
         substr(md5(source || '/' || doc_id || '.md'), 1, 16) AS chunk_id,
         source || '/' || doc_id || '.md' AS file_path, doc_id || '.md' AS chunk_name,
         text AS code_content
  FROM documents),
project_pairs AS (
  SELECT project, version, substr(md5(chunk_id || '|explain_file|1'), 1, 16) AS pair_id, chunk_id,
         'explain_file' AS pair_type,
         'Summarize the purpose of this Java file:' || chr(10) || chr(10) || code_content
           AS input_text,
         'File: ' || chunk_name AS output_text
  FROM project_chunks)
"""


def pairs_of(chunks: str) -> str:
    """CTE ``pairs`` from a chunk relation with the generic chunk columns."""
    return f"""
pairs AS (
  SELECT substr(md5(chunk_id || '|explain_method|1'), 1, 16) AS pair_id, chunk_id, 'explain_method' AS pair_type,
         'Explain this Java method:' || chr(10) || chr(10) || code_content AS input_text,
         coalesce(nullif(description, ''), 'Method ''' || chunk_name || ''' in class ' || coalesce(parent_class, 'None'))
           AS output_text,
         chunk_type || ',method_explanation,' || coalesce(parent_class, '') AS tags
  FROM {chunks} WHERE chunk_type = 'method'
  UNION ALL
  SELECT substr(md5(chunk_id || '|qa|2'), 1, 16), chunk_id, 'qa',
         'What does the method ''' || chunk_name || ''' do in class ''' || coalesce(parent_class, 'None') || '''?',
         coalesce(nullif(description, ''), 'Method ''' || chunk_name || ''' in class ' || coalesce(parent_class, 'None')),
         chunk_type || ',method_qa,' || coalesce(parent_class, '')
  FROM {chunks} WHERE chunk_type = 'method'
  UNION ALL
  SELECT substr(md5(chunk_id || '|explain_logic|3'), 1, 16), chunk_id, 'explain_logic',
         'How to use the ' || chunk_name || '() method?' || chr(10) || chr(10) || 'Method code:' || chr(10) || code_content,
         CASE WHEN code_content LIKE '%void%' AND code_content LIKE '%System.out%'
                THEN 'This is a utility method. Call ' || chunk_name || '() to execute its operations.'
              WHEN code_content LIKE '%return%'
                THEN 'This method returns a value. Use the result from ' || chunk_name || '() for further processing.'
              ELSE 'Call this method as: ' || chunk_name || '()' END,
         chunk_type || ',method_usage,' || coalesce(parent_class, '')
  FROM {chunks} WHERE chunk_type = 'method'
  UNION ALL
  SELECT substr(md5(chunk_id || '|explain_class|1'), 1, 16), chunk_id, 'explain_class',
         'Explain this Java class:' || chr(10) || chr(10) || code_content,
         coalesce(nullif(description, ''), 'Java class ''' || chunk_name || ''''),
         chunk_type || ',class_explanation'
  FROM {chunks} WHERE chunk_type = 'class'
  UNION ALL
  SELECT substr(md5(chunk_id || '|qa|2'), 1, 16), chunk_id, 'qa',
         'What is the purpose of the ''' || chunk_name || ''' class?',
         coalesce(nullif(description, ''), 'Java class ''' || chunk_name || ''''),
         chunk_type || ',class_qa'
  FROM {chunks} WHERE chunk_type = 'class'
  UNION ALL
  SELECT substr(md5(chunk_id || '|explain_file|1'), 1, 16), chunk_id, 'explain_file',
         'Summarize the purpose of this Java file:' || chr(10) || chr(10) || code_content,
         coalesce(nullif(description, ''), 'Code content from ' || file_path),
         chunk_type || ',file_explanation'
  FROM {chunks} WHERE chunk_type = 'file')
"""

REVISIONS = """
revisions AS (
  SELECT o.o_orderkey + 1 AS revision,
         CASE WHEN o.o_custkey % 10 <> 0 THEN c.c_name END AS author,
         o.o_orderdate AS ts,
         CASE WHEN o.o_orderkey % 13 = 0 THEN '' ELSE o.o_orderpriority END AS message,
         coalesce(li.n, 0) AS files_changed, o.o_orderstatus AS order_status
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) li
    ON o.o_orderkey = li.l_orderkey)
"""

LEDGER = REVISIONS + """,
ledger AS (
  SELECT revision AS svn_revision,
         CASE WHEN st = 'completed' THEN substr(sha256('r' || revision), 1, 40) END AS git_commit_sha,
         author AS svn_author, ts AS svn_timestamp, message AS svn_message,
         (revision - 1) // 50 + 1 AS batch_number, ts AS created_at, ts AS updated_at, st AS status,
         CASE WHEN st = 'failed' THEN 'Test error' END AS error_message,
         CASE WHEN st = 'failed' THEN (revision - 1) % 3 ELSE 0 END AS retry_count
  FROM (SELECT *, CASE WHEN (revision - 1) % 97 = 0 THEN 'failed'
                       WHEN order_status = 'F' THEN 'completed'
                       WHEN order_status = 'P' THEN 'in_progress' ELSE 'pending' END AS st
        FROM revisions))
"""

CHECKPOINT_WRITES = """
checkpoint_writes AS (
  SELECT user_id + 1 AS svn_revision, user_id // 50 + 1 AS batch_number, 'user' || user_id AS svn_author,
         ts AS svn_timestamp, props AS svn_message, ts, event_id AS seq
  FROM events WHERE event_type = 'signup')
"""

TRANSITIONS = """
transitions AS (
  SELECT user_id + 1 AS svn_revision,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END
           AS status,
         CASE WHEN event_type = 'purchase' THEN substr(sha256('e' || event_id), 1, 40) END AS git_commit_sha,
         CASE WHEN event_type = 'error' THEN 'error ' || props END AS error_message,
         ts, event_id AS seq
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error'))
"""

ERRORS = """
error_log AS (
  SELECT event_id AS error_id, event_id % (SELECT count(*) FROM orders) + 1 AS svn_revision,
         (event_id % (SELECT count(*) FROM orders)) // 50 + 1 AS batch_number,
         (['TimeoutError','SVNConnectionError','GitPushError','SVNFetchError','GitAuthenticationError'])
           [event_id % 5 + 1] AS error_type,
         props AS error_message, ts AS error_timestamp, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS resolved
  FROM events WHERE event_type = 'error')
"""

RUNS = """
runs AS (
  SELECT n_nationkey::BIGINT AS run_id, 'svn://repo/' || lower(n_name) AS svn_url,
         'git@host:' || lower(n_name) || '.git' AS git_url,
         TIMESTAMP '2024-01-01 00:00:00' AS start_time, TIMESTAMP '2024-01-01 00:00:00' AS last_update_time,
         0::BIGINT AS last_checkpoint_revision, n_regionkey::BIGINT AS total_svn_revisions,
         0::BIGINT AS current_batch_number, 'in_progress' AS migration_status
  FROM nation),
run_updates AS (
  SELECT user_id % 25 AS run_id,
         CASE event_type WHEN 'click' THEN 'last_checkpoint_revision' WHEN 'view' THEN 'current_batch_number'
              WHEN 'purchase' THEN 'migration_status' WHEN 'error' THEN 'migration_status' ELSE 'svn_url' END
           AS field,
         CASE event_type WHEN 'click' THEN floor(value)::BIGINT::VARCHAR WHEN 'view' THEN event_id::VARCHAR
              WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE props END AS value,
         ts, event_id AS seq
  FROM events),
run_latest AS (
  SELECT run_id, field, value FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, field ORDER BY ts DESC, seq DESC) AS rn
    FROM run_updates
    WHERE field IN ('last_checkpoint_revision','current_batch_number','migration_status','total_svn_revisions'))
  WHERE rn = 1),
run_ts AS (
  SELECT run_id, max(ts) AS u_ts FROM run_updates
  WHERE field IN ('last_checkpoint_revision','current_batch_number','migration_status','total_svn_revisions')
  GROUP BY run_id),
run_pivot AS (
  SELECT run_id,
         max(CASE WHEN field = 'last_checkpoint_revision' THEN value END)::BIGINT AS u_lcr,
         max(CASE WHEN field = 'total_svn_revisions' THEN value END)::BIGINT AS u_tot,
         max(CASE WHEN field = 'current_batch_number' THEN value END)::BIGINT AS u_cbn,
         max(CASE WHEN field = 'migration_status' THEN value END) AS u_st
  FROM run_latest GROUP BY run_id),
runs_updated AS (
  SELECT r.run_id, r.svn_url, r.git_url, r.start_time,
         coalesce(t.u_ts, r.last_update_time) AS last_update_time,
         coalesce(p.u_lcr, r.last_checkpoint_revision) AS last_checkpoint_revision,
         coalesce(p.u_tot, r.total_svn_revisions) AS total_svn_revisions,
         coalesce(p.u_cbn, r.current_batch_number) AS current_batch_number,
         coalesce(p.u_st, r.migration_status) AS migration_status
  FROM runs r LEFT JOIN run_pivot p ON r.run_id = p.run_id LEFT JOIN run_ts t ON r.run_id = t.run_id)
"""

SNAPSHOTS = """
snap_cur AS (
  SELECT 'snap/' || doc_id || '.txt' AS rel_path, text AS content, sha256(text) AS file_sha FROM documents),
snap_prev AS (
  SELECT 'snap/' || doc_id || '.txt' AS rel_path,
         CASE WHEN doc_id % 7 = 0 THEN text || ' (old)' ELSE text END AS content
  FROM documents WHERE doc_id % 10 <> 0
  UNION ALL
  SELECT 'snap/' || (doc_id + 1000000) || '.txt', text FROM documents WHERE doc_id % 11 = 0),
snap_state AS (SELECT rel_path, sha256(content) AS file_sha FROM snap_prev),
snap_diff AS (
  SELECT coalesce(c.rel_path, s.rel_path) AS rel_path,
         CASE WHEN c.rel_path IS NULL THEN 'deleted' WHEN s.rel_path IS NULL THEN 'new'
              WHEN c.file_sha <> s.file_sha THEN 'modified' ELSE 'unchanged' END AS change
  FROM snap_cur c FULL OUTER JOIN snap_state s ON c.rel_path = s.rel_path)
"""

TOKEN_PAT = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_ \\t\\n\\x0B\\f\\r]"

TURN_PAIRS = """
turn_pairs AS (
  SELECT u.conv_id || '-' || u.turn AS pair_id, u.text AS input_text, a.text AS output_text
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""


def vocab(size: int = 2000, texts: str = "SELECT text FROM documents") -> str:
    return f"""
vocab_counts AS (
  SELECT token, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN_PAT}')) AS token FROM ({texts})) GROUP BY token),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY freq DESC, token) + 2)::INTEGER AS id
  FROM (SELECT * FROM vocab_counts WHERE token NOT IN ('<pad>', '<unk>', '<eos>')
        ORDER BY freq DESC, token LIMIT {size - 3})
  UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', 1 UNION ALL SELECT '<eos>', 2)
"""


def encode(name: str, src: str, key: str, text: str) -> str:
    """CTE ``name``(key, ids) encoding ``text`` of ``src`` with ``vocab``."""
    return f"""
{name}_tok AS (
  SELECT {key} AS k, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
  FROM (SELECT {key}, regexp_extract_all({text}, '{TOKEN_PAT}') AS toks FROM {src})),
{name}_enc AS (
  SELECT t.k, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids
  FROM {name}_tok t LEFT JOIN vocab v ON t.token = v.token GROUP BY t.k),
{name} AS (
  SELECT s.{key} AS k, coalesce(e.ids, []::INTEGER[]) AS ids FROM {src} s LEFT JOIN {name}_enc e ON s.{key} = e.k)
"""


def tokenized(max_length: int) -> str:
    """CTE ``tokenized`` of ``turn_pairs`` (needs ``vocab``)."""
    comb = "input_text || chr(10) || chr(10) || 'EXPLANATION:' || chr(10) || output_text"
    return (encode("enc_in", "turn_pairs", "pair_id", "input_text") + "," +
            encode("enc_all", "turn_pairs", "pair_id", comb) + f""",
tok_staged AS (
  SELECT p.pair_id, least(len(i.ids), {max_length}) AS in_len, list_slice(a.ids, 1, {max_length}) AS comb,
         length({comb}) AS original_length
  FROM turn_pairs p JOIN enc_in i ON p.pair_id = i.k JOIN enc_all a ON p.pair_id = a.k),
tok_lab AS (
  SELECT *, list_concat(list_resize([]::INTEGER[], in_len, -100), list_slice(comb, in_len + 1, len(comb))) AS lab
  FROM tok_staged),
tokenized AS (
  SELECT pair_id, len(comb) AS token_count, original_length,
         CASE WHEN len(comb) < {max_length} THEN list_resize(comb, {max_length}, 0) ELSE comb END AS input_ids,
         CASE WHEN len(comb) < {max_length}
              THEN list_concat(list_resize([]::INTEGER[], len(comb), 1), list_resize([]::INTEGER[], {max_length} - len(comb), 0))
              ELSE list_resize([]::INTEGER[], {max_length}, 1) END AS attention_mask,
         CASE WHEN len(comb) < {max_length} THEN list_resize(lab, {max_length}, -100)
              ELSE list_slice(lab, 1, {max_length}) END AS labels
  FROM tok_lab)
""")


def tokenized_windows(max_length: int) -> str:
    """CTE ``windows`` of whole ``turn_pairs`` (needs ``vocab``): each pair in rows of ``max_length`` tokens."""
    comb = "input_text || chr(10) || chr(10) || 'EXPLANATION:' || chr(10) || output_text"
    return (encode("enc_in", "turn_pairs", "pair_id", "input_text") + "," +
            encode("enc_all", "turn_pairs", "pair_id", comb) + f""",
win_all AS (
  SELECT p.pair_id, a.ids, length({comb}) AS original_length,
         list_concat(list_resize([]::INTEGER[], len(i.ids), -100), list_slice(a.ids, len(i.ids) + 1, len(a.ids))) AS lab
  FROM turn_pairs p JOIN enc_in i ON p.pair_id = i.k JOIN enc_all a ON p.pair_id = a.k
  WHERE p.input_text IS NOT NULL AND p.output_text IS NOT NULL),
win_no AS (SELECT *, unnest(range((len(ids) + {max_length} - 1) // {max_length})) AS window_no FROM win_all),
win_cut AS (
  SELECT pair_id, window_no, original_length, list_slice(ids, window_no * {max_length} + 1, (window_no + 1) * {max_length}) AS part,
         list_slice(lab, window_no * {max_length} + 1, (window_no + 1) * {max_length}) AS lab FROM win_no),
windows AS (
  SELECT pair_id, window_no::BIGINT AS window_no, pair_id || '#' || window_no AS window_id, len(part) AS token_count, original_length,
         list_resize(part, {max_length}, 0) AS input_ids, list_resize(lab, {max_length}, -100) AS labels,
         list_resize(list_resize([]::INTEGER[], len(part), 1), {max_length}, 0) AS attention_mask
  FROM win_cut)
""")


def packed(src: str, key: str, size: str, max_tokens: int = 2048, max_sequences: int = 16) -> str:
    """CTE ``packed``(key, size, batch_id): the greedy walk as a recursive CTE."""
    brk = f"(w.cur_len >= {max_sequences} OR w.cur_tok + o.sz > {max_tokens})"
    return f"""
pack_order AS (
  SELECT {key} AS k, {size} AS sz, row_number() OVER (ORDER BY {size} DESC, {key}) AS rn FROM {src}),
pack_walk AS (
  WITH RECURSIVE walk(rn, k, sz, batch_id, cur_len, cur_tok) AS (
    SELECT rn, k, sz, 0::BIGINT, 1, sz FROM pack_order WHERE rn = 1
    UNION ALL
    SELECT o.rn, o.k, o.sz,
           CASE WHEN {brk} THEN w.batch_id + 1 ELSE w.batch_id END,
           CASE WHEN {brk} THEN 1 ELSE w.cur_len + 1 END,
           CASE WHEN {brk} THEN o.sz ELSE w.cur_tok + o.sz END
    FROM walk w JOIN pack_order o ON o.rn = w.rn + 1)
  SELECT k, sz, batch_id FROM walk),
packed AS (SELECT k AS {key}, sz AS {size}, batch_id FROM pack_walk)
"""


def terms_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> ''))"


QUESTIONS = """
questions AS (
  SELECT item_id * 2 AS qid, text AS question
  FROM benchmark
  UNION ALL
  SELECT item_id * 2 + 1, CASE item_id % 3 WHEN 1 THEN lower(q) WHEN 2 THEN upper(q) ELSE q END
  FROM (SELECT item_id, 'What does the Order' || ((item_id // 3) * 7) || 'Controller class do?' AS q FROM benchmark)),
answer_cache AS (
  SELECT sha256(lower(question)) AS qkey, min('cached answer ' || qid) AS answer
  FROM questions WHERE qid % 4 = 1 GROUP BY 1),
misses AS (SELECT * FROM questions WHERE sha256(lower(question)) NOT IN (SELECT qkey FROM answer_cache)),
hits AS (SELECT q.qid, q.question, c.answer FROM questions q JOIN answer_cache c ON sha256(lower(q.question)) = c.qkey)
"""


def retrieval(src: str, k: int) -> str:
    """CTEs ``scores`` and ``topk`` for questions of ``src`` against ``all_chunks``."""
    return f"""
q_terms AS (SELECT qid, unnest(tq) AS term, len(tq) AS nq FROM (SELECT qid, {terms_sql('question')} AS tq FROM {src})),
c_terms AS (SELECT chunk_id, unnest(tc) AS term, len(tc) AS nc
            FROM (SELECT chunk_id, {terms_sql("chunk_name || ' ' || description")} AS tc FROM all_chunks)),
scores AS (
  SELECT qid, chunk_id, count(*) / (any_value(nq) + any_value(nc) - count(*)) AS score
  FROM q_terms JOIN c_terms USING (term) GROUP BY qid, chunk_id),
ranked AS (
  SELECT s.qid, s.chunk_id, s.score, c.file_path, c.chunk_type, c.chunk_name, c.code_content,
         row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, c.file_path, c.start_line,
                            CASE c.chunk_type WHEN 'file' THEN 0 WHEN 'class' THEN 1 ELSE 2 END) AS rank
  FROM scores s JOIN all_chunks c ON s.chunk_id = c.chunk_id),
topk AS (SELECT * FROM ranked WHERE rank <= {k}),
cites AS (
  SELECT qid, count(*) AS n_sources, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids,
         'RELEVANT CODE CONTEXT:' || chr(10) ||
         string_agg(chr(10) || upper(chunk_type) || ': ' || chunk_name || chr(10) || code_content
                    || '...' || chr(10), '' ORDER BY rank) AS context
  FROM topk GROUP BY qid)
"""

META_FILES = """
md_files AS (
  SELECT 'docs/' || doc_id || '.md' AS rel_path,
         '# Doc ' || doc_id || chr(10) || chr(10) || split_part(text, chr(10), 1) || chr(10) || chr(10) || '## ' ||
         lang || chr(10) || text ||
         CASE WHEN doc_id % 4 = 0 THEN chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' ELSE '' END AS content
  FROM documents),
yaml_files AS (
  SELECT 'conf/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.yaml' ELSE '.yml' END AS rel_path,
         'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || 'n_chars: ' || n_chars || chr(10) ||
         'meta:' || chr(10) || '  id: ' || doc_id || chr(10) AS content
  FROM documents),
java_meta AS (
  SELECT rel_path, nullif(regexp_extract(content, 'package\\s+([\\w.]+)', 1), '') AS package,
         regexp_extract_all(content, '(public\\s+)?(class|interface)\\s+(\\w+)', 3) AS classes,
         regexp_extract_all(content, 'import\\s+([\\w.*]+)', 1) AS imports,
         length(content) - length(replace(content, chr(10), '')) + 1 AS lines
  FROM java_files),
md_meta AS (
  SELECT rel_path, regexp_extract_all(content, '(?m)^#+\\s+(.+)$', 1) AS headings,
         length(content) - length(replace(content, chr(10), '')) + 1 AS lines,
         contains(content, '```') AS has_code_blocks
  FROM md_files),
yaml_meta AS (
  SELECT rel_path, list_sort(list_distinct(regexp_extract_all(content, '(?m)^(\\w+):\\s*', 1))) AS keys,
         length(content) - length(replace(content, chr(10), '')) + 1 AS lines
  FROM yaml_files),
all_meta AS (
  SELECT rel_path, 'JavaFileHandler' AS handler, 'java' AS file_type,
         'Java file' || coalesce(' in package ' || package, '') ||
         CASE WHEN len(classes) > 0 THEN ' containing classes: ' || array_to_string(classes, ', ') ELSE '' END
           AS description, lines
  FROM java_meta
  UNION ALL
  SELECT rel_path, 'MarkdownFileHandler', 'markdown',
         'Documentation file' || CASE WHEN len(headings) > 0
                                      THEN ' with sections: ' || array_to_string(list_slice(headings, 1, 3), ', ')
                                      ELSE '' END, lines
  FROM md_meta
  UNION ALL
  SELECT rel_path, 'YamlFileHandler', 'yaml',
         'YAML configuration file' || CASE WHEN len(keys) > 0
                                           THEN ' with properties: ' || array_to_string(list_slice(keys, 1, 5), ', ')
                                           ELSE '' END, lines
  FROM yaml_meta)
"""

WALKED_TREE = """
walked AS (
  SELECT *, CASE WHEN rel_path LIKE '%.java' THEN 'JavaFileHandler' WHEN rel_path LIKE '%.md' THEN 'MarkdownFileHandler'
                 WHEN rel_path LIKE '%.yaml' OR rel_path LIKE '%.yml' THEN 'YamlFileHandler' END AS handler
  FROM doc_tree WHERE NOT regexp_matches(rel_path, '(^|/)(\\.[^/]*|node_modules|dist|build|target)/')),
by_ext AS (SELECT ext, count(*)::BIGINT AS n_files FROM walked GROUP BY ext),
by_handler AS (
  SELECT handler, count(*)::BIGINT AS n_files, arg_min(ext, rel_path) AS extension,
         array_to_string(list_slice(list(rel_path ORDER BY rel_path), 1, 3), ',') AS examples
  FROM walked WHERE handler IS NOT NULL GROUP BY handler)
"""

PROJECTS = """
projects AS (
  SELECT s_suppkey, 'src' || s_suppkey AS project_name, 'Project of ' || s_name AS description,
         (['microservices','documentation','monolith'])[s_nationkey % 3 + 1] AS project_type
  FROM supplier)
"""
