"""Property graphs over relational tables: nodes and edges as views, and the relations that builders join."""

from __future__ import annotations

NODES = """
SELECT 'p' AS id, 'project' AS type, 'project' AS name, 'project' AS full_name, 'project' AS file_path, CAST('' AS {S}) AS summary, true AS is_exported
UNION ALL SELECT concat('r', r_regionkey), 'module', r_name, r_name, r_name, '', true FROM {region}
UNION ALL SELECT concat('n', n_nationkey), 'file', concat(r_name, '/', n_name), concat('/repo/', r_name, '/', n_name), concat('/repo/', r_name, '/', n_name), '', true FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('c', c_custkey), 'class', c_name, concat(n_name, '#', c_name), concat('/repo/', r_name, '/', n_name), c_mktsegment, c_acctbal > 0 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('s', s_suppkey), 'interface', s_name, concat(n_name, '#', s_name), concat('/repo/', r_name, '/', n_name), '', s_acctbal > 0 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('f', p_partkey), 'function', p_name, concat(p_brand, '.', p_name), concat('/repo/', p_brand), p_type, p_size > 25 FROM {part}
UNION ALL SELECT concat('m', o_orderkey), 'method', concat('order_', o_orderkey), concat('order_', o_orderkey), concat('/repo/', o_orderpriority), o_orderstatus, false FROM {orders}
"""

#: The dependencies among the 25 files alone, a small cyclic graph.
TRADE = """
SELECT DISTINCT concat('DEPENDS_ON:n', c_nationkey, ':n', s_nationkey) AS id, 'DEPENDS_ON' AS type, concat('n', c_nationkey) AS from_id, concat('n', s_nationkey) AS to_id, true AS resolved
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
WHERE l_quantity > 48 AND l_returnflag = 'R' AND o_orderkey < 3000 AND c_nationkey <> s_nationkey
"""

EDGES = f"""
SELECT concat('OWNS:p:r', r_regionkey) AS id, 'OWNS' AS type, 'p' AS from_id, concat('r', r_regionkey) AS to_id, true AS resolved FROM {{region}}
UNION ALL SELECT concat('OWNS:r', n_regionkey, ':n', n_nationkey), 'OWNS', concat('r', n_regionkey), concat('n', n_nationkey), true FROM {{nation}}
UNION ALL SELECT concat('DEFINES:n', c_nationkey, ':c', c_custkey), 'DEFINES', concat('n', c_nationkey), concat('c', c_custkey), true FROM {{customer}}
UNION ALL SELECT concat('DEFINES:n', s_nationkey, ':s', s_suppkey), 'DEFINES', concat('n', s_nationkey), concat('s', s_suppkey), true FROM {{supplier}}
UNION ALL SELECT concat('ENTRY_POINT:p:c', c_custkey), 'ENTRY_POINT', 'p', concat('c', c_custkey), true FROM {{customer}} WHERE c_acctbal > 9000
UNION ALL SELECT concat('OWNS:c', o_custkey, ':m', o_orderkey), 'OWNS', concat('c', o_custkey), concat('m', o_orderkey), true FROM {{orders}}
UNION ALL SELECT concat('CALLS:m', l_orderkey, ':f', l_partkey, ':', min(l_linenumber)), 'CALLS', concat('m', l_orderkey), concat('f', l_partkey), true FROM {{lineitem}} WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_partkey
UNION ALL SELECT concat('CALLS_UNRESOLVED:m', l_orderkey, ':f', l_partkey, ':', min(l_linenumber)), 'CALLS_UNRESOLVED', concat('m', l_orderkey), concat('f', l_partkey), false FROM {{lineitem}} WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_partkey
UNION ALL SELECT DISTINCT concat('USES:m', l_orderkey, ':s', l_suppkey), 'USES', concat('m', l_orderkey), concat('s', l_suppkey), true FROM {{lineitem}}
UNION ALL {TRADE}
"""

#: A span per line item, as provenance of the order's method.
SPANS = "SELECT concat('m', l_orderkey) AS subject_id, concat('/repo/', l_orderkey) AS source_file, l_linenumber AS start_line, l_linenumber + l_linenumber % 3 AS end_line, concat('text ', l_partkey) AS text, CAST(l_linenumber AS BIGINT) AS idx, l_orderkey % 5 AS rest FROM {lineitem}"

#: Two snapshots of a set of files.
OLD_FILES = "SELECT concat('/repo/o', o_orderkey) AS path, sha256(o_orderstatus) AS hash, CAST(o_orderkey AS BIGINT) AS created_at, CAST(o_orderkey AS BIGINT) AS updated_at FROM {orders} WHERE o_orderkey % 10 <> 0"
NEW_FILES = "SELECT concat('/repo/o', o_orderkey) AS path, sha256(concat(o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '!' ELSE '' END)) AS hash, CAST(o_orderkey + 1000000 AS BIGINT) AS created_at, CAST(o_orderkey + 1000000 AS BIGINT) AS updated_at FROM {orders} WHERE o_orderkey % 7 <> 0"

#: Relations of parsed files, for the resolution of names.
FILES = """
SELECT concat('/repo/', r_name, '/', n_name, CASE n_nationkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.js' END) AS path,
       concat('n', n_nationkey) AS id, n_nationkey AS key, n_name AS name, r_name AS region, n_nationkey % 5 = 0 AS is_test FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""
SYMBOLS = f"""
SELECT f.path AS file_path, CASE WHEN s_suppkey % 3 = 0 THEN concat('Owner', s_suppkey % 5) ELSE '' END AS owner, concat('s', s_suppkey % 40) AS name, concat('sym', s_suppkey) AS id, CAST(s_suppkey AS BIGINT) AS ord,
       CASE s_suppkey % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'function' WHEN 3 THEN 'method' WHEN 4 THEN 'route' WHEN 5 THEN 'doc' ELSE 'constant' END AS type,
       s_acctbal > 0 AS is_exported, concat('s', (s_suppkey + 7) % 55) AS ref, concat('s', (s_suppkey * 3) % 50, ',s', (s_suppkey + 11) % 45) AS refs
FROM {{supplier}} JOIN ({FILES}) f ON s_nationkey = f.key
UNION ALL SELECT f.path, '', concat('Owner', o), concat('own', f.key, '_', o), CAST(f.key * 5 + o - 1000 AS BIGINT), 'class', true, 's1', 's2,s3'
FROM ({FILES}) f CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) owners
"""
CALLS = f"""
SELECT concat('m', o_orderkey % 500) AS from_id, f.path AS file_path, f.is_test AS is_test, CAST(o_orderkey % 40 AS INT) AS line, CAST(o_orderkey AS BIGINT) AS ord, concat('s', o_orderkey % 60) AS name,
       CASE o_orderkey % 3 WHEN 0 THEN concat('s', o_orderkey % 60) WHEN 1 THEN concat('obj.s', o_orderkey % 60) ELSE concat('pkg.tool.s', (o_orderkey + 13) % 60) END AS full_name,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('Owner', o_orderkey % 5) ELSE '' END AS owner
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN ({FILES}) f ON c_nationkey = f.key
"""
IMPORTS = f"""
SELECT f.path AS file_path, f.id AS file_id, f.is_test AS is_test, CAST(s_suppkey AS BIGINT) AS ord, CAST(s_suppkey % 90 AS INT) AS line,
       CASE s_suppkey % 5 WHEN 0 THEN concat('./NATION_', s_suppkey % 25) WHEN 1 THEN concat('@lib/NATION_', s_suppkey % 25, '/x') WHEN 2 THEN 'left-pad' WHEN 3 THEN concat('../', f.region, '/NATION_', s_suppkey % 25, '.js') ELSE concat(f.region, '/NATION_', s_suppkey % 25) END AS module,
       concat('s', s_suppkey % 40) AS imported, concat('local', s_suppkey % 40) AS local
FROM {{supplier}} JOIN ({FILES}) f ON s_nationkey = f.key
"""
EXPORTS = f"""
SELECT f.path AS file_path, concat('s', s_suppkey % 40) AS exported, CASE WHEN s_suppkey % 2 = 0 THEN concat('s', (s_suppkey + 2) % 40) ELSE '' END AS local, CAST(s_suppkey AS BIGINT) AS ord,
       CASE WHEN s_suppkey % 6 = 0 THEN concat('./NATION_', (s_suppkey + 5) % 25) ELSE '' END AS module
FROM {{supplier}} JOIN ({FILES}) f ON s_nationkey = f.key
"""
#: Path aliases: prefix, suffix, target with a star, priority.
ALIASES = """
SELECT '@lib/' AS prefix, '/x' AS suffix, '/repo/AFRICA/*' AS target, 0 AS priority
UNION ALL SELECT '@lib/', '/x', '/repo/REGION_1/*', 1
UNION ALL SELECT '@lib/', '/x', '/repo/ASIA/*', 2
"""

#: Symbols with names, places and summaries of every kind, for the rules of labels.
LABELLED = """
SELECT CAST(p_partkey AS BIGINT) AS key, split_part('class,function,method,interface,type,enum,constant,variable,route,test', ',', CAST(p_partkey % 10 AS INT) + 1) AS type,
       concat(split_part('getUser,setMode,updateRow,testAll,describeIt,mySpec,fetchPage,queryDb,createOne,deleteIt,validateAll,recheck,verifyNow,formatDate,transformIt,parseTree,handleIt,processAll,initApp,setupAll,logIt,debugIt,UserService,HomeController,ClickHandler,DataProvider,AuthMiddleware,RowRepository,ShapeFactory,RowModel,UserEntity,plain,AppConfig,BadError,defaultSize', ',', CAST(CAST(floor(p_partkey / 10) AS BIGINT) % 35 AS INT) + 1), p_partkey % 3) AS name,
       concat('/repo/', split_part('api/v1/,auth/,core/,Common/,config/,database/,db/x/,server/,client/,utils/,helpers/,middleware/,routes/,services/,models/,types/,tests/,e2e/,unit/,src/entity/,lib/schema/,,web/handler/,deep/a/b/c/,x/controllers/', ',', CAST(CAST(floor(p_partkey / 7) AS BIGINT) % 25 AS INT) + 1),
         split_part('index.ts,main.tsx,app.config.js,thing.test.ts,tool-spec.jsx,settings.ts,plain.mjs,api.ts,README', ',', CAST(p_partkey % 9 AS INT) + 1)) AS path,
       split_part('POST /widgets,PUT /x,delete it,Patch me,none,put', ',', CAST(CAST(floor(p_partkey / 3) AS BIGINT) % 6 AS INT) + 1) AS summary
FROM {part}
"""
