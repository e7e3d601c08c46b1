"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_REST = "CASE WHEN instr({0},'://')>0 THEN substr({0},instr({0},'://')+3) ELSE '' END"
_HOST = "translate(regexp_extract({0},'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0},'^[^/?#]*([^?#]*)',1)"


def _node(url: str) -> str:
    rest = _REST.format(url)
    scheme = f"translate(substr({url},1,instr({url},'://')+2),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    path = _PATH.format(rest)
    query = f"regexp_extract({rest},'^[^?#]*(\\?[^#]*)?',1)"
    return f"CASE WHEN instr({url},'://')>0 THEN {scheme}||{_HOST.format(rest)}||CASE WHEN {path}='' THEN '/' ELSE {path} END||coalesce({query},'') END"


def _rule(host: str, path: str) -> str:
    def fits(name: str, prefix: str) -> str:
        return f"({host}='{name}' OR ends_with({host},'.{name}')) AND starts_with({path},'{prefix}')"

    return (
        f"CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {fits('example.com', '/de/')} THEN 'example.com/de/' "
        f"WHEN {fits('org', '/fr/')} THEN 'org/fr/' WHEN {fits('net', '/')} THEN 'net/' END"
    )


_ACTION = "CASE WHEN {0} IN ('example.net/en/','org/fr/') THEN 'allow' WHEN {0} IS NOT NULL THEN 'block' END"

OP1 = f"""
WITH RECURSIVE tags AS (
  SELECT url, list_filter(regexp_extract_all(html,'(?i)<link\\b[^>]*'), lambda x: regexp_matches(x,'(?i)\\brel\\s*=\\s*["'']?canonical\\b') AND regexp_matches(x,'(?i)\\bhref\\s*=')) AS links,
    list_filter(regexp_extract_all(html,'(?i)<meta\\b[^>]*'), lambda x: regexp_matches(x,'(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')) AS metas FROM pages WHERE url IS NOT NULL),
found AS (
  SELECT url, regexp_extract(links[1],'(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)',1) AS target FROM tags WHERE len(links)>0
  UNION ALL SELECT url, regexp_extract(metas[1],'(?i)url\\s*=\\s*([^"''\\s>]+)',1) FROM tags WHERE len(metas)>0),
resolved AS (
  SELECT url, CASE WHEN instr(target,'://')>0 THEN target WHEN starts_with(target,'//') THEN split_part(url,'://',1)||':'||target
    WHEN starts_with(target,'/') THEN split_part(url,'://',1)||'://'||regexp_extract({_REST.format("url")},'^([^/?#]*)',1)||target
    ELSE regexp_extract(url,'^([^?#]*/)',1)||target END AS target FROM found WHERE target<>''),
linked AS (SELECT {_node("url")} AS src, {_node("target")} AS dst FROM resolved),
known AS (SELECT url FROM pages UNION SELECT dst FROM linked),
parts AS (SELECT {_node("url")} AS src, regexp_replace({_HOST.format(_REST.format("url"))},'^(www|m)\\.','') AS host, regexp_replace({_PATH.format(_REST.format("url"))},'/$','') AS path,
  array_to_string(list_filter(string_split(regexp_extract({_REST.format("url")},'^[^?#]*\\?([^#]*)',1),'&'), lambda p: p<>'' AND NOT starts_with(p,'utm_')),'&') AS params FROM known),
edges AS (
  SELECT src, dst FROM linked WHERE src IS NOT NULL AND dst IS NOT NULL AND src<>dst
  UNION SELECT src, dst FROM (SELECT src, 'https://'||host||CASE WHEN path='' THEN '/' ELSE path END||CASE WHEN params='' THEN '' ELSE '?'||params END AS dst FROM parts WHERE regexp_matches(src,'^https?://')) WHERE src<>dst),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach(a, b) AS (SELECT DISTINCT src, src FROM both_ways UNION SELECT r.a, e.dst FROM reach r JOIN both_ways e ON e.src=r.b),
members AS (SELECT b AS node, min(a) AS component FROM reach GROUP BY b),
judged AS (SELECT component, {_ACTION.format("rule")} AS action FROM (SELECT component, {_rule("host", "path")} AS rule FROM
  (SELECT component, {_HOST.format(_REST.format("node"))} AS host, {_PATH.format(_REST.format("node"))} AS path FROM members))),
spread AS (SELECT component, CASE WHEN bool_or(action='allow') THEN 'allow' WHEN bool_or(action='block') THEN 'block' END AS inherited FROM judged GROUP BY component),
cut AS (SELECT page_id, coalesce({_HOST.format(_REST.format("url"))},'') AS host, coalesce({_PATH.format(_REST.format("url"))},'') AS path, {_node("url")} AS node FROM pages),
ruled AS (SELECT *, {_rule("host", "path")} AS rule FROM cut)
SELECT page_id, host, path, rule, coalesce({_ACTION.format("rule")}, s.inherited, 'allow') AS verdict, rule IS NULL AND s.inherited IS NOT NULL AS inherited
FROM ruled LEFT JOIN members USING (node) LEFT JOIN spread s USING (component)
"""

_WORDS = "regexp_extract_all(coalesce(text,''),'[^\\x20\\x09-\\x0D]+')"

OP2 = f"""
WITH split AS (SELECT doc_id, coalesce(text,'') AS text, {_WORDS} AS words, list_filter(string_split(coalesce(text,''),chr(10)), lambda x: regexp_matches(x,'[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, words[i] AS a, words[i+1] AS b, words[i+2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words)-1)) AS i FROM split WHERE len(words)>2)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n>1),
covered AS (SELECT doc_id, count(DISTINCT i+k) AS n FROM repeated, (VALUES (0),(1),(2)) t(k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words,'')),0)::BIGINT AS word_chars, (length(text)-length(regexp_replace(text,'[#*$%&|<>]','','g')))::BIGINT AS n_symbols,
    (length(text)-length(regexp_replace(text,'\\p{{Lu}}','','g')))::BIGINT AS n_upper, len(lines)::BIGINT AS n_word_lines, (len(lines)-len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n,0)::BIGINT AS n_repeat_words FROM split LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, (n_words<50)::BIGINT AS f0, (100*n_repeat_words>50*n_words)::BIGINT AS f1, (10*n_symbols>3*n_words)::BIGINT AS f2, (2*n_upper>word_chars AND n_words>0)::BIGINT AS f3,
    (2*n_dup_lines>n_word_lines AND n_word_lines>0)::BIGINT AS f4, (word_chars>25*n_words)::BIGINT AS f5 FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0+f1>0 AS base_failed, f0+f1+f2+f3+f4+f5=0 AS kept, f0+2*f1+4*f2+8*f3+16*f4+32*f5 AS failures FROM judged
"""

OP3 = """
WITH payloads AS (SELECT page_id, coalesce(html,'') AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS winner FROM payloads)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x'||substr(hex,(i//4)*5+1,5))::BIGINT >> (15-5*(i%4))) & 31)+1, 1)),'') AS payload_digest,
  CASE WHEN page_id=winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<>winner THEN winner END AS refers_to
FROM hashed
"""

OP4 = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words)=0 THEN [] WHEN len(words)<5 THEN [array_to_string(words,' ')]
    ELSE list_distinct(list_transform(range(1,len(words)-3), lambda i: array_to_string(words[i:i+4],' '))) END AS shingles FROM split),
copies AS (SELECT shingles, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM sets) WHERE len(shingles)>0 GROUP BY shingles),
terms AS (SELECT rep, len(shingles) AS n, unnest(shingles) AS shingle FROM copies),
pairs AS (SELECT a.rep AS u, b.rep AS v FROM terms a JOIN terms b ON a.shingle=b.shingle AND a.rep<b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100*count(*)>=85*(a.n+b.n-count(*))),
links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(a, b) AS (SELECT rep, rep FROM copies UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u=r.b),
heads AS (SELECT b AS rep, min(a) AS component FROM reach GROUP BY b),
placed AS (SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(h.component, s.doc_id) AS component_id
  FROM sets s LEFT JOIN copies c ON c.shingles=list_sort(s.shingles) LEFT JOIN heads h ON h.rep=c.rep)
SELECT doc_id, n_shingles, component_id, doc_id=component_id AS kept FROM placed
"""

ORACLES = {"op1_url_filter": OP1, "op2_quality_rules": OP2, "op3_warc": OP3, "op4_near_dedup": OP4}

#: Table of CRC-32 for all byte values, and the checksum of a text's UTF-8 bytes by it.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, [0,1,2,3,4,5,6,7]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(text: str) -> str:
    data = f"list_transform(range(0, strlen({text})), lambda k: ('0x'||substring(hex(encode({text})), 2*k+1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)||':'||{0}::VARCHAR END"
    return "sha256(" + "||".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, levels: int) -> str:
    """Views ``name``1 to ``name``levels above ``name``0(g, pos, total, h)."""
    return ", ".join(
        f"""{name}{k + 1} AS (SELECT g, pos//8 AS pos, any_value((total+7)//8) AS total, CASE WHEN any_value(total)=1 THEN any_value(h) ELSE sha256(string_agg(h,'' ORDER BY pos)) END AS h
        FROM {name}{k} GROUP BY g, pos//8)"""
        for k in range(levels)
    )


def _folds(name: str, tree: str, levels: int) -> str:
    """Views ``name``1 to ``name``levels above ``name``0(doc_id, g, pos, node, proof): one step up ``tree`` each."""
    return ", ".join(
        f"""{name}{k + 1} AS (SELECT doc_id, g, pos//8 AS pos, CASE WHEN total=1 THEN node ELSE sha256(lefts||node||rights) END AS node, proof||lefts||rights AS proof
        FROM (SELECT f.doc_id, f.g, f.pos, f.node, f.proof, any_value(s.total) AS total, coalesce(string_agg(s.h,'' ORDER BY s.pos) FILTER (WHERE s.pos<f.pos),'') AS lefts,
          coalesce(string_agg(s.h,'' ORDER BY s.pos) FILTER (WHERE s.pos>f.pos),'') AS rights
          FROM {name}{k} f JOIN {tree}{k} s ON s.g=f.g AND s.pos//8=f.pos//8 GROUP BY f.doc_id, f.g, f.pos, f.node, f.proof))"""
        for k in range(levels)
    )


#: Levels that the SQL spells out: 8^7 documents of a lang and 8^3 langs.
_LEVELS, _TOP_LEVELS = 7, 3

OP11 = f"""
WITH {_CRC_TABLE},
rows_ AS (SELECT doc_id, coalesce('='||lang,'') AS g, {_leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")}%3=0 THEN {_leaf(_lower("text"))} ELSE {_leaf("text")} END AS seen FROM documents, crc_table),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf)-1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM rows_),
t0 AS (SELECT g, pos, total, leaf AS h FROM numbered), {_tree("t", _LEVELS)},
s0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(g))-1 AS pos, count(*) OVER () AS total, h, g AS lang_ FROM t{_LEVELS}), {_tree("s", _TOP_LEVELS)},
f0 AS (SELECT doc_id, g, pos, seen AS node, '' AS proof FROM numbered), {_folds("f", "t", _LEVELS)},
u0 AS (SELECT f.doc_id, s.g, s.pos, f.node, f.proof FROM f{_LEVELS} f JOIN s0 s ON s.lang_=f.g), {_folds("u", "s", _TOP_LEVELS)}
SELECT n.doc_id, n.leaf, t.h AS subroot, s.h AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node=s.h AS verified
FROM numbered n JOIN u{_TOP_LEVELS} u ON u.doc_id=n.doc_id JOIN t{_LEVELS} t ON t.g=n.g, s{_TOP_LEVELS} s
"""

ORACLES |= {"op11_merkle": OP11}

OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_lower("text")}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
sums AS (SELECT run, c, {_crc32("(doc_id::VARCHAR||':'||run)")} AS h FROM runs, crc_table),
slipped AS (SELECT CASE WHEN h%31=0 THEN substring(run,1,(h%length(run))::INT)||substring(run,(h%length(run))::INT+2) ELSE run END AS word, c FROM sums),
words AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word)>=7 GROUP BY word HAVING sum(c)>=2),
cuts AS (SELECT word, i, substring(word,1,i::INT-1)||substring(word,i::INT+1) AS rest FROM (SELECT word, unnest(range(1,length(word)+1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i=b.i AND a.rest=b.rest AND a.word<>b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word=c.rest UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word=c.rest),
best AS (SELECT x.word, count(*) AS n_near, min({{'m': -w.n, 'w': x.near}}) AS b FROM near x JOIN words w ON w.word=x.near GROUP BY x.word),
forms AS (SELECT w.word, w.n, coalesce(n_near,0) AS n_near, CASE WHEN -b.m>=10*w.n THEN b.w END AS form, CASE WHEN -b.m>=10*w.n THEN -b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last_, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, c.step+1 FROM chain c JOIN forms f ON f.word=c.last_ WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(last_, step) AS root, n, n_near, form_n FROM forms JOIN chain USING (word) GROUP BY word, form, n, n_near, form_n
"""

ORACLES |= {"op13_spelling": OP13}
