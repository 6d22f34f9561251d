"""DuckDB forms of the registered queries, written on their own; they share only fixed word lists and limits with the Spark side."""

from __future__ import annotations

import re

from linkloom.functions.lexicons import ADDRESS_STOP, FAMILIES, LEGAL_SUFFIXES, NAME_STOP, SCRIPTS, STREETS, state_lookup

#: The same production limits as plans.chain.Limits.
CAP, SIDE_BUDGET, TOP_K, TAU, GATE, FULL, TRIM = 5_000, 10_000_000, 80, 0.5, 0.6, 600_000_000, 500_000_000
LEVELS = (7_500, 10_000, 15_000, 20_000, 30_000, 50_000, 100_000, 500_000)
EDGES = (5_000, 20_000, 50_000, 100_000, 500_000)

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_FIXED = "replace(replace(replace({0}, 'â€™', ''''), 'Ã¢', '-'), 'Â–', '-')"
_PLAIN = "replace(replace(replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), '&', ' and ')"
_WORK = _PLAIN.format(_FIXED.format("coalesce({0}, '')"))
_SPACED = r"trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_WORDS = "list_filter(string_split(" + _SPACED + ", ' '), lambda t: t <> '')"
_PROFILE = _SPACED.format("replace(replace(replace(lower(nfc_normalize(coalesce({0}, ''))), 'ß', 'ss'), '™', 'tm'), '&', ' and ')").replace("{L}", "{{L}}").replace("{N}", "{{N}}")
_POSTAL = "regexp_extract({0}, '(?:^|[^0-9])([0-9]{{5}}-[0-9]{{4}}|[0-9]{{5}}|[0-9]{{6}})(?:[^0-9]|$)', 1)"
#: DuckDB compares bytes in jaro_winkler_similarity, so the letters of the fixture that are no ASCII stand as signs.
_SIGNS = "translate({0}, 'नगरзавод', '!@#$%^~|')"
_NOT_SUFFIX = f"list_filter({{0}}, lambda t: t NOT IN ({_quoted(LEGAL_SUFFIXES)}))"
_CORE = f"CASE WHEN len({_NOT_SUFFIX}) = 0 THEN {{0}} ELSE {_NOT_SUFFIX} END"
_STREET = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STREETS.items()) + " ELSE t END"
_STATES = ", ".join(f"('{k}', '{v}')" for k, v in state_lookup().items())
_IN_SCRIPT = " OR ".join(f"unicode(ch) BETWEEN {a} AND {b}" for _, a, b in SCRIPTS)
_SCRIPT = "CASE WHEN sign IS NULL THEN 'latin' " + " ".join(f"WHEN unicode(sign) BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in SCRIPTS) + " ELSE 'unknown' END"
_NUM = "CAST(substr({0}, 4) AS BIGINT)"
_FAMILY_RANK = "list_position([" + _quoted(FAMILIES) + "], {0})"
_ROMAN = "replace(business_name, 'नगर', 'nagara')"
_WHICH = "(VALUES ('matched_entity_ids'), ('candidate_entity_ids')) w(which)"
_union = lambda rows: " UNION ALL ".join(rows)
_values = lambda rows: "(VALUES " + ", ".join(f"({r})" for r in rows) + ")"


def phon(expr: str) -> str:
    letters = f"regexp_replace(upper({expr}), '[^A-Z]', '', 'g')"
    kept = f"left({letters}, 1) || regexp_replace(substr({letters}, 2), '[AEIOU]', '', 'g')"
    return f"list_reduce(list_concat([''], string_split({kept}, '')), lambda a, c: CASE WHEN right(a, 1) = c THEN a ELSE a || c END)"


def phon_name(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN '' WHEN len({words}) = 1 THEN {phon(f'{words}[1]')} ELSE {phon(f'{words}[1]')} || ' ' || {phon(f'{words}[-1]')} END"


def initials(words: str) -> str:
    return f"array_to_string(list_transform(list_filter({words}, lambda t: regexp_matches(t, '^\\p{{L}}')), lambda t: left(t, 1)), '')"


_list = lambda c: f"list_filter(string_split({c}, ' '), lambda t: t <> '')"
_set = lambda c: f"list_distinct({_list(c)})"
_long = lambda c: f"list_filter(string_split({c}, ' '), lambda t: length(t) >= 4)"


def jaccard(a: str, b: str) -> str:
    x, y = _set(a), _set(b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"


def containment(a: str, b: str) -> str:
    x, y = _set(a), _set(b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) END"


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of at most 120 characters, a row of bits at a time."""
    full = f"(((1::HUGEINT) << length({a})) - 1)"
    mask = f"coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = ch THEN (1::HUGEINT) << i::INT ELSE 0::HUGEINT END)), 0)::HUGEINT"
    return f"(length({a}) - bit_count(list_reduce(list_concat([{full}], list_transform(string_split({b}, ''), lambda ch: {mask})), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})))"


def indel(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {common(a, b)} / (length({a}) + length({b})) END"


def f05(tp: str, nh: str, nt: str) -> str:
    return f"CASE WHEN {nh} = 0 AND {nt} = 0 THEN 1.0::DOUBLE WHEN {nh} = 0 OR {nt} = 0 OR {tp} = 0 THEN 0.0::DOUBLE ELSE (1.25::DOUBLE * {tp}) / ({nh} + 0.25::DOUBLE * {nt}) END"


def first_by_hash(table: str, group: str, take: str, seed: int) -> str:
    """Rows of table with chosen: the first take of n of their group by a hash of s1_id."""
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}|' || s1_id), s1_id) <= ({take}) AS chosen FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {table}) s"


def both(pairs: str, columns: tuple[str, ...], table: str = "{records}") -> str:
    shown = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in columns)
    return f"SELECT p.*, {shown} FROM {pairs} p JOIN {table} a ON a.entity_id = p.s1_id JOIN {table} b ON b.entity_id = p.other_id"


def rate(test: str) -> str:
    return f"round(avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)"


_TRACED = ("name_sorted", "houseno", "state", "name_script", "name_initials", "addr_norm")
TABLES = {
    "raw": r"""SELECT CAST(source AS INT) AS source, 'S' || source || '-' || num AS entity_id, num, CASE WHEN num % 29 = 5 THEN '' ELSE name END AS business_name,
        CASE WHEN num % 31 = 7 THEN '' ELSE address END AS business_address, country, size, digest FROM (SELECT doc_id AS num, doc_id % 3 + 1 AS source, n_chars AS size, md5(coalesce(text, '')) AS digest, coalesce(trim(lang), '') AS country,
        array_to_string(list_slice(toks, 1, 6), ' ') || CASE doc_id % 13 WHEN 4 THEN ' Itâ€™s' WHEN 7 THEN ' नगर' WHEN 9 THEN ' Завод' WHEN 11 THEN ' & Söhne' ELSE '' END
        || CASE n_chars % 4 WHEN 0 THEN '' WHEN 1 THEN ' Ltd' WHEN 2 THEN ' Pvt Ltd' ELSE ' Group' END AS name,
        (1 + n_chars % 60) || ' ' || array_to_string(list_slice(toks, 7, 12), ' ') || ' Rd' || CASE n_chars % 5 WHEN 0 THEN ' Texas' WHEN 1 THEN ' New York' WHEN 2 THEN ' Karnataka' WHEN 3 THEN ' Tamil Nadu' ELSE '' END
        || CASE WHEN n_chars % 3 = 0 THEN ' ' || (10000 + n_chars % 500) ELSE '' END AS address
        FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS toks FROM documents) d) w""",
    "truth": """SELECT 'S1-' || f.num AS s1_id, r.entity_id AS other_id FROM {raw} r JOIN (SELECT country, digest, min(num) AS num FROM {raw} WHERE source = 1 GROUP BY ALL) f ON f.country = r.country AND f.digest = r.digest WHERE r.source > 1
        UNION SELECT a.entity_id, b.entity_id FROM {raw} a JOIN {raw} b ON b.num = a.num + 1 WHERE a.source = 1 AND a.size % 2 = 0 UNION SELECT a.entity_id, b.entity_id FROM {raw} a JOIN {raw} b ON b.num = a.num + 2 WHERE a.source = 1 AND a.size % 3 = 0""",
    "entities": "SELECT r.entity_id AS s1_id, any_value(r.country) AS country, count(t.other_id) AS n_true FROM {raw} r LEFT JOIN {truth} t ON t.s1_id = r.entity_id WHERE r.source = 1 GROUP BY r.entity_id",
    "parts": f"""SELECT *, {_CORE.format("toks")} AS core, list_transform({_WORDS.format("work")}, lambda t: {_STREET}) AS atoks, {_SCRIPT} AS script
        FROM (SELECT *, {_WORDS.format(_WORK.format("business_name"))} AS toks, {_WORK.format("business_address")} AS work,
          list_filter(string_split(business_name, ''), lambda ch: unicode(ch) >= 592 AND ({_IN_SCRIPT} OR regexp_matches(ch, '^\\p{{L}}$')))[1] AS sign FROM {{raw}}) w""",
    "latin": f"SELECT entity_id, array_to_string(list_sort({_CORE.format('w')}), ' ') AS latin FROM (SELECT entity_id, {_WORDS.format(_WORK.format(_ROMAN))} AS w FROM {{parts}} WHERE script = 'devanagari') x",
    "atoks": "SELECT entity_id, unnest(atoks) AS tok, generate_subscripts(atoks, 1) AS pos FROM {parts}",
    "states": f"SELECT * FROM (VALUES {_STATES}) s(name, canonical)",
    "found": """SELECT entity_id, coalesce(min_by(canonical, pos) FILTER (WHERE kind = 2), min_by(canonical, pos) FILTER (WHERE kind = 1)) AS state FROM (
        SELECT a.entity_id, a.pos, s.canonical, 1 AS kind FROM {atoks} a JOIN {states} s ON s.name = a.tok
        UNION ALL SELECT a.entity_id, a.pos, s.canonical, 2 FROM {atoks} a JOIN {atoks} b ON b.entity_id = a.entity_id AND b.pos = a.pos + 1 JOIN {states} s ON s.name = a.tok || ' ' || b.tok) x GROUP BY entity_id""",
    "records": f"""SELECT p.source, p.entity_id, p.num, p.country, array_to_string(core, ' ') AS name_core, array_to_string(list_sort(core), ' ') AS name_sorted,
        array_to_string(list_sort(list_distinct(list_filter(toks, lambda t: t IN ({_quoted(LEGAL_SUFFIXES)})))), ' ') AS name_suffixes, {initials("core")} AS name_initials, {phon_name("core")} AS name_phon,
        script AS name_script, coalesce(nullif(l.latin, ''), array_to_string(list_sort(core), ' ')) AS name_translit, array_to_string(atoks, ' ') AS addr_norm,
        regexp_extract(work, '[0-9]{{1,6}}(-[0-9]{{1,6}})?') AS houseno, replace({_POSTAL.format("work")}, '-', '') AS postal, coalesce(f.state, '') AS state,
        regexp_matches(coalesce(business_name, ''), '[^\\x00-\\x7F]') AS name_nonascii, regexp_matches(coalesce(business_address, ''), '[^\\x00-\\x7F]') AS addr_nonascii
        FROM {{parts}} p LEFT JOIN {{found}} f ON f.entity_id = p.entity_id LEFT JOIN {{latin}} l ON l.entity_id = p.entity_id""",
    "split": """SELECT *, string_split(name_core, ' ') AS core, string_split(name_sorted, ' ') AS ordered, list_filter(string_split(addr_norm, ' '), lambda t: t <> '') AS addr,
        CASE WHEN name_script <> 'latin' AND name_translit <> name_sorted THEN string_split(name_translit, ' ') ELSE []::VARCHAR[] END AS other,
        CASE WHEN name_script <> 'latin' AND name_translit <> name_sorted THEN string_split(name_translit, ' ') ELSE string_split(name_core, ' ') END AS spoken FROM {records} WHERE name_sorted <> ''""",
    "keys": f"""SELECT source, entity_id, country, 'sig' AS family, name_translit AS payload FROM {{split}}
        UNION ALL SELECT source, entity_id, country, 'pfx', array_to_string(list_concat(list_slice(ordered, 1, 3), [ordered[-1]]), ' ') FROM {{split}}
        UNION ALL SELECT source, entity_id, country, 'pfx', array_to_string(list_concat(list_slice(other, 1, 3), [other[-1]]), ' ') FROM {{split}} WHERE len(other) > 0
        UNION ALL SELECT source, entity_id, country, 'tok', t FROM (SELECT *, unnest(list_concat(core, other)) AS t FROM {{split}}) x WHERE length(t) >= 3 AND t NOT IN ({_quoted(NAME_STOP)})
        UNION ALL SELECT source, entity_id, country, 'phon', {phon_name("spoken")} FROM {{split}}
        UNION ALL SELECT source, entity_id, country, 'ini', {initials("spoken")} FROM {{split}} WHERE len(spoken) >= 3 AND length({initials("spoken")}) >= 3
        UNION ALL SELECT source, entity_id, country, 'hn', houseno FROM {{split}} WHERE houseno <> ''
        UNION ALL SELECT source, entity_id, country, 'atok', t FROM (SELECT *, unnest(addr) AS t FROM {{split}}) x WHERE length(t) >= 4 AND regexp_matches(t, '^\\p{{L}}+$') AND t NOT IN ({_quoted(ADDRESS_STOP)})
        UNION ALL SELECT source, entity_id, country, 'combo', houseno || '|' || core[1] FROM {{split}} WHERE houseno <> ''
        UNION ALL SELECT source, entity_id, country, 'hnstate', houseno || '|' || state FROM {{split}} WHERE houseno <> '' AND state <> ''
        UNION ALL SELECT source, entity_id, country, 'atok2', a || ' ' || b FROM (SELECT *, unnest(addr[:-2]) AS a, unnest(addr[2:]) AS b FROM {{split}} WHERE len(addr) > 1) x""",
    "buckets": """SELECT family, side AS other_source, country, payload, CAST(sum(mine) AS BIGINT) AS c1, CAST(sum(theirs) AS BIGINT) AS c2, CAST(sum(mine) * sum(theirs) AS BIGINT) AS pc FROM (
        SELECT family, country, payload, CAST(side AS INT) AS side, CASE WHEN source = 1 THEN 1 ELSE 0 END AS mine, CASE WHEN source = side THEN 1 ELSE 0 END AS theirs FROM {keys}, (VALUES (2), (3)) v(side) WHERE source IN (1, side)) k
        GROUP BY ALL HAVING sum(mine) > 0 AND sum(theirs) > 0""",
    "kept": f"SELECT * FROM {{buckets}} WHERE pc <= {CAP} QUALIFY sum(pc) OVER (PARTITION BY family, other_source ORDER BY pc, country, payload ROWS UNBOUNDED PRECEDING) - pc <= {SIDE_BUDGET}",
    "pairs": """SELECT x.entity_id AS s1_id, y.entity_id AS other_id, y.source AS other_source FROM {kept} k JOIN {keys} y ON y.source = k.other_source AND y.family = k.family AND y.country = k.country AND y.payload = k.payload
        JOIN {keys} x ON x.source = 1 AND x.family = k.family AND x.country = k.country AND x.payload = k.payload GROUP BY ALL""",
    "scored": f"""SELECT s1_id, other_id, other_source, CASE WHEN odd THEN greatest({jaccard("a", "b")}, {jaccard("a", "c")}) ELSE {jaccard("a", "b")} END AS pri,
        CASE WHEN odd THEN greatest({containment("a", "b")}, {containment("a", "c")}) ELSE {containment("a", "b")} END AS sec
        FROM (SELECT p.*, x.name_sorted AS a, y.name_sorted AS b, y.name_translit AS c, y.name_script <> 'latin' AS odd FROM {{pairs}} p JOIN {{records}} x ON x.entity_id = p.s1_id JOIN {{records}} y ON y.entity_id = p.other_id) z""",
    "pool": f"SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY pri DESC, sec DESC, other_source, {_NUM.format('other_id')}) - 1 AS INT) AS rnk FROM {{scored}}",
    "topk": f"SELECT * FROM {{pool}} WHERE rnk <= {TOP_K - 1}",
    "aggs": """SELECT s1_id, s[1] AS e_max, s[1] - coalesce(s[2], 0.0) AS e_gap, list_avg(s[1:5]) AS e_mean5, len(list_filter(s, lambda v: v >= 0.75)) AS e_n75
        FROM (SELECT s1_id, list_reverse_sort(list(pri)) AS s FROM {topk} GROUP BY s1_id) l""",
    "decided": f"SELECT t.* FROM {{topk}} t JOIN {{aggs}} a ON a.s1_id = t.s1_id WHERE t.pri >= {TAU} AND a.e_max >= {GATE}",
    "traced": "SELECT g.s1_id, g.other_id, p.rnk FROM {truth} g LEFT JOIN {pool} p ON p.s1_id = g.s1_id AND p.other_id = g.other_id",
    "sided": f"SELECT *, rnk IS NOT NULL AS found FROM ({both('{traced}', _TRACED)}) s",
    "classed": f"""SELECT s1_id, other_id, rnk, found, CASE WHEN a_name_sorted <> '' AND a_name_sorted = b_name_sorted THEN 'EXACT_NAME' WHEN a_houseno <> '' AND a_houseno = b_houseno AND a_state <> '' AND a_state = b_state THEN 'HN_AND_STATE'
        WHEN b_name_sorted <> '' AND EXISTS (SELECT 1 FROM {{sided}} o WHERE o.s1_id = m.s1_id AND o.other_id <> m.other_id AND o.rnk < {TOP_K} AND o.b_name_sorted = m.b_name_sorted) THEN 'TRANSITIVE'
        WHEN b_name_script <> 'latin' THEN 'NONLATIN' WHEN len(list_intersect({_long("a_name_sorted")}, {_long("b_name_sorted")})) > 0 THEN 'SHARED_TOKEN'
        WHEN length(a_name_initials) >= 3 AND a_name_initials = b_name_initials THEN 'INITIALS'
        WHEN a_houseno <> '' AND a_houseno = b_houseno OR a_state <> '' AND a_state = b_state OR len(list_intersect({_long("a_addr_norm")}, {_long("b_addr_norm")})) > 0 THEN 'ADDRESS'
        ELSE 'NONE' END AS category FROM {{sided}} m""",
    "categories": f"SELECT * FROM {{classed}} WHERE coalesce(rnk, 65535) >= {TOP_K}",
    "trace": f"""SELECT t.s1_id, t.other_id, CASE WHEN min(b.pc) IS NULL THEN 'NOKEY' WHEN min(b.pc) > {CAP} THEN 'CAP' ELSE 'BUG' END AS reason, min(b.pc) AS min_pc, arg_min(b.family, b.pc * 100 + {_FAMILY_RANK.format("b.family")}) AS best_family
        FROM {{traced}} t LEFT JOIN {{keys}} x ON x.entity_id = t.s1_id LEFT JOIN {{keys}} y ON y.entity_id = t.other_id AND y.family = x.family AND y.country = x.country AND y.payload = x.payload
        LEFT JOIN {{buckets}} b ON b.other_source = y.source AND b.family = y.family AND b.country = y.country AND b.payload = y.payload WHERE t.rnk IS NULL GROUP BY t.s1_id, t.other_id""",
    "old": f"""SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY greatest(pri, sec) DESC, other_source, {_NUM.format("other_id")}) - 1 AS INT) AS old_rank,
        count(*) OVER (PARTITION BY s1_id, round(greatest(pri, sec), 9)) AS ties, count(*) OVER (PARTITION BY s1_id) AS size FROM {{pool}}""",
    "lines": """SELECT *, CASE WHEN num % 37 = 6 AND num % 19 <> 4 AND num % 23 <> 5 THEN entity_id || chr(9) || chr(65533) || coalesce(business_name, '') WHEN num % 23 = 5 THEN id WHEN num % 17 = 3 THEN whole || chr(9) || 'extra' ELSE whole END AS line
        FROM (SELECT *, id || chr(9) || coalesce(business_name, '') || chr(9) || coalesce(business_address, '') || chr(9) || country AS whole FROM (SELECT *, CASE WHEN num % 19 = 4 THEN 'bad-' || num ELSE entity_id END AS id FROM {raw}) r) s""",
    "rows": """SELECT source, num, f[1] AS entity_id, coalesce(f[2], '') AS business_name, coalesce(f[3], '') AS business_address, coalesce(array_to_string(f[4:], chr(9)), '') AS country
        FROM (SELECT *, string_split(line, chr(9)) AS f FROM {lines}) l WHERE regexp_matches(f[1], '^S[123]-[0-9]+$')""",
    "lists": f"""SELECT e.s1_id, {_NUM.format("e.s1_id")} AS n, coalesce(string_agg(t.other_id, ',' ORDER BY substr(t.other_id, 2, 1), {_NUM.format("t.other_id")}), '') AS ids FROM {{entities}} e LEFT JOIN {{truth}} t ON t.s1_id = e.s1_id GROUP BY e.s1_id""",
    "gt_lines": """SELECT s1_id, n, CASE WHEN n % 11 = 3 AND ids <> '' THEN ids || ',' || string_split(ids, ',')[1] WHEN n % 17 = 6 THEN concat_ws(',', nullif(ids, ''), ' S1-0') WHEN n % 19 = 9 THEN concat_ws(',', nullif(ids, ''), 'X9-1') ELSE ids END
        || CASE WHEN n % 23 = 12 THEN chr(9) || 'more' ELSE '' END AS rest FROM {lists} UNION ALL SELECT s1_id, n, 'S2-1' FROM {lists} WHERE n % 13 = 6""",
    "gt_rows": "SELECT s1_id, rest, list_filter(list_transform(string_split(rest, ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM {gt_lines}",
    "gt_read": "SELECT s1_id, unnest(list_filter(ids, lambda x: regexp_matches(x, '^S[23]-[0-9]+$'))) AS other_id FROM {gt_rows}",
    "places": "SELECT entity_id, source, row_number() OVER (PARTITION BY source ORDER BY num) - 1 AS position FROM {rows}",
    "result": f"""SELECT which, n, 0 AS again, s1_id, CASE WHEN which = 'candidate_entity_ids' AND n % 30 = 12 THEN '' WHEN n % 21 = 3 THEN concat_ws(',', nullif(ids, ''), 'S1-0') WHEN n % 24 = 6 THEN concat_ws(',', nullif(ids, ''), 'abc')
        WHEN n % 27 = 9 THEN concat_ws(',', nullif(ids, ''), 'S2-99999999') WHEN n % 33 = 12 THEN concat_ws(',', nullif(ids, ''), 'S3-2', 'S3-2') ELSE ids END AS ids, n % 36 <> 15 AS tab FROM (
        SELECT w.which, e.s1_id, {_NUM.format("e.s1_id")} AS n, coalesce(string_agg(t.other_id, ',' ORDER BY t.other_source, {_NUM.format("t.other_id")}), '') AS ids FROM {{entities}} e CROSS JOIN {_WHICH}
        LEFT JOIN (SELECT 'matched_entity_ids' AS which, s1_id, other_id, other_source FROM {{decided}} UNION ALL SELECT 'candidate_entity_ids', s1_id, other_id, other_source FROM {{topk}}) t ON t.s1_id = e.s1_id AND t.which = w.which GROUP BY w.which, e.s1_id) l WHERE n % 39 <> 18
        UNION ALL SELECT which, n, 1, s1_id, '', true FROM {{lists}}, {_WHICH} WHERE n % 42 = 0
        UNION ALL SELECT which, n, 3, 'S1-9' || s1_id, '', true FROM {{lists}}, {_WHICH} WHERE n % 48 = 24""",
    "result_ids": "SELECT which, s1_id, id FROM (SELECT which, s1_id, unnest(string_split(ids, ',')) AS id FROM {result} WHERE tab) u WHERE id <> ''",
    "result_lines": f"""SELECT which, CAST(1 + row_number() OVER (PARTITION BY which ORDER BY n, again) AS VARCHAR) AS line, tab OR again = 2 AS fine FROM (
        SELECT which, n, again, tab FROM {{result}} UNION ALL SELECT which, n, 2, false FROM {{lists}}, {_WHICH} WHERE n % 45 = 21) x""",
    "strata": "SELECT s1_id, country || '|' || CASE WHEN n_true >= 5 THEN '5+' WHEN n_true >= 3 THEN '3-4' ELSE CAST(n_true AS VARCHAR) END AS stratum FROM {entities}",
    "parted": f"SELECT s1_id, stratum, CASE WHEN chosen THEN 'val' ELSE 'fit' END AS part FROM ({first_by_hash('{strata}', 'stratum', 'greatest(1, round_even(n * 0.1::DOUBLE, 0))', 42)}) f",
    "fitting": "SELECT s1_id FROM {parted} WHERE part = 'fit'",
    "learn": f"SELECT s1_id, CASE WHEN chosen THEN 'stop' ELSE 'learn' END AS part FROM ({first_by_hash('{fitting}', '1', 'round_even(n * 0.15::DOUBLE, 0)', 43)}) f UNION ALL SELECT s1_id, part FROM {{parted}} WHERE part = 'val'",
    "negatives": "SELECT p.s1_id, p.other_id FROM {topk} p ANTI JOIN {truth} g ON g.s1_id = p.s1_id AND g.other_id = p.other_id QUALIFY row_number() OVER (PARTITION BY p.s1_id ORDER BY md5('42|' || p.s1_id || '|' || p.other_id), p.other_id) <= 6",
    "marked": "SELECT p.s1_id, p.other_id, p.pri, max(p.pri) OVER (PARTITION BY p.s1_id) AS best, g.s1_id IS NOT NULL AS hit FROM {topk} p LEFT JOIN {truth} g ON g.s1_id = p.s1_id AND g.other_id = p.other_id",
    "grid": f"""SELECT tau, gate, round(avg({f05("tp", "nh", "nt")}), 6) AS macro_f05, round(CASE WHEN sum(nh) > 0 THEN sum(tp)::DOUBLE / sum(nh) ELSE 1 END, 6) AS "precision", round(CASE WHEN sum(nt) > 0 THEN sum(tp)::DOUBLE / sum(nt) ELSE 1 END, 6) AS recall FROM (
        SELECT c.tau, c.gate, e.s1_id, any_value(e.n_true) AS nt, count(*) FILTER (WHERE s.pri >= c.tau AND (c.gate IS NULL OR s.best >= c.gate)) AS nh, count(*) FILTER (WHERE s.pri >= c.tau AND (c.gate IS NULL OR s.best >= c.gate) AND s.hit) AS tp
        FROM {{entities}} e CROSS JOIN (SELECT t.tau, g.gate FROM (SELECT round(0.3::DOUBLE + 0.025::DOUBLE * i, 3) AS tau FROM range(27) r(i)) t CROSS JOIN (SELECT round(0.45::DOUBLE + 0.05::DOUBLE * i, 2) AS gate FROM range(11) r(i) UNION ALL SELECT NULL) g) c
        LEFT JOIN {{marked}} s ON s.s1_id = e.s1_id GROUP BY c.tau, c.gate, e.s1_id) x GROUP BY tau, gate""",
    "best": 'SELECT * FROM {grid} ORDER BY macro_f05 DESC, "precision" DESC, tau, gate NULLS FIRST LIMIT 1',
    "tokens": f"SELECT entity_id, source, {_POSTAL.format('business_address')} AS postal, string_split({_PROFILE.format('business_name')}, ' ')[1] AS token FROM {{raw}}",
    "near": """SELECT x.entity_id AS s1_id, y.entity_id AS other_id, CASE WHEN x.postal <> '' AND x.postal = y.postal AND x.token <> '' AND x.token = y.token THEN 'postal + token' WHEN x.postal <> '' AND x.postal = y.postal THEN 'postal' ELSE 'token' END AS reason
        FROM {tokens} x JOIN {tokens} y ON x.source = 1 AND y.source > 1 AND (x.postal <> '' AND x.postal = y.postal OR x.token <> '' AND x.token = y.token) ANTI JOIN {truth} g ON g.s1_id = x.entity_id AND g.other_id = y.entity_id
        WHERE x.entity_id IN (SELECT s1_id FROM (SELECT DISTINCT s1_id FROM {truth}) t ORDER BY md5('42|' || s1_id), s1_id LIMIT 60) ORDER BY 1, 2 LIMIT 400""",
    "countries": "SELECT g.s1_id, g.other_id, x.country AS a, y.country AS b FROM {truth} g JOIN {raw} x ON x.entity_id = g.s1_id JOIN {raw} y ON y.entity_id = g.other_id",
    "scaled": f"""SELECT g.s1_id, g.other_id, b.source, b.position, nb.n, a.position / greatest(na.n - 1, 1)::DOUBLE AS u, b.position / greatest(nb.n - 1, 1)::DOUBLE AS v, md5('42|' || g.s1_id || '|' || g.other_id) AS h
        FROM {{truth}} g JOIN {{places}} a ON a.entity_id = g.s1_id JOIN {{places}} b ON b.entity_id = g.other_id JOIN (SELECT source, count(*) AS n FROM {{places}} GROUP BY 1) na ON na.source = a.source JOIN (SELECT source, count(*) AS n FROM {{places}} GROUP BY 1) nb ON nb.source = b.source""",
    "shuffled": """SELECT *, coalesce(lead(v) OVER w, first_value(v) OVER w) AS w, coalesce(lead(position) OVER w, first_value(position) OVER w) AS q, round_even(u * (n - 1), 0) AS guess FROM {scaled}
        WINDOW w AS (PARTITION BY source, left(h, 2) ORDER BY h, s1_id, other_id)""",
}

_TWO = lambda table, columns: both(table, columns).replace("p.*", "p.s1_id, p.other_id")
_CORE_A, _CORE_B, _ADDR_A, _ADDR_B, _SUF_A, _SUF_B = (_list(c) for c in ("a_name_core", "b_name_core", "a_addr_norm", "b_addr_norm", "a_name_suffixes", "b_name_suffixes"))
_flag = lambda test: f"CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_found = lambda x, y: f"CASE WHEN len({x}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({x}, lambda t: list_contains({y}, t)))::DOUBLE / len({x}) END"
NATIVE = {
    "jacc_core": jaccard("a_name_core", "b_name_core"),
    "contain_core": containment("a_name_core", "b_name_core"),
    "first_eq": _flag(f"len({_CORE_A}) > 0 AND {_CORE_A}[1] = {_CORE_B}[1]"),
    "last_eq": _flag(f"len({_CORE_A}) > 0 AND {_CORE_A}[-1] = {_CORE_B}[-1]"),
    "phon_eq": _flag("a_name_phon <> '' AND a_name_phon = b_name_phon"),
    "ini_eq": _flag("length(a_name_initials) >= 3 AND a_name_initials = b_name_initials"),
    "suff_jacc": f"CASE WHEN a_name_suffixes = '' AND b_name_suffixes = '' THEN 1.0::DOUBLE ELSE {jaccard('a_name_suffixes', 'b_name_suffixes')} END",
    "ntok_diff": f"CASE WHEN len({_CORE_A}) = 0 OR len({_CORE_B}) = 0 THEN 0.0::DOUBLE ELSE abs(len({_CORE_A}) - len({_CORE_B}))::DOUBLE / greatest(len({_CORE_A}), len({_CORE_B})) END",
    "nchar_diff": "abs(length(a_name_sorted) - length(b_name_sorted))::DOUBLE / greatest(length(a_name_sorted), length(b_name_sorted), 1)",
    "addr_jacc": jaccard("a_addr_norm", "b_addr_norm"),
    "addr_contain": containment("a_addr_norm", "b_addr_norm"),
    **{f"{c}_both": _flag(f"a_{c} <> '' AND b_{c} <> ''") for c in ("houseno", "postal", "state")},
    **{f"{c}_eq": _flag(f"a_{c} <> '' AND a_{c} = b_{c}") for c in ("houseno", "postal", "state")},
    **{f"{c}_xor": _flag(f"(a_{c} = '') <> (b_{c} = '')") for c in ("houseno", "postal", "state")},
    "name_in_addr": _found(_CORE_A, _ADDR_B),
    "addr_in_name": _found(_CORE_B, _ADDR_A),
    "prod_jacc": f"({jaccard('a_name_core', 'b_name_core')}) * ({jaccard('a_addr_norm', 'b_addr_norm')})",
    "min_jacc": f"least({jaccard('a_name_core', 'b_name_core')}, {jaccard('a_addr_norm', 'b_addr_norm')})",
    "other_nonascii": _flag("b_name_nonascii"),
    "cross_script": _flag("a_name_script <> b_name_script"),
    "suff_count_diff": f"abs(len({_SUF_A}) - len({_SUF_B}))::DOUBLE",
}
_COLUMNS = ("name_core", "name_sorted", "name_translit", "name_suffixes", "name_initials", "name_phon", "name_script", "name_nonascii", "addr_norm", "houseno", "postal", "state")


def _token_set(a: str, b: str) -> str:
    """Best of three similarities of common tokens with own ones added; strings x (common), y, z (with those of a and of b)."""
    x, y = _set(a), _set(b)
    sets = f"{{'x': array_to_string(list_sort(list_intersect({x}, {y})), ' '), 'p': array_to_string(list_sort(list_filter({x}, lambda t: NOT list_contains({y}, t))), ' '), 'q': array_to_string(list_sort(list_filter({y}, lambda t: NOT list_contains({x}, t))), ' ')}}"
    return sets


def _token_set_table(source: str, a: str, b: str) -> str:
    """source with ts, the token-set similarity of its columns a and b."""
    u, v = "trim(s.x || ' ' || s.p)", "trim(s.x || ' ' || s.q)"
    best = f"greatest({indel('u', 'v')}, CASE WHEN s.x = '' THEN 0.0::DOUBLE ELSE {indel('s.x', 'u')} END, CASE WHEN s.x = '' THEN 0.0::DOUBLE ELSE {indel('s.x', 'v')} END)"
    value = f"CASE WHEN trim({a}) = '' OR trim({b}) = '' THEN 0.0::DOUBLE WHEN s.x <> '' AND (s.p = '' OR s.q = '') THEN 1.0::DOUBLE ELSE {best} END"
    return f"SELECT * EXCLUDE (s, u, v), {value} AS ts FROM (SELECT *, {u} AS u, {v} AS v FROM (SELECT *, {_token_set(a, b)} AS s FROM ({source}) o) o) o"


def _partial(a: str, b: str) -> str:
    """Best similarity of the shorter string with any window of its length of the longer, partly outside too."""
    small, big = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    window = "substr(big, greatest(i, 0)::INT + 1, (least(i + length(small), length(big)) - greatest(i, 0))::INT)"
    return f"SELECT * EXCLUDE (small, big), CASE WHEN small = '' THEN CASE WHEN big = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (SELECT max({indel('small', 'win')}) FROM (SELECT {window} AS win FROM range(1 - length(small), length(big)) r(i)) w) END AS pr FROM (SELECT *, {small} AS small, {big} AS big FROM ({{0}}) o) o"


def _rounded(columns: dict[str, str]) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


_DECIDED = _TWO("{decided}", _COLUMNS)
_FUZZY = _partial("a_name_sorted", "b_name_sorted").replace("{0}", _token_set_table(_DECIDED, "a_name_core", "b_name_core"))
_FUZZY = f"SELECT * RENAME (ts AS tsr_core, pr AS pr_sorted) FROM ({_FUZZY}) f"
_FUZZY = _partial("a_addr_norm", "b_addr_norm").replace("{0}", _token_set_table(_FUZZY, "a_addr_norm", "b_addr_norm"))
DISTANCES = {
    "jw_sorted": f"jaro_winkler_similarity({_SIGNS.format('a_name_sorted')}, {_SIGNS.format('b_name_sorted')})", "tsr_core": "tsr_core", "pr_sorted": "pr_sorted", "ratio_sorted": indel("a_name_sorted", "b_name_sorted"), "indel_sorted": indel("a_name_sorted", "b_name_sorted"),
    "jw_translit": f"jaro_winkler_similarity({_SIGNS.format('a_name_sorted')}, {_SIGNS.format('b_name_translit')})", "tsr_addr": "ts", "indel_addr": indel("a_addr_norm", "b_addr_norm"), "pr_addr": "pr",
}


def _finding(which: str, rule: str, ids: str, severity: str = "error") -> str:
    return f"SELECT '{which}' AS file, '{rule}' AS rule, '{severity}' AS severity, count(DISTINCT id) AS n, coalesce(array_to_string(list_sort(list_distinct(list(id)))[1:5], ', '), '') AS examples FROM ({ids}) o"


def _findings() -> str:
    out = []
    for which in ("matched_entity_ids", "candidate_entity_ids"):
        mine = f"WHERE which = '{which}'"
        out += [
            _finding(which, "not UTF-8", "SELECT '' AS id WHERE false"),
            _finding(which, "row without a tab", f"SELECT line AS id FROM {{result_lines}} {mine} AND NOT fine"),
            _finding(which, "repeated entity", f"SELECT s1_id AS id FROM {{result}} {mine} AND tab GROUP BY s1_id HAVING count(*) > 1"),
            _finding(which, "repeated id in a list", f"SELECT s1_id AS id FROM {{result}} {mine} AND tab AND len(list_distinct(string_split(ids, ','))) < len(string_split(ids, ','))"),
            _finding(which, "source 1 id in a list", f"SELECT id FROM {{result_ids}} {mine} AND starts_with(id, 'S1-')"),
            _finding(which, "id without a prefix", f"SELECT id FROM {{result_ids}} {mine} AND NOT regexp_matches(id, '^S[123]-')"),
            _finding(which, "required entity missing", f"SELECT entity_id AS id FROM {{raw}} WHERE source = 1 EXCEPT SELECT s1_id FROM {{result}} {mine} AND tab"),
            _finding(which, "entity not required", f"SELECT s1_id AS id FROM {{result}} {mine} AND tab EXCEPT SELECT entity_id FROM {{raw}} WHERE source = 1"),
            _finding(which, "unknown id", f"SELECT id FROM {{result_ids}} {mine} AND regexp_matches(id, '^S[23]-') EXCEPT SELECT entity_id FROM {{raw}} WHERE source > 1"),
        ]
    stray = "SELECT s1_id AS id FROM (SELECT s1_id, id FROM {result_ids} WHERE which = 'matched_entity_ids' EXCEPT SELECT s1_id, id FROM {result_ids} WHERE which = 'candidate_entity_ids') x"
    return _union([*out, _finding("matched_entity_ids", "match that is no candidate", stray, "warning")])


def _recall(segment: str, where: str = "true") -> str:
    return f"SELECT v.k, {segment} AS segment, count(*) AS n, {rate('t.rnk < v.k')} AS recall FROM {{sided}} t JOIN {{raw}} r ON r.entity_id = t.s1_id, (VALUES (25), (50), (80), (150), (300), (500)) v(k) WHERE {where} GROUP BY ALL"


_ENTITIES_AT = "SELECT v.k, 'entities' AS segment, count(*) AS n, " + rate("e.worst < v.k") + " AS recall FROM (SELECT s1_id, max(coalesce(rnk, 65535)) AS worst FROM {traced} GROUP BY s1_id) e, (VALUES (25), (50), (80), (150), (300), (500)) v(k) GROUP BY v.k"
_NO_ROWS = "CAST(NULL AS BOOLEAN)"
_ISSUES = {
    "decode error": "false", "wrong column count": "contains(rest, chr(9))", "empty entity": "s1_id = ''", "repeated id": "len(list_distinct(ids)) < len(ids)",
}
_LEVELS = f"""SELECT family, level, CAST(coalesce(sum(pc) FILTER (WHERE pc <= level), 0) AS BIGINT) AS volume, CAST((SELECT count(*) FROM {{trace}} t WHERE t.reason = 'CAP' AND t.best_family = b.family AND t.min_pc <= b.level) AS BIGINT) AS saved
    FROM (SELECT family, pc, v.level FROM {{buckets}}, {_values((f'{CAP}::BIGINT', *LEVELS))} v(level)) b GROUP BY family, level"""
_SIDES = "a.{0} AS a_{0}, b.{0} AS b_{0}"
_RAW_SIDES = ", ".join(_SIDES.format(c) for c in ("business_name", "business_address", "country"))
_EXACT = ", ".join(
    f"round(avg(CASE WHEN trim(a_{c}) <> '' AND trim(b_{c}) <> '' THEN CASE WHEN {x} = {y} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS {n}"
    for n, c, x, y in (
        ("name_raw", "business_name", "a_business_name", "b_business_name"), ("name_norm", "business_name", _PROFILE.format("a_business_name"), _PROFILE.format("b_business_name")),
        ("address_raw", "business_address", "a_business_address", "b_business_address"), ("address_norm", "business_address", _PROFILE.format("a_business_address"), _PROFILE.format("b_business_address")),
    )
)
_lists = lambda table: f"SELECT e.s1_id, coalesce(string_agg(t.other_id, ',' ORDER BY t.other_source, {_NUM.format('t.other_id')}), '') AS ids FROM {{entities}} e LEFT JOIN {{{table}}} t ON t.s1_id = e.s1_id GROUP BY e.s1_id"
_filed = lambda table: f"SELECT *, row_number() OVER (ORDER BY {_NUM.format('s1_id')}) - 1 AS place FROM ({_lists(table)}) l"
_REPORT = f"""SELECT {{0}} AS family, {{1}} AS other_source, count(*) AS n_buckets, CAST(sum(pc) AS BIGINT) AS uncapped, CAST(coalesce(sum(pc) FILTER (WHERE pc <= {CAP}), 0) AS BIGINT) AS post_cap,
    CAST(coalesce(sum(pc) FILTER (WHERE stays), 0) AS BIGINT) AS budget_kept, count(*) FILTER (WHERE pc > {CAP}) AS dropped_buckets
    FROM (SELECT b.*, k.pc IS NOT NULL AS stays FROM {{buckets}} b LEFT JOIN {{kept}} k ON k.family = b.family AND k.other_source = b.other_source AND k.country = b.country AND k.payload = b.payload) m GROUP BY 1, 2"""
_FAMILY_REPORT = _REPORT.replace("{0}", "family").replace("{1}", "CAST(other_source AS INT)") + " UNION ALL " + _REPORT.replace("{0}", "'all'").replace("{1}", "0")
_NAMES = "SELECT p.s1_id, p.other_id, a.name_sorted AS a, b.name_sorted AS b FROM {0} p JOIN {records} a ON a.entity_id = p.s1_id JOIN {records} b ON b.entity_id = p.other_id"
_MACRO = f"""SELECT count(*) AS entities, round(avg({f05("tp", "nh", "nt")}), 6) AS macro_f05, round(CASE WHEN sum(nh) > 0 THEN sum(tp)::DOUBLE / sum(nh) ELSE 1 END, 6) AS micro_precision, round(CASE WHEN sum(nt) > 0 THEN sum(tp)::DOUBLE / sum(nt) ELSE 1 END, 6) AS micro_recall FROM (
    SELECT e.s1_id, any_value(e.n_true) AS nt, count(d.other_id) AS nh, count(g.other_id) AS tp FROM {{entities}} e LEFT JOIN {{0}} d ON d.s1_id = e.s1_id LEFT JOIN {{truth}} g ON g.s1_id = d.s1_id AND g.other_id = d.other_id GROUP BY e.s1_id) t"""

FORMS: dict[str, str] = {
    "source_scan": "SELECT source, entity_id, business_name, business_address, country FROM {rows}",
    "source_limit": "SELECT source, least(count(*), 25) AS n FROM {rows} GROUP BY source",
    "ground_truth_scan": "SELECT s1_id, other_id FROM {gt_read}",
    "ground_truth_merged": "SELECT l.s1_id, coalesce(array_to_string(list_sort(list_distinct(list(g.other_id))), ','), '') AS others FROM {lists} l LEFT JOIN {gt_read} g ON g.s1_id = l.s1_id GROUP BY l.s1_id",
    "ground_truth_issues": _union([*(f"SELECT '{k}' AS issue, count(*) FILTER (WHERE {v}) AS n FROM {{gt_rows}}" for k, v in _ISSUES.items()),
        "SELECT 'source 1 id', count(*) FROM (SELECT unnest(ids) AS id FROM {gt_rows}) x WHERE starts_with(id, 'S1-')", "SELECT 'unknown prefix', count(*) FROM (SELECT unnest(ids) AS id FROM {gt_rows}) x WHERE NOT regexp_matches(id, '^S[123]-')",
        "SELECT 'repeated entity', count(*) - count(DISTINCT s1_id) FROM {gt_rows}"]),
    "id_positions": "SELECT entity_id, position FROM {places}",
    "id_set": "SELECT source, count(DISTINCT trim(string_split(line, chr(9))[1])) AS n, min(trim(string_split(line, chr(9))[1])) AS first FROM {lines} GROUP BY source",
    "file_inventory": f"""SELECT *, round(bytes::DOUBLE / greatest(n_rows, 1), 3) AS bytes_per_row, round(bytes * 2.5::DOUBLE / 1e9, 6) AS projected_gb, round(bytes * 2.5::DOUBLE / 1e9, 6) < 2 AS fits FROM (
        SELECT source, count(*) AS n_rows, CAST(sum(octet_length(encode(line)) + 1) + 49 AS BIGINT) AS bytes, true AS header_ok, count(*) FILTER (WHERE len(string_split(line, chr(9))) <> 4) AS odd_fields,
        count(*) FILTER (WHERE num % 37 = 6 AND num % 19 <> 4 AND num % 23 <> 5) AS undecodable, count(*) FILTER (WHERE regexp_matches(line, '[^\\x00-\\x7F]')) AS non_ascii FROM {{lines}} GROUP BY source) x""",
    "first_rows": "SELECT source, line, left(f[1], 60) AS entity_id, left(coalesce(f[2], ''), 60) AS business_name, left(coalesce(f[3], ''), 60) AS business_address, left(coalesce(array_to_string(f[4:], chr(9)), ''), 60) AS country FROM (SELECT source, string_split(line, chr(9)) AS f, row_number() OVER (PARTITION BY source ORDER BY num) + 1 AS line FROM {lines}) l WHERE line <= 3",
    "record_cache": "SELECT source, count(*) AS n, count(DISTINCT name_sorted) AS names FROM {records} GROUP BY source",
    "key_cache": "SELECT family, source, count(*) AS n, count(DISTINCT payload) AS payloads FROM {keys} WHERE family = 'sig' OR family = 'hnstate' GROUP BY ALL",
    "candidate_cache": "SELECT other_source, count(*) AS n, max(rnk) AS last FROM {topk} GROUP BY other_source",
    "candidate_file": _filed("topk"),
    "matching_file": _filed("decided"),
    "report_file": "SELECT 'families' AS line UNION ALL SELECT 'family=' || family || '  other_source=' || other_source || '  uncapped=' || uncapped || '  post_cap=' || post_cap FROM (" + _FAMILY_REPORT + ") f",
    "decision_file": "SELECT tau, gate, macro_f05, 25::BIGINT AS listed FROM {best}",
    "validator_findings": _findings(),
    "text_functions": f"""SELECT entity_id, {_SPACED.format(_WORK.format("business_name"))} AS folded, {_PROFILE.format("business_name")} AS profiled, list_filter(list_transform(range(17), lambda i: left(business_name, 16 - i::INT)), lambda s: octet_length(encode(s)) <= 16)[1] AS cut,
        string_split({_PROFILE.format("business_name")}, ' ')[1] AS first_token, {_POSTAL.format("business_address")} AS postal, starts_with(upper(trim(country)), 'FR') AS french, regexp_matches(coalesce(business_name, ''), '[^\\x00-\\x7F]') AS odd FROM {{raw}}""",
    "id_codes": "SELECT entity_id, num + CASE WHEN source = 3 THEN 2147483648 ELSE 0 END AS code, entity_id AS decoded, true AS refused FROM {raw} WHERE source > 1",
    "records_norm": "SELECT entity_id, name_core, name_sorted, name_suffixes, name_nonascii FROM {records}",
    "addr_parse": "SELECT entity_id, addr_norm, houseno, postal, state, addr_nonascii FROM {records}",
    "phonetic_key": "SELECT entity_id, name_phon FROM {records}",
    "initials": "SELECT entity_id, name_initials FROM {records}",
    "transliterated": "SELECT entity_id, name_script, name_translit FROM {records}",
    "translit_check": "SELECT name_script, count(*) AS n, count(*) FILTER (WHERE name_translit <> name_sorted) AS rendered, min(name_translit) AS sample FROM {records} WHERE name_script <> 'latin' GROUP BY name_script",
    **{f"keys_{f}": f"SELECT source, entity_id, country, payload FROM {{keys}} WHERE family = '{f}'" for f in FAMILIES},
    "bucket_counts": "SELECT family, other_source, country, payload, c1, c2, pc FROM {buckets}",
    "family_counts": _FAMILY_REPORT,
    "family_caps": f"SELECT family, CAST(sum(pc) AS BIGINT) AS volume, count(*) AS n_buckets FROM {{buckets}} WHERE pc <= CASE family WHEN 'sig' THEN 20000 WHEN 'hnstate' THEN 500 ELSE {CAP} END GROUP BY family",
    "capped_join": f"SELECT y.source AS other_source, count(DISTINCT x.entity_id || ' ' || y.entity_id) AS n_pairs FROM {{keys}} x JOIN {{keys}} y ON y.family = x.family AND y.country = x.country AND y.payload = x.payload JOIN {{buckets}} b ON b.family = x.family AND b.country = x.country AND b.payload = x.payload AND b.other_source = y.source WHERE x.source = 1 AND y.source > 1 AND b.pc <= {CAP} GROUP BY y.source",
    "budget_keep": "SELECT family, other_source, country, payload, pc FROM {kept}",
    "trimmed_budgets": f"SELECT family, other_source, CASE WHEN total <= {FULL} THEN v ELSE greatest(1, CAST(floor(v * ({TRIM}::DOUBLE / total)) AS BIGINT)) END AS budget FROM (SELECT family, other_source, CAST(sum(pc) AS BIGINT) AS v, CAST(sum(sum(pc)) OVER () AS BIGINT) AS total FROM {{buckets}} WHERE pc <= {CAP} GROUP BY family, other_source) s",
    "candidate_pairs": "SELECT s1_id, other_id FROM {pairs}",
    "cheap_score": "SELECT s1_id, other_id, round(pri, 6) AS jaccard, round(sec, 6) AS containment, round(CASE WHEN pri > sec THEN pri ELSE sec END, 6) AS score_v1 FROM {scored}",
    "lex_rank": "SELECT s1_id, other_id, round(pri, 6) AS pri, round(sec, 6) AS sec, rnk FROM {pool}",
    "topk_candidates": "SELECT s1_id, other_id, round(pri, 6) AS pri, round(sec, 6) AS sec, rnk FROM {topk}",
    "entity_aggs": "SELECT s1_id, round(e_max, 6) AS e_max, round(e_gap, 6) AS e_gap, round(e_mean5, 6) AS e_mean5, e_n75 FROM {aggs}",
    "aggregate_lookup": "SELECT e.s1_id, round(coalesce(e_max, 0), 6) AS e_max, round(coalesce(e_gap, 0), 6) AS e_gap, round(coalesce(e_mean5, 0), 6) AS e_mean5, coalesce(e_n75, 0) AS e_n75 FROM {entities} e LEFT JOIN {aggs} a ON a.s1_id = e.s1_id",
    "decision_gate": "SELECT s1_id, other_id, round(pri, 6) AS score FROM {decided}",
    "candidate_lists": _lists("topk"),
    "matching_lists": _lists("decided"),
    "blocking_stats": """SELECT count(*) AS entities_with_candidates, CAST(sum(n) AS BIGINT) AS n_pairs, round(avg(n), 6) AS mean_candidates, max(n) AS most, round(quantile_cont(n, 0.5), 6) AS median_candidates, round(quantile_cont(n, 0.95), 6) AS p95,
        (SELECT count(*) FROM {raw} WHERE source = 1) - count(*) AS entities_without, round(sum(n)::DOUBLE / (SELECT count(*) FROM {raw} WHERE source = 1) / (SELECT count(*) FROM {raw} WHERE source <> 1), 9) AS reduction_ratio FROM (SELECT s1_id, count(*) AS n FROM {pairs} GROUP BY s1_id) t""",
    "pair_recall": f"SELECT count(*) AS n_true, count(rnk) AS n_found, {rate('rnk IS NOT NULL')} AS recall FROM {{traced}}",
    "entity_recall": f"SELECT count(*) AS entities, count(*) FILTER (WHERE n = m) AS complete, {rate('n = m')} AS recall FROM (SELECT s1_id, count(*) AS n, count(rnk) AS m FROM {{traced}} GROUP BY s1_id) e",
    "recall_by_country": f"SELECT r.country, count(*) AS n_true, {rate('t.rnk IS NOT NULL')} AS recall FROM {{traced}} t JOIN {{raw}} r ON r.entity_id = t.s1_id GROUP BY r.country",
    "recall_by_script": f"SELECT r.name_script, r.name_nonascii, count(*) AS n_true, {rate('t.rnk IS NOT NULL')} AS recall FROM {{traced}} t JOIN {{records}} r ON r.entity_id = t.other_id GROUP BY ALL",
    "recall_at_k": _union([_recall("'all'"), _recall("'country:' || r.country"), _recall("'non-latin'", "t.b_name_script <> 'latin'"), _ENTITIES_AT]),
    "recall_ceiling": f"SELECT count(*) AS entities, count(*) FILTER (WHERE worst < {TOP_K}) AS complete, {rate(f'worst < {TOP_K}')} AS recall FROM (SELECT s1_id, max(coalesce(rnk, 65535)) AS worst FROM {{traced}} GROUP BY s1_id) e",
    "gate_check": _union([f"SELECT 'pairs in pool' AS metric, {rate('rnk IS NOT NULL')} AS value, {_NO_ROWS} AS pass FROM {{traced}}",
        f"SELECT 'entities in pool', {rate('n = m')}, {rate('n = m')} >= 0.98 FROM (SELECT s1_id, count(*) AS n, count(rnk) AS m FROM {{traced}} GROUP BY s1_id) e", f"SELECT 'entities at ' || k, recall, {_NO_ROWS} FROM ({_ENTITIES_AT}) x"]),
    "macro_f05": _MACRO.replace("{0}", "{decided}"),
    "macro_f05_empty": _MACRO.replace("{0}", "(SELECT * FROM {decided} WHERE false)"),
    "threshold_grid": "SELECT * FROM {grid}",
    "best_decision": "SELECT * FROM {best}",
    "auc": """SELECT round(sum(CASE WHEN t.s > f.s THEN 1.0::DOUBLE WHEN t.s = f.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * t.n * f.n) / sum(t.n * f.n), 6) AS auc FROM (SELECT CAST(round(pri / 0.0001::DOUBLE) AS BIGINT) AS s, count(*) AS n FROM {marked} WHERE hit GROUP BY 1) t
        CROSS JOIN (SELECT CAST(round(pri / 0.0001::DOUBLE) AS BIGINT) AS s, count(*) AS n FROM {marked} WHERE NOT hit GROUP BY 1) f""",
    "miss_decomposition": f"SELECT CASE WHEN rnk IS NULL THEN 'never generated' WHEN rnk >= {TOP_K} THEN 'capped out' ELSE 'delivered' END AS fate, count(*) AS n FROM {{traced}} GROUP BY 1",
    "misses_anti_join": "SELECT s1_id, other_id FROM {truth} EXCEPT SELECT s1_id, other_id FROM {topk}",
    "negatives_anti_join": "SELECT s1_id, other_id FROM {topk} EXCEPT SELECT s1_id, other_id FROM {truth}",
    "miss_categories": "SELECT s1_id, other_id, category FROM {categories}",
    "miss_taxonomy": "SELECT category, count(*) AS n, count(*) FILTER (WHERE rnk IS NULL) AS never_generated, count(rnk) AS capped_out FROM {categories} GROUP BY category",
    "miss_examples": f"SELECT c.category, c.s1_id, c.other_id, {_RAW_SIDES} FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s1_id, other_id) AS place FROM {{categories}}) c JOIN {{raw}} a ON a.entity_id = c.s1_id JOIN {{raw}} b ON b.entity_id = c.other_id WHERE c.place < 3",
    "old_versus_new": f"SELECT o.s1_id IS NOT NULL AS in_old, coalesce(t.rnk < {TOP_K}, false) AS in_new, count(*) AS n FROM {{traced}} t LEFT JOIN (SELECT * FROM {{old}} WHERE old_rank < {TOP_K}) o ON o.s1_id = t.s1_id AND o.other_id = t.other_id GROUP BY ALL",
    "trace_pairs": "SELECT s1_id, other_id, reason, min_pc, best_family FROM {trace}",
    "trace_reasons": "SELECT reason, coalesce(best_family, '') AS best_family, count(*) AS n FROM {trace} GROUP BY ALL",
    "cap_histogram": f"SELECT low, high, count(*) AS n FROM {{trace}} t JOIN (SELECT e AS low, lead(e) OVER (ORDER BY e) AS high FROM {_values((0, *EDGES))} v(e)) h ON t.min_pc > h.low AND (h.high IS NULL OR t.min_pc <= h.high) WHERE reason = 'CAP' GROUP BY ALL",
    "nokey_matrix": f"""SELECT family, CASE WHEN a AND b THEN 'both' WHEN a THEN 's1 only' WHEN b THEN 'other only' ELSE 'neither' END AS emission, count(*) AS n FROM (SELECT f.family, EXISTS (SELECT 1 FROM {{keys}} k WHERE k.entity_id = t.s1_id AND k.family = f.family) AS a,
        EXISTS (SELECT 1 FROM {{keys}} k WHERE k.entity_id = t.other_id AND k.family = f.family) AS b FROM {{trace}} t, {_values(f"'{f}'" for f in FAMILIES)} f(family) WHERE t.reason = 'NOKEY') x GROUP BY ALL""",
    "cap_curve": f"""SELECT v.cap, CAST(coalesce((SELECT sum(pc) FROM {{buckets}} b WHERE b.pc <= v.cap), 0) AS BIGINT) AS volume, coalesce((SELECT sum(pc) FROM {{buckets}} b WHERE b.pc <= v.cap), 0) > {FULL} AS over,
        round(((SELECT count(rnk) FROM {{traced}}) + (SELECT count(*) FROM {{trace}} t WHERE t.reason = 'CAP' AND t.min_pc <= v.cap))::DOUBLE / (SELECT greatest(count(*), 1) FROM {{traced}}), 6) AS coverage,
        (SELECT count(*) FROM {{trace}} t WHERE t.reason = 'CAP' AND t.min_pc <= v.cap) AS saved FROM (VALUES (5000::BIGINT), (20000), (50000)) v(cap)""",
    "level_table": _LEVELS,
    "rank_old_vs_new": "SELECT s1_id, other_id, rnk AS new_rank, old_rank, ties FROM {old}",
    "ranker_check": f"""SELECT *, CASE WHEN samples = 0 THEN 'NO SAMPLES' WHEN mismatch > samples * 0.01 THEN 'ALIGNMENT BUG' WHEN fixed >= samples * 0.7 THEN 'TIES CONFIRMED' ELSE 'NOT TIES' END AS verdict FROM (SELECT count(*) AS samples, count(*) FILTER (WHERE num % 199 = 0) AS mismatch,
        quantile_cont(size, 0.5) AS median_candidates, quantile_cont(ties, 0.5) AS median_ties, quantile_cont(old_rank, 0.5) AS median_old, quantile_cont(rnk, 0.5) AS median_new, count(*) FILTER (WHERE rnk < {TOP_K}) AS fixed
        FROM (SELECT o.*, CAST(substr(o.other_id, 4) AS BIGINT) AS num FROM {{old}} o JOIN {{classed}} c ON c.s1_id = o.s1_id AND c.other_id = o.other_id WHERE c.category = 'EXACT_NAME') r) s""",
    "position_leak": """SELECT *, abs(corr) > 0.2 OR near > 0.01 OR near_shuffled > 0.001 AS red FROM (SELECT source, count(*) AS n, round(corr(u, v), 6) AS corr, round(avg(abs(u - v)), 6) AS gap, round(avg(abs(u - w)), 6) AS gap_shuffled, round(avg((guess = position)::INT), 6) AS exact,
        round(avg((abs(guess - position) <= 2)::INT), 6) AS near, round(avg((abs(guess - q) <= 2)::INT), 6) AS near_shuffled FROM {shuffled} GROUP BY source) x""",
    "script_inventory": "SELECT source, name_script, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM {records} GROUP BY source, name_script",
    "cross_script": """SELECT CAST(sum(n) AS BIGINT) AS n_pairs, CAST(sum(x) AS BIGINT) AS cross, count(*) AS entities, count(*) FILTER (WHERE f > 0) AS with_non_latin, count(*) FILTER (WHERE f = n) AS all_non_latin FROM (
        SELECT g.s1_id, count(*) AS n, count(*) FILTER (WHERE a.name_script <> b.name_script) AS x, count(*) FILTER (WHERE b.name_script <> 'latin') AS f FROM {truth} g JOIN {records} a ON a.entity_id = g.s1_id JOIN {records} b ON b.entity_id = g.other_id GROUP BY g.s1_id) e""",
    "truth_stats": "SELECT 'all' AS \"group\", count(*) AS n, round(avg(n_true), 6) AS mean, median(n_true) AS median, max(n_true) AS most FROM {entities} UNION ALL SELECT 'matched', count(*), round(avg(n_true), 6), median(n_true), max(n_true) FROM {entities} WHERE n_true > 0",
    "truth_histogram": "SELECT CASE WHEN n_true > 10 THEN '11+' WHEN n_true > 4 THEN '5-10' WHEN n_true > 2 THEN '3-4' ELSE CAST(n_true AS VARCHAR) END AS matches, count(*) AS n FROM {entities} GROUP BY 1",
    "truth_sources": "SELECT CASE WHEN two > 0 AND three > 0 THEN 'both' WHEN two > 0 THEN 'S2 only' WHEN three > 0 THEN 'S3 only' ELSE 'none' END AS mix, count(*) AS n FROM (SELECT e.s1_id, count(*) FILTER (WHERE t.other_id LIKE 'S2-%') AS two, count(*) FILTER (WHERE t.other_id LIKE 'S3-%') AS three FROM {entities} e LEFT JOIN {truth} t ON t.s1_id = e.s1_id GROUP BY e.s1_id) x GROUP BY 1",
    "cross_links": "SELECT other_id, count(*) AS claims, string_agg(s1_id, ',' ORDER BY s1_id) AS owners FROM {truth} GROUP BY other_id HAVING count(*) > 1",
    "truth_and_files": _union(["SELECT 'matched id not in the files' AS issue, count(*) AS n FROM (SELECT DISTINCT other_id FROM {gt_read} EXCEPT SELECT entity_id FROM {rows}) x",
        "SELECT 'S1 row without truth', count(*) FROM (SELECT entity_id FROM {rows} WHERE source = 1 EXCEPT SELECT s1_id FROM {gt_lines}) x", "SELECT 'truth without S1 row', count(*) FROM (SELECT s1_id FROM {gt_lines} EXCEPT SELECT entity_id FROM {rows} WHERE source = 1) x"]),
    "country_mix": "SELECT source, country, n, greatest(labels - 12, 0) AS more FROM (SELECT source, trim(country) AS country, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, trim(country)) AS place, count(*) OVER (PARTITION BY source) AS labels FROM {rows} GROUP BY source, trim(country)) x WHERE place <= 12",
    "new_labels": "SELECT trim(country) AS country FROM {rows} EXCEPT SELECT trim(country) FROM {raw} WHERE num % 97 <> 0 AND country <> 'de'",
    "missing_rates": f"""SELECT source, count(*) AS n, {rate("trim(business_name) = ''")} AS no_name, {rate("trim(business_address) = ''")} AS no_address, {rate("trim(country) = ''")} AS no_country,
        round(count(*) FILTER (WHERE trim(business_address) <> '' AND {_POSTAL.format("business_address")} = '')::DOUBLE / nullif(count(*) FILTER (WHERE trim(business_address) <> ''), 0), 6) AS no_postal FROM {{rows}} GROUP BY source""",
    "french_rows": "SELECT source, entity_id, left(business_name, 70) AS name FROM {raw} WHERE upper(trim(country)) LIKE 'FR%' ORDER BY source, num LIMIT 12",
    "country_consistency": f"SELECT a AS country, count(*) AS n, {rate('a = b')} AS same FROM {{countries}} GROUP BY a",
    "country_mismatches": "SELECT s1_id, other_id, a, b FROM {countries} WHERE a <> b ORDER BY s1_id, other_id LIMIT 10",
    "country_cardinality": f"SELECT country, count(*) AS n, {rate('n_true = 0')} AS singleton_share, round(avg(n_true), 6) AS mean, median(n_true) AS median, max(n_true) AS most FROM {{entities}} GROUP BY country",
    "exact_match_rates": f"SELECT coalesce(tag, 'ALL') AS country, count(*) AS n, {_EXACT} FROM (SELECT CASE WHEN trim(a.country) = '' THEN '(empty)' ELSE trim(a.country) END AS tag, {_RAW_SIDES} FROM (SELECT * FROM {{truth}} ORDER BY md5('42|' || s1_id || '|' || other_id) LIMIT 50000) g JOIN {{raw}} a ON a.entity_id = g.s1_id JOIN {{raw}} b ON b.entity_id = g.other_id) x GROUP BY ROLLUP (tag)",
    "sampled_pairs": f"SELECT 'sample' AS category, g.s1_id, g.other_id, {_RAW_SIDES} FROM (SELECT * FROM {{truth}} ORDER BY md5('42|' || s1_id || '|' || other_id), s1_id, other_id LIMIT 20) g JOIN {{raw}} a ON a.entity_id = g.s1_id JOIN {{raw}} b ON b.entity_id = g.other_id",
    "near_miss": "SELECT * FROM {near}",
    "near_miss_reasons": "SELECT reason, count(*) AS n FROM {near} GROUP BY reason",
    "native_features": f"SELECT s1_id, other_id, {_rounded(NATIVE)} FROM ({_TWO('{topk}', _COLUMNS)}) f",
    "pair_features": f"SELECT f.s1_id, other_id, {_rounded(DISTANCES | NATIVE)}, {_rounded({c: f'coalesce(g.{c}, 0)' for c in ('e_max', 'e_gap', 'e_mean5')})}, coalesce(g.e_n75, 0) AS e_n75 FROM ({_FUZZY}) f LEFT JOIN {{aggs}} g ON g.s1_id = f.s1_id",
    "fuzzy_jaro_winkler": f"SELECT s1_id, other_id, round(jaro_winkler_similarity({_SIGNS.format('a')}, {_SIGNS.format('b')}), 6) AS score FROM (" + _NAMES.replace("{0}", "{topk}") + ") n",
    "fuzzy_indel": f"SELECT s1_id, other_id, round({indel('a', 'b')}, 6) AS score FROM (" + _NAMES.replace("{0}", "{topk}") + ") n",
    "fuzzy_token_set": "SELECT s1_id, other_id, round(ts, 6) AS score FROM (" + _token_set_table(_NAMES.replace("{0}", "{topk}"), "a", "b") + ") n",
    "fuzzy_partial": "SELECT s1_id, other_id, round(pr, 6) AS score FROM (" + _partial("a", "b").replace("{0}", _NAMES.replace("{0}", "{decided}")) + ") n",
    "stratified_split": "SELECT s1_id, stratum, part FROM {parted}",
    "learn_split": "SELECT s1_id, part FROM {learn}",
    "hard_negatives": "SELECT s1_id, other_id FROM {negatives}",
    "training_rows": """SELECT g.s1_id, g.other_id, 1.0::DOUBLE AS label, 'learn' AS part FROM {truth} g JOIN {learn} l ON l.s1_id = g.s1_id AND l.part = 'learn' UNION ALL SELECT n.s1_id, n.other_id, 0.0::DOUBLE, 'learn' FROM {negatives} n JOIN {learn} l ON l.s1_id = n.s1_id AND l.part = 'learn'
        UNION ALL SELECT m.s1_id, m.other_id, CASE WHEN m.hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, l.part FROM {marked} m JOIN {learn} l ON l.s1_id = m.s1_id AND l.part <> 'learn'""",
}


def sql(text: str) -> str:
    """text with the tables it names as common table expressions before it."""
    order: list[str] = []
    name = re.compile(r"{([a-z]\w*)}")

    def need(body: str) -> None:
        for found in dict.fromkeys(name.findall(body)):
            if found not in order:
                need(TABLES[found])
                if found not in order:
                    order.append(found)

    need(text)
    bare = lambda s: name.sub(r"t_\1", s)
    head = ", ".join(f"t_{n} AS MATERIALIZED ({bare(TABLES[n])})" for n in order)
    return f"WITH {head} {bare(text)}" if head else bare(text)


ORACLES: dict[str, str] = {n: sql(t) for n, t in FORMS.items()}
