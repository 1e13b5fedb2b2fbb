"""The same queries in DuckDB SQL over the same tables."""

from __future__ import annotations

from tarn.config import DEFAULT
from tarn.functions.lang import FUNCTION_WORDS
from tarn.functions.language import BUCKETS, SIZES, STEP
from tarn.functions.text import STOP_WORDS
from tarn.plans.queries import CRAWL, QUERY, WEB

NETLOC = "regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PIECES = f"list_filter(string_split_regex(substr(text, 1, {DEFAULT.text_limit}), '{SPACE}'), lambda x: x <> '')"
PLAIN = f"list_filter({PIECES}, lambda x: regexp_full_match(x, '[A-Za-z0-9]+'))"
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
KEPT = f"term <> '' AND term NOT IN ({STOP}) AND length(term) <= {DEFAULT.term_limit}"
HAN = r"\p{Han}"


def _netloc(x: str) -> str:
    return NETLOC.format(x)


def _home(x: str) -> str:
    return f"(strpos(rtrim(CASE WHEN starts_with({x}, 'https://') THEN substr({x}, 9) ELSE {x} END, '/'), '/') = 0)"


def _penalty(x: str) -> str:
    s = f"greatest(0.0::DOUBLE, (length({x}) - 30) / 200.0::DOUBLE)"
    steps = (
        (f"contains({x}, '.htm') OR contains({x}, '.php')", "0.3"),
        (f"length(rtrim({x}, '/')) - length(replace(rtrim({x}, '/'), '/', '')) > 2", "0.1"),
        (f"length({x}) < 5 OR substr({x}, 5, 1) = ':'", "0.3"),
    )
    for when, k in steps:
        s = f"(CASE WHEN {when} THEN {s} + (1 - {s}) * {k}::DOUBLE ELSE {s} END)"
    return f"least({s}, 0.9::DOUBLE)"


def _prefixes(x: str) -> str:
    rest = f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '^https?://', ''), '[?#]', '/', 'g'), '/$', '')"
    return f"""(CASE WHEN regexp_matches(lower({x}), '^https?://') AND regexp_matches({rest}, '(?s)^[^ /%]')
      THEN list_transform(range(1, len(string_split({rest}, '/')) + 1), lambda i: array_to_string(string_split({rest}, '/')[1:i], '/')) ELSE [] END)"""


def _uniform(key: str, seed: str = "") -> str:
    return f"((('0x' || substr(md5('{seed}' || CAST({key} AS VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"


TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, lower(unnest({PLAIN})) AS term FROM documents) WHERE {KEPT} GROUP BY ALL)"
EDGES = """edges AS (SELECT p.page_id AS pos, p.url AS src, t.url AS dst, t.page_id AS "to" FROM pages p JOIN pages t
  ON t.page_id = (p.page_id * 7 + 3) % (SELECT count(*) FROM pages))"""
CROSS = f"{EDGES}, crossing AS (SELECT DISTINCT lower({_netloc('src')}) AS src_domain, dst FROM edges WHERE lower({_netloc('src')}) <> lower({_netloc('dst')}))"
BACK = f"{CROSS}, back AS (SELECT dst AS url, count(*) AS n FROM crossing GROUP BY dst)"
FRONT = f"{BACK}, front AS (SELECT p.page_id, p.url, coalesce(b.n, 0) AS backlinks FROM pages p LEFT JOIN back b USING (url))"
PROSPERITY = f"{CROSS}, counts AS (SELECT unnest({_prefixes('dst')}) AS prefix FROM crossing), prosperity AS (SELECT prefix, count(*) AS n FROM counts GROUP BY prefix)"


def _unescaped(x: str) -> str:
    """The character references that the pages have, the ampersand's last."""
    for name, character in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", "\xa0"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{character}')"
    return x


_BARE = r"""regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"""
VISIBLE = rf"""trim(regexp_replace({_unescaped(_BARE)}, '\s+', ' ', 'g'))"""
TITLE = _unescaped("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")
PAGE_TF = f"""page_text AS (SELECT page_id, {VISIBLE} AS text FROM pages),
ptf AS (SELECT page_id, term, count(*) AS tf FROM (SELECT page_id, lower(unnest({PLAIN})) AS term FROM page_text) WHERE {KEPT} GROUP BY ALL),
weighted AS (SELECT term, url, round(tf * (1 + ln(1 + backlinks)) * (1 - {_penalty('url')}), 6) AS weight, lower({_netloc('url')}) AS domain FROM ptf JOIN front USING (page_id)),
of_domain AS (SELECT *, row_number() OVER (PARTITION BY term, domain ORDER BY weight DESC, url) AS r FROM weighted),
trimmed AS (SELECT term, CAST(rank AS INT) AS rank, url, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, url) AS rank FROM of_domain WHERE r <= {DEFAULT.postings_per_domain}) WHERE rank <= {DEFAULT.postings_limit})"""
TERMS = ", ".join(f"'{t}'" for t in QUERY.split())
BEST = f"best AS (SELECT doc_id, round(sum(tf)::DOUBLE, 6) AS score FROM tf WHERE term IN ({TERMS}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {DEFAULT.results})"
TOPK = f"SELECT term, CAST(rank AS INT) AS rank, doc_id, tf FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) AS rank FROM tf) WHERE rank <= {DEFAULT.postings_limit}"
CAP = f"""SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY lower({_netloc('url')}) ORDER BY page_id) AS rn FROM pages)
  WHERE rn <= {DEFAULT.domain_cap} OR {_home('url')}"""
SEGMENT = f"list_filter(regexp_extract_all(x, '{HAN}|[\\p{{L}}\\p{{N}}]+'), lambda y: y <> '')"
ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_HREF = r"""<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
_TRIMMED = """trim(regexp_replace(y, '^["'']|["'']$', '', 'g'))"""
HREFS = f"list_transform(regexp_extract_all(html, '{_HREF}', 1, 'i'), lambda y: {_unescaped(_TRIMMED)})"
SEARCH_TERMS = f"""list_filter(list_transform(flatten(list_transform({PIECES}, lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9]+') THEN [x] ELSE {SEGMENT} END)), lambda t: lower(t)), lambda t: t <> '' AND t NOT IN ({STOP}) AND length(t) <= {DEFAULT.term_limit})"""

LANG_WORDS = f"list_transform(list_filter(string_split_regex(replace(text, chr(10), ''), '{SPACE}'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[^\\p{{L}}]+$', ''))"
LANG_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in known)}))) AS {lang}" for lang, known in FUNCTION_WORDS.items())
LANG_BEST = " ".join(f"WHEN {lang} = greatest({', '.join(FUNCTION_WORDS)}) THEN '{lang}'" for lang in sorted(FUNCTION_WORDS, reverse=True))


HELD_LANG = f"(CAST(floor({_uniform('doc_id', 'lang')} * 1000000) AS BIGINT) % 100 < 20)"
BYTES = "list_transform(range(1, length(x) // 2 + 1), lambda i: CAST(('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))"
_CODES = " UNION ALL ".join(
    f"SELECT doc_id, ({' + '.join(f'b[i + {k}] * {256 ** (n - 1 - k)}' for k in range(n))} + {n * STEP}) % {BUCKETS} AS bucket FROM (SELECT doc_id, b, unnest(range(1, len(b) - {n} + 2)) AS i FROM bytes)" for n in SIZES
)
LANGUAGE = f"""letters AS (SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(replace(text, chr(10), '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
bytes AS (SELECT doc_id, {BYTES} AS b FROM (SELECT doc_id, hex(encode(t)) AS x FROM letters)),
coded AS MATERIALIZED (SELECT doc_id, bucket, count(*) AS n FROM ({_CODES}) GROUP BY ALL),
taught AS (SELECT l.lang, c.bucket, CAST(sum(c.n) AS BIGINT) AS n FROM coded c JOIN letters l USING (doc_id) WHERE NOT {HELD_LANG} AND l.lang IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM taught GROUP BY lang),
every AS (SELECT lang, doc_id, bucket, c.n AS times, total FROM coded c CROSS JOIN total),
scores AS (SELECT e.doc_id, e.lang, sum(e.times * CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE / (e.total + {BUCKETS})::DOUBLE)) AS BIGINT)) AS score FROM every e LEFT JOIN taught t USING (lang, bucket) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM scores)"""
_L = DEFAULT.word_longest
CANDIDATES = f"""runs AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '{SPACE}', '', 'g'), '\\p{{L}}+')) AS run FROM documents),
places AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs),
g AS MATERIALIZED (SELECT gram, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT substr(run, i, {k}) AS gram FROM places WHERE i + {k} <= length(run) + 1" for k in range(1, _L + 2))}) GROUP BY gram),
w AS MATERIALIZED (SELECT gram AS word, n FROM g WHERE length(gram) <= {_L} AND n >= {DEFAULT.word_least}),
parts AS (SELECT c.word, max(a.n::DOUBLE * b.n) AS parts FROM (SELECT word, unnest(range(1, length(word))) AS k FROM w WHERE length(word) > 1) c
  JOIN w a ON a.word = substr(c.word, 1, k) JOIN w b ON b.word = substr(c.word, k + 1) GROUP BY c.word),
r AS (SELECT substr(gram, 1, length(gram) - 1) AS word, sum(n)::DOUBLE AS rn, sum(n * ln(n)) AS rs FROM g WHERE length(gram) > 1 GROUP BY 1),
l AS (SELECT substr(gram, 2) AS word, sum(n)::DOUBLE AS ln_, sum(n * ln(n)) AS ls FROM g WHERE length(gram) > 1 GROUP BY 1),
total AS (SELECT sum(n)::DOUBLE AS total FROM g WHERE length(gram) = 1)"""


def _entropy(n: str, s: str) -> str:
    end = f"(n - coalesce({n}, 0))"
    return f"(ln(n) - (coalesce({s}, 0) + CASE WHEN {end} > 0 THEN {end} * ln({end}) ELSE 0 END) / n)"


def _small(limits: str) -> str:
    """``PAGE_TF`` under other limits."""
    per_domain, of_term = limits.split()
    return PAGE_TF.replace(f"r <= {DEFAULT.postings_per_domain})", f"r <= {per_domain})").replace(f"rank <= {DEFAULT.postings_limit})", f"rank <= {of_term})")


def _crawl() -> str:
    """Every level of the crawl written out."""
    links = " UNION ALL ".join(f"SELECT page_id, url, (page_id * {k} + {c}) % (SELECT count(*) FROM pages) AS goes FROM pages" for k, c in WEB)
    parts = [
        f"""web AS MATERIALIZED (SELECT l.url AS src, t.url AS dst FROM ({links}) l JOIN pages t ON t.page_id = l.goes),
      back AS (SELECT dst AS url, count(DISTINCT lower({_netloc('src')})) AS n FROM web WHERE lower({_netloc('src')}) <> lower({_netloc('dst')}) GROUP BY dst),
      known AS MATERIALIZED (SELECT p.url, lower({_netloc('p.url')}) AS domain, coalesce(n, 0) AS backlinks, page_id % 3 = 0 AS orphan FROM pages p LEFT JOIN back USING (url)),
      v0 AS MATERIALIZED (SELECT url, 0 AS level FROM pages WHERE page_id < 3)"""
    ]
    for level in range(1, CRAWL.crawl_depth + 1):
        b = f"v{level - 1}"
        parts.append(
            f"""n{level} AS MATERIALIZED (SELECT DISTINCT k.* FROM {b} JOIN web ON web.src = {b}.url AND {b}.level = {level - 1} JOIN known k ON k.url = web.dst WHERE web.dst NOT IN (SELECT url FROM {b})),
      s{level} AS (SELECT lower({_netloc('url')}) AS domain, count(*) AS visits FROM {b} GROUP BY 1),
      a{level} AS (SELECT * EXCLUDE (visits), round(-ln({_uniform('url')}) / ((1 + ln(1 + backlinks)) / (1 + coalesce(visits, 0))), 9) AS draw FROM n{level} LEFT JOIN s{level} USING (domain) ORDER BY draw, url LIMIT {CRAWL.frontier_size}),
      d{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_uniform('url', 'domain')}, url) AS r FROM a{level}) WHERE r <= {CRAWL.frontier_per_domain}),
      h{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY starts_with(url, 'http://') ORDER BY {_uniform('url', 'http')}, url) AS q FROM d{level}) WHERE q <= {CRAWL.frontier_http} OR NOT starts_with(url, 'http://')),
      o{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY {_uniform('url', 'orphan')}, url) AS p FROM h{level}) WHERE p <= {CRAWL.frontier_orphans} OR NOT orphan),
      v{level} AS MATERIALIZED (SELECT url, level FROM {b} UNION ALL SELECT url, {level} AS level FROM o{level})"""
        )
    return f"WITH {', '.join(parts)} SELECT url, CAST(level AS INT) AS level FROM v{CRAWL.crawl_depth}"


MANY = f"""WITH {TF}, asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, lower(unnest({PLAIN})) AS term FROM benchmark) WHERE {KEPT}),
      scored AS (SELECT item_id, doc_id, round(sum(tf)::DOUBLE, 6) AS score FROM asked JOIN tf USING (term) GROUP BY ALL)
      SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {DEFAULT.results}"""

ORACLES = {
    "url_netloc": f"SELECT page_id, {_netloc('url')} AS netloc FROM pages",
    "url_home": f"SELECT page_id, {_home('url')} AS page_home, {_home(f"('https://' || {_netloc('url')})")} AS host_home FROM pages",
    "url_penalty": f"SELECT page_id, {_penalty('url')} AS penalty FROM pages",
    "url_prefixes": f"SELECT page_id, CAST(i - 1 AS INT) AS depth, p[i] AS prefix FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, {_prefixes('url')} AS p FROM pages))",
    "prefix_count": f"SELECT prefix, count(*) AS n FROM (SELECT unnest({_prefixes('url')}) AS prefix FROM pages) GROUP BY prefix",
    "domain_cap": CAP,
    "domain_cap_sorted": f"{CAP} ORDER BY page_id",
    "ordered_map": "SELECT page_id, CAST(length(url) AS INT) AS n FROM pages ORDER BY page_id",
    "tokens": f"""SELECT doc_id, CAST(i - 1 AS INT) AS pos, t[i] AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (
      SELECT doc_id, flatten(list_transform({PIECES}, lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9]+') THEN [x] ELSE {SEGMENT} END)) AS t FROM documents))""",
    "tokens_ascii": f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, t[i] AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {PLAIN} AS t FROM documents))",
    "doc_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({SEARCH_TERMS}) AS term FROM documents) GROUP BY ALL",
    "term_freq": f"WITH {TF} SELECT doc_id, term, tf FROM tf",
    "doc_freq": f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "term_filter": f"SELECT term, count(*) AS n FROM (SELECT lower(unnest({PLAIN})) AS term FROM documents) WHERE {KEPT} GROUP BY term",
    "stop_words": f"SELECT term, count(*) AS n FROM (SELECT lower(unnest({PLAIN})) AS term FROM documents) WHERE term IN ({STOP}) GROUP BY term",
    "postings_topk": f"WITH {TF} {TOPK}",
    "stream_postings": f"WITH {TF} {TOPK}",
    "postings_domain_trim": f"WITH {FRONT}, {PAGE_TF} SELECT term, rank, url, weight FROM trimmed",
    "postings_lists": f"WITH {FRONT}, {PAGE_TF} SELECT term, CAST(count(*) AS INT) AS n, string_agg(url, ' ' ORDER BY rank) AS urls FROM trimmed GROUP BY term",
    "search_pages": f"""WITH {FRONT}, {PAGE_TF}, found AS (SELECT url, round(sum(weight), 6) AS score FROM trimmed WHERE term IN ({TERMS}) GROUP BY url)
      SELECT url, score FROM (SELECT *, row_number() OVER (PARTITION BY lower({_netloc('url')}) ORDER BY score DESC, url) AS r FROM found) WHERE r <= 2 ORDER BY score DESC, url LIMIT {DEFAULT.results}""",
    "variant_merge": f"""SELECT term, arg_min(url, k) AS url, max(tf) AS tf FROM (SELECT {_netloc('url')} AS term, url, length(url) AS tf,
      regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '') AS key,
      (CASE WHEN starts_with(url, 'https://') THEN '0' ELSE '1' END) || (CASE WHEN ends_with(url, '/') THEN '1' ELSE '0' END) || url AS k FROM pages) GROUP BY term, key""",
    "compaction_flag": f"""WITH {TF}, c AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
      f AS (SELECT term, n, n > {DEFAULT.compact_over * DEFAULT.postings_limit}::DOUBLE AS over, CAST(floor({_uniform('term', '0')} * 1000000) AS BIGINT) % 100 < {DEFAULT.compact_percent} AS forced FROM c)
      SELECT term, n, over, forced, over OR forced AS due FROM f""",
    "page_records": rf"""SELECT page_id, {TITLE} AS title, CAST(length({VISIBLE}) AS INT) AS n_text, CAST(len({HREFS}) AS INT) AS n_links, url AS final_url FROM pages""",
    "page_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "page_links": f"""SELECT page_id, CAST(i - 1 AS INT) AS pos, {ROOT} || h[i] AS dst FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, {HREFS} AS h FROM pages))""",
    "backlinks_xdomain": f"WITH {BACK} SELECT url, n FROM back",
    "backlink_freeze": f"WITH {EDGES}, f AS (SELECT pos, unnest({_prefixes('dst')}) AS prefix FROM edges) SELECT prefix, count(*) AS n FROM f GROUP BY prefix HAVING min(pos) <= 100",
    "prosperous_urls": f"WITH {PROSPERITY} SELECT prefix, n FROM prosperity WHERE n >= {DEFAULT.prosperous}",
    "prosperity_estimate": f"""WITH {PROSPERITY}, known AS (SELECT page_id, unnest({_prefixes('url')}) AS prefix FROM pages)
      SELECT p.page_id, coalesce(e.n, 0) AS prosperity FROM pages p LEFT JOIN
      (SELECT page_id, arg_max(n, length(prefix)) AS n FROM known JOIN prosperity USING (prefix) WHERE n >= 2 GROUP BY page_id) e USING (page_id)""",
    "domain_weight": f"""WITH {EDGES}, d AS (SELECT DISTINCT lower({_netloc('src')}) AS s, lower({_netloc('dst')}) AS domain FROM edges) SELECT domain, count(*) AS n FROM d WHERE s <> domain GROUP BY domain""",
    "frontier_weighted": f"""WITH {FRONT}, d AS (SELECT page_id, round(-ln({_uniform('page_id')}) / ((1 + ln(1 + backlinks)) / (1 + length(url) % 5)), 9) AS draw FROM front) SELECT page_id, draw FROM d ORDER BY draw, page_id LIMIT {DEFAULT.frontier_size}""",
    "frontier_domain": f"""SELECT domain, CAST(rank AS INT) AS rank, page_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY draw, page_id) AS rank FROM (
      SELECT page_id, lower({_netloc('url')}) AS domain, {_uniform('page_id', 'domain')} AS draw FROM pages)) WHERE rank <= {DEFAULT.frontier_per_domain}""",
    "frontier_http": f"""SELECT page_id FROM pages WHERE NOT starts_with(url, 'http://') UNION ALL
      (SELECT page_id FROM pages WHERE starts_with(url, 'http://') ORDER BY {_uniform('page_id', 'http')}, page_id LIMIT {DEFAULT.frontier_http})""",
    "frontier_orphan": f"""WITH {FRONT}, o AS (SELECT page_id, page_id % 3 <> 0 OR backlinks = 0 AS orphan FROM front)
      SELECT page_id FROM o WHERE NOT orphan UNION ALL (SELECT page_id FROM o WHERE orphan ORDER BY {_uniform('page_id', 'orphan')}, page_id LIMIT {DEFAULT.frontier_orphans})""",
    "shuffled_links": f"SELECT page_id, {_uniform('page_id', 'links')} AS draw FROM pages",
    "bfs_levels": f"""WITH RECURSIVE {EDGES}, walk AS (SELECT pos AS node, 0 AS level FROM edges WHERE pos IN (0, 1, 2) UNION
      SELECT e."to", w.level + 1 FROM walk w JOIN edges e ON e.pos = w.node WHERE w.level < {DEFAULT.crawl_depth}) SELECT node, CAST(min(level) AS INT) AS level FROM walk GROUP BY node""",
    "search_topk": f"WITH {TF}, {BEST} SELECT doc_id, score FROM best",
    "search_snippet": f"""WITH {TF}, {BEST}, hit AS (SELECT doc_id, score, text, list_min(list_filter([{", ".join(f"strpos(lower(text), '{t}')" for t in QUERY.split())}], lambda x: x > 0)) AS place FROM best JOIN documents USING (doc_id))
      SELECT doc_id, score, substr(text, greatest(coalesce(place, 1) - {DEFAULT.snippet // 4}, 1), {DEFAULT.snippet}) AS snippet FROM hit""",
    "search_stored": f"""WITH {FRONT}, {PAGE_TF} SELECT url, round(sum(weight), 6) AS score FROM trimmed WHERE term IN ({TERMS}) GROUP BY url ORDER BY score DESC, url LIMIT {DEFAULT.results}""",
    "search_many": MANY,
    "stream_index": MANY,
    "search_window": f"""WITH {TF}, {BEST}, w AS (SELECT doc_id, score, {PIECES} AS p FROM best JOIN documents USING (doc_id)),
      hit AS (SELECT doc_id, place, lower(p[place + 1]) AS term FROM (SELECT doc_id, p, CAST(unnest(range(0, len(p))) AS INT) AS place FROM w) WHERE regexp_full_match(p[place + 1], '[A-Za-z0-9]+') AND lower(p[place + 1]) IN ({TERMS})),
      n AS (SELECT doc_id, count(DISTINCT term) AS n_terms FROM hit GROUP BY doc_id),
      back AS (SELECT e.doc_id, e.place AS last, s.term, max(s.place) AS place FROM hit e JOIN hit s ON s.doc_id = e.doc_id AND s.place <= e.place GROUP BY ALL),
      stretch AS (SELECT doc_id, last, min(place) AS first, count(*) AS met FROM back GROUP BY ALL),
      chosen AS (SELECT doc_id, n_terms, first, last, row_number() OVER (PARTITION BY doc_id ORDER BY last - first, first) AS r FROM stretch JOIN n USING (doc_id) WHERE met = n_terms)
      SELECT doc_id, score, CAST(n_terms AS INT) AS n_terms, first, last, substr(array_to_string(p[first + 1:], ' '), 1, {DEFAULT.snippet}) AS snippet FROM chosen JOIN w USING (doc_id) WHERE r = 1""",
    "misspelt_terms": f"""WITH {TF}, t AS (SELECT DISTINCT term FROM tf), asked AS (SELECT DISTINCT term FROM (SELECT lower(unnest({PLAIN})) AS term FROM benchmark) WHERE {KEPT} AND length(term) >= 6),
      q AS (SELECT DISTINCT substr(term, 1, 2) || substr(term, 4) AS word FROM asked)
      SELECT word, term, CAST(levenshtein(word, term) AS INT) AS distance FROM q JOIN t ON abs(length(word) - length(term)) <= 2 AND levenshtein(word, term) <= 2""",
    "index_segments": f"WITH {TF} {TOPK}",
    "search_json": f"WITH {TF}, {BEST} SELECT '{{\"doc_id\":' || doc_id || ',\"score\":' || score || '}}' AS result FROM best",
    "seed_scan": "SELECT page_id, url FROM pages WHERE page_id < 3",
    "postings_compacted": f"""WITH {FRONT}, {PAGE_TF}, c AS (SELECT term, count(*) AS n FROM weighted GROUP BY term),
      due AS (SELECT term FROM c WHERE n > {DEFAULT.compact_over * DEFAULT.postings_limit}::DOUBLE OR CAST(floor({_uniform('term', '0')} * 1000000) AS BIGINT) % 100 < {DEFAULT.compact_percent})
      SELECT term, url, weight FROM weighted WHERE term NOT IN (SELECT term FROM due) UNION ALL SELECT term, url, weight FROM trimmed WHERE term IN (SELECT term FROM due)""",
    "small_limits": f"""WITH {FRONT}, {_small('1 3')} SELECT term AS what, url FROM trimmed UNION ALL SELECT 'frontier' AS what, url FROM (
      SELECT url, row_number() OVER (PARTITION BY lower({_netloc('url')}) ORDER BY {_uniform('page_id', 'domain')}, page_id) AS rank FROM pages) WHERE rank <= 1""",
    "prosperity_json": f"WITH {PROSPERITY} SELECT prefix, n FROM prosperity WHERE n >= {DEFAULT.prosperous}",
    "domain_info": f"""WITH p AS (SELECT lower({_netloc('url')}) AS domain, list_transform({HREFS}, lambda h: lower({_netloc(f"({ROOT} || h)")})) AS o FROM pages)
      SELECT domain, count(*) AS visits, array_to_string(list_sort(list_distinct(flatten(list(o)))), ' ') AS outlinks FROM p GROUP BY domain""",
    "domain_languages": f"""WITH t AS (SELECT page_id, url, html, {VISIBLE} AS text FROM pages), c AS (SELECT page_id, {LANG_COUNTS} FROM (SELECT page_id, {LANG_WORDS} AS w FROM t)),
      k AS (SELECT page_id, CASE WHEN greatest({', '.join(FUNCTION_WORDS)}) = 0 THEN 'und' {LANG_BEST} END AS lang FROM c),
      p AS (SELECT page_id, lower({_netloc('url')}) AS domain, lang, list_transform({HREFS}, lambda h: lower({_netloc(f"({ROOT} || h)")})) AS o FROM t JOIN k USING (page_id)),
      l AS (SELECT domain, string_agg(lang || ':' || n, ' ' ORDER BY lang) AS langs FROM (SELECT domain, lang, count(*) AS n FROM p GROUP BY ALL) GROUP BY domain)
      SELECT domain, count(*) AS visits, any_value(langs) AS langs, CAST(len(list_distinct(flatten(list(o)))) AS BIGINT) AS n_outlinks FROM p JOIN l USING (domain) GROUP BY domain""",
    "page_store": f"""SELECT page_id, url, {TITLE} AS title, CAST(len({HREFS}) AS INT) AS n_links, lower({_netloc('url')}) AS domain FROM pages""",
    "indicators": "SELECT count(*) AS rows, CAST(sum(length(url)) AS BIGINT) AS characters, max(length(url)) AS longest, CAST(count(*) FILTER (starts_with(url, 'http://')) AS BIGINT) AS plain FROM pages",
    "lang_detect": f"SELECT doc_id, CASE WHEN greatest({', '.join(FUNCTION_WORDS)}) = 0 THEN 'und' {LANG_BEST} END AS lang FROM (SELECT doc_id, {LANG_COUNTS} FROM (SELECT doc_id, {LANG_WORDS} AS w FROM documents))",
    "crawl_levels": _crawl(),
    "redirects": f"""WITH RECURSIVE {EDGES}, sent AS (SELECT src, dst FROM edges WHERE pos % 5 < 3),
      walk AS (SELECT src AS url, dst AS "at", CAST(1 AS BIGINT) AS hops FROM sent UNION SELECT walk.url, sent.dst, hops + 1 FROM walk JOIN sent ON sent.src = walk."at" WHERE hops <= (SELECT count(*) FROM sent))
      SELECT url, max(CASE WHEN "at" NOT IN (SELECT src FROM sent) THEN "at" END) AS final_url, coalesce(max(CASE WHEN "at" NOT IN (SELECT src FROM sent) THEN hops END), 0) AS hops FROM walk GROUP BY url""",
    "freeze_by_size": f"""WITH {EDGES}, f AS (SELECT prefix, count(*) AS n, min(pos) AS made FROM (SELECT pos, unnest({_prefixes('dst')}) AS prefix FROM edges) GROUP BY prefix)
      SELECT prefix, n FROM f WHERE made <= coalesce((SELECT made FROM f ORDER BY made LIMIT 1 OFFSET 149), (SELECT max(made) FROM f))""",
    "lang_learnt": f"""WITH {LANGUAGE} SELECT d.doc_id, CASE WHEN length(l.t) <= 2 THEN 'und' ELSE r.lang END AS lang, {HELD_LANG.replace('doc_id', 'd.doc_id')} AS held_out
      FROM documents d JOIN letters l USING (doc_id) LEFT JOIN (SELECT doc_id, lang FROM ranked WHERE r = 1) r USING (doc_id)""",
    "word_candidates": f"""WITH {CANDIDATES} SELECT w.word, w.n, round(ln(n * total / parts), 6) + 0.0 AS cohesion, CASE WHEN length(w.word) > 1 THEN round(least({_entropy('rn', 'rs')}, {_entropy('ln_', 'ls')}), 6) + 0.0 END AS entropy
      FROM w LEFT JOIN parts USING (word) LEFT JOIN r USING (word) LEFT JOIN l USING (word), total""",
    "edit_distance": "SELECT p.page_id, CAST(levenshtein(p.url, q.url) AS INT) AS distance FROM pages p JOIN pages q ON q.page_id = p.page_id + 1",
    "json_parse": "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type",
    "errors_by_type": "SELECT 'ValueError' AS type, count(*) AS errors FROM pages WHERE NOT contains(html, '</html>') HAVING count(*) > 0",
    "kv_store": "SELECT url AS key, CAST(max(CASE WHEN length(url) > 45 THEN -length(url) ELSE length(url) END) AS INT) AS value FROM pages GROUP BY url",
    "scored_lists": f"SELECT url, round({_penalty('url')}, 6) AS score FROM pages",
}
