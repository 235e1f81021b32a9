"""The registered queries once more, as plain SQL for DuckDB over the given tables."""

from __future__ import annotations

import unicodedata

from .fixtures import SHARED, references

# Stated here once more, so that a wrong value in the engine shows.
K1, B, IDF_FLOOR = 1.2, 0.75, 0.000001
TOKEN = r"[\p{L}\p{M}\p{N}\p{Co}]+"
WHITESPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}-\x{2029}\x{202f}\x{205f}\x{3000}"
)
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid ref ref_src source".split()
# Latin letters with one mark lose it, marks that stand alone too, some variants are folded.
_LETTERS = [chr(c) for c in range(0xC0, 0x1F00) if chr(c).lower() == chr(c) and unicodedata.decomposition(chr(c)).count(" ") == 1]
_PLAIN = {c: unicodedata.normalize("NFD", c)[0] for c in _LETTERS if unicodedata.decomposition(c)[0] != "<"}
_PLAIN = {c: base for c, base in _PLAIN.items() if "a" <= base <= "z" and len(unicodedata.normalize("NFD", c)) == 2}
_VARIANTS = dict(zip("µſςϐϑϕϖϰϱϵ", "μsσβθφπκρε"))
_MARKS = "".join(
    chr(c)
    for first, last in ((0x300, 0x304), (0x306, 0x30C), (0x30F, 0x30F), (0x311, 0x311), (0x31B, 0x31B), (0x323, 0x328),
                        (0x32D, 0x32E), (0x330, 0x331))
    for c in range(first, last + 1)
    if c not in (0x30D, 0x30E)
)
FOLD_FROM = "".join(_PLAIN) + "".join(_VARIANTS) + _MARKS
FOLD_TO = "".join(_PLAIN.values()) + "".join(_VARIANTS.values())

DUCKDB_WORDS = {
    "{epoch_of_ts}": "CAST(floor(epoch(ts)) AS BIGINT)",
    "{no_text}": "CAST(NULL AS STRING)",
}

_WS = f"[{WHITESPACE}]"
_TRACKING = ", ".join(f"'{name}'" for name in TRACKING)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _recode(x: str) -> str:
    decoded = f"url_decode(replace({x}, '+', ' '))"
    return f"replace(url_encode({decoded}), '%20', '+')"


def normalized(u: str) -> str:
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    kept = (
        f"list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '=.') "
        f"AND split_part(p, '=', 1) NOT IN ({_TRACKING}))"
    )
    name = _recode("split_part(p, '=', 1)")
    value = _recode("substr(p, strpos(p, '=') + 1)")
    joined = f"array_to_string(list_transform({kept}, lambda p: {name} || '=' || {value}), '&')"
    path = f"regexp_replace(regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return (
        f"(lower(split_part({u}, ':', 1)) || '://' || regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1) "
        f"|| CASE WHEN {path} = '' THEN '/' ELSE {path} END "
        f"|| CASE WHEN {joined} = '' THEN '' ELSE '?' || {joined} END)"
    )


def tokens(x: str) -> str:
    folded = f"translate(lower({x}), {_quoted(FOLD_FROM)}, {_quoted(FOLD_TO)})"
    return f"coalesce(regexp_extract_all({folded}, '{TOKEN}'), [])"


def escaped(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{char}', '{entity}')"
    return x


def paragraphs(x: str) -> str:
    parts = f"string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')"


def slug(x: str) -> str:
    kept = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{WHITESPACE}-]', '', 'g')"
    joined = f"trim(regexp_replace({kept}, '[{WHITESPACE}_-]+', '-', 'g'), '-')"
    return f"coalesce(nullif(trim(substr({joined}, 1, 60), '-'), ''), 'article')"


def yaml(x: str) -> str:
    value = f"replace(replace(coalesce({x}, ''), '\\', '\\\\'), '\"', '\\\"')"
    return f"'\"' || {value} || '\"'"


def clean_tags(x: str) -> str:
    """Distinct cleaned tags of a list in first-seen order, joined by commas."""
    cleaned = f"list_filter(list_transform({x}, lambda t: lower({strip('t')})), lambda t: t <> '')"
    return (
        f"array_to_string(list_filter({cleaned}, lambda t, i: list_position({cleaned}, t) = i), ',')"
    )


def unescaped(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_BLOCK = "</?(?:p|div|br|h1|body|html|article)(?:\\s[^>]*)?>"


def _block_texts(x: str) -> str:
    text = unescaped("regexp_replace(b, '<[^>]*>', '', 'g')")
    text = f"trim(regexp_replace({text}, '{_WS}+', ' ', 'g'))"
    texts = f"list_transform(string_split_regex({x}, '{_BLOCK}'), lambda b: {text})"
    return f"list_filter({texts}, lambda b: b <> '')"


def weight(hits: str, n: str) -> str:
    # Written with exponents, so that nothing is computed in decimals.
    idf = f"ln((c.n_docs - {n} + 5e-1) / ({n} + 5e-1))"
    idf = f"CASE WHEN {idf} <= 0 THEN {IDF_FLOOR:e} ELSE {idf} END"
    return (
        f"-(({idf}) * ({hits} * {K1 + 1:e}) / "
        f"({hits} + {K1:e} * ({1 - B:e} + {B:e} * d.dl / c.avgdl)))"
    )


TABLES = {
    "page_urls": f"SELECT page_id, {normalized('url')} AS url FROM pages",
    **SHARED,
    # Full-text index.
    "words": " UNION ALL ".join(
        f"SELECT id, {n} AS field, unnest({tokens(name)}) AS term, "
        f"unnest(range(len({tokens(name)}))) AS pos FROM articles"
        for n, name in enumerate(("title", "author", "text"))
    ),
    "lengths": """SELECT a.id, coalesce(w.dl, 0) AS dl FROM articles a
        LEFT JOIN (SELECT id, count(*) AS dl FROM words GROUP BY id) w ON w.id = a.id""",
    "corpus": "SELECT count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM lengths",
    # Import.
    "listed": f"""SELECT line_no, {normalized('url')} AS url, title, author, added_at, text, tag_text
        FROM saves WHERE url LIKE 'http://%' OR url LIKE 'https://%'""",
    "firsts": """SELECT url, arg_min(struct_pack(title := title, author := author,
               added_at := added_at, text := text), line_no) AS f,
               min(line_no) AS line_no, count(*) AS n_items FROM listed GROUP BY url""",
    # Extraction.
    "page_parts": """SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(
               regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<nav>.*?</nav>', '', 'g'),
               '(?s)<footer>.*', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS body FROM pages""",
    "page_blocks": f"""SELECT page_id, url,
               {_block_texts("regexp_extract(body, '(?s)^(.*?)<article>', 1)")} AS before,
               {_block_texts("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
               {_block_texts("regexp_extract(body, '(?s)</h1>(.*?)</article>', 1)")} AS rest,
               {_block_texts("regexp_extract(body, '(?s)</article>(.*)$', 1)")} AS after
        FROM page_parts""",
    "page_articles": """SELECT page_id, url AS raw_url, heading[1] AS title,
               array_to_string(rest, chr(10)) AS text FROM page_blocks""",
    "block_rows": """SELECT page_id, split_part(url, '/', 3) AS host, i - 1 AS block_no,
               CASE WHEN i > len(before) AND i <= len(before) + len(heading) + len(rest)
                    THEN 'article' ELSE 'body' END AS place, texts[i] AS text
        FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM (
              SELECT *, list_concat(list_concat(before, heading), list_concat(rest, after)) AS texts
              FROM page_blocks))""",
    "bare_texts": f"""SELECT b.page_id, b.url, split_part(b.url, '/', 3) AS host, b.heading[1] AS title,
               list_concat(list_concat(b.before, {_block_texts("replace(regexp_extract(p.body, '(?s)</h1>(.*?)</article>', 1), '. ', '.<br /> <br>')")}),
                           ['Share this', split_part(b.url, '/', 3) || ' news.']) AS texts
        FROM page_blocks b JOIN page_parts p ON p.page_id = b.page_id""",
    "bare_blocks": """SELECT page_id, host, i, texts[i] AS text
        FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM bare_texts)""",
    "bare_repeats": """SELECT host, text FROM bare_blocks GROUP BY host, text HAVING count(DISTINCT page_id) >= 3""",
    # Content of linked pages.
    "closest": """SELECT url, arg_max(struct_pack(available := available, status := status,
               snapshot_url := snapshot_url, ts := timestamp), timestamp) AS c
        FROM snapshots GROUP BY url""",
    "copies": """SELECT url, replace(replace(c.snapshot_url, '/web/' || c.ts || '/',
               '/web/' || c.ts || 'id_/'), 'http://web.archive.org', 'https://web.archive.org')
               AS raw_url FROM closest WHERE c.available AND c.status = '200'""",
    "sources": """SELECT r.url, r.status, r.error, a.title, a.text, k.raw_url
        FROM responses r LEFT JOIN page_articles a ON a.page_id = r.page_id AND a.text <> ''
        LEFT JOIN copies k ON k.url = r.url""",
    "fetched": """SELECT url, CASE WHEN source IS NOT NULL THEN title END AS title,
               CASE WHEN source IS NOT NULL THEN text END AS text, source,
               CASE WHEN source IS NULL THEN coalesce(
                   CASE WHEN status = 200 THEN 'no article text' END, error,
                   'HTTP Error ' || CAST(status AS STRING), 'no response') END AS reason
        FROM (SELECT *, CASE WHEN status = 200 AND text <> '' THEN 'live'
                             WHEN raw_url IS NOT NULL AND text <> '' THEN 'wayback' END AS source
              FROM sources)""",
    "outcomes": """SELECT f.url, f.line_no, f.n_items, f.f.added_at AS added_at,
               CASE WHEN s.url IS NOT NULL THEN 'skipped'
                    WHEN f.f.text <> '' OR p.text <> '' THEN 'saved' ELSE 'failed' END AS status,
               CASE WHEN s.url IS NOT NULL THEN NULL WHEN f.f.text <> '' THEN 'export'
                    ELSE p.source END AS source,
               CASE WHEN s.url IS NULL AND coalesce(f.f.text, '') = '' AND p.text IS NULL
                    THEN coalesce(p.reason, 'no response') END AS reason,
               CASE WHEN f.f.text <> '' THEN f.f.title
                    ELSE coalesce(nullif(p.title, ''), f.f.title) END AS title,
               CASE WHEN f.f.text <> '' THEN f.f.author END AS author,
               CASE WHEN f.f.text <> '' THEN f.f.text ELSE p.text END AS text
        FROM firsts f LEFT JOIN stored s ON s.url = f.url LEFT JOIN fetched p ON p.url = f.url""",
    "rejects": """SELECT line_no, url, 'not an http(s) URL' AS reason FROM saves
        WHERE NOT (url LIKE 'http://%' OR url LIKE 'https://%')""",
    "imported": """SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY line_no) AS id,
               url, title, author, text, added_at FROM outcomes WHERE status = 'saved'""",
    "url_tags": """SELECT DISTINCT url, lower(trim(tag)) AS tag FROM (
               SELECT url, unnest(string_split(tag_text, '|')) AS tag FROM listed)
        WHERE trim(tag) <> ''""",
    # Addresses.
    "page_hops": f"""SELECT DISTINCT {normalized('url')} AS given_url, hop, target FROM hops""",
    "last_hops": """SELECT given_url, arg_max(target, (hop, target)) AS target FROM page_hops GROUP BY given_url""",
    "given_pages": f"""SELECT url, {normalized('url')} AS given_url FROM pages""",
    # From page to page until it stops, or comes to one where it was before.
    "onward": f"""SELECT given_url, {normalized('target')} AS next FROM last_hops""",
    "walked": """SELECT given_url AS page, [given_url] AS path, next FROM onward
        UNION ALL SELECT w.page, list_append(w.path, w.next), n.next FROM walked w JOIN onward n ON n.given_url = w.next
        WHERE NOT list_contains(w.path, w.next)""",
    "ends": """SELECT page, arg_max(path, len(path)) AS path, arg_max(next, len(path)) AS next FROM walked GROUP BY page""",
    "resolved": """SELECT p.url, p.given_url, CASE WHEN e.page IS NULL THEN p.given_url
            WHEN list_contains(e.path, e.next) THEN list_min(e.path[list_position(e.path, e.next) :]) ELSE e.next END AS final_url
        FROM given_pages p LEFT JOIN ends e ON e.page = p.given_url""",
    "targets": """SELECT url, 0 AS step, 0 AS hop, url AS target FROM pages
        UNION ALL SELECT p.url, s.step, h.hop, h.target FROM given_pages p
        JOIN (SELECT page, unnest(path) AS at, unnest(range(1, len(path) + 1)) AS step FROM ends) s ON s.page = p.given_url
        JOIN page_hops h ON h.given_url = s.at""",
    "verdicts": """SELECT host, bool_or(ip LIKE '10.%' OR ip LIKE '169.254.%' OR ip LIKE 'fd%' OR ip LIKE 'fe80:%'
               OR ip LIKE '999.%' OR lower(ip) LIKE '2001:db8:%') AS blocked FROM resolutions GROUP BY host""",
    "guarded": """SELECT t.url, arg_min(CASE WHEN v.host IS NULL THEN 'unknown-host ' || split_part(t.target, '/', 3)
            WHEN v.blocked THEN 'internal-host ' || v.host END, (t.step, t.hop, t.target))
            FILTER (v.host IS NULL OR v.blocked) AS reason
        FROM targets t LEFT JOIN verdicts v ON v.host = split_part(t.target, '/', 3) GROUP BY t.url""",
}


def statement(body: str) -> str:
    """Prefix a SELECT with the tables it needs, in the order of ``TABLES``."""
    needed: set[str] = set()
    queue = references(body, TABLES)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += [n for n in references(TABLES[name], TABLES) if n != name]
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in references(TABLES[name], needed):
            if other != name:
                place(other)
        order.append(name)

    for name in TABLES:
        if name in needed:
            place(name)
    ctes = ",\n".join(f"{name} AS ({TABLES[name]})" for name in order)
    sql = f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
    for word, meaning in DUCKDB_WORDS.items():
        sql = sql.replace(word, meaning)
    return sql


# -- search --------------------------------------------------------------------

_FOUND = "a.id, a.url, a.title, a.author, a.added_at, {score} AS score"


def ranked(
    hits: dict[str, str], matched: str, counted: dict[str, str] | None = None, digits: int | None = 6
) -> str:
    """Rank articles: ``hits`` gives (id, f) per phrase, ``matched`` the condition.

    ``counted`` gives other hit counts for the score where these differ (NEAR).
    """
    counted = {**hits, **(counted or {})}
    ctes = [f"{k} AS ({sql})" for k, sql in hits.items()]
    ctes += [f"{k}_near AS ({counted[k]})" for k in hits if counted[k] != hits[k]]
    joins, terms = [], []
    for k in hits:
        near = f"{k}_near" if counted[k] != hits[k] else k
        joins.append(f"LEFT JOIN {near} AS j{k} ON j{k}.id = a.id")
        part = weight(f"j{k}.f", f"(SELECT count(*) FROM {k})")
        terms.append(f"coalesce({part}, 0)")
    total = " + ".join(terms)
    score = _FOUND.format(score=total if digits is None else f"round({total}, {digits})")
    body = (
        f"SELECT {score} FROM articles a JOIN lengths d ON d.id = a.id CROSS JOIN corpus c "
        f"{' '.join(joins)} WHERE {matched}"
    )
    sql = statement(body + " " + " ".join(ctes))  # collects the tables of both
    head = sql[: sql.rindex(body)]
    return f"{head.rstrip()},\n{', '.join(ctes)}\n{body}"


def has_word(word: str, condition: str = "true") -> str:
    return f"SELECT id, count(*) AS f FROM words WHERE term = '{word}' AND {condition} GROUP BY id"


def has_prefix(prefix: str) -> str:
    return f"SELECT id, count(*) AS f FROM words WHERE starts_with(term, '{prefix}') GROUP BY id"


def has_phrase(*phrase: str) -> str:
    joins = " ".join(
        f"JOIN words w{k} ON w{k}.id = w0.id AND w{k}.field = w0.field AND w{k}.pos = w0.pos + {k} "
        f"AND w{k}.term = '{word}'"
        for k, word in enumerate(phrase) if k
    )
    return f"SELECT w0.id, count(*) AS f FROM words w0 {joins} WHERE w0.term = '{phrase[0]}' GROUP BY w0.id"


def has_near(word: str, other: str, distance: int) -> str:
    return (
        f"SELECT x.id, count(*) AS f FROM words x WHERE x.term = '{word}' AND EXISTS (SELECT 1 FROM words y "
        f"WHERE y.term = '{other}' AND y.id = x.id AND y.field = x.field "
        f"AND abs(y.pos - x.pos) <= {distance + 1}) GROUP BY x.id"
    )
