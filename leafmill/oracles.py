"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

from .functions import fixed

_LINKS = r"""
__a as (select page_id, url, unnest(regexp_extract_all(html, '(?is)(<a\s[^>]*>.*?)</a>', 1)) as a, generate_subscripts(regexp_extract_all(html, '(?is)(<a\s[^>]*>.*?)</a>', 1), 1) - 1 as pos from pages),
__l as (select page_id, url, pos, regexp_extract(a, '(?is)^<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) as href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g')) as txt from __a),
__links as (select *, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href as link_url, case when txt = '' then regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href else txt end as title from __l where href <> '')"""
_ENT = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_H1 = "trim(" + _ENT.format("regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '<[^>]+>', '', 'g')") + ")"
_BODY = """__p as (select page_id, url, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<div[^>]*class=["'']ad["''][^>]*>.*?</div>', '', 'g'), '(?is)<footer[^>]*>.*?</footer>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') as h from pages),
__m as (select page_id, url, html, regexp_extract(h, '(?is)<article(?:\\s[^>]*)?>(.*?)</article>', 1) as m from __p),
__x as (select page_id, url, html, """ + _ENT.format("regexp_replace(regexp_replace(m, '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g')") + """ as x from __m),
__b as (select page_id, url, html, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda v: trim(regexp_replace(v, '[ \\t]+', ' ', 'g'))), lambda v: v <> ''), chr(10)) as body from __x)"""
_TITLED = """__t as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, case when page_id % 11 = 0 then 'Notice ' || page_id when page_id % 5 = 0 then 'Interlude ' || page_id
    when page_id % 3 = 0 then 'Ep. #' || (page_id % 40) else 'Chapter  ' || (page_id % 40) || ': on' end as title from pages),
__n as (select *, try_cast(nullif(regexp_extract(title, '(?:Chapter\\s+|Ep\\. #)(\\d+)', 1), '') as bigint) as chapter_no, contains(lower(title), 'notice') as is_notice from __t)"""
_LIKELY = "__k as (select * from (select *, max(chapter_no is not null) over (partition by host) as s from __n where not is_notice) where not s or chapter_no is not null)"
_DISC = "__d as (select doc_id, source as site from documents), __r as (select __d.*, coalesce(e.there, false) as skipped from __d left join (select distinct doc_id, true as there from labels where quality > 0) e using (doc_id))"
_OUT = _DISC + """, __o as (select * from (select *, coalesce(sum((status = 'fetched')::int) over (partition by site order by doc_id rows between unbounded preceding and 1 preceding), 0) as done
    from (select *, case when skipped then 'skipped' when doc_id % 7 = 3 then 'failed' else 'fetched' end as status from __r)) where done < 20)"""
_META = " or ".join(f"contains(lower(text), '{m}')" for m in fixed.METADATA_MARKERS)
_SECT = """__s as (select doc_id, source, row_number() over (partition by source order by doc_id) as idx, text, case when doc_id % 13 = 0 then '' when doc_id % 11 = 0 then 'Announcement 3' when doc_id % 17 = 0 then 'Table of Contents'
    when source < 'src5' and doc_id % 4 = 0 then 'Episode ' || (doc_id % 30) else 'Story ' || doc_id end as title from documents),
__q as (select *, try_cast(nullif(regexp_extract(title, 'Episode (\\d+)', 1), '') as bigint) as e from __s where title <> '' and not contains(lower(title), 'announcement') and not contains(lower(title), 'contents') and not (idx <= 5 and (""" + _META + """))),
__c as (select doc_id, source, idx, case when s then e else row_number() over (partition by source order by idx) end as number from (select *, max(e is not null) over (partition by source) as s from __q) where not s or e is not null)"""


def _any(x: str, markers) -> str:
    return "(" + " or ".join(f"contains({x}, '{m}')" for m in markers) + ")"


_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<![^>]*>', '', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_PQ = "__p as (select page_id, html, lower(" + _ENT.format("regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)") + f") as title, lower({_VISIBLE}) as body from pages)"
_ORDER = "select host, row_number() over (partition by host order by case when ev then chapter_no * {0} else page_id * {0} end, page_id)::bigint as position, page_id, coalesce(chapter_no, -1) as chapter_no from (select *, bool_and(chapter_no is not null) over (partition by host) as ev from {1})"
_BASE = "regexp_extract(url, '^[^?#]*', 0)"

_BLOCKS = "|".join(sorted(fixed.BLOCK_TAGS))
_SECTION = rf"""with __h as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head>.*?</head>', '', 'g'), '(?is)<(script|style|svg)[^>]*>.*?</(script|style|svg)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') as h from pages),
    __x as (select page_id, regexp_replace(regexp_replace(h, '(?is)</?({_BLOCKS})(\s[^>]*)?/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') as x, regexp_extract(h, '(?is)<h1>(.*?)</h1>', 1) as t from __h)
    select page_id, trim({_ENT.format("t")}) as title, array_to_string(list_filter(list_transform(string_split({_ENT.format("x")}, chr(10)), lambda v: trim(regexp_replace(v, '[ \t]+', ' ', 'g'))), lambda v: v <> ''), chr(10) || chr(10)) as text from __x""".replace("\\\\", "\\")

ORACLES: dict[str, str] = {
    "links_all": f"with {_LINKS} select page_id, pos::bigint as pos, href, title from __links",
    "links_resolved_same_domain": f"with {_LINKS} select page_id, pos::bigint as pos, link_url from __links where regexp_extract(link_url, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)",
    "links_first_wins": f"with {_LINKS} select link_url, page_id, pos::bigint as pos, title from (select *, row_number() over (partition by link_url order by page_id, pos) as n from __links) where n = 1",
    "page_metadata": f"with __p as (select page_id, coalesce(nullif(regexp_replace({_H1}, '[ \\t]+', ' ', 'g'), ''), url) as title from pages) select page_id, title, length(title)::bigint as title_chars from __p",
    "article_text": f"with {_BODY} select page_id, body, case when body = '' then 'content is empty' end as error from __b",
    "chapter_text_file": f"with {_BODY} select page_id, 'chapter_' || page_id || '.txt' as path, {_H1} || chr(10) || chr(10) || body || chr(10) as content from __b where body <> ''",
    "chapter_number": f"with {_TITLED} select page_id, coalesce(chapter_no, -1) as chapter_no, is_notice from __n",
    "likely_chapters": f"with {_TITLED}, {_LIKELY} select page_id, host, coalesce(chapter_no, -1) as chapter_no from __k",
    "likely_fallback": f"with {_TITLED} select page_id, host, replace(replace(title, 'Chapter', 'Part'), 'Ep. #', 'Part ') as title from __n where not is_notice",
    "order_chapters_asc": f"with {_TITLED}, {_LIKELY} " + _ORDER.format(1, "__k"),
    "order_chapters_desc": f"with {_TITLED}, {_LIKELY} " + _ORDER.format(-1, "__k"),
    "order_chapters_fallback": f"with {_TITLED} " + _ORDER.format(-1, "__n"),
    "toc_walk": """with recursive __n as (select count(*) as n from pages), __e as (select page_id as page, (page_id * 7 + 3) % n as next_page from pages, __n),
        __w as (select page_id as start, page_id as page, 1 as page_no, [page_id] as seen from pages
            union all select w.start, e.next_page, w.page_no + 1, list_append(w.seen, e.next_page) from __w w join __e e on w.page = e.page where w.page_no < 50 and not list_contains(w.seen, e.next_page))
        select start, page, page_no::bigint as page_no from __w""",
    "resume_split": f"with {_DISC} select doc_id, skipped from __r",
    "quota_prefix": f"with {_OUT} select site, doc_id, status from __o",
    "manifest_rollup": f"""with {_OUT} select * from (select site, count(*)::bigint as total_chapters from __d group by site) left join (select site, count(*)::bigint as completed_chapters,
        count(*) filter (status = 'fetched')::bigint as fetched_chapters, count(*) filter (status = 'skipped')::bigint as skipped_chapters, count(*) filter (status = 'failed')::bigint as failed_chapters from __o group by site) using (site)""",
    "manifest_document": f"""with {_OUT} select site, count(*) filter (status <> 'failed')::bigint as n_chapters, count(*) filter (status = 'failed')::bigint as n_errors,
        coalesce(string_agg(doc_id::varchar, ',' order by doc_id) filter (status = 'failed'), '') as error_ids, 'https://x.example/' || min(doc_id) filter (status <> 'failed') as first_url from __o group by site""",
    "reconcile_interrupted": "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1) and doc_id in (select item_id * 3 from benchmark)",
    "spine_join": """with __m as (select l_orderkey as book, (l_suppkey % 5)::varchar as id, arg_max('s' || l_partkey || '.xhtml', l_linenumber * 4294967296::bigint + l_partkey) as href from lineitem group by all)
        select l_orderkey as book, l_linenumber::bigint as pos, (l_partkey % 5)::varchar as idref, href from lineitem join __m on l_orderkey = book and (l_partkey % 5)::varchar = id""",
    "section_select": f"with {_SECT} select doc_id, source, number::bigint as number from __c",
    "section_duplicates": f"""with {_SECT}, __f as (select *, row_number() over (partition by source, number order by idx) as n from __c)
        select source, count(*) filter (n = 1)::bigint as n_kept, sum(doc_id) filter (n = 1)::bigint as sum_ids, count(*) filter (n > 1)::bigint as n_warnings from __f group by source""",
    "illustration_names": f"""with {_LINKS}, __i as (select page_id, pos, row_number() over (partition by page_id order by pos) as n, row_number() over (partition by regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) order by page_id, pos) as image_index from __links)
        select page_id, pos::bigint as pos, image_index::bigint as image_index, printf('%03d-%03d', page_id, n) || case pos % 3 when 0 then '.png' when 1 then '.img' else '.jpeg' end as file from __i""",
    "marker_substitution": """select doc_id, trim(regexp_replace((case when doc_id % 2 = 0 then '[[EPUB_IMAGE:1]]' else '' end) || chr(10) || chr(10) || text || chr(10) || chr(10)
        || (case when doc_id % 3 = 0 then '[[EPUB_IMAGE:' || ((doc_id % 2 = 0)::int + 1) || ']]' else '' end) || chr(10) || chr(10) || 'end' || chr(10) || chr(10)
        || (case when doc_id % 5 = 0 then '[[EPUB_IMAGE:' || ((doc_id % 2 = 0)::int + (doc_id % 3 = 0)::int + 1) || ']]' else '' end), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)) as text from documents""",
    "page_quality": f"""with {_PQ} select page_id, length(trim(html)) < 200 or {_any("title", fixed.BAD_PAGE_SIGNALS)} or {_any("body[1:300]", fixed.BAD_PAGE_SIGNALS)} as bad_suspect,
        {_any("title", fixed.ERROR_TITLE_SIGNALS)} or {_any("body[1:500]", fixed.ERROR_BODY_SIGNALS)} as error_suspect,
        {_any("title", fixed.CHALLENGE_TITLE_SIGNALS)} or {_any("body[1:500]", fixed.CHALLENGE_BODY_SIGNALS)} or (length(html) < 1500 and {_any("html", fixed.CHALLENGE_WRAPPERS)}) as challenge_suspect from __p""",
    "http_usable": """with __e as (select event_id, (case when event_type = 'error' then 403 + event_id % 200 else 200 end)::bigint as status, trunc(value)::int * 20 as n from events)
        select event_id, status, status < 400 or n > 500 as usable, status in (403, 429, 500, 502, 503, 504) as retriable from __e""",
    "origin_robots": """with __p as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) as o, regexp_replace(regexp_replace(url, '#.*', ''), '^[a-z]+://[^/?#]*', '') as p from pages)
        select page_id, case when contains(o, 'spam') then true when contains(o, 'blog') then not starts_with(p, '/en/') when starts_with(p, '/fr') then true else not starts_with(p, '/de') end as can_fetch from __p""",
    "known_domain_config": """with __p as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as a from pages), __c as (select a, min('c' || lpad(page_id::varchar, 6, '0') || '.json') as config_file from __p where page_id % 4 = 0 group by a)
        select page_id, config_file from __p left join __c using (a)""",
    "selector_report": """with __c as (select page_id, len(regexp_extract_all(html, '(?i)<a\\s')) as n1, len(regexp_extract_all(html, '(?i)<h1[\\s>]')) as n2, len(regexp_extract_all(html, '(?i)<article[\\s>]')) as n3, len(regexp_extract_all(html, 'class="cover"')) as n4 from pages),
        __u as (select page_id, 'chapter_link_selector' as selector_key, n1 as matches from __c union all select page_id, 'novel_title_selector', n2 from __c union all select page_id, 'chapter_content_selector', n3 from __c union all select page_id, 'illustration_selector', n4 from __c)
        select page_id, selector_key, matches::bigint as matches, matches > 0 as ok from __u""",
    "cache_lookup": "with __k as (select page_id, url, sha256(url)[1:16] || '.html' as key from pages) select page_id, key, key in (select key from __k where page_id % 3 = 0) as from_cache from __k",
    "config_defaults": """select n_nationkey, (case when n_nationkey % 2 = 0 then 7 else 50 end)::int as max_toc_pages, true as same_domain, (case when n_nationkey % 7 = 2 then 2 else 1 end)::int as version,
        case n_nationkey % 3 when 0 then '.ad' when 1 then 'p|q' else '' end as removed, true as no_author,
        case when n_nationkey % 7 = 2 then 'unsupported future config version' when n_nationkey % 5 = 4 then 'missing required config fields: start_url' end as error from nation""",
    "selector_dedup": "select p_partkey, case p_partkey % 4 when 0 then 'p|style|script' when 1 then 'script|style|q' when 2 then 'script|style|q|' || p_brand else 'script|style' end as selectors from part",
    "llm_json_recover": "select event_id, case when event_id % 4 < 3 then (props ->> '$.k')::bigint else -1 end as k from events",
    "log_correlate": """with __w as (select *, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn, role))
        select conv_id, turn, length(text)::bigint as request_chars, coalesce(case when next_role = 'assistant' then length(next_text) end, -1)::bigint as response_chars from __w where role = 'user'""",
    "log_summary": "select conv_id, coalesce(sum(length(text)) filter (role = 'system'), 0)::bigint as system_chars, coalesce(sum(length(text)) filter (role = 'user'), 0)::bigint as user_chars, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as response_chars from conversations group by conv_id",
    "referer_gap": "select event_id as request_id, lag(event_type) over w as referer, round((epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6, 3) as gap_seconds from events window w as (partition by user_id order by ts, event_id)",
    "progress_labels": "select event_id, '[' || event_id || '/10] ' || case event_type when 'view' then 'fetching' when 'purchase' then 'last' when 'click' then 'skipped' else 'failed' end || ': ' || event_type as line from events",
    "css_url_srcset": "select p_partkey, case p_partkey % 3 when 0 then 'https://h.example:8080/i/' || p_partkey || '.png' when 1 then 'https://h.example:8080/n/a' || p_partkey || '.jpg' else 'https://h.example:8080/bg/' || p_size || '.webp' end as cover from part",
    "slug_ascii": "select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ') -- /'), '[^a-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') as slug from part",
    "truncate_text": "select doc_id, case when length(text) > 200 then text[1:200] || '... (' || length(text) || ' chars total)' else text end as text from documents",
    "redact_secrets": """select event_id, '{"Token": "***REDACTED***", "props": ' || props || ', "list": [{"api_KEY": "***REDACTED***", "n": ' || event_id || '}]}' as json from events""",
    "redact_flat_secrets": """select event_id, '{"Token": "***REDACTED***", "n": 1, "secret": "***REDACTED***"}' as json from events""",
    "section_text": _SECTION,
    "css_links": r"""with __n as (select page_id, unnest(regexp_extract_all(html, '(?is)<nav>.*?</nav>')) as nav from pages), __a as (select page_id, regexp_extract_all(nav, '(?is)<a [^>]*>.*?</a>') as a from __n),
        __l as (select page_id, unnest(a) as a, generate_subscripts(a, 1) - 1 as pos from __a)
        select page_id, pos::bigint as pos, regexp_extract(a, 'href="([^"]*)"', 1) as href, regexp_extract(a, '>(.*)</a>', 1) as text from __l""",
    "chapter_by_selectors": f"with {_BODY} select page_id, {_H1} as title, body from __b",
    "page_through_cache": "select page_id, case when page_id % 3 = 0 then html else 'fetched ' || url end as body from pages where page_id % 3 <> 0 or length(html) > 0",
    "slug_any": "select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(strip_accents('Crème Brûlée ' || p_name)), '[^a-z0-9._-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[._-]+|[._-]+$', '', 'g') as slug from part",
    "fetched_pages": """select page_id, case when contains(url, 'spam') then null else url || '/' end as final_url, case when contains(url, 'spam') then 3 when contains(url, 'blog') then 2 else 1 end::bigint as attempts,
        case when contains(url, 'spam') then 'no route' end as error, case when not contains(url, 'spam') then 'body of ' || url end as body from pages""",
    "model_answers": "select p_partkey::varchar as key, case when p_partkey % 3 = 0 then 'known' when p_partkey % 3 = 1 then upper(p_name) else upper(p_name || chr(10) || 'Fix: too short') end as answer from part",
    "call_join": """with __q as (select conv_id, turn, text from conversations where role = 'user'), __a as (select conv_id, turn, text from conversations where role = 'assistant')
        select __q.conv_id, __q.turn, length(__q.text)::bigint as request_chars, coalesce(length(__a.text), -1)::bigint as response_chars from __q left join __a on __a.conv_id = __q.conv_id and __a.turn = __q.turn + 1""",
    "resource_paths": """with __r as (select p_partkey, unnest(['../I/a%20b.png', './x+y.png#f', 'http://x/y.png', '', '/abs/p.png', 'a%zz.png', '../../../up.png']) as ref from part)
        select p_partkey, ref, case ref when '../I/a%20b.png' then 'O/I/a b.png' when './x+y.png#f' then 'O/T' || p_partkey || '/x+y.png' when '/abs/p.png' then 'abs/p.png' when 'a%zz.png' then 'O/T' || p_partkey || '/a%zz.png' when '../../../up.png' then '../up.png' end as path from __r""",
    "model_retries": "select event_id, regexp_matches('HTTP ' || (event_id % 600) || ' ' || event_type, '(?i)429|503|500|rate|internal') as retriable from events",
    "response_rows": """select event_id, '{"type":"response","call_type":"generate","provider":"p","call_id":"' || event_id || '","url":"https://m.example/v1","status_code":' || (200 + event_id % 300) || ',"duration_ms":' || (event_id % 1000)::double || ',"response":"' || event_type || '"}' as line from events""",
    "merged_configs": """select p_partkey, case when p_partkey % 2 = 0 then 'nav a' else 'a' end as chapter_link_selector, case when p_partkey % 3 = 0 then 'article' else 'body' end as chapter_content_selector,
        case when p_partkey % 3 = 0 then p_brand || '|style|script' else 'script|style' end as removed, (case when p_partkey % 5 = 0 then 50 else 1 end)::int as max_toc_pages from part""",
    "preview_topk": f"with {_TITLED} select host, n::bigint as n, page_id, greatest(c - 3, 0)::bigint as more from (select *, row_number() over (partition by host order by page_id) as n, count(*) over (partition by host) as c from __t) where n <= 3",
    "url_resolution": f"""with __r as (select page_id, url, {_BASE} as b, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) as o, regexp_extract(url, '^[a-z]+:', 0) as sc, unnest(['../x', './y?z=1', '?q=2', '#f', '//o.example/p', '/r/../s', 'https://t.example/', '']) as ref from pages),
        __f as (select *, case when b = o then '/' else regexp_replace(b, '[^/]*$', '')[length(o) + 1:] end as folder from __r)
        select page_id, ref, case ref when '' then url when 'https://t.example/' then ref when '//o.example/p' then sc || ref when '#f' then regexp_replace(url, '#.*', '') || '#f' when '?q=2' then b || '?q=2' when '/r/../s' then o || '/s'
        when './y?z=1' then o || folder || 'y?z=1' else o || (case when folder = '/' then '/' else regexp_replace(folder, '[^/]+/$', '') end) || 'x' end as resolved from __f""",
    "normalized_text": "select doc_id, trim(regexp_replace(replace('  ' || chr(9) || text || ' ' || chr(12) || ' x' || chr(10) || ' ', chr(160), ' '), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ' || chr(10)) as text from documents",
    "config_names": f"""with __p as (select page_id, url, list_filter(string_split({_BASE}[length(regexp_extract(url, '^[a-z]+://[^/?#]*', 0)) + 1:], '/'), lambda x: x <> '') as parts from pages)
        select page_id, case when len(parts) > 0 then parts[-1] else replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '.', '-') end as name, regexp_replace(url, '/+$', '') || '/' as with_slash from __p""",
    "first_attempt": "select user_id as url, event_id as attempt, event_type from (select *, row_number() over (partition by user_id order by event_id) as n from events where event_type <> 'error') where n = 1",
    "page_charset": "select page_id, case page_id % 3 when 0 then 'iso-8859-1' else 'utf-8' end as charset, length(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1))::bigint as title_chars from pages",
    "book_chapters": """with __s as (select doc_id // 4 as book, doc_id % 4 + 1 as number, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(regexp_replace(v, '[ \\t\\r\\f\\x0B]+', ' ', 'g'))), lambda v: v <> '') as lines from documents)
        select book, number::bigint as number, 'Chapter ' || number as title, 'Chapter ' || number || chr(10) || chr(10) || '[[ILLUSTRATION:' || lpad(number::varchar, 3, '0') || '-001.png]]' ||
        case when len(lines) > 0 then chr(10) || chr(10) || array_to_string(lines, chr(10) || chr(10)) else '' end || chr(10) as text from __s""",
    "book_illustrations": """select doc_id // 4 as book, row_number() over (partition by doc_id // 4 order by doc_id)::bigint as image_index, (doc_id % 4 + 1)::bigint as number, lpad((doc_id % 4 + 1)::varchar, 3, '0') || '-001.png' as file from documents""",
    "selectors_structural": r"""with __n as (select page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) as nav, html from pages),
        __l as (select page_id, html, regexp_extract_all(nav, '<li><a href="([^"]*)">', 1) as h, regexp_extract_all(nav, '<li><a href="[^"]*">(.*?)</a></li>', 1) as a from __n),
        __p as (select *, list_filter(list_zip(h, a), lambda x: x[1] <> '/the' and not contains(x[1], ',')) as plain from __l),
        __r as (select page_id, unnest([
            {'k': 'sibling', 'm': case when regexp_matches(html, '</h1>\s*<p[ >]') then 1 else 0 end, 'f': null}, {'k': 'siblings', 'm': 1, 'f': null}, {'k': 'nth', 'm': (len(a) + 1) // 2, 'f': a[1]},
            {'k': 'nth_last', 'm': case when len(a) > 1 then 1 else 0 end, 'f': a[len(a) - 1]}, {'k': 'last', 'm': 1, 'f': a[len(a)]}, {'k': 'not', 'm': len(plain), 'f': plain[1][2]}, {'k': 'has', 'm': 1, 'f': null},
            {'k': 'quoted', 'm': len(list_filter(h, lambda x: x = '/the,')), 'f': null}, {'k': 'list', 'm': 2, 'f': null}, {'k': 'type', 'm': 1, 'f': null}, {'k': 'bad', 'm': null, 'f': null}, {'k': 'element', 'm': null, 'f': null}], recursive := true) from __p)
        select page_id, k as selector_key, m::bigint as matches, f as first from __r""",
    "selector_faults": r"""with __l as (select page_id, regexp_extract(html, '<li><a href="/([^"]*)"', 1) as w, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"', 1) as h from pages)
        select page_id, case when page_id % 4 > 0 then 'selector not understood' end as wrong, case when page_id % 4 = 0 then len(list_filter(h, lambda x: x = '/' || w)) end::bigint as matches from __l""",
    "damaged_books": """select doc_id // 4 as book, case (doc_id // 4) % 6 when 2 then 'Book' || chr(160) || (doc_id // 4) when 0 then 'Book ' || (doc_id // 4) when 1 then 'Book ' || (doc_id // 4) end as title,
        case when (doc_id // 4) % 6 < 3 then count(*) else 0 end::bigint as n_chapters,
        case (doc_id // 4) % 6 when 3 then 'package document' when 4 then 'META-INF/container.xml does not declare a rootfile' when 5 then 'not an archive' end as wrong from documents group by doc_id // 4""",
    "book_titles": "select doc_id // 4 as book, 'Book ' || (doc_id // 4) as title, 'src' || (doc_id // 4) as author, count(*)::bigint as n_sections from documents group by all",
}
