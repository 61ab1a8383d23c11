"""SQL for DuckDB of the operators' contracts, where it can express them: other ways to the same rows."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs of documents that share a shingle, counted; components by following links.
NEAR_DUPLICATES = f"""
    with recursive w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as ws from documents
    ),
    sh as (
        select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
            else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from w
    ),
    n as (select doc_id, count(*) as n from sh group by doc_id),
    shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
    pairs as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
    links as (select a, b from pairs union all select b, a from pairs),
    reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
    named as (select a, min(b) as low from reached group by a)
    select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id,
           d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
    from documents d left join n on n.doc_id = d.doc_id left join named on named.a = d.doc_id
"""

#: Every string of 100 bytes is written out; all but its first place are cut.
REPEATS = """
    with d as (select doc_id, encode(coalesce(text, '')) as t from documents),
    g as (select doc_id, i, t[i:i + 99] as s from (select doc_id, t, unnest(range(1, octet_length(t) - 98)) as i from d)),
    later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as place from g) where place > 1),
    marked as (select *, (not coalesce(i - lag(i) over w <= 100, false))::int as starts from later window w as (partition by doc_id order by i)),
    runs as (
        select doc_id, min(i) as low, max(i) + 100 as high
        from (select doc_id, i, sum(starts) over (partition by doc_id order by i rows unbounded preceding) as run from marked) group by doc_id, run
    ),
    pieces as (
        select doc_id, high as low, coalesce(lead(low) over (partition by doc_id order by low), 1000000000000) - 1 as high from runs
        union all select d.doc_id, 1, coalesce(min(low), 1000000000000) - 1 from d left join runs on runs.doc_id = d.doc_id group by d.doc_id
    ),
    kept as (
        select d.doc_id, sha256(unhex(string_agg(case when low <= octet_length(t) then hex(t[low:least(high, octet_length(t))]) else '' end, '' order by low))) as kept_sha256
        from pieces join d on d.doc_id = pieces.doc_id group by d.doc_id
    ),
    counted as (select doc_id, sum(high - low) as n_removed, count(*) as n_spans from runs group by doc_id)
    select d.doc_id, octet_length(t)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, kept_sha256
    from d join kept on kept.doc_id = d.doc_id left join counted on counted.doc_id = d.doc_id
"""

#: Counts of all terms and sources, also of those that don't occur, so that no share is left out.
DIVERGENCE = f"""
    with d as (
        select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
               regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents
    ),
    used as (select row, lang, source, unnest(terms) as item from d),
    kept as (select lang, item from used group by lang, item having count(distinct row) >= 30),
    v as (select lang, count(*) as v from kept group by lang),
    groups as (select distinct lang, source from d),
    n as (select lang, source, item, count(*) as n from used semi join kept using (lang, item) group by all),
    grid as (select g.lang, g.source, k.item, coalesce(n.n, 0) as n from groups g join kept k on k.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.item = k.item),
    p as (select lang, source, item, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from grid join v using (lang)),
    whole as (select lang, item, sum(n) as n from grid group by all),
    q as (select lang, item, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from whole join v using (lang)),
    sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.item = b.item and a.source <> b.source group by all),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
              left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    both_parts as (select * from pairs union all select lang, source, 'term', item, p - q from p join q using (lang, item) where n > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
    select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""

#: Digits of a SHA-1 in hexadecimal, five at a time, are four characters in base 32.
ARCHIVES = """
    with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
    s as (select page_id, payload, upper(sha1(payload)) as hex, min(page_id) over (partition by payload) as low, octet_length(payload)::bigint as payload_bytes from p),
    parts as (select page_id, list_transform(range(8), lambda i: ('0x' || hex[5 * i + 1:5 * i + 5])::int) as fives from s),
    digests as (select page_id, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), '') as payload_digest from parts)
    select s.page_id, payload_bytes, payload_digest, case when s.page_id = low then 'response' else 'revisit' end as record_type, case when s.page_id <> low then low end as refers_to
    from s join digests on digests.page_id = s.page_id
"""

#: Every anchor against every row; components are whole numbers, so sums are exact in any order.
HARD_NEGATIVES = """
    with v as (
        select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding::double[], lambda x: floor(256 * x)) as v from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    scored as (select a.id as anchor_id, a.label as anchor_label, b.id, b.label, list_dot_product(a.v, b.v)::bigint as score from v a join v b on len(a.v) = len(b.v) and a.id <> b.id where a.id % 100 = 0),
    ranked as (select *, row_number() over (partition by anchor_id order by score desc, id) as k from scored where label = anchor_label),
    found as (
        select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank, n.id as negative_id, p.score as positive_score, n.score as negative_score
        from ranked p join scored n on n.anchor_id = p.anchor_id and n.label <> n.anchor_label and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score where p.k <= 5
    )
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from found where rank <= 5
"""
