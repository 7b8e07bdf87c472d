"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, divergence, embeddings, licenses, neardup, packing, quality, resample, rollup, secrets, toxicity, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_secret_scan": secrets.query,
        "op3_benchmark_decontamination": decontaminate.query,
        "op4_quality_classifier": quality.query,
        "op5_embedding_near_dedup": embeddings.query,
        "op6_chat_formatting": chat.query,
        "op7_license_scan": licenses.query,
        "op8_toxicity": toxicity.query,
        "op9_minhash_near_dedup": neardup.query,
        "op10_token_rollup": rollup.query,
        "op11_importance_resampling": resample.query,
        "op12_source_divergence": divergence.query,
        "op13_warc": warc.query,
    }


#: All pairs of a label, and what is reachable by links.
EMBEDDINGS = f"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
 l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {embeddings.THRESHOLD}),
 r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on l.a = r.b),
 c as (select a, min(b) as component_id from r group by 1), n as (select a, count(*) as n from l group by 1)
 select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v join c on c.a = vec_id left join n on n.a = vec_id"""

#: What escaping adds to a text: the lengths of the stand-ins for the first sign of each control string.
_ADDED = r"coalesce(list_sum([case when m = '&' then 4 when m = '|>' then 5 when starts_with(m, '[') then 5 else 3 end for m in regexp_extract_all({0}, '&|<\||\|>|</?s>|\[/?INST\]|<</?SYS>>')]), 0)"
_SAID = "'</s>[INST] ok [/INST]'"
CHAT = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-1, 0, 'user', {_SAID}), (-1, 1, 'assistant', {_SAID}))
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 sum(24 + length(role) + 8 * (length(role) - length(replace(role, chr(10), ''))) + length(text) + {_ADDED.format("role")} + {_ADDED.format("text")})::bigint as formatted_chars from t group by conv_id"""

#: Every pair that shares a shingle, and what is reachable by links.  A shingle weighs tf * (1 + log(N / df) to the base s^3),
#: where s is 1000 or less and a text in s is the rarest that counts.
NEAR = f"""with recursive w as (select doc_id, list_filter([lower(regexp_replace(c, '[^\\p{{L}}\\p{{N}}]', '', 'g')) for c in string_split_regex(coalesce(text, ''), '\\s+')], lambda x: x <> '') as w from documents),
 s0 as (select doc_id, unnest(case when len(w) < {neardup.WORDS} then [w] else [w[i:i+{neardup.WORDS - 1}] for i in range(1, len(w) - {neardup.WORDS - 2})] end) as s from w where len(w) > 0),
 s1 as (select doc_id, hash(s) as s, count(*) as tf from s0 group by 1, 2), df as (select s, count(*) as df from s1 group by 1),
 q as (select count(*)::double as n, least({neardup.RAREST}, count(*), {2 * neardup.LIMIT} / avg(length(coalesce(text, '')))::double) as s0 from documents),
 s as (select doc_id, s, tf * case when s0 > 1 then 1 + least(ln(n / df) / ln(s0 ** {neardup.DAMPING}), 1.0 / {neardup.DAMPING}) else 1 end as x from s1 join df using (s), q), z as (select doc_id, sum(x) as z from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, sum(least(a.x, b.x)) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
 l as (select a, b from p join z za on za.doc_id = a join z zb on zb.doc_id = b where i / (za.z + zb.z - i) >= {neardup.THRESHOLD} - 1e-12),
 r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b)
 select a as doc_id, min(b) as class_id, a = min(b) as kept from r group by a"""


def _license_sql() -> str:
    """Words by pattern, every run of words against every run of the templates, votes by diagonal, neighbours merged, shares held."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [(label, phrase, True, len(phrase.split())) for phrase, label in licenses.BASE.items()] + [(label, text, False, licenses.K) for label, text in licenses.TEMPLATES]
    told = ", ".join(f"({i}, {quoted(label)}, {quoted(text)}, {base}, {k})" for i, (label, text, base, k) in enumerate(rows))
    words = lambda t: f"regexp_extract_all(translate({t}, '{licenses.CAPITALS}', '{licenses.SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = lambda k: f"[array_to_string(w[i:i+{k}-1], ' ') for i in range(1, len(w)-{k}+2)]"
    sizes = sorted({r[3] for r in rows})
    return f"""with d as (select row_number() over () as row, doc_id, {words("coalesce(text, '')")} as w from documents),
 t as (select id, label, {words("text")} as w, base, k from (values {told}) v(id, label, text, base, k)),
 tg as (select id, label, base, k, len(w)-k+1 as runs, unnest({runs("k")}) as g, unnest(range(0, len(w)-k+1)) as pos from t),
 dg as ({" union all ".join(f"select row, {k} as k, unnest({runs(k)}) as g, unnest(range(0, len(w)-{k}+1)) as place from d" for k in sizes)}),
 hit as (select row, id, label, base, runs, place, pos from dg join tg using (k, g)),
 b as (select row, count(*) as n, min(place) as f, max(place) as l, list_sort(list(distinct label)) as labels from hit where base group by 1),
 v as (select row, id, label, runs, place - pos as diagonal, list(distinct pos) as ats from hit where not base group by all),
 s as (select *, sum(new) over (partition by row, id order by diagonal) as span from (select *, case when diagonal - lag(diagonal) over (partition by row, id order by diagonal) <= {licenses.APART} then 0 else 1 end as new from v)),
 m as (select row, label, count(distinct pos)/runs as share from (select row, id, label, runs, span, unnest(ats) as pos from s) group by row, id, label, runs, span),
 o as (select row, list(distinct label) as labels, max(share) as share from m where share >= {licenses.COVERED} group by 1)
 select doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.f::bigint as first_word, b.l::bigint as last_word, coalesce(array_to_string(b.labels, ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(o.labels, []))), ','), '') as labels, greatest(coalesce(o.share, 0.0), case when b.n > 0 then 1.0 else 0.0 end)::double as score
 from d left join b using (row) left join o using (row)"""


#: CRC-32 by its table of 256 entries, made by eight steps of the reversed polynomial each; bytes are read off the hexadecimal text.
_CRC = """crc_table as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i)) as t),
 crc as (select word, xor(4294967295, list_reduce(list_transform(range(1, strlen(word) * 2, 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::bigint), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) as crc from (select distinct word from (select word from said union all select word from wanted)), crc_table)"""
RESAMPLE = f"""with docs as (select row_number() over () as line, doc_id, text from documents),
 said as (select line, unnest(regexp_extract_all(translate(coalesce(text, ''), '{resample.CAPITALS}', '{resample.SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from docs),
 wanted as (select unnest(regexp_extract_all(translate(coalesce(text, ''), '{resample.CAPITALS}', '{resample.SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from benchmark), {_CRC},
 b as (select word, crc % {resample.BUCKETS} as bucket from crc), s as (select bucket, count(*) as s from said join b using (word) group by 1), t as (select bucket, count(*) as t from wanted join b using (word) group by 1),
 g as (select range as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from said) + {resample.BUCKETS})::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from wanted) + {resample.BUCKETS})::double)))::bigint as gain from range({resample.BUCKETS}) left join s on s.bucket = range left join t on t.bucket = range),
 w as (select line, count(*) as n, floor(sum(gain) / count(*))::bigint as weight from said join b using (word) join g using (bucket) group by line),
 d as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{resample.SEED}:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score from docs left join w using (line)),
 r as (select *, row_number() over (partition by n_features >= {resample.LEAST_WORDS} order by score desc, doc_id nulls last) as place from d)
 select doc_id, n_features, weight, score, case when n_features >= {resample.LEAST_WORDS} and place <= (select count(*) from d where n_features >= {resample.LEAST_WORDS}) * {resample.PERCENT} // 100 then place end as rank from r"""


_SHARE = "(1 + (1000000000::hugeint * ({0} + 2)) // ({1} + 2 * v))::hugeint"
DIVERGENCE = f"""with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{resample.CAPITALS}', '{resample.SMALL}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
 t as (select row, lang, source, unnest(w) as term from d), kept as (select lang, term, count(*) as of_lang from t group by 1, 2 having count(distinct row) >= {divergence.LEAST_DOCS}),
 g as (select distinct lang, source from d), c as (select lang, source, term, count(*) as c from t join kept using (lang, term) group by 1, 2, 3),
 v as (select lang, count(*) as v, sum(of_lang) as n_lang from kept group by 1), n as (select lang, source, coalesce(sum(c), 0) as n from g left join c using (lang, source) group by 1, 2),
 s as (select lang, source, term, coalesce(c, 0) as c, {_SHARE.format("coalesce(c, 0)", "n")} as p, {_SHARE.format("of_lang", "n_lang")} as q from n join v using (lang) join kept using (lang) left join c using (lang, source, term)),
 pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
 f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from s where c > 0 and p > q),
 r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from f)
 select lang, source, part, item, value, rank::integer as rank from r where part = 'pair' or rank <= {divergence.TOP}"""


#: Five hexadecimal signs are four of base 32.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(sha1(payload), (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)::int) & 31))::int, 1)), '')"
WARC = f"""with p as (select page_id, coalesce(html, '') as payload from pages), f as (select payload, min(page_id) as first from p where strlen(payload) >= {warc.LEAST_BYTES} group by 1)
 select page_id, strlen(payload)::bigint as payload_bytes, {_BASE32} as payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type, case when page_id <> first then first end as refers_to from p left join f using (payload)"""


def oracle_sql() -> dict:
    return {"op7_license_scan": _license_sql(), "op5_embedding_near_dedup": EMBEDDINGS, "op6_chat_formatting": CHAT, "op9_minhash_near_dedup": NEAR, "op11_importance_resampling": RESAMPLE, "op12_source_divergence": DIVERGENCE, "op13_warc": WARC}
