"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact, html, jaccard, langid, lm, pieces, secrets, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_html_text": html.op3_html_text,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_language_id": langid.op7_language_id,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_lm_score": lm.op10_lm_score,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: What SQL can express on whole tables; the other operators are tested against brute force.
SQL: dict[str, str] = {
    "op2_exact_dedup": exact.SQL,
    "op4_substring_dedup": rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
win as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50),
keyed as (select doc_id, p, array_to_string(ws[p:p + 49], ' ') as k from win),
least as (select k, min(doc_id) as m from keyed group by k),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as i from keyed join least using (k) where m < doc_id),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w where len(ws) > 0),
kept as (select words.doc_id, string_agg(word, ' ' order by words.i) as t, count(*) as n from words anti join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
""",
    "op9_ngram_jaccard": rf"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
g as (select distinct doc_id, array_to_string(ws[p:p + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as p from w where len(ws) > 0)),
z as (select doc_id, count(*) as n, md5(string_agg(s, chr(1) order by s)) as k from g group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b, za.k as ka, zb.k as kb from pairs join z za on a = za.doc_id join z zb on b = zb.doc_id where pairs.n >= cast(0.8 as double) * (za.n + zb.n - pairs.n) - cast(1e-9 as double)),
reach(node, root) as (select a, b from links union select reach.node, links.b from reach join links on reach.root = links.a),
class as (select node, least(node, min(root)) as class_id from reach group by node),
classed as (select doc_id, coalesce(class_id, doc_id) as class_id from w left join class on doc_id = node),
sized as (select class_id, count(*) as class_size from classed group by class_id),
n as (select a, count(*) as n_links, count(distinct case when ka <> kb then kb end) as n_text_links from links group by a)
select doc_id, class_id, cast(coalesce(n_links, 0) as bigint) as n_links, cast(coalesce(n_text_links, 0) as bigint) as n_text_links, cast(class_size as bigint) as class_size
from classed join sized using (class_id) left join n on a = doc_id
""",
}
