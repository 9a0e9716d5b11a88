"""Queries of the operators of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tracewell.llm import exact_dedup, fingerprint, line_dedup, mixing, ngram_join, quality, sentencepiece, toxicity, url_filter, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    """Words that a mix of all sources by 5, 2, 1 takes of each document."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    """Each page as its WARC record reads after a round trip through archives."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_quality(spark, sf_dir):
    """Quality of each document by weighted rules over its statistics."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ngram_join(spark, sf_dir):
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_sentencepiece(spark, sf_dir):
    """Token ids of each document, and whether decoding restores its text."""
    return sentencepiece.encode_documents(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    """The verdict on each page's url."""
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op7_fingerprint(spark, sf_dir):
    """Fingerprints of each document and of its edited text, and their likeness."""
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    """The document that stays for each document."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    """Toxicity of each document by its best segment of token log-odds."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark, sf_dir):
    """Each document without later copies of repeated runs of lines with 50 words or more."""
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_warc, op3_quality, op4_ngram_join, op5_sentencepiece, op6_url_filter, op7_fingerprint, op8_exact_dedup, op9_toxicity, op10_line_dedup)}

_MIX = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5('42:' || coalesce(cast(doc_id as varchar), '')) as o
  from {docs}),
src as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
wts as (select *, case (row_number() over (order by source is null, encode(source)) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from src),
lv as (
  select *, sum(w) over (order by source_size / w, source is null, encode(source) rows between current row and unbounded following) as above,
    (select sum(source_size) from src) - coalesce(sum(source_size * 3) over (order by source_size / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as rest
  from wts),
op as (select rest, above from lv where not rest * w > source_size * 3 * above order by source_size / w limit 1),
goal as (
  select source, source_size, case when lv.rest * w > source_size * 3 * lv.above or op.rest is null then cast(source_size * 3 as double)
    else least(cast(source_size * 3 as double), cast(cast(op.rest * w as bigint) as double) / cast(op.above as double)) end as target
  from lv left join op on true),
n as (select cast(round(sum(target) / 8) as bigint) as seats from goal),
q as (
  select source, row_number() over (order by target / (2 * k + 1) desc, coalesce(hex(source), '~'), k) as r
  from goal, n, (select unnest(generate_series(0, (select seats from n))) as k) where target > 0 and k <= 3 * seats * target / (select sum(target) from goal) + 3),
quota as (select source, count(*) as quota from q, n where r <= seats group by source),
shard as (select source, cast(('0x' || substr(o, 1, 8)) as bigint) % 1024 as t, cast(sum(size) as bigint) as shard_size from sized group by all),
part as (select s.*, g.source_size, g.target, coalesce(quota, 0) as quota from shard s join goal g on s.source is not distinct from g.source left join quota q on s.source is not distinct from q.source),
sq as (
  select source, t, quota, row_number() over (partition by source order by shard_size / (2 * k + 1) desc, t, k) as r
  from part, lateral (select unnest(generate_series(0, cast(3 * quota * shard_size / greatest(source_size, 1) + 3 as bigint))) as k) where shard_size > 0),
won as (select source, t, count(*) as c from sq where r <= quota group by all),
take as (select p.*, least(coalesce(c, 0) * 8, shard_size * 3) as take from part p left join won w on p.source is not distinct from w.source and p.t = w.t),
seq as (select *, cast(('0x' || substr(o, 1, 8)) as bigint) % 1024 as t, coalesce(sum(size) over (partition by source, cast(('0x' || substr(o, 1, 8)) as bigint) % 1024 order by o, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from sized)
select s.doc_id, s.source, s.size, k.source_size, k.target,
  cast(take // greatest(shard_size, 1) * s.size + greatest(0, least(s.size, take - take // greatest(shard_size, 1) * shard_size - before)) as bigint) as taken
from seq s join take k on s.source is not distinct from k.source and s.t = k.t
"""

ORACLES = {
    "op1_mixing": _MIX.format(docs="documents", text="text"),
    "op8_exact_dedup": r"""
with h as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as s from documents),
g as (select *, first_value(doc_id) over (partition by s order by n desc, doc_id nulls last) as keep_id, count(*) over (partition by s) as c from h)
select doc_id, keep_id, c as group_size, doc_id is not distinct from keep_id as kept, s as text_sha256 from g
""",
    "op2_warc": r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha256(b) as s from p),
m as (select *, min(page_id) over (partition by s) as first from d)
select page_id, cast(n as bigint) as payload_bytes, s as payload_digest, case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id <> first then first end as refers_to from m
""",
    "op4_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
n as (select doc_id, len(s) as n from s),
k as (select doc_id, unnest(s) as k from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from k a join k b on a.k = b.k and a.doc_id < b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e2 as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id as reach from n union select r.doc_id, e2.b from r join e2 on e2.a = r.reach)
select n.doc_id, cast(n as bigint) as n_shingles, min(reach) as component_id from n join r on r.doc_id = n.doc_id group by all
""",
    "op10_line_dedup": r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
f as (select doc_id, pos, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') as norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as wc from l),
k as (select *, row_number() over (partition by doc_id order by pos) as k, sum(wc) over (partition by doc_id order by pos) as c from f where wc > 0),
g as (select doc_id, list(norm order by k) as norms, count(*) as n from k group by doc_id),
fw as (select a.doc_id, a.k as s, min(b.k) as e from k a join k b on a.doc_id = b.doc_id and b.k >= a.k and b.c - a.c + a.wc >= 50 group by all),
bw as (select b.doc_id, max(a.k) as s, b.k as e from k a join k b on a.doc_id = b.doc_id and b.k >= a.k and b.c - a.c + a.wc >= 50 group by b.doc_id, b.k),
r as (select * from fw union select doc_id, s, e from bw),
named as (select r.*, array_to_string(norms[s:e], chr(10)) as name from r join g using (doc_id)),
later as (select *, row_number() over (partition by name order by doc_id, s) as copy from named),
gone as (select distinct k.doc_id, k.pos from later join k on k.doc_id = later.doc_id and k.k between s and e where copy > 1),
rest as (select l.doc_id, string_agg(line, chr(10) order by l.pos) as text from l left join gone on gone.doc_id = l.doc_id and gone.pos = l.pos where gone.pos is null group by l.doc_id),
removed as (select doc_id, count(*) as x from gone group by doc_id)
select d.doc_id, case when d.text is null then null when x is null then d.text when x = n then '' else rest.text end as text, cast(coalesce(n, 0) as bigint) as n_lines, cast(coalesce(x, 0) as bigint) as n_removed
from documents d left join g on g.doc_id = d.doc_id left join removed on removed.doc_id = d.doc_id left join rest on rest.doc_id = d.doc_id
""",
}
