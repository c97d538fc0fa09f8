"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bpe import bpe_decode, bpe_encode
from docspark.llm.collocations import collocations
from docspark.llm.divergence import source_divergence
from docspark.llm.fingerprints import fingerprints
from docspark.llm.language import languages
from docspark.llm.licenses import license_scan
from docspark.llm.neighbours import nearest
from docspark.llm.ngram_join import ngram_jaccard_join
from docspark.llm.packing import concatenate_and_cut
from docspark.llm.pii import KINDS, joined, personal_data
from docspark.llm.quality import quality_scores
from docspark.llm.sentencepieces import sentencepiece_decode, sentencepiece_encode
from docspark.llm.url_filter import url_verdicts

QUERIES: dict = {}
ORACLE: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _query(f):
    QUERIES[f.__name__] = f
    return f


#: Equal sets are one node; nodes that share a shingle are compared; components are followed from node to node.
ORACLE["op1_ngram_jaccard"] = r"""
with recursive w as (select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
  s as (select id, doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')] else list_sort(list_distinct(list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2])))) end as items from w),
  k as (select id, doc_id, len(items) as n, md5(array_to_string(items, chr(10))) as node, items from s),
  nodes as (select node, min(doc_id) as rep, any_value(n) as n, any_value(items) as items from k where n > 0 group by node),
  i as (select node, n, unnest(items) as item from nodes),
  p as (select a.node as x, b.node as y from i a join i b on a.item = b.item and a.node <> b.node group by a.node, b.node, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
  r(node, reached) as (select node, node from nodes union select r.node, p.y from r join p on r.reached = p.x),
  c as (select r.node, min(m.rep) as component_id from r join nodes m on r.reached = m.node group by r.node),
  d as (select x as node, count(*) as links from p group by x)
select k.doc_id, k.n::bigint as n_shingles, coalesce(c.component_id, k.doc_id) as component_id, coalesce(d.links, 0)::bigint as links
from k left join c on k.node = c.node and k.n > 0 left join d on k.node = d.node and k.n > 0"""


@_query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@_query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = concatenate_and_cut(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_50k.json")
    done = bpe_decode(bpe_encode(_table(spark, sf_dir, "documents"), path), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return languages(docs, docs)


@_query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digest are those of the base spans, which the contract fixes; what the method adds is in spans."""
    found = personal_data(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


@_query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


@_query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_bytes is where the last span ends: the bytes of the text, if spans cover it whole."""
    path = _vocabulary("piece_bpe_32k.model")
    done = sentencepiece_decode(sentencepiece_encode(_table(spark, sf_dir, "documents"), path), path)
    n_tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return done.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("bounds", -1).cast("long").alias("n_bytes"))


#: Every word is a row; every kept term meets every source of its language.
ORACLE["op11_divergence"] = r"""
with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
  w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
  c as (select lang, source, term, count(*)::hugeint as n, count(distinct id) as docs from w group by all),
  kept as (select lang, term, sum(n)::hugeint as total from c group by all having sum(docs) >= 3),
  v as (select lang, count(*)::hugeint as v, sum(total)::hugeint as n from kept group by all),
  g as (select distinct lang, source from d),
  gn as (select lang, source, sum(n)::hugeint as n from c join kept using (lang, term) group by all),
  cells as (select g.lang, g.source, k.term, coalesce(c.n, 0) as count, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(gn.n, 0) + v.v) as p, 1 + (1000000000 * (k.total + 1)) // (v.n + v.v) as q
    from g join kept k using (lang) join v using (lang) left join gn using (lang, source) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
  sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
  terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from cells where count > 0 and p > q),
  parts as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms),
  ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200"""


@_query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


#: Every run of one to five words of every piece is a row.
ORACLE["op12_collocations"] = r"""
with d as (select row_number() over () as id, coalesce(lang, 'und') as lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
  p as (select id, lang, unnest(pieces) as piece from d),
  w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
  totals as (select lang, sum(len(words))::hugeint as n from w group by lang),
  sizes as (select unnest([1, 2, 3, 4, 5]) as size),
  runs as (select lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i : i + size - 1], ' '))) as phrase from w, sizes where len(words) >= size),
  f as (select lang, size, phrase, count(*)::hugeint as f from runs group by all having count(*) >= 100),
  cand as (select *, string_split(phrase, ' ') as words from f where size >= 2),
  cuts as (select lang, phrase, size, words, f, unnest(range(1, size)) as k from cand),
  scored as (select c.lang, c.phrase, c.size, c.f as a, k, l.f as l, r.f as r, t.n, (1000 * c.f * t.n) // (l.f * r.f) as score
    from cuts c join totals t using (lang) join f l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.words[k + 1 :], ' ')),
  best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
  inside as (select lang, unnest([array_to_string(words[1:size - 1], ' '), array_to_string(words[2:], ' ')]) as phrase, f from cand where size > 2),
  over as (select lang, phrase, max(f) as f from inside group by all),
  kept as (select b.* from best b left join over o on o.lang = b.lang and o.phrase = b.phrase where o.f is null or 100 * o.f < 100 * b.a),
  ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000"""


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))
