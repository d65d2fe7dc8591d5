"""The queries of this subpackage: one for each operator, and the pipeline.

Each query is thin: it reads its table, applies an operator with production
parameters to all rows and derives the columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, fim, fingerprint, html_extract, katz, langid, piece_fst, probminhash, quality, resample, tokenout, toxicity
from .common import crc_mod, shared_dir, table


#: The chain's categories, in order, over the columns of `labels`; the last one is the decision.
TOXICITY = {"nuisance": "1 - quality", "toxic": "toxic"}


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op2_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(langid.training_rows(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_nuisance, p_toxic, toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), TOXICITY)
    return toxicity.predict(docs, chain, list(TOXICITY))


def op4_boosted_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op5_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return katz.score(table(spark, sf_dir, "documents"), mod=5, rest=1)


def op7_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    found = quality.predict(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file (a parameter of the operators that need one)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files."""
    folder = f"{shared_dir(spark)}/tokens"
    parts = tokenout.write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenout.read_tokens(spark, folder, parts)


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, exact (decoding the ids gives the text back)."""
    return piece_fst.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of its class)."""
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_chunk_memo_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    found = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op12_quickselect_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    found = fingerprint.spliced(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


# DuckDB: the words of the contract, and the two queries that SQL can answer in full.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_SQL = f"""with i as (select item_id, {_WORDS} as w from benchmark), b as (select item_id, w, least(13, len(w)) as n from i where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[k : k + n - 1], ' ') as s from b, unnest(generate_series(1, len(w) - n + 1)) as t(k)),
d as (select doc_id, {_WORDS} as w from documents), l as (select distinct n from b),
dw as (select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as s from d, l, unnest(generate_series(1, len(w) - n + 1)) as t(k)),
m as (select doc_id, k, dw.n, item_id from dw join win using (n, s)), h as (select doc_id, count(distinct p) as n_hit from m, unnest(generate_series(k, k + n - 1)) as t(p) group by doc_id),
f as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as items from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join h using (doc_id) left join f using (doc_id)"""

CLASSES_SQL = f"""with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, sh, count(*)::double as c from (select doc_id, case when len(w) >= 5 then array_to_string(w[k : k + 4], ' ') else array_to_string(w, ' ') || ' .' end as sh from d, unnest(generate_series(1, greatest(1, len(w) - 4))) as t(k) where len(w) > 0) group by all),
n as (select doc_id, sum(c) as total from s group by doc_id), m as (select a.doc_id as a, b.doc_id as b, a.c as x, b.c as y, count(*) as m from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
o as (select m.a, m.b, max(p.total) - sum(m * x) as ox, max(q.total) - sum(m * y) as oy from m join n p on p.doc_id = m.a join n q on q.doc_id = m.b group by all),
i as (select i.a, i.b, i.m, i.x, i.y, sum(j.m * greatest(j.x / i.x, j.y / i.y)) as common from m i join m j on i.a = j.a and i.b = j.b group by all),
e as (select a, b from i join o using (a, b) group by all having sum(m / (common + ox / x + oy / y)) >= 0.8 - 1e-9), g as (select a, b from e union all select b, a from e),
r(doc_id, reached) as (select doc_id, doc_id from d union select r.doc_id, g.b from r join g on g.a = r.reached)
select doc_id, min(reached) as class_id from r group by doc_id"""

# DuckDB has no CRC-32: it is taken over the bytes of each distinct feature, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(0, strlen(f)), lambda i: cast('0x' || substr(hex(encode(f)), cast(2 * i + 1 as int), 2) as bigint)), lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), cast(4294967295 as bigint)), 4294967295)"""

RESAMPLING_SQL = f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select {_WORDS} as w from benchmark),
df as (select doc_id, unnest(w) as f from d union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from d where len(w) > 1),
bf as (select unnest(w) as f from b union all select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from b where len(w) > 1),
fb as (select f, {_CRC} % 10000 as bucket from (select f from df union select f from bf)),
s as (select bucket, count(*) as n from df join fb using (f) group by bucket), t as (select bucket, count(*) as n from bf join fb using (f) group by bucket),
g as (select bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from df) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from bf) + 10000)::double))) as bigint) as gain from s full join t using (bucket)),
w as (select doc_id, count(*) as n_features, cast(floor(sum(gain)::double / count(*)) as bigint) as weight from df join fb using (f) join g using (bucket) group by doc_id),
c as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) as h from d left join w using (doc_id)),
o as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from c),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from o where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= (select 25 * count(*) // 100 from r) then rank end as rank from o left join r using (doc_id)"""


FIM_SQL = """with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || doc_id) as x from documents),
h as (select *, len(w) as n, list_transform([1, 9, 17, 25], lambda k: cast('0x' || substr(x, k, 8) as bigint)) as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as u, greatest(h[1] % (n + 1), h[2] % (n + 1)) as v,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(w[1 : u], '') as a, array_to_string(w[u + 1 : v], '') as b, array_to_string(w[v + 1 : n], '') as z from c)
select doc_id, n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(b) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) as output_sha256, sha256(text) as restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {"op11_chunk_memo_fim": FIM_SQL, "op5_suffix_decontamination": CONTAMINATION_SQL, "op10_probminhash": CLASSES_SQL, "op12_quickselect_resampling": RESAMPLING_SQL}
