"""One query for each operator, over its whole table with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, dartminhash, decontam, editprint, linededup, ranked, secrets, spm, substrings, tokencounts, toolchat, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.SecretScan(secrets.fit(docs)).spans(docs)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.near(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_counts(table(spark, sf_dir, "documents"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolchat.formatted(toolchat.asked(table(spark, sf_dir, "conversations")), toolchat.ASK)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(table(spark, sf_dir, "pages")).index()


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings")).drop("refined")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_edit_fingerprint, op4_token_counts, op5_tool_calls, op6_sentencepiece, op7_decontamination, op8_dartminhash, op9_warc, op10_substring_dedup, op11_code_compression, op12_line_dedup, op13_lexical_search)}


def _rounds(n: int) -> str:
    """Codebooks b1 ... bn, each from the one before: parts go to their nearest entries, which move to the mean."""
    one = """a{k} as materialized (select vec_id, part, min(d * 16 + entry) % 16 as entry, min(d * 16 + entry) // 16 as d from (select vec_id, part, entry, sum((x - y) * (x - y)) as d from v join b{k} using (part, pos) group by all) group by all)"""
    move = """b{m} as materialized (select part, entry, pos, cast(coalesce((s - (s % n + n) % n) // n, y) as bigint) as y from b{k} left join (select part, entry, pos, cast(sum(x) as bigint) as s, count(*) as n from v join a{k} using (vec_id, part) group by all) using (part, entry, pos))"""
    return ", ".join(one.format(k=k) + ("" if k == n else ", " + move.format(k=k, m=k + 1)) for k in range(n + 1))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Where SQL states the whole result. Random fields, tokenizers, embeddings and signatures are tested against brute force instead.
SQL = {
    "op5_tool_calls": r"""with c as (select conv_id, turn, coalesce(text, '') as t, coalesce(role = 'user', false) as is_call, coalesce(role = 'assistant', false) as is_result,
  case role when 'user' then 'call' when 'assistant' then 'tool' else role end as role, case role when 'user' then turn when 'assistant' then turn - 1 end as asks from conversations),
 w as (select *, case when is_call or is_result then 'reply' end as name, 'c' || conv_id || 't' || asks as call_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as words from c),
 l as (select conv_id, call_id, min(turn) filter (where is_call) as first, count(*) filter (where is_result) as results from w where call_id is not null group by all),
 s as (select w.*, case when is_call and turn <> first then 'repeated' when is_call and results = 0 then 'open' when is_call then 'call' when is_result and first is null then 'orphan' when is_result then 'result' else 'said' end as state,
  first, case when is_call then case when length(t) > 256 then 'bounds:question' when words < 3 then 'bounds:words' else 'ok' end end as valid,
  case when is_call then '{"characters":' || length(t) || ',"question":' || cast(to_json(t) as varchar) || ',"words":' || words || '}' else t end as content from w left join l on w.conv_id = l.conv_id and w.call_id = l.call_id)
 select conv_id, case when state = 'result' then first else turn end as at, case when state = 'result' then 1 else 0 end as step, turn, state, valid,
  '{' || concat_ws(',', '"call_id":' || cast(to_json(call_id) as varchar), '"content":' || cast(to_json(content) as varchar), '"name":' || cast(to_json(name) as varchar), '"role":' || cast(to_json(role) as varchar), '"state":"' || state || '"', '"valid":"' || valid || '"') || '}' as message from s""",
    "op7_decontamination": f"""with grams as (select 'd' as side, doc_id as id, {_WORDS.format('text')} as w from documents union all select 'i', item_id, {_WORDS.format('text')} from benchmark),
 sh as (select distinct side, id, array_to_string(list_slice(w, k, k + least(len(w), 5) - 1), ' ') as s from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from grams where len(w) > 0)),
 n as (select id, count(*) as n from sh where side = 'i' group by 1), hit as (select d.id as doc_id, i.id as item_id, count(*) as k from sh d join sh i on d.s = i.s and d.side = 'd' and i.side = 'i' group by all)
 select doc_id, item_id, cast(k as int) as n_shared, cast(n as int) as n_shingles, k / n as containment from hit join n on n.id = item_id where k >= 0.8 * n - 1e-9""",
    "op9_warc": """with d as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages), f as (select *, min(page_id) over (partition by payload_digest) as one from d)
 select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> one then 'revisit' else 'response' end as record_type, case when payload_bytes >= 100 and page_id <> one then one end as refers_to from f""",
    "op10_substring_dedup": f"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents), w as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
 win as (select doc_id, k as i, array_to_string(list_slice(w, k, k + 19), ' ') as s from (select *, unnest(range(1, len(w) - 18)) as k from d where len(w) >= 20)),
 again as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as n from win) where n > 1),
 mark as (select w.doc_id, w.i, word, coalesce(max(a.i) over (partition by w.doc_id order by w.i rows between 19 preceding and current row) is not null, false) as gone from w left join again a on a.doc_id = w.doc_id and a.i = w.i),
 out as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from mark group by 1)
 select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join out using (doc_id)""".replace("select d.doc_id, coalesce", "select doc_id, coalesce"),
    "op11_code_compression": f"""with e as (select * from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 v as materialized (select vec_id, label, (i - 1) // (len(embedding) // 8) as part, (i - 1) % (len(embedding) // 8) as pos, cast(floor(4096 * cast(embedding[i] as double)) as bigint) as x from (select *, unnest(range(1, len(embedding) + 1)) as i from e)),
 b0 as materialized (select part, entry, pos, x as y from v join (select vec_id, row_number() over (order by vec_id) - 1 as entry from e order by vec_id limit 16) using (vec_id)),
 {_rounds(6)}, c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a6 group by 1)
 select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(y, ',' order by part, entry, pos)) from b6) as codebooks_sha256 from c join e using (vec_id)""",
    "op12_line_dedup": """with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
 k as (select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key from l),
 g as (select key, max(doc_id) as top from k where length(key) >= 20 group by 1 having count(distinct doc_id) >= 3), m as (select k.*, coalesce(doc_id <> top, false) as gone from k left join g using (key))
 select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from m group by 1""",
    "op13_lexical_search": r"""with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from documents),
 i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
 p as (select doc_id, w, count(*) as tf from t group by all), n as (select doc_id, cast(sum(tf) as bigint) as n from p group by 1), a as (select count(*) as nn, cast(sum(n) as bigint) as l from n),
 f as (select w, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1))) as bigint) as wt from p cross join a where w in (select w from i) group by w, nn),
 s as (select item_id, doc_id, cast(sum(wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l)))) as bigint) as score from i join f using (w) join p using (w) join n using (doc_id) cross join a group by all),
 r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0) select * from r where rank <= 20""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
