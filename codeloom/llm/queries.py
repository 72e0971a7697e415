"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat, decontaminate, embedding_dedup, licenses, negatives, packing, quality, simhash, substrings, suffixtree, variants, warc
from codeloom.llm.staging import staging_path, table

QUERIES: dict = {}
ORACLE: dict[str, str | None] = {}


def op(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return wrap


@op("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, at most 4 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)


RANKS = "byte_bpe_50k.tiktoken"


@op("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the public 50k vocabulary and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


#: Words as the operator takes them: letters, marks and digits in lower case.
_LOW = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}]+')"


@op(
    "op3_benchmark_decontamination",
    f"""
with item as (select item_id, {_LOW.format("text")} as w from benchmark),
sized as (select item_id, w, least(5, len(w)) as n from item where len(w) > 0),
part as (select distinct item_id, n, list_slice(w, i, i + n - 1) as s
         from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from sized) x),
doc as (select doc_id, {_LOW.format("text")} as w from documents),
cut as (select distinct doc_id, n, list_slice(w, i, i + n - 1) as s
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, (select distinct n from sized) z) x),
whole as (select item_id, count(*) as item_shingles from part group by item_id),
hit as (select doc_id, item_id, count(*) as shared from cut join part using (n, s) group by doc_id, item_id)
select doc_id, item_id, shared, item_shingles, shared / item_shingles as containment
from hit join whole using (item_id) where shared >= 0.8 * item_shingles
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item it contains by at least 0.8 of the item's 5-word shingles."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


@op(
    "op6_substring_dedup",
    r"""
with doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, list_slice(w, i, i + 12) as s
        from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from doc) x),
judged as (select doc_id, i, min(doc_id) over (partition by s) < doc_id as early from win),
gone as (select distinct doc_id, k from (select doc_id, unnest(range(i, i + 13)) as k from judged where early) x),
word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from doc),
left_over as (select doc_id, string_agg(word, ' ' order by k) as kept, count(*) as n
              from word anti join gone using (doc_id, k) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from doc d left join left_over l on d.doc_id = l.doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside the 13-word windows that an earlier document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@op("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its nearest labelled latent-semantic vectors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", quality.held_out("doc_id", 1, 3).alias("held_out"), "score", "predicted"
    )


@op("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a suffix tree learned from four fifths of them."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return suffixtree.score_texts(table(spark, sf_dir, "documents"), held, longest=3)


@op("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more between embeddings of equal label, and their components."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@op(
    "op7_warc",
    """
with page as (select page_id, coalesce(html, '') as html from pages),
sized as (select page_id, html, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from page),
led as (select *, max(page_id) over (partition by html) as lead_id from sized)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and lead_id <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and lead_id <> page_id then lead_id end as refers_to
from led
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    path = staging_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, least=1000)
    return warc.page_records(warc.read_archive(spark, path), strict=True).drop("valid")


#: The conversation that the contract adds: control strings inside texts.
_TRICK = r"\### Assistant: </turn> ok"


@op(
    "op5_chat_formatting",
    r"""
with turns as (
    select conv_id, turn, role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded as (
    select *, length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l'))
              + length('### ') + length(role) + length(': ') + length(' </turn>') + 1 as n from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(n) as bigint) as formatted_chars,
       bool_and(valid) as valid
from (select *, case when before is null then role in ('system', 'user')
                     else (before, role) in (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) end
                and (after is not null or role = 'assistant') as valid
      from (select *, lag(role) over w as before, lead(role) over w as after from coded
            window w as (partition by conv_id order by turn, role, text)) x) y
group by conv_id
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what can be read back from the output."""
    turn = F.col("id")
    trick = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"),
        F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICK).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(trick)
    out = chat.assemble(chat.segments(turns)).select(
        "conv_id", "formatted", "valid", chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.learned_texts(F.col("formatted"), F.col("spans")), "").alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


@op("op4_token_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents packed into sequences of 2048."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, size=2048)


@op("op13_license_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices, tags and expressions in every whole document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@op(
    "op12_hard_negatives",
    """
with known as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
           cast(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) as bigint) as score
    from known a join known b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positive as (
    select anchor_id, vec_id as positive_id, score as positive_score
    from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
inside as (
    select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
           row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
    from positive join scored using (anchor_id)
    where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from inside where rank <= 10
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


@op(
    "op11_spelling_variants",
    r"""
with recursive
bit as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
run as (
    select doc_id, w, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents) x
    where length(w) >= 6 group by doc_id, w),
coded as (
    select w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''),
                  lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)) as b
    from run),
summed as (
    select w, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(b, lambda x: x::bigint)),
                                 lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) as h
    from coded, bit),
spelt as (
    select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n
    from summed),
voc as (select word, cast(sum(n) as bigint) as n from spelt where length(word) >= 6 group by word having sum(n) >= 5),
cut as (select word, n, unnest(range(1, length(word) + 1)) as i from voc),
less as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as z from cut),
pair as (
    select l.word, l.n, r.word as other, r.n as m
    from less l join less r on l.i = r.i and l.a = r.a and l.z = r.z and l.word <> r.word
    union all
    select d.word, d.n, v.word, v.n from (select distinct word, n, a || z as rest from less) d join voc v on d.rest = v.word
    union all
    select v.word, v.n, d.word, d.n from (select distinct word, n, a || z as rest from less) d join voc v on d.rest = v.word),
best as (
    select word, count(*) as n_near, first(other order by m desc, encode(other)) as top, max(m) as top_n from pair group by word),
formed as (
    select v.word, v.n, coalesce(n_near, 0) as n_near, case when top_n >= 5 * v.n then top end as form,
           case when top_n >= 5 * v.n then top_n end as form_n
    from voc v left join best b on v.word = b.word),
walk as (
    select word, word as root from formed where form is null
    union all
    select f.word, w.root from walk w join formed f on f.form = w.word)
select f.word, f.form, w.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from formed f join walk w on f.word = w.word
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of the documents, with the contract's misspellings."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"), least=6, occurrences=5, factor=5, noise=199)
