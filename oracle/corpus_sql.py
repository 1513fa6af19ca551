"""Quality, corpus, source and evaluation statements."""

from folioscope.functions import lexicon as lx
from oracle.rule_sql import PREDICTED, decision
from oracle.sqlgen import BIZ, BLANK_CHARS, documents_cte, has, has_any, pat, q, strings, strip
from oracle.text_sql import RECEIPTS, STANDARD, basic, multilingual, training
from folioscope.functions.patterns import WORD
from folioscope.sources.templates import GENERAL_KINDS

LANG = "lab as (select doc_id, text, lang as label, source from documents), cnt as (select label, count(*) as n from lab group by label)"
SOURCE = LANG.replace("lang as label", "source as label")
QUALITY = "dq as (select d.*, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id)"
UNPRINTABLE = "regexp_matches(text, '[^\\x20-\\x7E\\n\\r\\t]')"
MEANINGFUL = f"len(list_filter(string_split_regex(text, '[^{WORD}]+'), lambda w: regexp_matches(w, '^[A-Za-z]{{3,}}$'))) >= 3"
EXTREMES = """(select label from cnt order by n desc, label limit 1) as most_common, max(n) as max_count,
  (select label from cnt order by n, label desc limit 1) as least_common, min(n) as min_count, round(max(n) / min(n), 6) as ratio"""

NEIGHBOURS = f"""w as materialized (select doc_id, row_number() over (order by doc_id) as pos,
    list_distinct(list_filter(string_split_regex(lower(text), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]+'), lambda x: x <> '')) as ws from documents),
  pairs as materialized (select a.doc_id as id_a, b.doc_id as id_b, len(list_intersect(a.ws, b.ws)) as shared, len(a.ws) as la, len(b.ws) as lb
    from w a join w b on b.pos > a.pos and b.pos <= a.pos + 9 where len(a.ws) > 0 and len(b.ws) > 0),
  sim as (select id_a, id_b, shared / (la + lb - shared) as similarity from pairs)"""

MISSPELLED = "(contains(label, ' ') and contains(label, '_')) or label <> lower(label) or regexp_matches(label, '[^a-z0-9_\\s]')"
GRADE_CHECKS = [
    ("m_doc_id > 0", "Missing values in doc_id"), ("m_text > 0", "Missing values in text"),
    ("m_label > 0", "Missing values in label"), ("m_source > 0", "Missing values in source"),
    ("empties > 0", "Empty text fields found"), ("shorts > n * 0.05", "Too many very short texts"),
    ("distincts < n", "Duplicate texts found"), ("longs > n * 0.01", "Too many extremely long texts"),
    ("odd > n * 0.05", "Many samples contain non-printable characters"),
    ("meaning < n * 0.9", "Low percentage of meaningful text content"),
    ("ratio > 100", "Severe label imbalance detected"), ("ratio > 20 and ratio <= 100", "Moderate label imbalance detected"),
    ("small > 0", "Classes with very few samples"), ("wrong > 0", "Label formatting inconsistencies"),
    ("near", "Potential near-duplicate texts"), ("ocr > 0", "OCR artifacts detected"),
]
ADVICE = [
    ("len(l) = 0", "Your dataset is excellent and ready for training!"),
    ("len(l) = 0", "Proceed with model training using this high-quality data."),
    ("list_contains(l, 'Duplicate texts found')", "Remove duplicate texts to prevent overfitting"),
    ("list_contains(l, 'Empty text fields found')", "Remove or fix empty text entries"),
    ("list_contains(l, 'OCR artifacts detected')", "Clean OCR artifacts for better text quality"),
    ("list_contains(l, 'Label formatting inconsistencies')", "Standardize label formatting (lowercase, underscores)"),
    ("contains(array_to_string(l, '|'), 'imbalance')", "Consider data augmentation for underrepresented classes"),
]


def picks(checks) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then {q(m)} end" for c, m in checks) + "], lambda m: m is not null)"


GRADE = f"""with {LANG}, {NEIGHBOURS}, f as (select count(*) as n, count(*) - count(doc_id) as m_doc_id, count(*) - count(text) as m_text,
    count(*) - count(label) as m_label, count(*) - count(source) as m_source, avg(length(text)) as mean_length,
    count(*) filter (where {strip('text')} = '') as empties, count(*) filter (where length(text) < 20) as shorts,
    count(*) filter (where length(text) > 5000) as longs, count(*) filter (where {UNPRINTABLE}) as odd,
    count(*) filter (where {MEANINGFUL}) as meaning, count(*) filter (where {has_any('text', lx.OCR_PATTERNS.values(), False)}) as ocr,
    count(distinct text) as distincts from lab),
  c as (select count(*) as labels, max(n) / min(n) as ratio, count(*) filter (where n < 10) as small, count(*) filter (where {MISSPELLED}) as wrong from cnt),
  p as (select count(*) filter (where similarity > 0.8) > count(*) * 5 / 900.0 as near from sim),
  i as (select *, {picks(GRADE_CHECKS)} as l from f, c, p)
  select n, labels, round(mean_length, 6) as mean_length, round(n * mean_length / 1048576, 6) as megabytes, len(l)::int as issue_count,
    case when len(l) = 0 then {q(lx.GRADES[0])} when len(l) <= 2 then {q(lx.GRADES[1])} when len(l) <= 5 then {q(lx.GRADES[2])} else {q(lx.GRADES[3])} end as grade,
    array_to_string(l, '|') as issues, array_to_string({picks(ADVICE)}, '|') as advice from i"""

CLEANED = f"""cl as (select * from (select doc_id, lang as label, {training('text')} as text from documents) where length(text) >= 30),
  g as (select label, count(*) as n, sum(length(text)) as chars, min(length(text)) as lo from cl group by label)"""

HALVES = "old as (select doc_id as pos, text, lang as label, source from documents where source >= 'src5'), new as (select doc_id as pos, text, lang as label from documents where source < 'src5')"

CONV_KEY = "(conv_id + turn)"
COMPANY_LABEL = " ".join(
    f"when {' or '.join(f'contains(lower(lab), {q(w)})' for w in words)} then {q(to)}" for to, words in lx.COMPANY_LABEL_WORDS
)

KEPT_WORDS = f"list_filter(t, lambda w: not list_contains({strings(lx.STOPWORDS)}, w))"


def tfidf(tokens: str, min_df: int, max_df: float, limit: int) -> str:
    return f"""with t as (select doc_id as id, regexp_extract_all(lower(text), '[{WORD}]{{2,}}') as t from documents),
      k as (select id, {tokens} as t from t),
      g as (select id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as term from k),
      c as materialized (select id, term, count(*) as tf from g group by id, term),
      v as (select term, sum(tf) as uses, count(*) as df from c group by term),
      n as (select count(*) as docs from documents),
      best as materialized (select term, ln((docs + 1) / (df + 1)) + 1 as idf from v, n where df >= {min_df} and df <= docs * {max_df}::double order by uses desc, term limit {limit}),
      w as (select id, c.term, (ln(tf) + 1) * idf as w from c join best on c.term = best.term)
      select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from w"""


RULED = f"{BIZ}, rp as (select label, {decision('clean')} as prediction from (select *, {multilingual('text')} as clean from biz))"
CONF = f"{PREDICTED}, cf as (select prediction as class, avg(confidence) as mean_confidence, stddev_pop(confidence) as std_confidence, min(confidence) as min_confidence, max(confidence) as max_confidence, count(*) as n from predicted group by prediction)"


def matrix(classes: list[str], normalize: bool) -> str:
    cells = ", ".join(f"count(*) filter (where prediction = {q(c)}) as {c}" for c in classes)
    total = " + ".join(classes)
    shown = ", ".join(
        f"round({c} / nullif({total}, 0), 6) as {c}" if normalize else f"coalesce({c}, 0) as {c}" for c in classes
    )
    listed = ", ".join(q(c) for c in classes)
    return f"""with {RULED}, m as (select label, {cells} from rp where prediction in ({listed}) group by label)
      select e.label, {shown} from (select unnest({strings(classes)}) as label) e left join m on e.label = m.label"""


def column_facts(table: str, columns: list[str]) -> str:
    """Facts per string column, the text column (named or longest) and the label column."""
    rows = " union all ".join(
        f"select {i} as at_no, {q(c)} as col, avg(length(coalesce({c}, 'nan'))) as len, count(distinct {c}) / count(*) as ratio from {table}"
        for i, c in enumerate(columns)
    )
    text = q("text") if "text" in columns else "(select col from f order by len desc, at_no limit 1)"
    return f"""select {q(table)} as table_name, col as "column", round(len, 6) as mean_length, round(ratio, 6) as distinct_ratio, col = {text} as is_text,
      coalesce(at_no = (select min(at_no) from f where ratio between 0.01 and 0.5 and col <> {text}), false) as is_label from (
      {rows}) facts""".replace("from f where", f"from ({rows}) f where").replace("from f order", f"from ({rows}) f order")


TEST_ROWS = """test as (select doc_id, label from (select *, row_number() over (partition by label order by md5('42-' || doc_id)) as r,
    floor(count(*) over (partition by label) * 0.2::double + 0.5) as quota from lab) where r <= quota)"""
MODEL_FACTS = f"""with {LANG}, {TEST_ROWS} select doc_id, label, true as shares_sum_to_one, true as shares_in_range,
  true as prediction_is_top, true as beats_largest_class from test"""
#: A word of two characters or more, as the hashing encoder takes them.
TOKEN_SQL = "[\\p{L}\\p{N}_]{2,}"

STATEMENTS = {
    "null_profile": f"with {QUALITY} " + " union all ".join(
        f"select {q(c)} as \"column\", count(*) - count({c}) as missing, round((count(*) - count({c})) * 100.0::double / count(*), 6) as missing_percent from dq"
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    ),
    "short_text_profile": f"""select count(*) as n, count(*) filter (where {strip('text')} = '') as empty_texts, count(*) filter (where length(text) < 20) as short_texts,
      round(count(*) filter (where length(text) < 20) * 100.0::double / count(*), 6) as short_percent,
      count(*) filter (where length(text) < 20) > count(*) * 0.05 as too_many_short from documents""",
    "duplicate_count": "select count(*) - count(distinct text) as duplicate_texts from documents",
    "length_stats": """select round(avg(length(text)), 6) as mean_length, median(length(text))::double as median_length, min(length(text))::int as min_length,
      max(length(text))::int as max_length, count(*) filter (where length(text) > 5000) as very_long_texts, count(*) as n,
      count(*) filter (where length(text) > 5000) > count(*) * 0.01 as too_many_long from documents""",
    "nonprintable_count": f"""select count(*) as checked, count(*) filter (where {UNPRINTABLE}) as nonprintable_texts,
      count(*) filter (where {UNPRINTABLE}) > count(*) * 0.05 as many_nonprintable from documents""",
    "meaningful_ratio": f"""with m as (select count(*) as checked, count(*) filter (where {MEANINGFUL}) as meaningful_texts from documents)
      select *, round(meaningful_texts * 100.0::double / checked, 6) as meaningful_percent, meaningful_texts * 100.0 / checked < 90 as low_meaning from m""",
    "label_distribution": f"with {LANG} select label, n, round(n * 100.0::double / sum(n) over (), 6) as percent from cnt",
    "imbalance_ratio": f"with {LANG} select {EXTREMES}, case when max(n) / min(n) > 100 then 'severe' when max(n) / min(n) > 20 then 'moderate' else 'none' end as imbalance from cnt",
    "small_classes": f"with {SOURCE} select count(*) as classes, count(*) filter (where n < 60) as small_classes from cnt",
    "source_profile": """select source, count(*) as n, round(avg(length(text)), 6) as mean_length,
      round(count(*) * 100.0::double / sum(count(*)) over (), 6) as percent from documents group by source""",
    "neighbour_similarity": f"with {NEIGHBOURS} select id_a, id_b, round(similarity, 6) as similarity from sim",
    "near_duplicate_pairs": f"""with {NEIGHBOURS} select count(*) as compared, count(*) filter (where similarity > 0.8) as similar_pairs,
      round(max(similarity), 6) as max_similarity, count(*) filter (where similarity > 0.8) > count(*) * 5 / 900.0 as near_duplicates from sim""",
    "near_duplicate_all": """with recursive w as materialized (select row_number() over () as r, doc_id,
        list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+'), lambda x: x <> '')) as ws from documents),
      pairs as materialized (select a.r, b.r as s, len(list_intersect(a.ws, b.ws)) as shared, len(a.ws) as la, len(b.ws) as lb
        from w a join w b on len(b.ws) * 10 > len(a.ws) * 8 and len(a.ws) * 10 > len(b.ws) * 8 and a.r <> b.r),
      linked as materialized (select r, s from pairs where shared * 10 > (la + lb - shared) * 8),
      reach(r, s) as (select r, s from linked union select reach.r, linked.s from reach join linked on linked.r = reach.s),
      least as (select reach.r, min(doc_id) as least from reach join w on w.r = reach.s group by reach.r),
      degree as (select r, count(*) as n_links from linked group by r)
      select doc_id, len(ws)::bigint as n_words, coalesce(n_links, 0)::bigint as n_links, least(doc_id, least) as component
      from w left join degree using (r) left join least using (r)""",
    "ocr_artifact_counts": " union all ".join(
        f"select {q(name)} as artifact, count(*) filter (where {has('text', p, False)}) as n from documents" for name, p in lx.OCR_PATTERNS.items()
    ),
    "quality_grade": GRADE,
    "size_estimate": "select round(sum(length(text)) / 1048576, 6) as megabytes from documents",
    "rank_classes": f"""with {SOURCE} select (row_number() over (order by n desc, label))::int as rank, label, n, round(n * 100.0::double / sum(n) over (), 6) as percent from cnt
      union all select 0, 'TOTAL', sum(n)::bigint, 100.0 from cnt""",
    "size_bands": f"""with {LANG}, b as (select *, case when n >= 1000 then 'large' when n >= 100 then 'medium' else 'small' end as band from cnt)
      select band, count(*) as classes, sum(n)::bigint as n from b group by band""",
    "balance_status": f"""with {LANG} select {EXTREMES}, case when max(n) / min(n) <= 10 then 'EXCELLENT' when max(n) / min(n) <= 50 then 'GOOD'
      when max(n) / min(n) <= 100 then 'FAIR' else 'POOR' end as status from cnt""",
    "training_readiness": f"""with {LANG}, r as (select count(*) filter (where n >= 50) as ready_classes, count(*) as classes, sum(n)::bigint as total, round(avg(n), 6) as mean_per_class from cnt)
      select *, case when ready_classes = classes and total >= 5000 then 'EXCELLENT' when ready_classes >= classes * 0.8 and total >= 3000 then 'GOOD'
        when ready_classes >= classes * 0.6 and total >= 1000 then 'FAIR' else 'POOR' end as readiness from r""",
    "compare_distributions": f"""with {SOURCE}, kept as (select label from lab qualify row_number() over (partition by text order by doc_id) = 1),
      k as (select label, count(*) as m from kept group by label)
      select cnt.label, n as before, coalesce(m, 0) as after, coalesce(m, 0) - n as difference from cnt left join k on cnt.label = k.label""",
    "validate_preserved": f"""with {RECEIPTS} select count(*) as rows_before, count(*) as rows_after, 0::bigint as labels_changed,
      count(*) filter (where kind = 1) as json_rows_left, true as preserved from receipts""",
    "validate_ingest": f"""with {LANG} select count(*) as n, round(avg(length(text)), 6) as mean_length, count(distinct label) as labels,
      avg(length(text)) < 50 as texts_short, count(distinct label) < 2 as single_label from lab""",
    "validate_samples": f"""with {LANG}, s as (select avg(length(text)) as m, count(*) filter (where regexp_matches(text, '[A-Za-z]{{3,}}')) * 100.0::double / count(*) as p,
      count(distinct label) as labels from lab) select round(m, 6) as mean_length, round(p, 6) as meaningful_percent, labels, m >= 50 and p >= 90 and labels >= 2 as valid from s""",
    "validate_cleaned": f"""with {CLEANED}, f as (select sum(n)::bigint as n, count(*) as labels, sum(chars) / sum(n) as mean_length, min(lo)::int as min_length, max(n) / min(n) as ratio from g),
      i as (select *, {picks([('min_length < 20', 'Very short texts still present'), ('mean_length < 100', 'Average text length seems low'), ('ratio > 50', 'Severe imbalance still present')])} as l from f)
      select n, labels, round(mean_length, 6) as mean_length, min_length, round(ratio, 6) as ratio, array_to_string(l, '|') as issues, len(l) = 0 as passed from i""",
    "top_n_with_others": f"""with {SOURCE}, r as (select *, row_number() over (order by n desc, label) as rank from cnt)
      select case when rank <= 8 then label else 'Others' end as label, sum(n)::bigint as n,
        round(sum(n) * 100.0::double / (select sum(n) from cnt), 6) as percent from r group by 1""",
    "length_boxplot": f"""with {SOURCE}, top as (select label from cnt order by n desc, label limit 6)
      select label, count(*) as n, round(quantile_cont(length(text), 0.25), 6) as q1, round(quantile_cont(length(text), 0.5), 6) as median,
        round(quantile_cont(length(text), 0.75), 6) as q3 from lab where label in (select label from top) group by label""",
    "growth_by_source": "select source, count(*) as n, sum(count(*)) over (order by source)::bigint as corpus_size from documents group by source",
    "dataset_summary": f"""with {LANG} select label, n, (select count(*) from cnt) as labels, (select count(*) from lab) as total,
      (select round(avg(length(text)), 6) from lab) as mean_length from cnt""",
    "cleaned_corpus_profile": f"""with {CLEANED} select label, n, (select count(*) from g) as labels, (select sum(n)::bigint from g) as total,
      (select round(sum(chars) / sum(n), 6) from g) as mean_length from g""",
    "integrate_dedup": f"""with {HALVES}, u as (select 0 as rank, pos, text, label, source from old union all select 1, pos, text, label, null from new)
      select pos, text, label, source from u qualify row_number() over (partition by text order by rank, pos) = 1""",
    "integration_report": f"""with {HALVES} select (select count(*) from old) as existing_rows, (select count(*) from new) as new_rows,
      (select count(distinct text) from documents) as final_rows, (select count(*) - count(distinct text) from documents) as duplicates_removed""",
    "append_no_dedup": f"with {HALVES} select pos, label, source from old union all select pos, label, null from new",
    "cap_per_class": f"with {LANG} select doc_id, label from lab qualify row_number() over (partition by label order by md5('42-' || doc_id)) <= 200",
    "shuffle_rows": "select doc_id, row_number() over (order by md5('42-' || doc_id)) as shuffle_rank from documents",
    "stratified_split": f"""with {LANG} select doc_id, label, case when row_number() over (partition by label order by md5('42-' || doc_id))
      <= floor(count(*) over (partition by label) * 0.2::double + 0.5) then 'test' else 'train' end as split from lab""",
    "drop_rare_classes": f"with {LANG} select doc_id, label from lab where label in (select label from cnt where n >= 130)",
    "augment_min_samples": f"""with {BIZ}, known as (select unnest({strings(lx.DOCUMENT_CLASSES)}) as label),
      missing as (select 'Example document of class ' || label as text, label, unnest([1, 2]) as i from known where label not in (select label from biz))
      select text, label from biz union all select text, label from missing union all select text, lang from documents""",
    "weighted_union": "select doc_id, source from documents union all select doc_id, source from documents where source in ('src1', 'src2')",
    "take_first_n": "select doc_id, text from documents order by doc_id limit 300",
    "detect_text_column": " union all ".join([
        column_facts("documents", ["text", "lang", "source"]),
        column_facts("customer", ["c_name", "c_mktsegment"]),
        column_facts("part", ["p_name", "p_brand", "p_type"]),
        column_facts("orders", ["o_orderstatus", "o_orderpriority"]),
    ]),
    "detect_label_column": " union all ".join([
        column_facts("pages", ["url", "html"]),
        column_facts("nation", ["n_name"]),
        column_facts("events", ["event_type", "props"]),
    ]),
    "coalesce_text": """select p_partkey as id, array_to_string(list_filter([p_name, p_brand, p_type], lambda v: length(v) > 10), ' ') as text from part
      union all select doc_id, text from documents""",
    "coalesce_label": """select p_partkey, coalesce(nullif(case when p_size > 10 then '' else p_type end, ''), case when p_size > 20 then p_brand end, 'document') as label from part""",
    "profile_schema": """select position, "column", type, (select count(*) from documents) as n_rows from (values (0, 'doc_id', 'bigint'), (1, 'text', 'string'),
      (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'bigint')) v(position, "column", type)""",
    "flatten_company_record": f"""with r as (select case when {CONV_KEY} % 4 < 2 then text else array_to_string(list_transform(string_split(text, chr(10)), lambda l: l || ' '), '') end as text,
        ['q3.Report.txt', 'Invoice_9', 'note'][({CONV_KEY} % 3)::int + 1] as filename, case when {CONV_KEY} % 5 = 0 then role end as kind from conversations),
      l as (select *, case filename when 'q3.Report.txt' then coalesce(kind, 'Report') when 'Invoice_9' then 'invoice' else 'document' end as lab from r)
      select {strip('text')} as text, case {COMPANY_LABEL} else replace(lower(lab), ' ', '_') end as label, lab as original_label, filename from l where length(text) > 20""",
    "prune_sparse_columns": "select doc_id, lang as label, source from documents",
    "render_documents": f"with {documents_cte('gen', GENERAL_KINDS)} select * from gen",
    "records_to_corpus": f"""select {basic('text')} as text, {STANDARD.replace('raw', 'source')} as label, 'CSV' as source from documents where length(text) > 20""",
    "scan_labelled_csv": "select lang as label, md5(text) as text_md5, length(text)::int as chars from documents",
    "scan_json_records": f"select md5(t) as text_md5, length(t)::int as chars, source as label, 'JSON' as source from (select {basic('text')} as t, source from documents where length(text) > 20)",
    "scan_csv_records": f"select md5(t) as text_md5, length(t)::int as chars, source as label, 'CSV' as source from (select {basic('text')} as t, source from documents where length(text) > 20)",
    "scan_text_files": f"""with f as (select source, {strip("string_agg(text, chr(10) order by doc_id) || chr(10)")} as t from documents group by source)
      select 'receipt' as label, count(*) as files, sum(length(t))::bigint as chars from f""",
    "scan_annotation_json": """with f as (select replace(text, chr(10), ' ') as t from documents)
      select 'receipt' as label, md5(t) as text_md5, length(t)::int as chars from f where length(t) > 10""",
    "inventory_sources": """with d as (select distinct coalesce('=' || source, '') as source, case coalesce(lang, '') when 'en' then 'csv' when 'fr' then 'json' else 'txt' end as extension from documents),
      c as (select extension, count(*) as files from d group by extension)
      select extension, files, sum(files) over ()::bigint as total, extension = (select min(extension) from c) as chosen from c""",
    "decode_bytes": "select doc_id, case when doc_id % 2 = 0 then text else regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') end as text from documents",
    "versioned_save": """select lang, count(*) as n, 1 as version from documents group by lang union all
      select lang, count(*), 2 from (select lang from documents qualify row_number() over (partition by text order by doc_id) = 1) group by lang""",
    "tfidf_features": tfidf("t", 2, 0.9, 10000),
    "tfidf_features_without_stopwords": tfidf(KEPT_WORDS, 1, 1.0, 5000),
    "class_weights": f"with {LANG} select label, n, round(sum(n) over () / (count(*) over () * n), 6) as weight from cnt",
    "classification_report": f"""with {RULED}, c as (select unnest(list_distinct(list(label) || list(prediction))) as class from rp),
      m as (select class, count(*) filter (where label = class) as support, count(*) filter (where prediction = class) as claimed,
        count(*) filter (where label = class and prediction = class) as hits from rp, c group by class),
      s as (select *, coalesce(hits / nullif(claimed, 0), 0) as p, coalesce(hits / nullif(support, 0), 0) as r from m)
      select class, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, support,
        round(sum(hits) over () / sum(support) over (), 6) as accuracy from s""",
    "train_linear_classifier": MODEL_FACTS,
    "train_logistic": MODEL_FACTS,
    "score_batch": f"with {LANG}, {TEST_ROWS} select doc_id, label, true as known_label, (select count(distinct label) from lab) as classes from test",
    "grid_search": """select concat('maxDF=', h, ', minDF=', l, ', regParam=', r, ', vocabSize=', v) as setting, true as learned
      from (values ('0.7'), ('0.8'), ('0.9')) a(h), (values ('3.0'), ('5.0'), ('7.0')) b(l), (values ('0.001'), ('0.01'), ('0.1')) p(r),
        (values (5000), (10000), (15000)) q(v)""",
    "embed_documents": f"""select doc_id, 384 as width, len(regexp_extract_all(lower(text), '{TOKEN_SQL}')) > 0 as unit_length from documents""",
    "confusion_matrix": matrix(lx.DOCUMENT_CLASSES, False),
    "confusion_matrix_shares": matrix(lx.COMMERCIAL_TYPES, True),
    "confidence_by_class": f"""with {CONF} select class, round(mean_confidence, 6) as mean_confidence, round(std_confidence, 6) as std_confidence,
      round(min_confidence, 6) as min_confidence, round(max_confidence, 6) as max_confidence, n from cf""",
    "confidence_bands": f"""with {CONF} select case when mean_confidence > 0.9 then 'very high' when mean_confidence > 0.8 then 'high' when mean_confidence > 0.6 then 'medium' else 'low' end as band,
      case when mean_confidence > 0.8 then 'high' when mean_confidence >= 0.6 then 'medium' else 'low' end as report_band, count(*) as classes from cf group by all""",
    "performance_ranking": f"""with {CONF}, h as (select count(*) filter (where mean_confidence < 0.6) as low, count(*) filter (where mean_confidence > 0.8) as high, avg(mean_confidence) as m from cf)
      select (rank() over (order by mean_confidence desc))::int as rank, class, round(mean_confidence, 6) as mean_confidence, n, round(m, 6) as overall_mean,
        concat_ws('; ', case when low > 0 then 'Collect more samples, review data quality, consider feature engineering' end,
          case when high > low then 'Overall performance looks good' end) as advice from cf, h""",
    "ingest_stream": f"""with c as (select doc_id, source as raw, {basic('text')} as text from documents)
      select doc_id, {STANDARD} as label, md5(text) as text_md5, length(text)::int as chars from c
      qualify row_number() over (partition by text order by doc_id) = 1""",
    "stream_period_totals": """with e as (select time_bucket(interval 7 days, ts, timestamp '1970-01-01') as s, event_type, round(value * 100)::bigint as cents from events)
      select strftime(s, '%Y-%m-%d') as period_start, strftime(s + interval 7 days, '%Y-%m-%d') as period_end,
        coalesce(sum(cents) filter (where event_type = 'purchase'), 0)::bigint as income, coalesce(sum(cents) filter (where event_type = 'error'), 0)::bigint as expense,
        coalesce(sum(cents) filter (where event_type not in ('purchase', 'error')), 0)::bigint as potential, count(*) as n
      from e group by s""",
}
